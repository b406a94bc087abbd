import numpy as np
import pytest

from hedgerow.llm import similar, simhash


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, min(ids) if ids else None))
    return sorted(out, key=repr)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def changed(words, n, rng):
    """The words with n of them changed, far enough apart that each changes five shingles."""
    out = list(words)
    for i in rng.choice(np.arange(5, len(out) - 10, 6), n, replace=False):
        out[i] = f"changed{int(rng.integers(10**9))}"
    return out


def planted():
    """Texts of 204 words (200 shingles), each with a copy of 4 changed words (180 of 220: 0.82) and one of 6 (170 of 230: 0.74)."""
    rng = np.random.default_rng(8)
    rows = []
    for d in range(40):
        base = [f"w{int(x)}" for x in rng.integers(0, 5000, 204)]
        rows += [(10 * d, " ".join(base)), (10 * d + 1, "\n".join(changed(base, 4, rng))), (10 * d + 2, " ".join(changed(base, 6, rng)))]
    return rows


def test_planted_near_copies_go_and_others_stay(spark):
    import corpus_pipeline as p

    rows = planted()
    prints = lambda k: [int(simhash.majority(np.array(h, np.uint64), np.array([len(h)]))[0]) for h in (simhash.shingle_hashes(t, 4) for d, t in rows if d % 10 == k)]
    far = [(a ^ b).bit_count() for a, b in zip(prints(0), prints(1), strict=True)]
    assert sum(x > 4 for x in far) > 20
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in p.one_of_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(d for d, _ in rows if d % 10 != 1)


@pytest.mark.parametrize("most", [similar.SHINGLES, 900])
def test_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(similar, "SHINGLES", most)
    rng = np.random.default_rng(9)
    rows, base = planted()[:30], [f"v{i}" for i in range(120)]
    rows += [(1000 + i, " ".join(changed(base, int(rng.integers(0, 4)), rng))) for i in range(60)]
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9003, "one two"), (None, "ONE two"), (None, "null id alone x y z"), (9004, "A b C d " * 500)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, id string, row int")
    assert result(similar.near_copies(docs).select("doc_id", "component_id")) == brute(rows)


def test_labels_with_known_links_equal_those_of_all_pairs():
    rng = np.random.default_rng(10)
    base = [f"v{i}" for i in range(100)]
    sets = [similar.shingle_set(" ".join(changed(base, int(rng.integers(0, 6)), rng)), 5) for _ in range(80)]
    sets += [similar.shingle_set(" ".join(rng.choice(base, 60)), 5) for _ in range(30)]
    share = similar.Fraction("0.8")
    near = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    for known in (None, [i // 3 for i in range(110)], [0] * 70 + list(range(1, 41))):
        want = list(range(110)) if known is None else list(known)
        want = [f"k{x}" for x in want]
        for i in range(110):
            for j in range(i):
                if want[i] != want[j] and near(sets[i], sets[j]):
                    old, new = want[i], want[j]
                    want = [new if x == old else x for x in want]
        got = similar.linked(sets, share, known).tolist()
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_one_row_of_repeated_rows_stays(spark):
    import corpus_pipeline as p

    rows = [(1, "a b c d e f g", "en", "x", 13), (1, "a b c d e f g", "de", "x", 13), (1, "other words in this text here", "en", "x", 9), (2, "a b c d e f g", "en", "x", 13), (3, "a single one of its kind", None, None, None), (None, "a b c d e f g", "en", "x", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in p.one_of_near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([rows[1], rows[2], rows[4], rows[5]], key=repr)


def test_empty(spark):
    assert similar.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fingerprints_alone_link_what_blocks_guarantee(spark, monkeypatch):
    monkeypatch.setattr(similar, "keys", lambda shingles: np.empty(0, np.int64))
    rng = np.random.default_rng(11)
    bases = [[f"w{int(x)}" for x in rng.integers(0, 5000, 204)] for _ in range(30)]
    rows = [(10 * d + k, " ".join(changed(base, k, rng))) for d, base in enumerate(bases) for k in range(3)]
    rows += [(1000, "a b c d e f g h i j k"), (1001, "a b c d e f g h i j k " * 2)]
    sets = {d: similar.shingle_set(t, 5) for d, t in rows}
    prints = {d: int(simhash.majority(s, np.array([len(s)]))[0]) for d, s in sets.items()}
    near = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
    sure = [(a, b) for a in sets for b in sets if a < b and near(a, b) and (prints[a] ^ prints[b]).bit_count() <= similar.DISTANCE]
    got = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(sure) > 30 and all(got[a] == got[b] for a, b in sure)
    assert all(got[d] // 10 == d // 10 for d, _ in rows if d < 1000) and (got[1000], got[1001]) == (1000, 1001)


def test_fingerprints_that_meet_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 50)
    rng = np.random.default_rng(12)
    fps = rng.integers(-(2**63), 2**63 - 1, 60)
    flips = [sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 7)), replace=False)) for _ in range(140)]
    fps = np.concatenate([fps, fps[rng.integers(0, 3, 140)] ^ np.array(flips, np.int64)])
    groups = {}
    for r in simhash.met(spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps)], "id long, fp long"), 6, 12).collect():
        groups.setdefault(r.key, set()).add(r.id)
    together = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    bits = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :])
    assert {(a, b) for a in range(200) for b in range(a + 1, 200) if bits[a, b] <= 6} <= together
    assert all(len(g) > 1 and all(any(bits[a, b] <= 12 for b in g - {a}) for a in g) for g in groups.values())
