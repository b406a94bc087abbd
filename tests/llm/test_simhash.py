import numpy as np
import pytest
import xxhash

from hedgerow.llm import simhash


def brute(rows, distance=4, words=4):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()], key=repr)


def sample():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(60):
        base = list(rng.choice(vocab, 120))
        rows.append((d * 10, " ".join(base)))
        for c in range(3):
            near = list(base)
            near[int(rng.integers(120))] = "Changed"
            rows.append((d * 10 + 1 + c, "\n".join(near)))
    return rows + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one two"), (9003, "one two"), (None, "one two"), (None, "null id alone x y z"), (9004, "A b C d " * 5000)]


def test_matches_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, root int")
    assert result(simhash.near_duplicates(docs)) == brute(rows)


def test_heavy_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rows = [(i, f"alpha beta {'gamma ' * 40} {i}") for i in range(40)] + sample()[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(simhash.near_duplicates(docs)) == brute(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_any_close_pair_shares_a_key(blocks):
    rng = np.random.default_rng(1)
    chosen = [m & (1 << 64) - 1 for m in simhash.masks(4, blocks)]
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in chosen)


def test_majority_of_long_runs():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    got = simhash.majority(h, np.array([0, 1000, 1001, 3000]))
    for k, (i, j) in enumerate([(0, 0), (0, 1000), (1000, 1001), (1001, 3000)]):
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i:j]) > j - i)
        assert int(got[k]) == want
