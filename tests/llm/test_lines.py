import numpy as np

from hedgerow.llm import lines


def brute(rows, run, words, passages):
    """Every window of lines against all others, by plain dictionaries."""
    docs = {(d, t or "") for d, t in rows}
    order = lambda k: (k[0] is not None, k[0] or 0)
    seen, gone = {}, {}
    for d, t in sorted(docs, key=order):
        full = [(i, x.strip(" \t\r")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
        units = [full[s : s + run] for s in range(len(full) - run + 1)] + [[x] for x in full if len(x[1].split()) >= words]
        if passages:
            pieces = [full[s : s + n] for n in range(2, run) for s in range(len(full) - n + 1)]
            units += [u for u in pieces if sum(len(x.split()) for _, x in u) >= words]
        for u in units:
            key, at = tuple(x for _, x in u), (d, t, u[0][0])
            if seen.setdefault(key, at) != at:
                gone.setdefault((d, t), set()).update(i for i, _ in u)
    out = []
    for d, t in rows:
        cut = gone.get((d, t or ""), set())
        ls = (t or "").split("\n")
        out.append((d, len(ls), len(cut), "\n".join(x for i, x in enumerate(ls) if i not in cut)))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_lines", "n_removed", "kept").collect()], key=repr)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(120):
        rows.append((d, "\n".join(f"line {int(x)}" if x else " " for x in rng.integers(0, 25, int(rng.integers(0, 30))))))
    long = " ".join(f"w{i}" for i in range(12))
    rows += [(500, f"start\n{long}\nend"), (501, f"{long}\r"), (502, None), (503, ""), (504, "a\na\na\na\na\na"), (505, rows[3][1]), (505, rows[3][1]), (None, rows[4][1]), (506, "x\n" * 4000)]
    docs = spark.createDataFrame([(d, t, "r", "k", 9) for d, t in rows], "doc_id long, text string, run string, kept string, row int")
    assert got(lines.dedup_lines(docs, run=3, words=10, passages=False)) == brute(rows, 3, 10, False)
    for run, words in ((3, 10), (3, 4), (4, 6), (1, 10)):
        assert got(lines.dedup_lines(docs, run=run, words=words)) == brute(rows, run, words, True)


def test_other_columns_stay_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, hash int")
    out = lines.dedup_lines(docs)
    assert out.collect() == [] and out.columns == ["doc_id", "text", "hash", "kept", "n_lines", "n_removed"]


def test_equal_runs_select_equal_lines():
    rng = np.random.default_rng(6)
    hashes = [bytes([int(x)]) for x in rng.integers(0, 5, 400)]
    for run in (1, 2, 3, 5):
        picked = {s: i for i, starts in lines.selected(hashes, run).items() for s in starts}
        assert len(picked) == len(hashes) - run + 1
        where = {}
        for s, i in picked.items():
            assert s <= i < s + run
            assert where.setdefault(tuple(hashes[s : s + run]), i - s) == i - s


def test_passages_of_two_lines_between_differing_neighbours(spark):
    import corpus_pipeline as p

    part = lambda n, k: " ".join(f"{n}{i}" for i in range(k))
    two, uneven, short = f"{part('a', 47)}\n{part('b', 38)}", f"{part('c', 60)}\n{part('d', 5)}", f"{part('e', 24)}\n{part('f', 25)}"
    rows = [(d, f"before {d}\n{x}\nafter {d}") for i, x in enumerate((two, uneven, short)) for d in (2 * i, 2 * i + 1)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = dict(rows) | {1: "before 1\nafter 1", 3: "before 3\nafter 3"}
    assert {r.doc_id: r.text for r in p.repeated_lines_out(spark, docs, "").collect()} == want
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(docs, passages=False).collect() if r.n_removed} == {3: 1}
