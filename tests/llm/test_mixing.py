import hashlib

import numpy as np

from hedgerow.llm import mixing


def brute(rows):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    total = sum(size)
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, (*_, x) in zip(size, rows, strict=True) if x == s) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), mixing.SHARE * total
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * own[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * own[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for s in names:
        whole = int(target[s] // own[s]) if own[s] else 0
        rest, run = target[s] - whole * own[s], 0
        place = lambda i: int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:12], 16)  # noqa: E731, S324
        mine = [(place(i), n, i) for n, (i, _, x) in zip(size, rows, strict=True) if x == s]
        extra = {}
        for p in sorted({p for p, *_ in mine}):
            n = sum(n for q, n, _ in mine if q == p)
            extra[p] = run + n / 2 <= rest
            run += n
        out += [(i, n, own[s], round(target[s], 6), n * (whole + extra[p])) for p, n, i in mine]
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "w " * int(rng.integers(0, 40)), ["a", "b", "é", "Z", None, "big"][int(min(5, rng.integers(0, 9)))]) for i in range(700)]
    rows += [(700, None, "none"), (701, "\t\n", "none"), (702, " x\ty ", "tiny"), (702, " x\ty ", "tiny"), (None, "a b c", "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, copies int")
    found = mixing.mix(docs)
    got = sorted([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in found.collect()], key=repr)
    assert got == brute(rows)
    by = {}
    for _, n, own, target, taken in got:
        by.setdefault((own, target), []).append((n, taken))
    for (own, target), x in by.items():
        assert target <= 2 * own + 1e-9 and abs(sum(t for _, t in x) - target) <= max(n for n, _ in x) and all(t <= 2 * n for n, t in x)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []


def test_empty_texts_in_a_capped_source_are_not_taken_thrice(spark):
    rows = [(i, "w " * (i % 3), "a") for i in range(30)] + [(100 + i, "w " * 50, "b") for i in range(30)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.copies for r in found if r.source == "a"} == {2} and max(r.copies for r in found) <= 2
