from collections import Counter

import numpy as np

from hedgerow.llm import substrings
from hedgerow.llm.common import written


def brute(rows, length):
    words = [[w for w in (t or "").encode().split()] for _, t in rows]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(length)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def sample():
    rng = np.random.default_rng(8)
    vocab = [f"wörd{i}" for i in range(400)]
    passages = [list(rng.choice(vocab, n)) for n in (3, 5, 6, 7, 8, 20, 60)]
    rows = []
    for d in range(150):
        w = list(rng.choice(vocab, int(rng.integers(0, 60))))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passages[int(rng.integers(len(passages)))]
        rows.append((d, " \n".join(w)))
    return rows + [(900, None), (901, ""), (902, " \t "), (903, rows[5][1]), (903, rows[5][1]), (None, rows[6][1]), (904, "a b " * 3000), (905, "short text")]


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_matches_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, k1 int, copies int")
    for length in (6, 7, 17, 35):
        assert got(substrings.remove_repeats(docs, length)) == brute(rows, length)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_end(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = substrings.texts_of(docs)
    different = {t or "" for _, t in rows}
    length, level = 6, written(substrings.repeated_windows(texts, 6), "level")
    while True:
        count = Counter(tuple(t.split()[i : i + length]) for t in different for i in range(len(t.split()) - length + 1))
        assert level.count() == sum(n for n in count.values() if n > 1)
        if level.isEmpty():
            break
        level, length = written(substrings.longer(level, length), "level"), 2 * length
    assert length > 48


def test_lengthen_ends_by_emptiness(spark):
    rows = sample()
    texts = written(substrings.texts_of(spark.createDataFrame(rows, "doc_id long, text string")), "texts")
    found = Counter(r["length"] for r in substrings.lengthen(substrings.repeated_windows(texts, 6), 6).collect())
    different = {t or "" for _, t in rows}
    for length in (6, 12, 24, 48, 3072):
        count = Counter(tuple(t.split()[i : i + length]) for t in different for i in range(len(t.split()) - length + 1))
        assert found[length] == sum(n for n in count.values() if n > 1)


def test_chain_and_stand_ins():
    assert substrings.chain(35) == [9, 18, 35] and substrings.chain(6) == [6] and substrings.chain(17) == [9, 17]
    rng = np.random.default_rng(2)
    w = substrings.Windows([" ".join(f"w{x}" for x in rng.integers(0, 3, n)).encode() for n in (200, 10, 0, 90, 35)])
    lengths = substrings.chain(35)
    s, at = w.levels(lengths, 2)
    where = {}
    for level, p in enumerate(at):
        assert ((p >= s) & (p + lengths[level] <= s + 35)).all()
        for window, offset in zip(w.hashes(35, s).tolist(), (p - s).tolist(), strict=True):
            assert where.setdefault((level, window), offset) == offset
    assert (at[2] == s).all() and len(s) == 166 + 56 + 1
