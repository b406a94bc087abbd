"""Operator 4's links by shingle similarity, for the pipeline: texts that share at least ``similarity`` of their shingles.

As in operator 4, texts have SimHash fingerprints (here of their distinct shingles), these are cut into blocks, and those
that agree on some choice of blocks meet; groups within ``FAR`` bits are candidates. All pairs that differ in up to
``DISTANCE`` bits meet. The exact Jaccard similarity of their shingle sets decides, so no pair is linked wrongly.

Of 64 bits, about ten differ between texts that share 0.8 of their shingles, and often more than fifteen; no blocks that
guarantee such a distance tell anything apart. So the rest comes by another way, and no link is lost: minima of hashed
shingles are cut into ``BANDS`` keys of ``ROWS`` minima each, and sets that share a key and that fingerprints have not
linked yet are compared in the same way. A pair of similarity s meets in no key with probability (1 - s^ROWS)^BANDS: 3e-6
at 0.8. Equal shingle sets count once, and so do keys at which the same texts meet. Keys at which only sets meet that are
linked by then are left out, so a large group of copies costs little. A key yields a star for each of its linked groups,
not its pairs; stars are merged into components. Keys with over ``SHINGLES`` shingles are dealt out as pairs of parts, each
small enough for a task.

Defined results: shingles are op4's, of ``words`` words. Null and empty texts, and texts without words, are equal.
Texts with fewer words than a shingle are one shingle. Repeated rows give repeated rows. Rows with a null doc_id take
part; component_id is the smallest doc_id that isn't null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices, written
from .components import components
from .simhash import majority, met, shingle_hashes

#: Bits in which fingerprints that surely meet differ at most, and those that are candidates if they meet.
DISTANCE, FAR = 6, 12
#: Keys of a text for what fingerprints leave, and minima in each.
BANDS, ROWS = 24, 4
#: Shingles that one task compares at once.
SHINGLES = 4_000_000
_RNG = np.random.default_rng(4)
_XOR = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def set_id(shingles: np.ndarray) -> int:
    """What stands for a set of shingles, as a signed long."""
    n = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return n - (1 << 64) if n >> 63 else n


def keys(shingles: np.ndarray) -> np.ndarray:
    """The keys (as signed longs) at which a set meets others; the empty set has none."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 1000):
        least = np.minimum(least, ((shingles[i : i + 1000] ^ _XOR) * _TIMES).min(axis=1))
    raw = least.tobytes()
    step = 8 * ROWS
    return np.array([xxhash.xxh3_64_intdigest(raw[step * k : step * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64)


def linked(sets: list[np.ndarray], similarity: Fraction, known: list[int] | None = None) -> np.ndarray:
    """A label for each set: sets have equal labels if similar enough sets join them, or ``known`` labels do already.

    A set is compared with all sets of other labels at once. Those left in the most frequent label when all others have
    been compared need not be: what links them to others has been seen from there.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    at = np.cumsum(sizes[full]) - sizes[full]
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    _, label = np.unique(np.arange(len(sets)) if known is None else np.array(known), return_inverse=True)
    marks, pending, shared = np.zeros(len(values), np.int64), np.ones(len(sets), bool), np.zeros(len(sets), np.int64)
    while pending.any():
        most = np.bincount(label[pending]).argmax()
        others = pending & (label != most)
        if not others.any():
            break
        i = int(np.flatnonzero(others)[0])
        pending[i] = False
        maybe = label != label[i]
        least, largest = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        maybe &= least * similarity.denominator >= largest * similarity.numerator
        if not maybe.any():
            continue
        marks[flat[ends[i] - sizes[i] : ends[i]]] = 1
        if maybe.sum() * 8 < len(sets):
            for j in np.flatnonzero(maybe).tolist():
                shared[j] = marks[flat[ends[j] - sizes[j] : ends[j]]].sum()
        else:
            shared[full] = np.add.reduceat(marks[flat], at)
        marks[flat[ends[i] - sizes[i] : ends[i]]] = 0
        new = maybe & (shared * similarity.denominator >= (sizes + sizes[i] - shared) * similarity.numerator)
        if new.any():
            label[np.isin(label, label[new])] = label[i]
    return label


def _stars(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Links (id, least id of its group) from rows (key, part, id, root, set) sorted by key and part; sets of one root are
    linked already."""

    def out(held: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        ids, roots = np.array(list(held), np.int64), [r for r, _ in held.values()]
        label = linked([x for _, x in held.values()], similarity, roots)
        order = np.lexsort((ids, label))
        first = np.append(True, label[order][1:] != label[order][:-1])
        least = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[order][~first]), pa.array(least[~first])], ["a", "b"])

    at, held = None, {}
    for batch in batches:
        for k, part, i, root, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k, part) != at:
                yield from out(held)
                at, held = (k, part), {}
            held[i] = root, np.frombuffer(s, np.uint64)
    yield from out(held)


def _scanned(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, row, id, fp, keys)`` for every row of docs(doc_id, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t or "", words) for t in b.column(2).to_pylist()]
            found = [keys(s) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            prints = majority(np.concatenate(sets), np.cumsum([len(s) for s in sets])).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([set_id(s) for s in sets], pa.int64()), pa.array(prints), lists], ["doc_id", "row", "id", "fp", "keys"])

    return in_batches(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, id long, fp long, keys array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``(id, n, set)`` of texts(id, text): the number of shingles and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t or "", words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "set"])

    return in_batches(texts, run, "id long, n long, set binary")


def _edges(members: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Stars (a, b) of linked sets, from members(key, id, root). Keys of one root alone link nothing. All that is asked of a
    key is known before its members are joined, once, so that adaptive execution can split the members of a frequent one."""
    sized = members.join(sets.select("id", F.col("n").alias("size")), "id")
    x, y = F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit(1), "id"))
    same = sized.groupBy("key").agg(F.count("*").alias("n"), x.alias("x"), y.alias("y"), F.sum("size").alias("size"), F.min("root").alias("least"), F.max("root").alias("most"))
    # of the keys with the same members, one; a heavy key of p parts: every part meets every other in one task
    parts = F.when(F.col("size") > SHINGLES, F.ceil(F.col("size") / (SHINGLES // 2)))
    chosen = same.filter("least <> most").groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.min("size").alias("size")).select("key", parts.alias("p"))
    own = F.pmod(F.xxhash64("id"), F.col("p"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda i: F.least(own, i) * F.col("p") + F.greatest(own, i))
    dealt = (
        members.join(chosen, "key")
        .withColumn("part", F.when(F.col("p").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair))
        .select("key", F.explode("part").alias("part"), "id", "root")
    )
    sorted_ = dealt.join(sets.select("id", "set"), "id").select("key", "part", "id", "root", "set").repartition("key", "part").sortWithinPartitions("key", "part")
    return in_batches(sorted_, lambda it: _stars(it, similarity), "a long, b long")


def _several(rows: DataFrame, what: str) -> DataFrame:
    """The keys at which ``what`` has two values at least. Grouped under another form of the key, so that a join by key
    exchanges both its sides: only then does adaptive execution split the rows of a very frequent key."""
    both = rows.groupBy(F.bitwise_not("key").alias("k")).agg(F.min(what).alias("x"), F.max(what).alias("y"))
    return both.filter("x <> y").select(F.bitwise_not("k").alias("key"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, row, root, component_id)`` for every row of docs(doc_id, text): row tells texts under one doc_id apart,
    root the groups, of which several can have one smallest doc_id."""
    share = Fraction(str(similarity))
    base = docs.select("doc_id", row_key(docs["text"]).alias("row"), docs["text"].cast("string").alias("text"))
    found = written(_scanned(base, words), "shingled")
    # each set once, and the row to take it from
    distinct = written(found.groupBy("id").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "row")).alias("at"), F.min("fp").alias("fp")), "distinct-sets")
    close = written(met(distinct.select("id", "fp"), DISTANCE, FAR), "members")
    # what is left: keys at which different sets meet
    shared = found.select("id", F.explode("keys").alias("key"))
    members = written(shared.join(_several(shared, "id"), "key").select("key", "id").distinct(), "members")
    at = members.select("id").union(close.select("id")).distinct().join(distinct, "id").select("id", F.col("at.doc_id").alias("d"), F.col("at.row").alias("r"))
    texts = base.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).select("id", "text")
    sets = written(_sets(texts, words), "sets")
    links = written(components(_edges(close.select("key", "id", F.col("id").alias("root")), sets, share)), "links")
    rest = written(members.join(links.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "members")
    more = _edges(rest, sets, share)
    links = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    roots = distinct.join(links.select(F.col("node").alias("id"), "root"), "id", "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of = roots.join(least, "root").select("id", "root", "component_id")
    return found.select("doc_id", "row", "id").join(of, "id").select("doc_id", "row", "root", "component_id")


def row_key(text: Column) -> Column:
    """What tells the texts under one doc_id apart."""
    return F.xxhash64(F.lit(5), text)
