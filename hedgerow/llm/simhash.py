"""Operator 4: near-duplicates by SimHash fingerprints.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Fingerprints are cut into blocks; two
that differ in at most ``distance`` bits agree on at least ``blocks - distance`` of them (pigeonhole), so each distinct
fingerprint is joined on every choice of so many blocks, and the Hamming distance of those that meet is verified. A
bucket yields a star for each of its linked groups, not its pairs; stars are merged into components. Buckets over
``BUCKET`` fingerprints are dealt out as pairs of parts, each small enough for a task.

Defined results: null and empty texts, and texts without words, have fingerprint zero, which links like any other.
Texts with fewer words than a shingle are one shingle. Repeated rows give repeated rows. Rows with a null doc_id take
part; component_id is the smallest doc_id that isn't null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices, written
from .components import components

#: Fingerprints that one task compares at once.
BUCKET = 20_000
#: Sums of up to 255 bits in each of a word's 8 bytes: the bits of a byte, one in each byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; runs end at ``ends``. A bit is set if it is in over half of them."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(ends), np.uint64)
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return out
    starts, ends = starts[full], ends[full]
    pieces = (ends - starts + 254) // 255
    first = np.concatenate([[0], np.cumsum(pieces)])
    at = np.repeat(starts - 255 * first[:-1], pieces) + 255 * np.arange(first[-1])
    spread = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, at, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(sums.astype(np.int64), first[:-1], axis=0)
    bits = counts * 2 > (ends - starts)[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (seed 42) of each of a text's shingles, in order; A-Z count as a-z."""
    found = text.encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], 42) for i, j in zip(starts, ends[words - 1 :].tolist())]  # noqa: B905


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)``: each whole text's fingerprint, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes: list[int] = []
            ends = []
            for t in b.column(1).to_pylist():
                hashes += shingle_hashes(t or "", words)
                ends.append(len(hashes))
            fp = majority(np.array(hashes, np.uint64), np.array(ends, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def masks(distance: int, blocks: int) -> list[int]:
    """The bits (as signed longs) of each choice of ``blocks - distance`` of the blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(c)) for c in combinations(block, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The least number of blocks whose shared bits tell ``n`` fingerprints apart."""
    blocks = distance + 2
    while blocks < distance + 5 and 64 * (blocks - distance) / blocks < np.log2(max(n, 1)):
        blocks += 1
    return blocks


def linked(fps: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """The groups (two members at least) that links within ``distance`` bits join; no pair is kept."""
    return (fps[g] for g in linked_at(fps, distance))


def linked_at(fps: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Where the members of each group of ``linked`` are."""
    left = np.arange(len(fps))
    while len(left) > 1:
        group, todo, left = [int(left[0])], [int(left[0])], left[1:]
        while todo and len(left):
            near = np.bitwise_count(fps[left] ^ fps[todo.pop()]) <= distance
            if near.any():
                new = left[near].tolist()
                group += new
                todo += new
                left = left[~near]
        if len(group) > 1:
            yield np.array(group)


def _stars(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links (fp, least fp of its group) from rows sorted by bucket; a bucket may span batches."""

    def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if rows:
            both = np.concatenate(rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def star(group: np.ndarray) -> np.ndarray:
        least = group.view(np.int64).min()
        rest = group[group.view(np.int64) != least]
        return np.stack([rest, np.full(len(rest), least).view(np.uint64)], axis=1)

    for rows, bounds in _whole(batches, 4):
        yield from out(_groups(rows, bounds, distance, star))


def _whole(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of longs (bucket in three columns) with the bounds of their buckets, each bucket whole."""
    held: np.ndarray | None = None
    for b in batches:
        rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)], axis=1)
        if held is not None:
            rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        bounds = np.concatenate([[0], cut])
        held = rows[bounds[-1] :]
        yield rows, bounds
    if held is not None:
        yield held, np.array([0, len(held)])


def _groups(rows: np.ndarray, bounds: np.ndarray, distance: int, star) -> list[np.ndarray]:  # noqa: ANN001
    """The stars of all buckets between bounds; pairs are verified together."""
    fps, sizes, found = rows[:, 3].astype(np.int64).view(np.uint64), np.diff(bounds), []
    two = bounds[:-1][sizes == 2]
    if len(two):
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= distance
        if near.any():
            a, b = a[near].view(np.int64), b[near].view(np.int64)
            found.append(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1).view(np.uint64))
    for i in np.flatnonzero(sizes > 2):
        found += [star(g) for g in linked(fps[bounds[i] : bounds[i + 1]], distance)]
    return found


def _dealt(fps: DataFrame, chosen: list[int]) -> DataFrame:
    """``(k, key, part, *columns)`` of fps(.., fp), sorted by bucket: the rows that agree in the bits of a mask."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(chosen)])).alias("x")
    buckets = fps.select("*", keys).select("x.k", "x.key", *fps.columns)
    heavy = buckets.groupBy("k", "key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    parts = F.ceil(F.col("n") / (BUCKET // 2))
    # a heavy bucket of p parts: every part meets every other in one task
    own = F.pmod(F.xxhash64(*fps.columns), F.col("p"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda i: F.least(own, i) * F.col("p") + F.greatest(own, i))
    dealt = (
        buckets.join(heavy.select("k", "key", parts.alias("p")), ["k", "key"], "left")
        .withColumn("part", F.when(F.col("p").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair))
        .select("k", "key", F.explode("part").alias("part"), *fps.columns)
    )
    return dealt.repartition("k", "key", "part").sortWithinPartitions("k", "key", "part")


def _met(batches: Iterator[pa.RecordBatch], far: int) -> Iterator[pa.RecordBatch]:
    """(key, id) of the groups in each bucket that links within ``far`` bits join, from rows (k, key, part, id, fp)."""
    for rows, bounds in _whole(batches, 5):
        sizes, fps = np.diff(bounds), rows[: bounds[-1], 4].astype(np.int64).view(np.uint64)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        some = sizes > 64
        for d in range(1, min(64, sizes.max(initial=1))):
            near = (bucket[d:] == bucket[:-d]) & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= far)
            some[bucket[d:][near]] = True
        keys, ids = [], []
        for i in np.flatnonzero(some):
            for g in linked_at(fps[bounds[i] : bounds[i + 1]], far):
                of = np.sort(rows[bounds[i] + g, 3])
                keys.append(np.full(len(of), xxhash.xxh3_64_intdigest(rows[bounds[i], :3].tobytes() + of[:1].tobytes()), np.uint64))
                ids.append(of)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "id"])


def met(fps: DataFrame, distance: int, far: int) -> DataFrame:
    """``(key, id)`` of fps(id, fp): keys stand for groups whose members some block choice brings together and links within
    ``far`` bits join. Those that differ in ``distance`` bits at most have one in common for certain."""
    blocks, n = distance + 2, fps.count()
    while blocks < distance + 5 and 64 * (blocks - distance) / blocks < np.log2(max(n, 1)) - 8:
        blocks += 1
    return in_batches(_dealt(fps.select("id", "fp"), masks(distance, blocks)), lambda it: _met(it, far), "key long, id long")


def link(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``(fp, root)`` for the fingerprints that are linked to others, from a table of distinct ``fp``."""
    chosen = masks(distance, blocks_for(fps.count(), distance))
    sorted_ = _dealt(fps, chosen)
    edges = sorted_.mapInArrow(lambda it: _stars(it, distance), "a long, b long")
    return components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of docs(doc_id, text)."""
    found = written(fingerprints(docs, words), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fp")
    roots = distinct.join(link(distinct.select("fp"), distance), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of = roots.join(least, "root").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):  # noqa: ANN201
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
