"""Operator 8: removes words in repeated windows, by level-wise doubling of windows.

Windows of 9, then 18, then 35 words are looked at (``chain``: each level about twice the one before, the last the full
length). The first level looks at one short window inside each full window, the one with the least hash, so equal full
windows are stood for by equal short ones, and only one position in about fourteen is looked at. A short window that
recurs, and such alone, is extended to the next length, inside the full windows that it stands for, to the right where
there is room and else to the left; those that recur are extended again. The chain ends at the full length or where no
candidate survives. ``lengthen`` goes on doubling from there until none does.

Texts are taken once each, keyed by 95 bits of hash, with their number of copies: a text with copies is repeated as a
whole. Positions and hashes move between levels, never pairs of a group. Counts are pre-aggregated and join the
positions by an exchange of their own, so that adaptive execution splits the positions of a window that many texts
share. Full windows are told apart by 95 bits of hash.

Defined results: null and empty texts have no words and no windows. A text shorter than a window keeps all words.
Repeated rows are copies of each other, so what they share is removed from all of them. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, in_batches, slices, written

#: Words of a window.
WINDOW = 35
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, base, np.uint64))
    return up, np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))


def _mixed(v: np.ndarray) -> np.ndarray:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        v = (v ^ (v >> np.uint64(33))) * np.uint64(m)
    return v ^ (v >> np.uint64(33))


class Windows:
    """The words of several UTF-8 texts (between space and U+0009 to U+000D) in one row, with the hash of any window."""

    def __init__(self, texts: list[bytes]) -> None:
        words: list[bytes] = []
        ends = [0]
        for t in texts:
            words += t.split()
            ends.append(len(words))
        self.ends = np.array(ends, np.int64)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        hashes = known[coded.indices.to_numpy()] if words else np.zeros(0, np.uint64)
        self.n = len(hashes)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.ends))
        self.sums = []
        for base in _BASES:
            up, down = _powers(base, 1 << max(16, int(self.n).bit_length()))
            self.sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: self.n], dtype=np.uint64)]), down))

    def hashes(self, length: int, at: np.ndarray | None = None, which: int = 0) -> np.ndarray:
        """The hash of the window at each position (at all, if none are given)."""
        sums, down = self.sums[which]
        if at is None:
            return _mixed((sums[length:] - sums[:-length]) * down[: max(self.n - length + 1, 0)]) if self.n >= length else np.zeros(0, np.uint64)
        return _mixed((sums[at + length] - sums[at]) * down[at])

    def starts(self, length: int) -> np.ndarray:
        """Where a window lies within one text."""
        if self.n < length:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: self.n - length + 1] == self.doc[length - 1 :])

    def stand_ins(self, length: int, short: int) -> tuple[np.ndarray, np.ndarray]:
        """(start of each window, start of the short window that stands for it: the least hash in it, leftmost)."""
        s = self.starts(length)
        if not len(s):
            return s, s
        span = length - short + 1
        least = (self.hashes(short) >> np.uint64(32) << np.uint64(32)) | np.arange(self.n - short + 1, dtype=np.uint64)
        wide = 1
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        return s, (np.minimum(least[s], least[s + span - wide]) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def levels(self, lengths: list[int], level: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(start of each full window, for each level up to ``level`` the start of the window that stands for it)."""
        length = lengths[-1]
        s, at = self.stand_ins(length, lengths[0])
        out = [at]
        for before, now in zip(lengths[:level], lengths[1 : level + 1], strict=True):
            right = out[-1] + now <= s + length
            out.append(s if now == length else np.where(right, out[-1], out[-1] + before - now))
        return s, out


def chain(length: int, least: int = 8) -> list[int]:
    """The lengths of the levels: ``length``, its half (rounded up) and so on, while at least ``least``; ascending."""
    out = [length]
    while (half := (out[0] + 1) // 2) >= least and half < out[0]:
        out.insert(0, half)
    return out


def _batch(b: pa.RecordBatch, docs: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows for positions of a batch's texts, with the texts' keys (columns 0 and 1)."""
    at = pa.array(docs, pa.int64())
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(x) for x in columns.values()]], ["k1", "k2", *columns])


def _k2(text: Column) -> Column:
    return F.xxhash64(F.lit(8), text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("k2")


def texts_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(k1, k2, packed, copies)``: each different text once, compressed."""
    text = F.coalesce(docs[text_col], F.lit(""))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor()
        for b in slices(batches):
            packed = [z.compress(t.encode()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["k1", "k2", "packed"])

    keyed = in_batches(docs.select(F.xxhash64(text).alias("k1"), _k2(text), text.alias("text")), pack, "k1 long, k2 int, packed binary")
    return keyed.groupBy("k1", "k2").agg(F.first("packed").alias("packed"), F.count("*").alias("copies"))


def unpacked(b: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch that has ``packed`` third."""
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in b.column(2).to_pylist()]


def windows_at(texts: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """``(k1, k2, pos, w1, w2)``: the windows of a level, each position once. Above level 0 ``texts`` has ``places``, the
    positions of the windows that survived the level before; only the windows that extend these are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = lengths[level]
        for b in slices(batches, "packed", SLICE_BYTES // 2):
            w = Windows(unpacked(b))
            at = w.levels(lengths, level)[1]
            p = at[level]
            if level:
                places = b.column(3)
                counts = np.diff(places.offsets.to_numpy())
                marks = np.zeros(w.n + 1, bool)
                marks[places.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.ends[:-1], counts)] = True
                p = p[marks[at[level - 1]]]
            mine = np.zeros(w.n + 1, bool)
            mine[p] = True
            p = np.flatnonzero(mine)
            if len(p):
                doc = w.doc[p]
                columns = {"pos": (p - w.ends[doc]).astype(np.int32), "w1": w.hashes(length, p).view(np.int64)}
                if level == len(lengths) - 1:  # shorter windows are candidates only
                    columns["w2"] = w.hashes(length, p, 1).astype(np.uint32).view(np.int32)
                yield _batch(b, doc, columns)

    # all columns of the texts, everywhere that they are read: only equal exchanges are shared
    extra = ", w2 int" if level == len(lengths) - 1 else ""
    return in_batches(texts.select("k1", "k2", "packed", *(["places"] if level else []), "copies"), run, f"k1 long, k2 int, pos int, w1 long{extra}")


def recurring(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key at least two rows have. The keys are counted under another form of themselves, so that they
    are exchanged once more for the join: adaptive execution splits a key's rows only where both sides are exchanged."""
    first, *rest = key
    many = rows.groupBy(F.bitwise_not(first).alias(first), *rest).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(many.select(F.bitwise_not(first).alias(first), *rest), list(key), "left_semi")


def repeated_windows(texts: DataFrame, length: int = WINDOW) -> DataFrame:
    """``(k1, k2, pos, w1, w2)``: every window of ``length`` words that starts at two places or more."""
    lengths = chain(length)
    found = recurring(windows_at(texts, lengths, 0), *(("w1",) if len(lengths) > 1 else ("w1", "w2")))
    for level in range(1, len(lengths)):
        places = found.groupBy("k1", "k2").agg(F.collect_list("pos").alias("places"))
        found = recurring(windows_at(texts.join(places, ["k1", "k2"]), lengths, level), *(("w1",) if level < len(lengths) - 1 else ("w1", "w2")))
    return found


def longer(windows: DataFrame, length: int) -> DataFrame:
    """The repeated windows of twice the length, from those of ``length``: both halves are repeated, and so is the whole."""
    second = windows.select("k1", "k2", (F.col("pos") - length).alias("pos"), F.struct("w1", "w2").alias("next"))
    both = windows.join(second, ["k1", "k2", "pos"])
    whole = both.select("k1", "k2", "pos", F.xxhash64("w1", "w2", "next").alias("w1"), F.xxhash64(F.lit(2), "w1", "w2", "next").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("w2"))
    return recurring(whole, "w1", "w2")


def lengthen(windows: DataFrame, length: int) -> DataFrame:
    """``(length, k1, k2, pos)``: the repeated windows of ``length`` words and of every doubling of it, until none is left."""
    out, level = None, written(windows, "windows")
    while not level.isEmpty():
        rows = level.select(F.lit(length).alias("length"), "k1", "k2", "pos")
        out = rows if out is None else out.unionByName(rows)
        level, length = written(longer(level, length), "windows"), 2 * length
    return level.select(F.lit(length).alias("length"), "k1", "k2", "pos") if out is None else out


def remove_repeats(docs: DataFrame, length: int = WINDOW, digest: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for docs(doc_id, text): the words outside repeated windows, joined by one
    space. With ``digest``, ``kept_sha256`` in place of kept, so that no text leaves the worker.
    """
    texts = texts_of(docs)
    starts = repeated_windows(texts, length).groupBy("k1", "k2").agg(F.collect_list("pos").alias("starts"))
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "packed", SLICE_BYTES // 2):
            n, gone, kept = [], [], []
            starts = b.column(4)
            for i, (t, copies) in enumerate(zip(unpacked(b), b.column(3).to_pylist(), strict=True)):
                words = t.split()
                n.append(len(words))
                if copies > 1 and len(words) >= length:
                    words = []
                elif starts[i].is_valid:
                    at = starts[i].values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    free = np.cumsum(edge[:-1]) == 0
                    words = [w for w, f in zip(words, free.tolist(), strict=True) if f]
                gone.append(n[-1] - len(words))
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_words", "n_removed", last])

    marked = texts.join(starts, ["k1", "k2"], "left").select("k1", "k2", "packed", "copies", "starts")
    done = in_batches(marked, run, f"k1 long, k2 int, n_words long, n_removed long, {last} string")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("k1"), _k2(text))
    return rows.join(done, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", last)


def oracle_sql(length: int = WINDOW) -> str:
    """DuckDB SQL of the query: every window spelled out and counted."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {length - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS k FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT word.doc_id, count(g.k) AS n_removed, string_agg(CASE WHEN g.k IS NULL THEN x END, ' ' ORDER BY word.k) AS t FROM word LEFT JOIN gone g ON g.doc_id = word.doc_id AND g.k = word.k GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
