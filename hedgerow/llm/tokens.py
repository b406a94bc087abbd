"""Operator 1: token ids as ORC files.

Documents are range-partitioned and sorted by id, encoded whole with the tokenizers library, and written as ORC:
integer run-length encoding of ids, row indexes, and Bloom filters on the document id, in stripes that readers take in
parallel and skip by their metadata. Each row also holds its file's number and the ids before it in that file, so that
a document's global start needs only the files' totals.

Defined results: null text counts as empty and yields the end id alone. Rows with one doc_id are ordered by their text
(null first). Null doc_ids come first. An empty table yields no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Words, byte_alphabet, codec, with_special
from .common import SLICE_BYTES, slices

SCHEMA = "doc_id long, chunk int, offset long, n_tokens long, tokens array<int>"
#: Bytes of an ORC stripe, rows between two entries of a row index, and the Bloom filters' error rate.
STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01


@lru_cache(maxsize=2)
def library(vocabulary: str):  # noqa: ANN201
    """The tokenizers library's tokenizer, one for each worker process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def _encoder(vocabulary: str):  # noqa: ANN202
    """Encodes texts with the library; a pre-token that recurs is encoded once.

    New pre-tokens go to the library's model in the form that its pre-tokenizer gives them: a character for each byte.
    """
    tokenize = library(vocabulary).model.tokenize
    printed = {b: c for c, b in byte_alphabet().items()}

    def encode(words: list[str]) -> list[bytes]:
        return [array("i", [k.id for k in tokenize(w.encode().decode("latin-1").translate(printed))]).tobytes() for w in words]

    c, cache = codec(vocabulary), Words(encode)
    return lambda texts: with_special(c, cache, texts)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Writes the ids of every document, each with ``end_id`` after it, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, offset = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        last = np.array([end_id], np.int32)
        for b in slices(batches, "text", 2 * SLICE_BYTES):
            found = encode([x or "" for x in b.column(1).to_pylist()])
            flat = [y for x in found for y in (x, last)]
            lengths = np.array([len(x) + 1 for x in found], np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            starts = offset + bounds[:-1]
            offset += int(bounds[-1])
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chunk] * len(lengths), pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), tokens], ["doc_id", "chunk", "offset", "n_tokens", "tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(INDEX_ROWS), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES), "compression": "zstd"}
    ordered.mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. Filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def with_start(rows: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """The rows with ``start``: the ids of all documents before, by the files' totals (one row for each file).

    ``totals`` has (chunk, n_tokens) of all stored rows, where ``rows`` are not these.
    """
    totals = (rows if totals is None else totals).groupBy("chunk").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("chunk", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(bases, "chunk").withColumn("start", F.col("base") + F.col("offset"))


def checksums(stored: DataFrame) -> DataFrame:
    """The stored rows with ``ids_crc32``, the CRC-32 of each row's ids as little-endian unsigned 32-bit integers, in
    place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, crc = b.column(4), []
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            for i in range(len(ids)):
                crc.append(zlib.crc32(values[ends[i] : ends[i + 1]]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "chunk", "offset", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, "doc_id long, chunk int, offset long, n_tokens long, ids_crc32 long")
