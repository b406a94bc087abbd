"""Operator 5: repeated runs of lines, by winnowing over line hashes.

Of every ``run`` consecutive lines the one with the least hash is selected (the last of equals), so two equal runs of
that many lines select the same line. Lines of ``words`` words or more are a run by themselves and always selected.
With ``passages``, fewer than ``run`` lines that have so many words together are a run too, with a window minimum.
Only selected lines are stored, each with its position and the hashes of the lines around it. They are joined on their
hash; one that recurs at another position, and such alone, is extended before and after to the runs that selected it.
These are compared by 128 bits a line; all occurrences of a run but the first, by (doc_id, line), are deleted. Longer
repeated stretches are the union of their runs. Only hashes and positions move, never pairs of a group; a line or run
that many texts share is dealt out over tasks (common.rows_of).

Defined results: lines end at "\\n"; spaces, tabs and carriage returns at a line's ends don't count. Blank lines are no
part of runs and stay. Null text counts as empty, which is one blank line. Rows equal in doc_id and text are one
occurrence: they get the same result. Null doc_ids come first. Rows with one doc_id and other texts are ordered by a
hash of the text. An empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, rows_of, slices, written

#: Lines of the shortest run that is deleted, and words of a line that counts as a run.
RUN, WORDS = 3, 50
_MARGIN = " \t\r"
#: Bytes of a line's hash; what a run's first line is multiplied by where it is stored in one number with its length.
_BYTES, _WIDE = 16, 1 << 10
_ROW, _TEXT = "hedgerow_row", "hedgerow_text"


def selected(hashes: list[bytes], run: int) -> dict[int, list[int]]:
    """The window minima: for each selected place, the starts of the windows that selected it."""
    out: dict[int, list[int]] = {}
    for s in range(len(hashes) - run + 1):
        best = s
        for i in range(s + 1, s + run):
            if hashes[i] <= hashes[best]:
                best = i
        out.setdefault(best, []).append(s)
    return out


def fingerprints(text: str, run: int, words: int, passages: bool = True) -> Iterator[tuple[list[bytes], list[int], list[int], int]]:
    """For each selected line of a text: the hashes and numbers of it and the lines around it, the runs that selected it
    (each ``start * _WIDE + lines``, counted among these), and its own place among these."""
    places, hashes, counts = [], [], []
    units: dict[int, list[tuple[int, int]]] = {}  # the runs (first, lines) by the line that stands for them
    for i, line in enumerate(text.split("\n")):
        if line := line.strip(_MARGIN):
            raw = line.encode()
            if passages or len(raw) >= 2 * words - 1:
                counts.append(len(raw.split()))
                if counts[-1] >= words and run > 1:
                    units[len(hashes)] = [(len(hashes), 1)]
            places.append(i)
            hashes.append(xxhash.xxh3_128_digest(raw))
    for n in range(2, run) if passages else ():
        for i, starts in selected(hashes, n).items():
            long = [(s, n) for s in starts if sum(counts[s : s + n]) >= words]
            if long:
                units.setdefault(i, []).extend(long)
    for i, starts in selected(hashes, run).items():
        units.setdefault(i, []).extend((s, run) for s in starts)
    for i, runs in units.items():
        low, high = min(s for s, _ in runs), max(s + n for s, n in runs)
        yield hashes[low:high], places[low:high], [(s - low) * _WIDE + n for s, n in runs], i - low


def _row_key(df: DataFrame) -> Column:
    return F.xxhash64(F.lit(5), df[_TEXT])


def repeated(docs: DataFrame, run: int, words: int, passages: bool = True) -> DataFrame:
    """``(doc_id, row, spans)``: the first and last lines of each run that has occurred before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _TEXT):
            at, line, place, near, numbers, units = [], [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for hashes, places, runs, own in fingerprints(t or "", run, words, passages):
                    at.append(i)
                    line.append(hashes[own][:8])
                    place.append(places[own])
                    near.append(b"".join(hashes))
                    numbers.append(places)
                    units.append(runs)
            at, ints = pa.array(at, pa.int64()), pa.list_(pa.int32())
            line = pa.array(np.frombuffer(b"".join(line), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), line, pa.array(place, pa.int32()), pa.array(near, pa.binary()), pa.array(numbers, ints), pa.array(units, ints)], ["doc_id", "row", "line", "place", "near", "numbers", "units"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, row long, line long, place int, near binary, numbers array<int>, units array<int>"
    found = written(in_batches(docs.select("doc_id", docs[_ROW].alias("row"), _TEXT), scan, schema), "lines")

    def several(rows: DataFrame, key: str, where: Column) -> DataFrame:
        """The keys that stand at two positions at least, the first of these, and the number of rows."""
        keys = rows.groupBy(key).agg(F.min(where).alias("origin"), F.max(where).alias("last_one"), F.count("*").alias("n"))
        return written(keys.filter("origin <> last_one").drop("last_one"), "recurring")

    recurring = rows_of(found, several(found, "line", F.struct("doc_id", "row", "place")), ["line"], "place")
    start, size = F.floor(F.col("unit") / _WIDE).cast("int"), F.col("unit") % _WIDE
    runs = recurring.select("doc_id", "row", "near", "numbers", F.explode("units").alias("unit")).select(
        "doc_id",
        "row",
        F.substring("near", start * _BYTES + 1, size * _BYTES).alias("run"),
        F.element_at("numbers", start + 1).alias("first"),
        F.element_at("numbers", start + size).alias("last"),
    )
    runs = written(runs, "runs")
    where = F.struct("doc_id", "row", "first")
    later = rows_of(runs, several(runs, "run", where), ["run"], "first", ("origin",)).filter(where != F.col("origin"))
    return later.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, text_col: str = "text", out: str = "kept", passages: bool = True) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with ``out`` (the lines that stay), n_lines and n_removed."""
    base = docs.withColumn(_TEXT, docs[text_col])
    base = base.withColumn(_ROW, _row_key(base))
    spans = repeated(base, run, words, passages).select(F.col("doc_id").alias("hedgerow_doc"), F.col("row").alias("hedgerow_other"), F.col("spans").alias("hedgerow_spans"))
    joined = base.join(spans, base["doc_id"].eqNullSafe(spans["hedgerow_doc"]) & (base[_ROW] == spans["hedgerow_other"]), "left")
    keep = [c for c in docs.columns if c not in (out, "n_lines", "n_removed")]
    narrow = joined.select(*[joined[f"`{c}`"] for c in keep], _TEXT, "hedgerow_spans")
    schema = narrow.drop("hedgerow_spans", _TEXT).schema.add(out, "string").add("n_lines", "long").add("n_removed", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _TEXT):
            k = b.num_columns - 2
            texts, total, gone = [], [], []
            for t, spans in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), strict=True):
                lines = (t or "").split("\n")
                drop = {i for s in spans or () for i in range(s["first"], s["last"] + 1) if lines[i].strip(_MARGIN)}
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else t or "")
                total.append(len(lines))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return in_batches(narrow, cut, schema)


def oracle_sql(run: int = RUN, words: int = WORDS) -> str:
    """DuckDB SQL of the query, by window functions over all lines."""

    def later(lines: int, where: str) -> str:
        return f"SELECT doc_id, i AS s, e{lines} AS e FROM (SELECT doc_id, i, e{lines}, row_number() OVER (PARTITION BY {', '.join(f'l{k}' for k in range(lines))} ORDER BY doc_id, i) AS n FROM win WHERE {where}) WHERE n > 1"

    ahead = ", ".join(f"lead(l, {k}) OVER w AS l{k}, lead(n_words, {k}) OVER w AS n{k}, lead(i, {k}) OVER w AS e{k + 1}" for k in range(run))
    passages = [later(n, f"e{n} IS NOT NULL AND {' + '.join(f'n{k}' for k in range(n))} >= {words}") for n in range(1, run)]
    return f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, i, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(13)) AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM x)),
full_ AS (SELECT *, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n_words FROM line WHERE l <> ''),
win AS (SELECT doc_id, i, {ahead} FROM full_ WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (
  {(chr(10) + "  UNION ALL" + chr(10) + "  ").join([later(run, f"e{run} IS NOT NULL"), *passages])}),
gone AS (SELECT DISTINCT f.doc_id, f.i FROM full_ f JOIN span s ON f.doc_id = s.doc_id AND f.i BETWEEN s.s AND s.e)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.raw END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
