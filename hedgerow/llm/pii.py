"""Operator 7: personal data, with DataFrame functions only.

Regular expressions propose spans; validators confirm them (value ranges, digit counts, Luhn for cards, mod 97 for
IBANs); words near a span adjust its score. A text is cut at a pattern's matches, so the lengths of the pieces give the
positions, in code points. Matches of a kind are leftmost and don't overlap; one that fails its test is dropped, and
what it covers isn't searched again. The positions are running sums, taken in chunks of about the cube root of the
number of matches, so arrays that grow stay short; context comes from neighbouring pieces, not from the text.

Beside the base kinds (email, ip, card, phone) the method finds ``iban`` and ``ssn``; ssn, which no checksum confirms,
needs a context word. Patterns avoid backtracking, so cutting takes time in proportion to a text's length; the sums
take time in proportion to the power 4/3 of the number of matches (5 MB with 200,000 of them: 9 s on one slow core).

Defined results: null and empty texts have no spans. Positions count code points, ends are exclusive. Repeated rows
repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Kind(NamedTuple):
    """How a kind of span is proposed, confirmed and scored."""

    name: str
    pattern: str
    gate: str  # a text in which this (a regular expression) isn't found has no such span
    base: float
    context: str  # words near a span that make it likelier
    least: float = 0.0  # score that a span needs


#: The contract's patterns in forms that match the same spans without backtracking. A match of email or
#: ip can start within a run of its first characters only where the last match ended.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"(?i)(?:^|[^A-Za-z0-9_])(?:e-?mail|contact|write|mailto)"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"(?i)(?:^|[^A-Za-z0-9_])(?:ip|address|host|server)(?:$|[^A-Za-z0-9_])"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){15}", 0.8, r"(?i)(?:^|[^A-Za-z0-9_])(?:card|visa|credit|debit|amex|mastercard)"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"(?i)(?:^|[^A-Za-z0-9_])(?:phone|call|tel|mobile|fax)"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.9, r"(?i)(?:^|[^A-Za-z0-9_])(?:iban|bank|account|transfer)"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, r"(?i)(?:^|[^A-Za-z0-9_])(?:ssn|social security|tax id)", 0.5),
)
BASE = ("email", "ip", "card", "phone")
#: Code points before and after a span in which context words count, and what one adds to the score.
NEAR, GAIN = 40, 0.3
#: Pieces that hold NEAR code points at least: every match has two or more.
REACH = NEAR // 2 + 1


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn test of a string of digits: from the right, every second digit counts twice."""
    at = F.split(F.reverse(digits), "")
    value = F.aggregate(
        F.filter(at, lambda d: d != ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda a, d: F.struct(
            (a["sum"] + F.when(a["i"] % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))).alias("sum"),
            (a["i"] + 1).alias("i"),
        ),
    )
    return value["sum"] % 10 == 0


def mod97(iban: Column) -> Column:
    """The IBAN test: first four characters moved to the end, letters as 10 to 35, remainder 1 by 97."""
    s = F.regexp_replace(iban, " ", "")
    chars = F.filter(F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _confirmed(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, r"^0+(?=[0-9])", "")) <= 3
        small = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "").cast("int") <= 255
        return F.forall(F.split(s, r"\."), lambda p: F.when(part(p), small(p)).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(s, " ", "")).between(15, 34), mod97(s)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~s.rlike(r"^(?:000|666|9)|-00-|-0000\z")
    return F.lit(True)


_SPAN = "array<struct<rank:int,start:int,end:int,kind:string,score:double>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _walk(rows: Column, after: Column, begin: Column, left: Column, kind: Kind) -> Column:
    """The confirmed spans of a few (n, tail, hit, i) in a row, whose first gap is at ``begin`` after the text ``left``.
    The pieces that follow a match are those of ``after`` from its number i."""

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["n"]
        before = F.right(F.concat(a["left"], x["tail"]), F.lit(NEAR))
        behind = F.transform(F.slice(after, x["i"] + 1, REACH), lambda y: F.concat(y["head"], F.when(y["n"] < NEAR, F.coalesce(y["hit"], F.lit(""))).otherwise(F.lit(""))))
        near = F.concat(before, F.lit(" "), F.left(F.array_join(behind, ""), F.lit(NEAR)))
        keep = x["hit"].isNotNull() & F.coalesce(_confirmed(kind.name, x["hit"]), F.lit(False))
        span = F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), near.alias("near"))
        return F.struct(
            (start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.right(F.concat(before, F.coalesce(x["hit"], F.lit(""))), F.lit(NEAR)).alias("left"),
            F.when(keep, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"),
        )

    first = F.struct(begin.alias("at"), left.alias("left"), F.expr("cast(array() as array<struct<start:int,end:int,near:string>>)").alias("out"))
    return F.aggregate(rows, first, step)["out"]


def _pieces(text: Column, kind: Kind) -> Column:
    """A text cut at a kind's matches: array of (n, tail, head, hit), a gap's length and ends and the match after it."""
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        lambda x: F.struct(F.length(x["gap"]).alias("n"), F.right(x["gap"], F.lit(NEAR)).alias("tail"), F.left(x["gap"], F.lit(NEAR)).alias("head"), x["hit"].alias("hit")),
    )


def _chunked(pieces: Column, kind: Kind) -> Column:
    """The confirmed spans of all pieces. Chunks of about the cube root of their number keep every array that grows small."""
    count = F.size(pieces)
    wide = F.greatest(F.lit(16), F.ceil(F.pow(count.cast("double"), F.lit(1 / 3))).cast("int"))

    def walked(j: Column, base: Column, wide: Column) -> Column:
        rows = F.transform(F.slice(pieces, j * wide + 1, wide), lambda x, i: F.struct(x["n"].alias("n"), x["tail"].alias("tail"), x["hit"].alias("hit"), i.alias("i")))
        return _bound(F.slice(pieces, j * wide + 2, wide + REACH), lambda after: _walk(rows, after, base, left(j, wide), kind))

    def bases(wide: Column) -> Column:
        """The position at which each chunk begins."""
        size = lambda j: F.aggregate(F.slice(pieces, j * wide + 1, wide), F.lit(0), lambda a, x: a + x["n"] + F.coalesce(F.length(x["hit"]), F.lit(0)))
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(numbers(wide), first, lambda a, j: F.struct((a["at"] + size(j)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def numbers(wide: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((count - 1) / wide).cast("int"))

    def left(j: Column, wide: Column) -> Column:
        back = F.slice(pieces, F.greatest(j * wide - REACH + 1, F.lit(1)), F.least(j * wide, F.lit(REACH)))
        return F.right(F.array_join(F.transform(back, lambda y: F.concat(y["tail"], F.coalesce(y["hit"], F.lit("")))), ""), F.lit(NEAR))

    return _bound(wide, lambda w: F.flatten(F.transform(F.arrays_zip(numbers(w).alias("j"), bases(w).alias("base")), lambda c: walked(c["j"], c["base"], w))))


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of a kind: array of (rank, start, end, kind, score)."""

    def scored(x: Column) -> Column:
        score = F.lit(kind.base) + F.when(x["near"].rlike(kind.context), GAIN).otherwise(0.0)
        return F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    spans = _bound(_pieces(text, kind), lambda p: F.filter(F.transform(_chunked(p, kind), scored), lambda x: x["score"] >= kind.least))
    return F.when(text.rlike(kind.gate), spans).otherwise(F.expr(f"cast(array() as {_SPAN})")).cast(_SPAN)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``(doc_id, spans)``: array of (rank, start, end, kind, score), by kind and then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select("doc_id", text.alias("text")).select("doc_id", *[spans_of(F.col("text"), k, i).alias(f"k{i}") for i, k in enumerate(kinds)])
    return each.select("doc_id", F.concat(*[F.col(f"k{i}") for i in range(len(kinds))]).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts of base spans, the hash of the base spans, all spans as text and their scores in hundredths."""
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: reduce(lambda a, b: a | b, [x["kind"] == k for k in BASE]))
    scores = F.array_join(F.transform("spans", lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def oracle_sql() -> str:
    """DuckDB SQL of the query: the contract's own patterns, positions from the pieces between matches."""
    digits = "regexp_replace(s, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    moved = "replace(s, ' ', '')[5:] || replace(s, ' ', '')[:4]"
    mod = f"list_reduce(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1"
    near = f"substr(t, greatest(a - {NEAR}, 0) + 1, a - greatest(a - {NEAR}, 0)) || ' ' || substr(t, b + 1, {NEAR})"
    words = {
        "email": "e-?mail|contact|write|mailto", "ip": "(ip|address|host|server)($|[^A-Za-z0-9_])", "card": "card|visa|credit|debit|amex|mastercard",
        "phone": "phone|call|tel|mobile|fax", "iban": "iban|bank|account|transfer", "ssn": "ssn|social security|tax id",
    }
    hundredths = {"email": 90, "ip": 60, "card": 80, "phone": 70, "iban": 90, "ssn": 30}
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(s, '.'), lambda p: TRY_CAST(p AS UHUGEINT) IS NULL OR TRY_CAST(p AS UHUGEINT) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN len({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({digits}) BETWEEN 8 AND 15"),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", f"CASE WHEN len(replace(s, ' ', '')) BETWEEN 15 AND 34 THEN {mod} ELSE false END"),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(s, '^(000|666|9)|-00-|-0000$') AND score >= 50"),
    ]
    parts = []
    for i, (kind, pattern, test) in enumerate(kinds):
        score = f"least(100, {hundredths[kind]} + CASE WHEN regexp_matches({near}, '(?i)(^|[^A-Za-z0-9_])({words[kind]})') THEN 30 ELSE 0 END)"
        parts.append(f"""SELECT doc_id, {i} AS r, '{kind}' AS kind, a, b, score FROM (SELECT *, {score} AS score FROM (SELECT doc_id, t, s, g AS a, g + len(s) AS b FROM (
            SELECT doc_id, t, m[i] AS s, list_sum(list_transform(p[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT AS g FROM (
            SELECT doc_id, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text AS t, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents WHERE regexp_matches(text, '{pattern}')))))) WHERE {test}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    text = "kind || ':' || a || ':' || b, ',' ORDER BY r, a"
    return f"""WITH spans AS ({" UNION ALL ".join(parts)}),
        found AS (SELECT doc_id, {counts}, string_agg({text}) FILTER (kind IN ({base})) AS base, string_agg({text}) AS spans, string_agg(score::VARCHAR, ',' ORDER BY r, a) AS scores FROM spans GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN found ON d.doc_id = found.doc_id"""
