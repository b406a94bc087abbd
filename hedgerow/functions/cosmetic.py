"""Column functions that rewrite cosmetic rules for the engine.

A selector is cut into pieces at its top-level commas by one fold over its characters; a fold also finds where an
operator's argument ends. Only rules with procedural operators are touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .rules import any_of, let, none, trim

_PROCEDURAL = any_of(T.RUNNABLE + T.DEAD + tuple(T.RENAMED) + (":watch-attr(",) + T.EMPTY_ACTIONS)


def split_rule(line: Column) -> Column:
    """struct(host, sep, selector) of a plain or exception cosmetic rule, else null."""
    sep = F.when(line.contains("#@#"), "#@#").when(line.contains("##"), "##")
    host = F.substring(line, F.lit(1), F.instr(line, sep) - 1)
    return F.when(sep.isNotNull() & ~host.endswith("?"), F.struct(host.alias("host"), sep.alias("sep"), F.substring(line, F.instr(line, sep) + F.length(sep), F.length(line)).alias("selector")))


def split_top_level(selector: Column) -> Column:
    """The pieces between commas outside brackets and quotes, trimmed; one at least."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit("").alias("piece"), none().alias("out"))

    def step(a: Column, c: Column) -> Column:
        quoted = a["quote"] != ""
        cut = ~quoted & (c == ",") & (a["depth"] == 0)
        depth = F.when(quoted, a["depth"]).when(c.isin("(", "["), a["depth"] + 1).when(c.isin(")", "]"), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        quote = F.when(quoted & ~a["escaped"] & (c == a["quote"]), "").when(~quoted & c.isin("'", '"'), c).otherwise(a["quote"])
        escaped = quoted & ~a["escaped"] & (c == "\\")
        return F.struct(
            depth.alias("depth"), quote.alias("quote"), escaped.alias("escaped"),
            F.when(cut, "").otherwise(F.concat(a["piece"], c)).alias("piece"),
            F.when(cut, F.concat(a["out"], F.array(trim(a["piece"])))).otherwise(a["out"]).alias("out"),
        )

    folded = F.aggregate(F.filter(F.split(selector, ""), lambda c: c != ""), start, step)
    return F.concat(folded["out"], F.array(trim(folded["piece"])))


def argument_end(s: Column) -> Column:
    """Where the parenthesis that is open at the start of s closes: 1-based, 0 if it doesn't. Brackets aren't counted."""
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        quoted, i = a["quote"] != "", a["i"] + 1
        depth = F.when(quoted, a["depth"]).when(c == "(", a["depth"] + 1).when(c == ")", a["depth"] - 1).otherwise(a["depth"])
        quote = F.when(quoted & ~a["escaped"] & (c == a["quote"]), "").when(~quoted & c.isin("'", '"'), c).otherwise(a["quote"])
        return F.struct(depth.alias("depth"), quote.alias("quote"), (quoted & ~a["escaped"] & (c == "\\")).alias("escaped"), i.alias("i"), F.when((a["end"] == 0) & (depth == 0) & ~quoted, i).otherwise(a["end"]).alias("end"))

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step)["end"]


def _rename(piece: Column, op: str, to: str) -> Column:
    """Every ``op(argument)`` under its other name; null where an argument is open or holds parentheses.

    The text is cut at the operator, so each part but the first begins with an argument.
    """
    parts = F.split(piece, any_of((op,)), -1)

    def one(p: Column) -> Column:
        return let(argument_end(p), lambda end: F.when((end > 0) & ~F.substring(p, F.lit(1), end - 1).rlike("[()]"), F.concat(F.lit(to), p)))

    # an argument that holds the operator itself has parentheses, and its own part is then open
    renamed = let(F.transform(F.slice(parts, 2, 1 << 30), one), lambda r: F.when(F.forall(r, lambda p: p.isNotNull()), F.array_join(r, "")))
    return F.when(F.instr(piece, op) > 0, F.concat(parts[0], renamed)).otherwise(piece)


def _renaming(op: str, to: str) -> Callable[[Column], Column]:
    return lambda piece: _rename(piece, op, to)


def _strip(piece: Column, op: str) -> Column:
    """A piece without any ``op(...)``; one that doesn't close stays."""
    parts = F.split(piece, any_of((op,)), -1)

    def one(p: Column) -> Column:
        return let(argument_end(p), lambda end: F.when(end > 0, F.substring(p, end + 1, F.length(p))).otherwise(F.concat(F.lit(op), p)))

    return F.when(F.instr(piece, op) > 0, trim(F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), "")))).otherwise(piece)


def rewrite_piece(piece: Column) -> Column:
    """A piece with operators renamed and watchers removed; null if it can't work. An empty piece stays."""
    s = trim(piece)
    for op, to in T.RENAMED.items():
        s = let(s, _renaming(op, to))
    dead = any_of(T.DEAD + T.EMPTY_ACTIONS)
    kept = let(s, lambda x: F.when(x.isNotNull() & ~x.rlike(dead), let(_strip(x, ":watch-attr("), lambda y: F.when(y != "", y))))
    return F.when(trim(piece) == "", F.lit("")).otherwise(kept)


def transform(line: Column) -> Column:
    """The rules that a line becomes (itself, if nothing is procedural)."""

    def made(parts: Column) -> Column:
        pieces = F.filter(F.transform(split_top_level(parts["selector"]), rewrite_piece), lambda p: p.isNotNull())
        return F.when(parts["selector"].rlike(_PROCEDURAL), F.transform(pieces, lambda p: F.concat(parts["host"], parts["sep"], p))).otherwise(F.array(line))

    return F.when(line.contains("##") | line.contains("#@#"), let(split_rule(line), made)).otherwise(F.array(line))


def contamination(line: Column) -> Column:
    """What an engine would choke on: 'dead operator', 'unsplit comma+op', or null."""
    sep = F.when(line.contains("#@#"), "#@#").when(line.contains("##"), "##")
    selector = F.substring(line, F.instr(line, sep) + F.length(sep), F.length(line))
    dead = selector.rlike(any_of(T.DEAD + tuple(T.RENAMED) + (":watch-attr(",) + T.EMPTY_ACTIONS))
    unsplit = selector.rlike(any_of(T.RUNNABLE)) & (F.size(split_top_level(selector)) > 1)
    return F.when(dead, "dead operator").when(unsplit, "unsplit comma+op")


def positive_hosts(host: Column) -> Column:
    """The distinct lower-case hosts of a rule's scope; null where it has none, or other than plain hosts."""
    tokens = F.filter(F.transform(F.split(host, ",", -1), trim), lambda t: t != "")
    plain = F.forall(tokens, lambda t: t.rlike(r"\A[A-Za-z0-9.-]+\z"))
    return F.when((F.size(tokens) > 0) & plain, F.array_distinct(F.transform(tokens, F.lower)))


def class_id_tokens(line: Column) -> Column:
    """array of struct(kind, token): the classes and ids that a selector names."""
    sep = F.when(line.contains("#@#"), "#@#").when(line.contains("##"), "##")
    selector = F.substring(line, F.instr(line, sep) + F.length(sep), F.length(line))
    found = F.regexp_extract_all(selector, F.lit(r"(?<![A-Za-z0-9_])([.#][A-Za-z0-9_-]+)"), F.lit(1))
    return F.when(sep.isNotNull(), F.transform(found, lambda x: F.struct(F.when(x.startswith("."), "class").otherwise("id").alias("kind"), F.substring(x, F.lit(2), F.length(x)).alias("token"))))
