"""Operators that drop rules which others make needless: exact duplicates, covered hosts and paths, cancelled, scoped
and host-covered cosmetic rules. All are distinct, equi-joins and anti-joins; no pair of a group is emitted beyond those
that share a key.

Rules are tables ``(rule, ord_key)``: ord_key is the text by which the list is in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cosmetic, rules
from ..functions import tables as T
from .storage import stored


def distinct_rules(lines: DataFrame) -> DataFrame:
    """Each rule text once, as (rule, ord_key)."""
    return lines.select("rule").distinct().select("rule", F.col("rule").alias("ord_key"))


def parsed_simple(table: DataFrame) -> DataFrame:
    """The host-and-path rules with host and path."""
    return table.withColumn("x", rules.simple_rule(F.col("rule"))).filter("x is not null").select(*table.columns, "x.host", "x.path")


def network_subsume(table: DataFrame, strict: bool = False) -> DataFrame:
    """Without rules that a rule for a parent host, or for a leading part of the path, covers. Of rules for one host and
    path (in any case of letters) the first in order stays; others pass.

    A rule's end, caret or slash, doesn't count. With ``strict`` it does: a slash covers what goes on after it, and a
    caret of the same host and path or a parent's also covers a slash, but not the other way.
    """
    ends = F.when(F.lit(strict) & F.col("rule").endswith("/"), "/").otherwise("^")
    marked = table.withColumn("x", rules.simple_rule(F.col("rule"))).withColumn("host", F.col("x.host")).withColumn("lpath", rules.ascii_lower(F.col("x.path"))).withColumn("end", ends).drop("x")
    simple = (F.col("host").isNotNull()) & (F.col("host") != "")
    # stored: rules, their ancestors and the keys are read from it
    first = stored(marked.filter(simple).groupBy("host", "lpath", "end").agg(F.min(F.struct("ord_key", "rule")).alias("first")))
    keys = first.select(F.col("host").alias("up"), F.col("lpath").alias("part"), F.col("end").alias("by"))
    hosts = first.select("host", "lpath", "end", F.explode(rules.label_suffixes(F.col("host"))).alias("up"))
    above = hosts.select("host", "lpath", "end", "up", F.explode(rules.path_prefixes(F.col("lpath"))).alias("part"))
    if strict:
        covers = above.join(keys, ["up", "part"]).filter("(up <> host or part <> lpath or by <> end) and (part <> lpath or by = '^' or by = end)")
    else:
        covers = above.filter("up <> host or part <> lpath").join(keys, ["up", "part"], "left_semi")
    kept = first.join(covers.select("host", "lpath", "end"), ["host", "lpath", "end"], "left_anti").select("first.rule", "first.ord_key")
    return kept.unionByName(marked.filter(~simple | F.col("host").isNull()).select("rule", "ord_key"))


def strip_badfilters(table: DataFrame, strict: bool = False) -> DataFrame:
    """Without badfilter rules and the rules that they cancel: equal pattern and equal other options, in order (with
    ``strict``, in any order)."""
    options = rules.option_list(F.col("rule"))
    marked = table.select("*", rules.pattern_of(F.col("rule")).alias("pattern"), (F.array_sort(options) if strict else options).alias("o")).withColumn("bad", F.array_contains("o", "badfilter"))
    cancelled = marked.filter("bad").select("pattern", F.array_join(F.filter("o", lambda o: o != "badfilter"), ",").alias("opts")).distinct()
    return marked.filter("not bad").withColumn("opts", F.array_join("o", ",")).join(cancelled, ["pattern", "opts"], "left_anti").select(*table.columns)


def scoped_subsume(table: DataFrame) -> DataFrame:
    """Without rules whose options only narrow them where the option-less twin is there."""
    narrow = F.forall(rules.option_list(F.col("rule")), lambda o: F.regexp_replace(o, r"\A~", "").isin(*T.NARROWING))
    scoped = F.col("rule").contains("$") & narrow
    twins = table.filter(~F.col("rule").contains("$")).select(F.col("rule").alias("pattern")).distinct()
    kept = table.filter(scoped).withColumn("pattern", rules.pattern_of(F.col("rule"))).join(twins, "pattern", "left_anti").select(*table.columns)
    return table.filter(~scoped).unionByName(kept)


def registrable(host: Column, suffixes: Sequence[str] = T.PUBLIC_SUFFIXES) -> Column:
    """The public suffix of a host and one label more; null where there is none. A host under no suffix of the table has
    its last label for one. ``*.x`` stands for every label below x, but for those named as ``!y.x``."""
    parents = rules.label_suffixes(host)
    public = F.split(F.lit("\n".join(suffixes)), "\n")
    known = lambda p: F.array_contains(public, p)
    if any(s.startswith(("*.", "!")) for s in suffixes):
        below = lambda p: F.array_contains(public, F.concat(F.lit("*."), F.regexp_replace(p, r"\A[^.]*\.", ""))) & p.contains(".")
        known = lambda p: (F.array_contains(public, p) | below(p)) & ~F.array_contains(public, F.concat(F.lit("!"), p))
    at = F.array_min(F.filter(F.transform(parents, lambda p, i: F.when(known(p), i)), lambda i: i.isNotNull()))
    at = F.coalesce(at, F.size(parents) - 1)
    return F.when(at > 0, F.get(parents, at - 1))


def cosmetic_subsume(table: DataFrame, suffixes: Sequence[str] = T.PUBLIC_SUFFIXES) -> DataFrame:
    """Without host-scoped plain cosmetic rules that another with the same selector covers: each of its hosts is one of
    the other's, or below one, within its registrable domain. Rules that cover each other both stay.

    Rules with the same selector and hosts are looked at once. A set of hosts is joined to those that may cover it by the
    one host of it that the fewest sets name or are above, so a host that many rules name brings no pairs by itself.
    """
    line = F.col("rule")
    parts = cosmetic.split_rule(line)
    plain = parts.isNotNull() & ~parts["selector"].rlike(cosmetic._PROCEDURAL)
    scoped = table.withColumn("sep", F.when(plain, parts["sep"])).withColumn("selector", F.when(plain, parts["selector"])).withColumn("hosts", F.array_sort(F.when(plain, cosmetic.positive_hosts(parts["host"]))))
    reach = lambda token: F.filter(rules.label_suffixes(token), lambda s: F.length(s) >= F.length(registrable(token, suffixes)))
    key = ["sep", "selector"]
    # stored: sets, what they name and what they are below are read from it
    sets = stored(scoped.filter("hosts is not null").select(*key, "hosts").distinct().withColumn("reach", F.transform("hosts", reach)))
    tokens = sets.select(*key, F.col("hosts").alias("cover"), F.col("reach").alias("above"), F.explode("hosts").alias("up"))
    named = tokens.groupBy(*key, "up").agg(F.count("*").alias("n"))
    below = sets.select(*key, "hosts", F.posexplode("reach").alias("i", "ups")).select(*key, "hosts", "i", F.explode("ups").alias("up"))
    few = below.join(named, [*key, "up"]).groupBy(*key, "hosts", "i").agg(F.sum("n").alias("n")).groupBy(*key, "hosts").agg(F.min_by("i", F.struct("n", "i")).alias("i"))
    covers = lambda by, ups: F.forall(ups, lambda u: F.arrays_overlap(u, by))
    asked = sets.join(few, [*key, "hosts"]).select(*key, "hosts", "reach", F.explode(F.get("reach", F.col("i"))).alias("up"))
    pairs = asked.join(tokens, [*key, "up"]).filter(F.col("cover") != F.col("hosts"))
    gone = pairs.filter(covers(F.col("cover"), F.col("reach")) & ~covers(F.col("hosts"), F.col("above"))).select(*key, "hosts").distinct()
    return scoped.join(gone, [*key, "hosts"], "left_anti").select(*table.columns)


def convert_carets(table: DataFrame) -> DataFrame:
    """Bare-host rules with a slash for their caret; ord_key stays, so the order of the list doesn't change."""
    return table.withColumn("rule", rules.caret_to_slash(F.col("rule")))
