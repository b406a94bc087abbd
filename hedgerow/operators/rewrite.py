"""Rewriting of rules to cheaper texts with the same meaning, and merging of rules that mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import tables as T

SAMPLES = 5


def _content_type(o: Column) -> Column:
    return F.regexp_replace(o, r"\A~+", "").isin(*T.CONTENT_TYPES)


def candidates(rule: Column) -> Column:
    """The texts that may replace a rule, in order: without $all, case folded, without wildcards at the edges."""
    pattern, options = rules.pattern_of(rule), rules.option_list(rule)
    other = F.filter(options, lambda o: o != "all")
    plain = F.filter(other, lambda o: ~_content_type(o))
    all_forms = F.array(rules.with_options(pattern, other), pattern, rules.with_options(pattern, F.concat(plain, F.array(F.lit("all")))), rules.with_options(pattern, plain))
    regex = rules.is_full_regex(rule)
    folded, bare = rules.lowercase_pattern(rule), rules.trim_wildcards(rule)
    return F.concat(
        F.when(F.array_contains(options, "all"), all_forms).otherwise(rules.none()),
        F.when(~regex & rules.mixed_case(rule), F.array(folded)).otherwise(rules.none()),
        F.when(~regex & (bare != rule), F.array(bare)).otherwise(rules.none()),
    )


def best_text(rule: Column) -> Column:
    """The least costly candidate that means the same; the rule itself where none is cheaper."""
    return rules.let(rules.trim(rule), lambda t: F.when(rules.kind(t) == "network", rules.let(rules.signature(t), lambda sig: _best(t, sig))).otherwise(t))


def _best(t: Column, sig: Column) -> Column:
    ranked = lambda c, i: F.struct(rules.rank(c).alias("rank"), i.alias("at"), c.alias("text"))
    same = F.filter(F.transform(candidates(t), lambda c, i: F.when(rules.signature(c) == sig, ranked(c, i))), lambda x: x.isNotNull())
    return F.array_min(F.concat(F.array(ranked(t, F.lit(-1))), same))["text"]


def diagnostics(rule: Column) -> Column:
    """struct of eight flags; null where a rule doesn't parse, all false for cosmetic rules."""
    t, what = rules.trim(rule), rules.kind(rule)
    options, pattern = rules.option_list(t), rules.pattern_of(rules.trim(rule))
    name = lambda o: F.substring_index(o, "=", 1)
    anchored = F.regexp_replace(F.regexp_replace(pattern, r"\A@@", ""), r"\A\|\|?", "")
    core = F.regexp_replace(anchored, r"\|\z", "")
    flags = {
        "is_network": F.lit(True),
        "is_regex": rules.is_regex(t),
        "is_complete_regex": rules.is_full_regex(t),
        "with_all": F.array_contains(options, "all"),
        "has_domain_opts": F.exists(options, lambda o: name(o).isin("domain", "from")),
        "has_modifier": F.exists(options, lambda o: name(o).isin("redirect", "redirect-rule", "rewrite", "csp", "removeparam")),
        "trimmable_wildcards": core.endswith("*") | (~anchored.startswith("|") & core.startswith("*")),
        "mixed_case": rules.mixed_case(t),
    }
    network = F.struct(*[v.alias(k) for k, v in flags.items()])
    nothing = F.struct(*[F.lit(False).alias(k) for k in flags])
    return F.when(what == "network", network).when(what == "cosmetic", nothing)


def rewritten(table: DataFrame) -> DataFrame:
    """(rule, ord_key) with best and sig; rules that don't parse have a null sig."""
    return table.withColumn("best", best_text(F.col("rule"))).withColumn("sig", rules.signature(F.col("rule")))


def semantic_merge(table: DataFrame) -> DataFrame:
    """Of rules that mean the same the one with the least costly text, rewritten; the first in order breaks ties.
    Rules that don't parse go. The new order is that of the texts."""
    rows = rewritten(table).filter("sig is not null")
    order = F.struct(rules.rank(F.col("best")).alias("rank"), F.col("ord_key"))
    merged = rows.groupBy("sig").agg(F.min_by("best", order).alias("rule"))
    return merged.select("rule", F.col("rule").alias("ord_key"))


CATEGORIES = ("regex", "all", "wildcards", "mixed-case", "rewritten")


def categories(table: DataFrame) -> DataFrame:
    """(rule, category): a row for each kind of inefficiency of a rule."""
    d = diagnostics(F.col("rule"))
    rows = table.select("rule", d.alias("d"), best_text(F.col("rule")).alias("best"))
    holds = {"regex": "d.is_regex", "all": "d.with_all", "wildcards": "d.trimmable_wildcards", "mixed-case": "d.mixed_case", "rewritten": "d is not null and best <> rule"}
    found = F.filter(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in holds.items()]), lambda x: x.isNotNull())
    return rows.select("rule", F.explode(found).alias("category"))


def samples(table: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first n rules of each category."""
    order = Window.partitionBy("category").orderBy("rule")
    return categories(table).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def inefficiency(table: DataFrame) -> DataFrame:
    """One row: how many rules have what, and how many a merge would leave."""
    d = diagnostics(F.col("rule"))
    rows = rewritten(table).withColumn("d", d)
    count = lambda e: F.count_if(F.coalesce(F.expr(e), F.lit(False)))
    return rows.agg(
        F.count("*").alias("total"), count("d.is_network").alias("network"), count("d.is_regex").alias("regex"), count("d.with_all").alias("with_all"),
        count("d.has_domain_opts").alias("with_domains"), count("d.has_modifier").alias("with_modifier"), count("d.trimmable_wildcards").alias("wildcards"), count("d.mixed_case").alias("mixed_case"),
        count("d is not null and best <> rule").alias("rewritten"), (F.count("*") - F.countDistinct("sig")).alias("merged"),
        F.when(F.count("*") > 0, F.round(100.0 * count("d.is_regex") / F.count("*"), 3)).otherwise(0.0).alias("regex_pct"),
    )
