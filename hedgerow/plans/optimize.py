"""The passes over a list's rules, in order, with their counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import rewrite, subsume
from ..operators.storage import stored


@dataclass
class Optimized:
    """The rules that stay (rule, ord_key) and, once ``counted``, the counters."""

    rules: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)

    def counted(self) -> DataFrame:
        """One row of counters: what came in, duplicates, and what each pass removed or changed."""
        n = {k: df.agg(F.count("*").alias(k)) for k, df in self.stages.items()}
        rows = n.pop("input")
        for df in n.values():
            rows = rows.crossJoin(df)  # one row each
        has = set(self.stages)
        less = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0)) if {a, b} <= has else F.lit(0).cast("long")
        before_network = "cosmetic" if "cosmetic" in has else "unique"
        changed = self.stages["caret"].agg(F.count_if(F.col("rule") != F.col("ord_key")).alias("caret_converted")) if "caret" in has else None
        if changed is not None:
            cheaper = rewrite.rewritten(self.stages[before_network]).agg(F.count_if(F.col("sig").isNotNull() & (F.col("best") != F.col("rule"))).alias("rewritten"))
            rows = rows.crossJoin(changed).crossJoin(cheaper)
        return rows.select(
            "input", "unique", (F.col("input") - F.col("unique")).alias("duplicates"), less("unique", "cosmetic").alias("cosmetic_subsumed"), (F.col("rewritten") if changed is not None else F.lit(0).cast("long")).alias("rewritten"), less(before_network, "merged").alias("semantic_merged"),
            (F.col("caret_converted") if changed is not None else F.lit(0).cast("long")).alias("caret_converted"), less("stripped", "network").alias("network_subsumed"), less("network", "scoped").alias("scoped_subsumed"),
        )


def optimize(lines: DataFrame, cosmetic_compat: bool = True, network_optimize: bool = True, keep: Callable[[DataFrame], DataFrame] = stored) -> Optimized:
    """lines(rule) to the rules that stay. Each pass is a table of its own; ``keep`` stores a pass's rows where several
    readers would compute them again.

    Order: exact duplicates; host-covered cosmetic rules; cheaper texts and merging; carets; badfilters; covered hosts
    and paths; scoped rules. Sort by ord_key where the list is written: sorting comes before caret conversion.
    """
    stages = {"input": lines.select("rule")}
    table = stages["unique"] = keep(subsume.distinct_rules(lines))
    if cosmetic_compat:
        table = stages["cosmetic"] = subsume.cosmetic_subsume(table)
    if network_optimize:
        table = stages["merged"] = keep(rewrite.semantic_merge(table))
        table = stages["caret"] = subsume.convert_carets(table)
        table = stages["stripped"] = keep(subsume.strip_badfilters(table))
        table = stages["network"] = keep(subsume.network_subsume(table))
        table = stages["scoped"] = subsume.scoped_subsume(table)
    return Optimized(table, stages)


def sorted_rules(table: DataFrame) -> DataFrame:
    """The list's order: by ord_key, in bytes."""
    return table.orderBy("ord_key", "rule")


def rule_lines(texts: DataFrame) -> DataFrame:
    """Non-blank, non-comment lines of a rule list, as (rule)."""
    return texts.select(rules.trim(F.col("raw")).alias("rule")).filter((F.col("rule") != "") & ~F.col("rule").startswith("!"))
