"""Lines of lists to classified rules, and what is counted on the way.

``lines`` is a table (list_id, line_no, raw, hosts); stages fan out by explode and keep a key, so that one table feeds
both the kept rules and the statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cosmetic, rules
from ..functions import tables as T

COUNTERS = ("total_lines", "network_rules", "cosmetic_rules", "empty", "unsupported", "invalid", "scriptlets_removed", "redirects_removed", "hosts_converted", "unsupported_options", "unsupported_cosmetic", "cosmetic_transforms")


def split_lines(texts: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """(keys, line_no, raw): the lines of texts; a line break at the end begins no line."""
    parts = F.split(F.col(text), "\r?\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return texts.select(*keys, F.posexplode(kept).alias("line_no", "raw"))


def normalized(lines: DataFrame) -> DataFrame:
    """lines with t (trimmed) and n: struct(lines, hosts_converted)."""
    t = rules.trim(F.col("raw"))
    return lines.withColumn("t", t).withColumn("n", F.when(F.col("hosts"), rules.normalize_hosts_line(F.col("raw"))).otherwise(rules.normalize_line(F.col("raw"))))


def products(lines: DataFrame, compat: bool = True) -> DataFrame:
    """A row for each rule that a line makes (one with nulls where it makes none), with the flags that are counted."""
    rows = normalized(lines)
    blank = F.col("t") == ""
    base = rows.select(
        *lines.columns, blank.alias("blank"), (~blank & F.col("n.hosts_converted")).alias("converted"), (~blank & (F.size("n.lines") == 0)).alias("nothing"),
        F.posexplode_outer(F.when(~blank, F.col("n.lines"))).alias("c_no", "candidate"),
    )
    made = cosmetic.transform(F.col("candidate")) if compat else F.array("candidate")
    base = base.withColumn("made", F.when(F.col("candidate").isNotNull(), made))
    base = base.withColumn("transformed", F.col("candidate").isNotNull() & ~((F.size("made") == 1) & (F.get("made", F.lit(0)) == F.col("candidate"))))
    base = base.withColumn("dropped", F.col("candidate").isNotNull() & (F.size("made") == 0))
    return base.select("*", F.posexplode_outer("made").alias("p_no", "rule")).drop("made")


def classified(lines: DataFrame, compat: bool = True, scriptlets: bool = True, allowed: tuple[str, ...] = T.REDIRECT_ALLOWLIST) -> DataFrame:
    """products with the bucket of each rule."""
    return products(lines, compat).withColumn("bucket", F.when(F.col("rule").isNotNull(), rules.bucket(F.col("rule"), scriptlets, allowed)))


def kept(found: DataFrame) -> DataFrame:
    """The rules that stay."""
    return found.filter(F.col("bucket").isin("network", "cosmetic")).select("rule")


def stats(found: DataFrame, *keys: str) -> DataFrame:
    """The twelve counters by key. A line's own flags count once, however many rules it makes."""
    first_of_line = F.coalesce(F.col("c_no"), F.lit(0)) + F.coalesce(F.col("p_no"), F.lit(0)) == 0
    first_of_candidate = F.coalesce(F.col("p_no"), F.lit(0)) == 0

    def n(cond: Column) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False)))

    b = lambda name: F.col("bucket") == name
    return found.groupBy(*keys).agg(
        n(first_of_line).alias("total_lines"), n(b("network")).alias("network_rules"), n(b("cosmetic")).alias("cosmetic_rules"),
        n((first_of_line & F.col("blank")) | b("empty")).alias("empty"), n((first_of_line & F.col("nothing")) | b("unsupported")).alias("unsupported"), n(b("invalid")).alias("invalid"),
        n(b("scriptlets_removed")).alias("scriptlets_removed"), n(b("redirects_removed")).alias("redirects_removed"), n(first_of_line & F.col("converted")).alias("hosts_converted"),
        n(b("unsupported_options")).alias("unsupported_options"), n((first_of_candidate & F.col("dropped")) | b("unsupported_cosmetic")).alias("unsupported_cosmetic"), n(first_of_candidate & F.col("transformed")).alias("cosmetic_transforms"),
    )
