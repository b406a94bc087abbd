"""Audit operators: probes, samples, estimates and before/after comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosmetic, rules
from .match import cosmetic_resources
from .requests import check_requests
from .storage import stored

#: Hosts that every audit probes (fixed values).
PROBED_HOSTS = (
    "example.com", "example.org", "www.google.com", "www.youtube.com", "m.facebook.com", "reddit.com", "www.reddit.com", "amazon.com",
    "www.amazon.com", "x.com", "github.com", "docs.rs", "developer.mozilla.org", "mail.google.com", "news.ycombinator.com",
    "stackoverflow.com", "www.netflix.com", "store.steampowered.com", "play.google.com", "apis.google.com", "google.com", "youtube.com", "facebook.com",
)
#: The page that audits' requests come from (a fixed value).
PROBING_SITE = "https://www.example.com/"
MAX_HOSTS, SAMPLE = 20_000, 50_000


def audit_simple(table: DataFrame) -> DataFrame:
    """(rule, host, path) of the rules that the audits take as simple: they end in a caret; only a double at sign is barred."""
    fits = ~F.col("rule").rlike(r"[*$]|@@") & F.col("rule").rlike(r"(?s)\A\|\|[a-z0-9.-]*(?:/.*)?\^\z")
    body = F.regexp_extract("rule", r"(?s)\A\|\|(.*)\^\z", 1)
    return table.filter(fits).select("rule", F.substring_index(body, "/", 1).alias("host"), F.regexp_extract(body, r"(?s)\A[^/]*/(.*)\z", 1).alias("path"))


def subsumable(table: DataFrame) -> DataFrame:
    """One row: simple rules, those that stay if others' bare hosts and same-host path prefixes cover, mean bytes, saving."""
    simple = audit_simple(table)
    bare = simple.filter("path = ''").select("host").distinct()
    under = simple.select("host", "path").distinct().select("host", "path", F.explode(rules.label_suffixes(F.col("host"))).alias("up")).filter("path <> '' or up <> host")
    by_host = under.join(bare.select(F.col("host").alias("up")), "up", "left_semi").select("host", "path").distinct()
    parts = simple.filter("path <> ''").select("host", "path").distinct().select("host", "path", F.explode(rules.path_prefixes(F.col("path"))).alias("part")).filter("part <> path and part <> ''")
    by_path = parts.join(simple.select("host", F.col("path").alias("part")).distinct(), ["host", "part"], "left_semi").select("host", "path").distinct()
    covered = by_host.union(by_path).distinct().withColumn("covered", F.lit(True))
    order = Window.partitionBy("host", "path").orderBy("rule")
    rows = simple.withColumn("n", F.row_number().over(order)).join(covered, ["host", "path"], "left")
    stays = F.col("covered").isNull() & ((F.col("path") != "") | (F.col("n") == 1))
    total = rows.agg(F.count("*").alias("simple"), F.count_if(stays).alias("kept"))
    size = table.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("bytes"))
    return total.join(size, F.lit(True)).select("simple", "kept", (F.col("simple") - F.col("kept")).alias("removable"), F.when(F.col("lines") > 0, F.round((F.col("simple") - F.col("kept")) * F.col("bytes") / F.col("lines") / 1e6, 6)).otherwise(0.0).alias("saving_mb"))


def probe_requests(table: DataFrame) -> DataFrame:
    """(rule, url): the request that each audit-simple rule must block."""
    return audit_simple(table).select("rule", F.concat(F.lit("https://"), "host", F.lit("/"), "path").alias("url"))


def probe_urls(table: DataFrame) -> DataFrame:
    """(rule, url): requests at the edges of each simple rule's host and path."""
    x = table.select("rule", rules.simple_rule(F.col("rule")).alias("x")).filter("x is not null").select("rule", "x.host", "x.path")
    base = F.concat(F.lit("https://"), "host", F.lit("/"), "path")
    root = lambda sub: F.concat(F.lit(f"https://{sub}"), "host", F.lit("/"))
    always = [base, F.concat(base, F.lit("/extra")), F.concat(base, F.lit("?q=1")), root(""), root("www."), root("deep.sub.")]
    pathed = [F.concat(root("www."), "path"), F.concat(base, F.lit("x"))]
    urls = F.when(F.col("path") == "", F.array(*always)).otherwise(F.array(*always, *pathed))
    return x.select("rule", F.explode(F.array_distinct(urls)).alias("url"))


def sample_hosts(table: DataFrame, cap: int = MAX_HOSTS) -> DataFrame:
    """(host): fixed hosts and those that cosmetic rules name alone, with two subdomains of each; the first ``cap``."""
    sep = F.when(F.col("rule").contains("#@#"), "#@#").when(F.col("rule").contains("##"), "##")
    named = table.select(rules.trim(F.substring(F.col("rule"), F.lit(1), F.instr(F.col("rule"), sep) - 1)).alias("host")).filter(F.col("host").rlike(r"\A[a-z0-9.-]+\z"))
    fixed = table.sparkSession.createDataFrame([(h,) for h in PROBED_HOSTS], "host string")
    every = named.union(fixed).distinct().select(F.explode(F.array("host", F.concat(F.lit("www."), "host"), F.concat(F.lit("deep.sub."), "host"))).alias("host"))
    return every.distinct().orderBy("host").limit(cap)


def systematic_sample(table: DataFrame, n: int = SAMPLE) -> DataFrame:
    """Every k-th rule in order, k the whole part of rows by n (1 at least). Ranks come from the range partitions' sizes,
    so no task sees all rows."""
    # stored, as sizes and ranks must see the same ranges
    ordered = stored(table.select("rule").repartitionByRange("rule").withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("size").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("rule")) - 1
    step = F.greatest(F.floor(F.col("total") / n), F.lit(1))
    return ordered.withColumn("i", rank).join(before, "part").filter((F.col("i") + F.col("before")) % step == 0).select("rule")


def badfiltered(table: DataFrame) -> DataFrame:
    """(pattern): what rules with the lone option badfilter cancel."""
    return table.filter(F.col("rule").endswith("$badfilter")).select(F.regexp_replace("rule", r"\$badfilter\z", "").alias("pattern")).distinct()


def contamination(table: DataFrame) -> DataFrame:
    """(rule, problem) of cosmetic rules that should have been rewritten."""
    return table.select("rule", cosmetic.contamination(F.col("rule")).alias("problem")).filter("problem is not null")


def check_urls(urls: DataFrame, table: DataFrame) -> DataFrame:
    """check_requests of urls(url) as an audit asks: of no type, from a site of its own."""
    return check_requests(urls.select("url", F.lit(PROBING_SITE).alias("source"), F.lit("other").alias("type")), table)


def liveness(table: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row: sampled rules, dead ones that badfilters explain, other dead ones, verdict."""
    probes = probe_requests(sampled)
    blocked = check_urls(probes, table).select("url", "blocked")
    rows = probes.join(blocked, "url").join(badfiltered(table).withColumnRenamed("pattern", "rule").withColumn("expected", F.lit(True)), "rule", "left")
    found = rows.agg(F.count("*").alias("sampled"), F.count_if(~F.col("blocked") & F.col("expected").isNotNull()).alias("expected_dead"), F.count_if(~F.col("blocked") & F.col("expected").isNull()).alias("dead"))
    dirty = contamination(table).agg(F.count("*").alias("contaminated"))
    return found.join(dirty, F.lit(True)).withColumn("passed", (F.col("dead") == 0) & (F.col("contaminated") == 0))


def growth(now: int, baseline: int) -> tuple[int, float]:
    """Lines more than the baseline, and percent of it (0 for none)."""
    return now - baseline, 100.0 * (now - baseline) / baseline if baseline else 0.0


def compare_network(before: DataFrame, after: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: requests, and those on which the two lists differ in blocking, exceptions or redirects."""
    requests = stored(requests.select("url").distinct())  # each list's answers read it
    answers = ("blocked", "exception", "redirect")
    side = lambda t, n: check_urls(requests, t).select("url", F.struct(*answers).alias(n))
    both = side(before, "a").join(side(after, "b"), "url", "full")
    return both.agg(F.count("*").alias("requests"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


def serialized(table: DataFrame) -> DataFrame:
    """One row: rules, bytes with line breaks, and a hash that doesn't depend on order."""
    return table.agg(F.count("*").alias("rules"), F.coalesce(F.sum(F.octet_length("rule") + 1), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(F.xxhash64("rule")), F.lit(0)).alias("hash"))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rules of one list whose text isn't in another."""
    return before.select("rule").distinct().join(after.select("rule"), "rule", "left_anti")


def adversarial_corpus(before: DataFrame, rewritten: DataFrame, after: DataFrame, cap: int = 600_000) -> DataFrame:
    """(url): probes of the rules that a pass removed and of those that it wrote anew (rule, best); the first ``cap``."""
    gone = removed(before, after).union(rewritten.filter("best <> rule").select("rule")).distinct()
    return probe_urls(gone).select("url").distinct().orderBy("url").limit(cap)


def compare_cosmetic(pages: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(host, only_before, only_after): hosts whose hidden or spared (marked #@#) selectors differ, with up to five of each side."""
    named = lambda c, mark: F.transform(F.filter(F.split(c, "\n"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    side = lambda t, n: cosmetic_resources(pages, t).select("host", F.concat(named("hide", ""), named("exceptions", "#@#")).alias(n))
    both = side(before, "a").join(side(after, "b"), "host", "full")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    less = lambda x, y: F.array_join(F.slice(F.array_sort(F.array_except(x, y)), 1, 5), ",")
    return both.select("host", less(a, b).alias("only_before"), less(b, a).alias("only_after")).filter("only_before <> '' or only_after <> ''")


def partition_lines(lines: DataFrame, kept_cosmetic: DataFrame) -> DataFrame:
    """The lines that aren't cosmetic, and the cosmetic ones that are kept."""
    is_cosmetic = F.col("rule").rlike("#@?#|#[?]#")
    return lines.filter(~is_cosmetic).unionByName(lines.filter(is_cosmetic).join(kept_cosmetic.select("rule"), "rule", "left_semi").select(*lines.columns))
