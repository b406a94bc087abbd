"""Requests against rules: network checks of host-and-path rules, and cosmetic resources of a page.

A request is exploded to its host's parents and to every leading part of its path that ends at a separator, so matching
is an equi-join; no rule is tried against every request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cosmetic, rules

_URL = r"(?i)\A[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(.*)\z"


def host_of(url: Column) -> Column:
    return rules.ascii_lower(F.regexp_extract(url, _URL, 1))


def request_keys(requests: DataFrame, url: str = "url") -> DataFrame:
    """(url, host, lpath, next): what a rule's host and path may be, and the character after it ('' at the end)."""
    rest = rules.ascii_lower(F.regexp_extract(F.col(url), f"(?s){_URL}", 2))
    rows = requests.select(url).distinct().withColumn("h", host_of(F.col(url))).withColumn("rest", rest)
    ends = F.filter(F.sequence(F.lit(0), F.length("rest")), lambda i: (i == F.length("rest")) | F.substring(F.col("rest"), i + 1, F.lit(1)).rlike(r"[^A-Za-z0-9_.%-]"))
    cut = F.transform(ends, lambda i: F.struct(F.substring(F.col("rest"), F.lit(1), i).alias("part"), F.substring(F.col("rest"), i + 1, F.lit(1)).alias("next")))
    rows = rows.select(url, F.explode(rules.label_suffixes(F.col("h"))).alias("host"), cut.alias("cuts")).select(url, "host", F.explode("cuts").alias("c"))
    return rows.select(url, "host", F.regexp_replace("c.part", r"\A/", "").alias("lpath"), (F.col("c.part") == "").alias("bare"), F.col("c.next").alias("next"))


def rule_keys(table: DataFrame) -> DataFrame:
    """(rule, exception, host, lpath, bare, slash) of the option-less host-and-path rules, exceptions included."""
    text = F.regexp_replace("rule", r"\A@@", "")
    rows = table.select("rule", F.col("rule").startswith("@@").alias("exception"), text.alias("text"), rules.simple_rule(text).alias("x")).filter("x is not null")
    bare = ~F.substring("text", 3, 1 << 20).rlike(r"(?s)\A[^/]*/.")  # no path; a lone slash at the end is its terminator
    return rows.select("rule", "exception", "x.host", rules.ascii_lower(F.col("x.path")).alias("lpath"), bare.alias("bare"), F.col("text").endswith("/").alias("slash"))


def hits(requests: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
    """(url, rule, exception): every match."""
    keys = rule_keys(table)
    asked = request_keys(requests, url)
    return asked.join(keys, ["host", "lpath", "bare"]).filter(~F.col("slash") | (F.col("next") == "/")).select(url, "rule", "exception").distinct()


def network_match(requests: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
    """(url, hit, exception, blocked) of each distinct request; an exception suppresses blocking."""
    found = hits(requests, table, url).groupBy(url).agg(F.bool_or(~F.col("exception")).alias("hit"), F.bool_or("exception").alias("exception"))
    no = F.lit(False)
    rows = requests.select(url).distinct().join(found, url, "left").select(url, F.coalesce("hit", no).alias("hit"), F.coalesce("exception", no).alias("exception"))
    return rows.withColumn("blocked", F.col("hit") & ~F.col("exception"))


def cosmetic_resources(pages: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
    """(host, hide, exceptions): the selectors of each page host, sorted and joined by newlines; exceptions take away."""
    parts = cosmetic.split_rule(F.col("rule"))
    rows = table.select(parts.alias("x")).filter("x is not null").select("x.sep", "x.selector", cosmetic.positive_hosts(F.col("x.host")).alias("hosts")).filter("hosts is not null")
    keyed = rows.select("sep", "selector", F.explode("hosts").alias("up"))
    hosts = pages.select(host_of(F.col(url)).alias("host")).distinct().select("host", F.explode(rules.label_suffixes(F.col("host"))).alias("up"))
    found = hosts.join(keyed, "up").select("host", "sep", "selector").distinct().groupBy("host", "selector").agg(F.bool_or(F.col("sep") == "##").alias("hides"), F.bool_or(F.col("sep") == "#@#").alias("spared"))
    text = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("selector")))), "\n")
    return found.groupBy("host").agg(text(F.col("hides") & ~F.col("spared")).alias("hide"), text(F.col("spared")).alias("exceptions"))


def generic_selectors(table: DataFrame, classes: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(selector) of generic rules whose class or id is among classes(kind, token), but for exceptions(selector)."""
    parts = cosmetic.split_rule(F.col("rule"))
    generic = table.select("rule", parts.alias("x")).filter("x is not null and x.host = '' and x.sep = '##'")
    named = generic.select("x.selector", F.explode(cosmetic.class_id_tokens(F.col("rule"))).alias("t")).select("selector", "t.kind", "t.token")
    return named.join(classes, ["kind", "token"], "left_semi").select("selector").distinct().join(exceptions, "selector", "left_anti")
