"""The rule-list queries by name, and the SQL that they are held against; the SQL goes other ways where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cosmetic, rules
from ..functions import tables as T
from ..operators import audit, classify, match, requests, rewrite, subsume
from ..operators.storage import stored
from ..sources.lists import expand_edges
from .build import totals
from .corpora import FREE, MATCHED, ODD, corpus, sql
from .optimize import optimize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, d: str, *names: str) -> DataFrame:
    df = corpus(spark, d, *names)
    return subsume.distinct_rules(df.withColumnRenamed("line", "rule") if "line" in df.columns else df)


_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_SIMPLE = r"^\|\|([a-z0-9.-]*)(/(.*))?[\^/]$"
_PARSED = rf"SELECT rule, regexp_extract(rule, '{_SIMPLE}', 1) AS host, regexp_extract(rule, '{_SIMPLE}', 3) AS path FROM r WHERE regexp_matches(rule, '{_SIMPLE}') AND NOT regexp_matches(rule, '[*$@]')"
_PARTS = "*, CASE WHEN contains(rule, '$') THEN regexp_extract(rule, '^(.*)[$][^$]*$', 1) ELSE rule END AS pattern, CASE WHEN contains(rule, '$') THEN regexp_extract(rule, '[$]([^$]*)$', 1) ELSE '' END AS opts"


@_query(f"SELECT DISTINCT rule FROM ({sql('F1')}) ORDER BY rule")
def rule_distinct_sorted(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "F1").orderBy("ord_key").select("rule")


@_query(f"WITH r AS (SELECT DISTINCT rule FROM ({sql('F1', 'F2')})) {_PARSED}")
def network_simple_parse(spark: SparkSession, d: str) -> DataFrame:
    return subsume.parsed_simple(_table(spark, d, "F1", "F2")).select("rule", "host", "path")


def _subsumed(c: str) -> str:
    return f"""WITH r AS ({c}), s AS (SELECT rule, host, lower(path) AS p, row_number() OVER (PARTITION BY host, lower(path) ORDER BY rule) AS n FROM ({_PARSED})),
        up AS (SELECT rule, host, p, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS h FROM s WHERE n = 1),
        gone AS (SELECT DISTINCT up.rule FROM up JOIN s b ON b.host = up.h WHERE (b.host <> up.host OR b.p <> up.p) AND (b.p = '' OR b.p = up.p OR starts_with(up.p, b.p || '/')))
        SELECT rule FROM s WHERE n = 1 AND rule NOT IN (SELECT rule FROM gone)"""


@_query(_subsumed(sql("F1")))
def network_subsume(spark: SparkSession, d: str) -> DataFrame:
    return subsume.network_subsume(_table(spark, d, "F1")).select("rule")


@_query(f"SELECT (SELECT count(*) FROM ({sql('F1')})) AS n_in, (SELECT count(*) FROM ({_subsumed(sql('F1'))})) AS n_out")
def network_subsume_removed_count(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "F1")
    return t.agg(F.count("*").alias("n_in")).join(subsume.network_subsume(t).agg(F.count("*").alias("n_out")), F.lit(True))


@_query(_subsumed(sql("F8")))
def network_subsume_large(spark: SparkSession, d: str) -> DataFrame:
    return subsume.network_subsume(_table(spark, d, "F8")).select("rule")


@_query(rf"""WITH r AS (SELECT DISTINCT rule FROM ({sql("F1", "F2")})), p AS (SELECT {_PARTS} FROM r), c AS (SELECT rule, CASE WHEN regexp_matches(pattern, '^\|\|[^/*@]+\^$') THEN regexp_replace(pattern, '\^$', '/') || CASE WHEN opts <> '' THEN '$' || opts ELSE '' END ELSE rule END AS converted FROM p)
    SELECT rule, converted, converted <> rule AS changed FROM c""")
def caret_to_slash(spark: SparkSession, d: str) -> DataFrame:
    c = rules.caret_to_slash(F.col("rule"))
    return _table(spark, d, "F1", "F2").select("rule", c.alias("converted"), (c != F.col("rule")).alias("changed"))


@_query(f"""WITH r AS (SELECT DISTINCT rule FROM ({sql("F2")})), p AS (SELECT {_PARTS} FROM r)
    SELECT rule FROM p WHERE opts NOT LIKE '%badfilter%' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.opts LIKE '%badfilter%' AND b.pattern = p.pattern AND regexp_replace(b.opts, ',?badfilter', '') = p.opts)""")
def badfilter_strip(spark: SparkSession, d: str) -> DataFrame:
    return subsume.strip_badfilters(_table(spark, d, "F2")).select("rule")


@_query(f"""WITH r AS (SELECT DISTINCT rule FROM ({sql("F2")})), p AS (SELECT {_PARTS} FROM r)
    SELECT rule FROM p WHERE NOT (opts <> '' AND len(list_filter(string_split(opts, ','), lambda o: regexp_replace(o, '^~', '') NOT IN ({_quoted(T.NARROWING)}))) = 0 AND EXISTS (SELECT 1 FROM r b WHERE b.rule = p.pattern))""")
def scoped_subsume(spark: SparkSession, d: str) -> DataFrame:
    return subsume.scoped_subsume(_table(spark, d, "F2")).select("rule")


_HOSTS = f"""SELECT page_id, '||' || h || '^' AS rule FROM (SELECT page_id, regexp_replace(regexp_replace(lower(t), '[.]+$', ''), '^[*][.]', '') AS h FROM
    (SELECT page_id, unnest(CASE WHEN line LIKE '#%' THEN [] WHEN contains(line, ' ') THEN string_split(split_part(line, ' #', 1), ' ')[2:] ELSE [line] END) AS t FROM ({sql("F4")})))
    WHERE h NOT IN ({_quoted(T.LOCAL_NAMES)})"""


@_query(_HOSTS)
def hosts_expand(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "F4").select("page_id", F.explode(rules.normalize_hosts_line(F.col("line"))["lines"]).alias("rule"))


_OPTION = """CASE o WHEN 'empty' THEN 'redirect=empty' WHEN 'mp4' THEN 'redirect=noop-1s.mp4' WHEN 'redirect=noopjs' THEN 'redirect=noop.js' WHEN 'redirect-rule=noopmp4-1s' THEN 'redirect-rule=noop-1s.mp4'
    WHEN 'rewrite=abp-resource:blank-js' THEN 'rewrite=noop.js' ELSE o END"""
_OPTIONS = f"SELECT line, split_part(line, '$', 1) || '$' || array_to_string(list_transform(string_split(split_part(line, '$', 2), ','), lambda o: {_OPTION}), ',') AS normalized FROM ({sql('F3')})"


@_query(_OPTIONS)
def option_normalize(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "F3").select("line", rules.normalize_options(F.col("line")).alias("normalized"))


@_query(f"""SELECT normalized AS rule FROM ({_OPTIONS}) WHERE NOT regexp_matches(normalized, '[$,](redirect|redirect-rule|rewrite)=') OR regexp_extract(normalized, '[$,](redirect|redirect-rule|rewrite)=([^,]*)', 2) IN ({_quoted(T.REDIRECT_ALLOWLIST)})""")
def redirect_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d, "F3").select(rules.normalize_options(F.col("line")).alias("rule"))
    return rows.filter(~rules.is_unsupported_redirect(F.col("rule")))


@_query(f"SELECT line FROM ({sql('F5')}) WHERE line NOT LIKE '%##+js(%' AND line NOT LIKE '%script:inject(%'")
def scriptlet_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "F5").filter(~rules.is_scriptlet(F.col("line")))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    row = lambda n, name, hosts: corpus(spark, d, n).select(F.lit(name).alias("list_id"), F.lit(0).alias("line_no"), F.col("line").alias("raw"), F.lit(hosts).alias("hosts"))
    return row("F3", "options", False).union(row("F4", "hosts", True)).union(row("F5", "cosmetic", False))


_BUCKETS = f"""SELECT 'options' AS list_id, CASE WHEN line LIKE '%chartbeat%' THEN 'redirects_removed' ELSE 'network' END AS bucket, 1 AS k FROM ({sql("F3")})
    UNION ALL SELECT 'hosts', 'network', 1 FROM ({_HOSTS})
    UNION ALL SELECT 'cosmetic', CASE WHEN line LIKE '%+js(%' THEN 'scriptlets_removed' ELSE 'cosmetic' END, unnest(CASE WHEN line LIKE '%:others()' THEN [] WHEN line LIKE '%.a, .b:has-text(x)' THEN [1, 2] ELSE [1] END) FROM ({sql("F5")})"""


@_query(f"SELECT bucket, count(*) AS n FROM ({_BUCKETS}) GROUP BY bucket")
def classify_buckets(spark: SparkSession, d: str) -> DataFrame:
    return classify.classified(_lists(spark, d)).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


_STATS = f"""SELECT l.list_id, l.n AS total_lines, coalesce(b.network, 0) AS network_rules, coalesce(b.cosmetic, 0) AS cosmetic_rules, 0::BIGINT AS empty, l.nothing AS unsupported, 0::BIGINT AS invalid,
    coalesce(b.scriptlets, 0) AS scriptlets_removed, coalesce(b.redirects, 0) AS redirects_removed, l.converted AS hosts_converted, 0::BIGINT AS unsupported_options, l.dropped AS unsupported_cosmetic, l.transformed AS cosmetic_transforms
    FROM (SELECT 'options' AS list_id, count(*) AS n, 0::BIGINT AS nothing, 0::BIGINT AS converted, 0::BIGINT AS dropped, 0::BIGINT AS transformed FROM ({sql("F3")})
      UNION ALL SELECT 'hosts', count(*), count(*) FILTER (page_id % 6 IN (2, 4)), count(*) FILTER (page_id % 6 NOT IN (2, 4)), 0, 0 FROM ({sql("F4")})
      UNION ALL SELECT 'cosmetic', count(*), 0, 0, count(*) FILTER (line LIKE '%:others()'), count(*) FILTER (regexp_matches(line, ':others|:contains|:has-text|:nth-ancestor|:watch-attr')) FROM ({sql("F5")})) l
    LEFT JOIN (SELECT list_id, count(*) FILTER (bucket = 'network') AS network, count(*) FILTER (bucket = 'cosmetic') AS cosmetic, count(*) FILTER (bucket = 'scriptlets_removed') AS scriptlets, count(*) FILTER (bucket = 'redirects_removed') AS redirects
      FROM ({_BUCKETS}) GROUP BY list_id) b ON l.list_id = b.list_id"""


@_query(_STATS)
def list_stats(spark: SparkSession, d: str) -> DataFrame:
    return classify.stats(classify.classified(_lists(spark, d)), "list_id")


@_query(f"SELECT {', '.join(f'sum({c})::BIGINT AS {c}' for c in classify.COUNTERS)} FROM ({_STATS})")
def source_totals(spark: SparkSession, d: str) -> DataFrame:
    return totals(list_stats(spark, d))


_LINES = r"SELECT source, unnest(CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END) AS line FROM documents WHERE text <> ''"


@_query(f"SELECT source, count(*) AS lines, count(DISTINCT line) AS distinct_lines, sum(strlen(line))::BIGINT AS bytes FROM ({_LINES}) GROUP BY source")
def line_split_dedup(spark: SparkSession, d: str) -> DataFrame:
    lines = classify.split_lines(spark.read.parquet(f"{d}/documents.parquet").filter("text <> ''"), "text", "source")
    each = lines.groupBy("source", "raw").agg(F.count("*").alias("n"))
    return each.groupBy("source").agg(F.sum("n").alias("lines"), F.count("*").alias("distinct_lines"), F.sum(F.octet_length("raw") * F.col("n")).alias("bytes"))


@_query(f"""WITH RECURSIVE e AS ({sql("F9")}), w AS (SELECT '' AS order_key, 'root' AS file, 0 AS level, ['root'] AS path
    UNION ALL SELECT w.order_key || '/' || lpad(e.line_no::VARCHAR, 9, '0'), e.child, w.level + 1, list_append(w.path, e.child) FROM w JOIN e ON e.parent = w.file WHERE w.level < 4 AND NOT list_contains(w.path, e.child))
    SELECT order_key, file, level FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY order_key) AS n FROM w) WHERE n = 1""")
def include_expand(spark: SparkSession, d: str) -> DataFrame:
    return expand_edges(corpus(spark, d, "F9"), "root")


@_query(f"WITH p AS (SELECT {_PARTS} FROM ({sql('F10')})) SELECT rule, translate(pattern, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || CASE WHEN opts <> '' THEN '$' || opts ELSE '' END AS lowered FROM p")
def rewrite_lowercase(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "F10").select("rule", rules.lowercase_pattern(F.col("rule")).alias("lowered"))


@_query(f"WITH p AS (SELECT {_PARTS} FROM ({sql('F10')})) SELECT rule, CASE WHEN rule LIKE '|%' THEN rule ELSE trim(pattern, '*') || CASE WHEN opts <> '' THEN '$' || opts ELSE '' END END AS trimmed FROM p")
def rewrite_trim_wildcards(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "F10").select("rule", rules.trim_wildcards(F.col("rule")).alias("trimmed"))


@_query(f"SELECT rule, CASE WHEN regexp_matches(rule, '[$](script,)?all$') THEN split_part(rule, '$', 1) ELSE rule END AS best FROM (SELECT DISTINCT rule FROM ({sql('F2')}))")
def rewrite_drop_all(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "F2").select("rule", rewrite.best_text(F.col("rule")).alias("best"))


_BEST = f"""SELECT *, CASE WHEN rule LIKE '*%' THEN trim(pattern, '*') || CASE WHEN opts <> '' THEN '$' || opts ELSE '' END WHEN opts = 'match-case' THEN rule
    WHEN regexp_matches(pattern, '[A-Z]') THEN lower(pattern) || CASE WHEN opts <> '' THEN '$' || opts ELSE '' END WHEN opts = 'all' THEN pattern ELSE rule END AS best
    FROM (SELECT {_PARTS} FROM ({sql("F10")}))"""


@_query(rf"""SELECT arg_min(best, (regexp_matches(best, '\^'), regexp_matches(split_part(best, '$', 1), '[A-Z]'), strlen(best), rule)) AS rule FROM ({_BEST})
    GROUP BY CASE WHEN opts = 'match-case' THEN pattern ELSE lower(trim(pattern, '*')) END, CASE WHEN opts = 'all' THEN '' ELSE opts END""")
def semantic_merge(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.semantic_merge(_table(spark, d, "F10")).select("rule")


_DIAG = rf"""SELECT rule, pattern, opts, regexp_matches(trim(pattern, '|'), '[*^]') AS is_regex, opts = 'all' OR opts = 'script,all' AS with_all, regexp_matches(pattern, '^[*]|[*]$') AS wildcards, regexp_matches(pattern, '[A-Z]') AS mixed_case
    FROM (SELECT {_PARTS} FROM (SELECT DISTINCT rule FROM ({sql("F2", "F10")})))"""


@_query(f"SELECT rule, true AS is_network, is_regex, false AS is_complete_regex, with_all, false AS has_domain_opts, false AS has_modifier, wildcards AS trimmable_wildcards, mixed_case FROM ({_DIAG})")
def rule_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "F2", "F10").select("rule", rewrite.diagnostics(F.col("rule")).alias("d")).select("rule", "d.*")


@_query(f"SELECT count(*) AS total, count(*) AS network, count(*) FILTER (is_regex) AS regex, count(*) FILTER (with_all) AS with_all, count(*) FILTER (wildcards) AS wildcards, count(*) FILTER (mixed_case) AS mixed_case, round(100.0 * count(*) FILTER (is_regex) / count(*), 3) AS regex_pct FROM ({_DIAG})")
def inefficiency_report(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.inefficiency(_table(spark, d, "F2", "F10")).select("total", "network", "regex", "with_all", "wildcards", "mixed_case", "regex_pct")


@_query(f"""SELECT category, n, rule FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY rule)::INTEGER AS n FROM
    (SELECT 'all' AS category, rule FROM ({_DIAG}) WHERE with_all UNION ALL SELECT 'wildcards', rule FROM ({_DIAG}) WHERE wildcards UNION ALL SELECT 'mixed-case', rule FROM ({_DIAG}) WHERE mixed_case UNION ALL SELECT 'regex', rule FROM ({_DIAG}) WHERE is_regex)) WHERE n <= 5""")
def sample_top5(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.samples(_table(spark, d, "F2", "F10")).filter("category <> 'rewritten'").select("category", "n", "rule")


@_query(f"""SELECT line, unnest(CASE WHEN line LIKE '%:others()' THEN [] WHEN line LIKE '%.a, .b:has-text(x)' THEN [replace(line, ', .b:has-text(x)', ''), replace(line, '.a, ', '')]
    ELSE [replace(replace(replace(line, ':contains(', ':has-text('), ':nth-ancestor(', ':upward('), ':watch-attr(x)', '')] END) AS rule FROM ({sql("F5")})""")
def cosmetic_split_procedural(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "F5").select("line", F.explode(cosmetic.transform(F.col("line"))).alias("rule"))


@_query(f"SELECT sel, CASE WHEN sel LIKE '%:others(%' THEN NULL ELSE replace(replace(replace(sel, ':contains(', ':has-text('), ':nth-ancestor(', ':upward('), ':watch-attr(x)', '') END AS rewritten FROM (SELECT DISTINCT regexp_extract(line, '#@?#(.*)$', 1) AS sel FROM ({sql('F5')}))")
def cosmetic_op_rewrite(spark: SparkSession, d: str) -> DataFrame:
    sels = corpus(spark, d, "F5").select(cosmetic.split_rule(F.col("line"))["selector"].alias("sel")).distinct()
    return sels.select("sel", cosmetic.rewrite_piece(F.col("sel")).alias("rewritten"))


@_query(f"SELECT line AS rule, CASE WHEN regexp_matches(line, ':contains|:nth-ancestor|:others|:watch-attr') THEN 'dead operator' ELSE 'unsplit comma+op' END AS problem FROM ({sql('F5')}) WHERE regexp_matches(line, ':contains|:nth-ancestor|:others|:watch-attr|, .b:has-text')")
def cosmetic_contamination(spark: SparkSession, d: str) -> DataFrame:
    return audit.contamination(_table(spark, d, "F5"))


_SCOPED = f"SELECT line, regexp_extract(line, '^([^#]*)#', 1) AS host, regexp_extract(line, '#@?#', 0) AS sep FROM ({sql('F6')})"


@_query(f"WITH c AS ({_SCOPED}) SELECT line AS rule FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.sep = a.sep AND ends_with(a.host, '.' || b.host) AND ends_with(b.host, 'example.' || split_part(a.host, '.', -1)))")
def cosmetic_subsume(spark: SparkSession, d: str) -> DataFrame:
    return subsume.cosmetic_subsume(_table(spark, d, "F6")).select("rule")


_COVERS = """len(list_filter({b}.t, lambda x: len(list_filter({a}.t, lambda p: (x = p OR ends_with(x, '.' || p)) AND ends_with('.' || p, '.' || array_to_string(string_split(x, '.')[-2:], '.')))) = 0)) = 0"""


@_query(f"""WITH c AS (SELECT line, CASE WHEN line NOT LIKE '%\\_%' ESCAPE '\\' THEN string_split(lower(split_part(line, '##', 1)), ',') END AS t FROM ({sql('F7')}))
    SELECT line AS rule FROM c b WHERE t IS NULL OR NOT EXISTS (SELECT 1 FROM c a WHERE a.t IS NOT NULL AND a.line <> b.line AND {_COVERS.format(a='a', b='b')} AND NOT {_COVERS.format(a='b', b='a')})""")
def cosmetic_subsume_hosts(spark: SparkSession, d: str) -> DataFrame:
    return subsume.cosmetic_subsume(_table(spark, d, "F7")).select("rule")


@_query(f"SELECT DISTINCT CASE WHEN starts_with(t, '.') THEN 'class' ELSE 'id' END AS kind, t[2:] AS token FROM (SELECT unnest(regexp_extract_all(regexp_extract(line, '#@?#(.*)$', 1), '[.#][A-Za-z0-9_-]+')) AS t FROM ({sql('F5')}))")
def class_id_tokens(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d, "F5").select(F.explode(cosmetic.class_id_tokens(F.col("line"))).alias("t")).select("t.*").distinct()


_PROBES = """SELECT DISTINCT rule, unnest(CASE WHEN path = '' THEN [base, base || '/extra', base || '?q=1', root, 'https://www.' || host || '/', 'https://deep.sub.' || host || '/']
    ELSE [base, base || '/extra', base || '?q=1', root, 'https://www.' || host || '/', 'https://deep.sub.' || host || '/', 'https://www.' || host || '/' || path, base || 'x'] END) AS url
    FROM (SELECT *, 'https://' || host || '/' || path AS base, 'https://' || host || '/' AS root FROM ("""


@_query(f"WITH r AS ({sql('F1')}) {_PROBES}{_PARSED}))")
def probe_urls(spark: SparkSession, d: str) -> DataFrame:
    return audit.probe_urls(_table(spark, d, "F1"))


@_query(f"WITH h AS (SELECT host FROM ({_SCOPED}) UNION SELECT unnest([{_quoted(audit.PROBED_HOSTS)}])) SELECT DISTINCT unnest([host, 'www.' || host, 'deep.sub.' || host]) AS host FROM h")
def sample_hosts(spark: SparkSession, d: str) -> DataFrame:
    return audit.sample_hosts(_table(spark, d, "F6"))


def _matched(c: str) -> str:
    return rf"""WITH r AS (SELECT regexp_replace(rule, '^@@', '') AS rule, starts_with(rule, '@@') AS exc FROM ({c})), s AS (SELECT p.*, exc FROM ({_PARSED}) p JOIN r USING (rule)),
        u AS (SELECT DISTINCT url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h, lower(regexp_extract(url, '://[^/?#:]*(.*)$', 1)) AS rest FROM pages),
        m AS (SELECT u.url, bool_or(NOT exc) AS hit, bool_or(exc) AS exception FROM u JOIN s ON (u.h = s.host OR ends_with(u.h, '.' || s.host))
          AND (CASE WHEN s.path = '' THEN true ELSE starts_with(u.rest, '/' || lower(s.path)) AND NOT regexp_matches(substr(u.rest, strlen(s.path) + 2, 1), '[a-z0-9_.%-]') END) GROUP BY u.url)
        SELECT u.url, coalesce(hit, false) AS hit, coalesce(exception, false) AS exception, coalesce(hit AND NOT exception, false) AS blocked FROM u LEFT JOIN m ON u.url = m.url"""


@_query(_matched(sql("F1")))
def network_match(spark: SparkSession, d: str) -> DataFrame:
    return match.network_match(spark.read.parquet(f"{d}/pages.parquet").select("url"), _table(spark, d, "F1"))


@_query(_matched(sql("F2")))
def network_match_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return match.network_match(spark.read.parquet(f"{d}/pages.parquet").select("url"), _table(spark, d, "F2"))


@_query(f"""WITH c AS ({_SCOPED}), u AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages)
    SELECT h AS host, CASE WHEN bool_or(sep = '##') AND NOT bool_or(sep = '#@#') THEN '.ad' ELSE '' END AS hide, CASE WHEN bool_or(sep = '#@#') THEN '.ad' ELSE '' END AS exceptions
    FROM u JOIN c ON u.h = c.host OR ends_with(u.h, '.' || c.host) GROUP BY h""")
def cosmetic_resources(spark: SparkSession, d: str) -> DataFrame:
    return match.cosmetic_resources(spark.read.parquet(f"{d}/pages.parquet").select("url"), _table(spark, d, "F6"))


@_query(f"""SELECT count(DISTINCT url) AS requests, 0::BIGINT AS mismatches FROM (WITH r AS (SELECT rule FROM ({sql("F1")}) WHERE rule NOT IN ({_subsumed(sql("F1"))})) {_PROBES}{_PARSED})))""")
def equivalence_network(spark: SparkSession, d: str) -> DataFrame:
    before = _table(spark, d, "F1")
    after = stored(subsume.network_subsume(before))
    removed = before.join(after.select("rule"), "rule", "left_anti")
    return audit.compare_network(before, after, audit.probe_urls(removed).select("url"))


@_query(rf"""WITH r AS ({sql("F1")}), s AS ({_PARSED}), k AS (SELECT *, EXISTS (SELECT 1 FROM s b WHERE (b.path = '' AND (ends_with(a.host, '.' || b.host) OR (a.path <> '' AND b.host = a.host))) OR (b.host = a.host AND b.path <> '' AND starts_with(a.path, b.path || '/'))) AS covered FROM s a)
    SELECT count(*) AS simple, count(*) FILTER (NOT covered) AS kept, count(*) FILTER (covered) AS removable, round(count(*) FILTER (covered) * (SELECT sum(strlen(rule)) FROM r)::DOUBLE / (SELECT count(*) FROM r) / 1e6, 6) AS saving_mb FROM k""")
def subsumable_estimate(spark: SparkSession, d: str) -> DataFrame:
    return audit.subsumable(_table(spark, d, "F1"))


@_query(f"WITH r AS (SELECT rule, row_number() OVER (ORDER BY rule) - 1 AS i, count(*) OVER () AS n FROM ({sql('F1')})) SELECT rule FROM r WHERE i % greatest(n // 50, 1) = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return audit.systematic_sample(_table(spark, d, "F1"), 50)


@_query(f"SELECT count(*) AS rules, sum(strlen(rule) + 1)::BIGINT AS bytes FROM ({_subsumed(sql('F1'))})")
def serialized_size(spark: SparkSession, d: str) -> DataFrame:
    return audit.serialized(subsume.network_subsume(_table(spark, d, "F1"))).select("rules", "bytes")


@_query(f"SELECT count(*) AS sampled, 0::BIGINT AS expected_dead, 0::BIGINT AS dead, 0::BIGINT AS contaminated, true AS passed FROM ({sql('F1')})")
def liveness(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "F1")
    return audit.liveness(t, t)


@_query(f"SELECT DISTINCT h.host, '' AS only_before, '' AS only_after FROM ({_SCOPED}) h WHERE false")
def equivalence_cosmetic(spark: SparkSession, d: str) -> DataFrame:
    before = _table(spark, d, "F6")
    return audit.compare_cosmetic(spark.read.parquet(f"{d}/pages.parquet").select("url"), before, subsume.cosmetic_subsume(before))


@_query(f"""WITH c AS ({_SCOPED}), u AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS h FROM pages),
    m AS (SELECT h AS host, bool_or(sep = '##') AS hidden FROM u JOIN c ON u.h = c.host OR ends_with(u.h, '.' || c.host) GROUP BY h HAVING bool_or(sep = '#@#'))
    SELECT host, '#@#.ad' AS only_before, CASE WHEN hidden THEN '.ad' ELSE '' END AS only_after FROM m""")
def equivalence_cosmetic_without_exceptions(spark: SparkSession, d: str) -> DataFrame:
    before = _table(spark, d, "F6")
    return audit.compare_cosmetic(spark.read.parquet(f"{d}/pages.parquet").select("url"), before, before.filter(~F.col("rule").contains("#@#")))


_GONE = f"SELECT rule FROM ({sql('F1')}) WHERE rule NOT IN ({_subsumed(sql('F1'))}) UNION SELECT rule FROM ({_BEST}) WHERE best <> rule"


@_query(f"SELECT DISTINCT url FROM (WITH r AS ({_GONE}) {_PROBES}{_PARSED})))")
def adversarial_corpus(spark: SparkSession, d: str) -> DataFrame:
    before, mixed = _table(spark, d, "F1"), _table(spark, d, "F10")
    return audit.adversarial_corpus(before, rewrite.rewritten(mixed).select("rule", "best"), subsume.network_subsume(before))


@_query(f"""WITH g AS (SELECT DISTINCT regexp_extract(line, '#@?#(.*)$', 1) AS selector, line LIKE '%#@#%' AS spared FROM ({sql("F5")}))
    SELECT selector FROM g WHERE NOT spared AND regexp_matches(selector, '(^|[^A-Za-z0-9_])[.](ad|b)([^A-Za-z0-9_-]|$)') AND selector NOT IN (SELECT selector FROM g WHERE spared)""")
def generic_selectors(spark: SparkSession, d: str) -> DataFrame:
    parts = cosmetic.split_rule(F.col("line"))
    found = corpus(spark, d, "F5").select(parts["sep"].alias("sep"), parts["selector"].alias("selector")).distinct()
    generic = found.filter("sep = '##'").select(F.concat(F.lit("##"), "selector").alias("rule"))
    classes = spark.createDataFrame([("class", "ad"), ("class", "b")], "kind string, token string")
    return match.generic_selectors(generic, classes, found.filter("sep = '#@#'").select("selector"))


@_query(f"SELECT rule FROM ({sql('F1')}) UNION ALL SELECT line FROM ({_SCOPED}) a WHERE NOT EXISTS (SELECT 1 FROM ({_SCOPED}) b WHERE b.sep = a.sep AND ends_with(a.host, '.' || b.host) AND ends_with(b.host, 'example.' || split_part(a.host, '.', -1)))")
def line_partition(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "F1", "F6")
    return audit.partition_lines(lines, subsume.cosmetic_subsume(_table(spark, d, "F6"))).select("rule")


@_query()
def optimize_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return optimize(corpus(spark, d, "F1", "F2", "F6", "F10")).rules.select("rule", "ord_key")


@_query()
def optimize_counters(spark: SparkSession, d: str) -> DataFrame:
    return optimize(corpus(spark, d, "F1", "F2", "F6", "F10")).counted()


#: What each of MATCHED and FREE is taken to mean, said apart from the rules: exception, types, third party, site wanted, site barred, important, resource, the regular expression after the host (or whole).
_ALL = "script image stylesheet object object-subrequest media subdocument ping xmlhttprequest websocket font other popup"
_END = "([^A-Za-z0-9_.%-]|$)"
_MEANT = (
    (False, _ALL + " document", "yes", "", "", False, "", _END), (True, "script", "", "", "", False, "", _END), (False, "image script", "", "", "", False, "", "/en/.*page="), (False, "script", "", "", "", True, "", _END),
    (True, _ALL.replace("image ", ""), "", "", "", False, "", _END), (False, "script", "", "", "", False, "noop.js", _END), (False, _ALL, "", "", "", False, "", "/fr/"), (False, _ALL.replace("image ", ""), "", "a.test", "b.a.test", False, "", _END),
    (False, _ALL + " document", "", "", "", False, "", _END), (False, "document", "", "", "", False, "", _END), None, None,
)
_MEANT_FREE = (
    (False, "script", "", "", "", False, "", "(?i)[?]page=[0-9]+&"), (False, "image", "", "", "", False, "", "(?i)ref=x$"), (False, _ALL, "", "", "", False, "", "(?i)utm_source=feed"), (False, _ALL, "", "b.a.test", "", False, "", "(?i)&ref="),
    (False, "document", "", "", "", False, "", "(?i)#top$"), None, (False, "websocket", "", "", "", False, "", "."), (False, "image", "no", "", "", False, "", "(?i)^http:.*/de/"), (True, _ALL, "", "", "", False, "", "/EN/9"), (True, _ALL, "", "", "", False, "", "/en/8"),
)


def _meant(row: tuple) -> str:
    return ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in row)


_REQUESTS = """SELECT url, CASE page_id % 4 WHEN 0 THEN 'https://b.a.test/' WHEN 1 THEN 'https://a.test/x' WHEN 2 THEN 'https://www.' || regexp_extract(url, '://([^/?#]+)', 1) || '/' END AS source,
    CASE page_id % 7 WHEN 0 THEN 'script' WHEN 1 THEN 'image' WHEN 2 THEN 'document' WHEN 3 THEN 'websocket' WHEN 4 THEN 'xmlhttprequest' WHEN 5 THEN 'image' ELSE 'other' END AS type FROM {pages}"""
_CANCELLED = MATCHED.index(("||", "^$badfilter")), MATCHED.index(("||", "^"))


@_query(rf"""WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(page_id) AS n FROM pages GROUP BY 1),
    o(k, pre, exc, types, third, site, barred, important, resource, tail) AS (VALUES {", ".join(f"({k}, '{MATCHED[k][0]}', {_meant(m)})" for k, m in enumerate(_MEANT) if m)}),
    f(exc, types, third, site, barred, important, resource, re) AS (VALUES {", ".join(f"({_meant(m)})" for m in _MEANT_FREE if m)}),
    r AS (SELECT exc, types, third, site, barred, important, resource, CASE WHEN pre LIKE '%||' THEN '(?i)^[a-z]+://([^/?#:]*[.])?' ELSE '(?i)^https://' END || replace(host, '.', '[.]') || tail AS re FROM h JOIN o ON (h.n + o.k) % 4 = 0
        WHERE NOT (k = {_CANCELLED[1]} AND (h.n + {_CANCELLED[0]}) % 4 = 0) UNION ALL SELECT * FROM f),
    q AS (SELECT DISTINCT url, source, type, coalesce(regexp_extract(source, '://([^/?#:]*)', 1), '') AS s,
        coalesce(array_to_string(string_split(regexp_extract(url, '://([^/?#:]*)', 1), '.')[-2:], '.') <> array_to_string(string_split(regexp_extract(source, '://([^/?#:]*)', 1), '.')[-2:], '.'), true) AS t FROM ({_REQUESTS.format(pages="pages")})),
    m AS (SELECT q.url, q.source, q.type, r.* EXCLUDE (types) FROM q JOIN r ON list_contains(string_split(r.types, ' '), q.type) AND (third = '' OR (third = 'yes') = t) AND (site = '' OR s = site OR ends_with(s, '.' || site))
        AND (barred = '' OR NOT (s = barred OR ends_with(s, '.' || barred))) AND regexp_matches(q.url, r.re)),
    g AS (SELECT url, source, type, bool_or(NOT exc) AS hit, bool_or(exc) AS exception, bool_or(NOT exc AND important) AS important, min(resource) FILTER (NOT exc AND resource <> '') AS redirect FROM m GROUP BY ALL)
    SELECT q.url, q.source, q.type, coalesce(hit, false) AS hit, coalesce(exception, false) AS exception, coalesce(important, false) AS important, CASE WHEN important OR NOT exception THEN redirect END AS redirect,
    coalesce(important OR (hit AND NOT exception), false) AS blocked FROM q LEFT JOIN g ON g.url = q.url AND g.source IS NOT DISTINCT FROM q.source AND g.type = q.type""")
def network_match_general(spark: SparkSession, d: str) -> DataFrame:
    return requests.check_requests(spark.sql(_REQUESTS.format(pages=f"parquet.`{d}/pages.parquet`")), corpus(spark, d, "F11"))


_ODD = ", ".join(f"({k}, '{pre}', '{post}', '{b}')" for k, (pre, post, b) in enumerate(ODD))
_ODD_LINES = f"SELECT line, bucket, k FROM ({sql('F12')}) JOIN (VALUES {_ODD}) AS o(k, pre, post, bucket) ON line <> ' ' AND starts_with(line, pre) AND ends_with(line, post) AND regexp_matches(line[strlen(pre) + 1:strlen(line) - strlen(post)], '^[a-z0-9.-]+$')"


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return classify.classified(corpus(spark, d, "F12").select(F.lit("odd").alias("list_id"), F.lit(0).alias("line_no"), F.col("line").alias("raw"), F.lit(False).alias("hosts")))


@_query(f"SELECT line, bucket FROM ({_ODD_LINES})")
def classify_errors(spark: SparkSession, d: str) -> DataFrame:
    return _odd(spark, d).filter("bucket is not null").select(F.col("raw").alias("line"), "bucket")


@_query(f"""SELECT 'odd' AS list_id, (SELECT count(*) FROM ({sql("F12")})) AS total_lines, {", ".join(f"count(*) FILTER (bucket = '{b}') AS {c}" for b, c in [("network", "network_rules"), ("cosmetic", "cosmetic_rules")])},
    (SELECT count(*) FROM ({sql("F12")}) WHERE line = ' ') AS empty, {", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in ["unsupported", "invalid", "scriptlets_removed", "redirects_removed"])}, 0::BIGINT AS hosts_converted,
    {", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in ["unsupported_options", "unsupported_cosmetic"])}, 0::BIGINT AS cosmetic_transforms FROM ({_ODD_LINES})""")
def list_stats_errors(spark: SparkSession, d: str) -> DataFrame:
    return classify.stats(_odd(spark, d), "list_id")


@_query(rf"""WITH c AS ({sql("F13")}), r AS (SELECT regexp_replace(rule, '^@@', '') AS rule, starts_with(rule, '@@') AS exc FROM c WHERE rule NOT LIKE '%$badfilter' AND rule || '$badfilter' NOT IN (SELECT rule FROM c)),
    s AS (SELECT DISTINCT regexp_extract(rule, '{_SIMPLE}', 1) AS host, lower(regexp_extract(rule, '{_SIMPLE}', 3)) AS path, exc FROM r),
    p AS (SELECT rule, regexp_extract(rule, '{_SIMPLE}', 1) AS host, lower(regexp_extract(rule, '{_SIMPLE}', 3)) AS path FROM c WHERE rule LIKE '||%^'),
    m AS (SELECT p.rule, bool_or(NOT s.exc) AND NOT bool_or(s.exc) AS blocked FROM p LEFT JOIN s ON (p.host = s.host OR ends_with(p.host, '.' || s.host))
      AND (s.path = '' OR (starts_with(p.path, s.path) AND NOT regexp_matches(substr(p.path, strlen(s.path) + 1, 1), '[a-z0-9_.%-]'))) GROUP BY p.rule),
    d AS (SELECT rule, coalesce(blocked, false) AS blocked, rule || '$badfilter' IN (SELECT rule FROM c) AS bad FROM m)
    SELECT count(*) AS sampled, count(*) FILTER (NOT blocked AND bad) AS expected_dead, count(*) FILTER (NOT blocked AND NOT bad) AS dead, 0::BIGINT AS contaminated, count(*) FILTER (NOT blocked AND NOT bad) = 0 AS passed FROM d""")
def liveness_failing(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "F13")
    return audit.liveness(t, t)


@_query(f"""WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(page_id) AS n FROM pages GROUP BY 1), u AS (SELECT DISTINCT url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS ph FROM pages),
    m AS (SELECT url, {", ".join(f"coalesce(bool_or((n + {k}) % 3 = 0), false) AS k{k}" for k in range(7))} FROM u LEFT JOIN h ON ph = host OR ends_with(ph, '.' || host) GROUP BY url)
    SELECT url, concat_ws(chr(10), CASE WHEN k0 AND NOT k1 THEN '.ad' END, CASE WHEN k6 THEN '.b' END) AS hide, CASE WHEN k2 THEN '.x:has-text(y)' ELSE '' END AS procedural,
    CASE WHEN k3 AND NOT k4 THEN '+js(a, b)' ELSE '' END AS scripts, concat_ws(chr(10), CASE WHEN k4 THEN '+js(a, b)' END, CASE WHEN k1 THEN '.ad' END) AS exceptions, k5 AS generichide FROM m""")
def page_resources(spark: SparkSession, d: str) -> DataFrame:
    return requests.page_resources(spark.read.parquet(f"{d}/pages.parquet").select("url"), corpus(spark, d, "F14"))


_NET = "WITH r AS (SELECT * FROM (" + _ODD_LINES + ") WHERE k IN (10, 11, 12, 13, 14, 15, 16, 17))"
_NET_FLAGS = "k <> 17 AS is_regex, k = 11 AS is_complete_regex, k = 16 AS with_all, k = 10 AS has_domain_opts, k IN (12, 13, 14) AS has_modifier, k = 15 AS trimmable_wildcards, k = 17 AS mixed_case"


@_query(f"{_NET} SELECT line AS rule, true AS is_network, {_NET_FLAGS} FROM r")
def rule_diagnostics_options(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d, "F12").select(F.col("line").alias("rule"), rewrite.diagnostics(F.col("line")).alias("d"))
    return rows.filter("d is not null").select("rule", "d.*")


@_query(f"""{_NET}, f AS (SELECT line, {_NET_FLAGS}, CASE WHEN k IN (15, 17) THEN replace(replace(line, '/ad*', '/ad'), '/AD', '/ad') ELSE line END AS sig FROM r), n AS (SELECT count(*) AS total FROM ({sql("F12")}))
    SELECT any_value(total) AS total, count(*) AS network, count(*) FILTER (is_regex) AS regex, count(*) FILTER (with_all) AS with_all, count(*) FILTER (has_domain_opts) AS with_domains, count(*) FILTER (has_modifier) AS with_modifier,
    count(*) FILTER (trimmable_wildcards) AS wildcards, count(*) FILTER (mixed_case) AS mixed_case, count(*) FILTER (with_all OR trimmable_wildcards OR mixed_case) AS rewritten, any_value(total) - count(DISTINCT sig) AS merged,
    round(100.0 * count(*) FILTER (is_regex) / any_value(total), 3) AS regex_pct FROM f, n""")
def inefficiency_report_options(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.inefficiency(_table(spark, d, "F12"))
