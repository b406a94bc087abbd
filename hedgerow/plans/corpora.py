"""Rule lists made from the driver's tables, in SQL that Spark and DuckDB both run. ``{name}`` stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"

#: Rules for matching: what stands before and after a host. Rows of ``FREE`` have no host.
MATCHED = (
    ("||", "^$third-party"), ("@@||", "^$script"), ("||", "/en/*page=$image,script"), ("||", "^$important,script"), ("@@||", "^$~image"), ("||", "^$redirect=noopjs,script"),
    ("|https://", "/fr/"), ("||", "^$~image,domain=a.test|~b.a.test"), ("||", "^"), ("||", "^$document"), ("||", "^$badfilter"), ("||", "^$csp=none"),
)
FREE = ("/[?]page=[0-9]+&/$script", "*ref=x|$image", "utm_source=feed", "&ref=$domain=b.a.test", "#top|$document", "/[/$image", "*$websocket", "|http:*/de/$~third-party,image", "@@/EN/9$match-case", "@@/en/8$match-case")

#: Lines that aren't plain rules: what stands before and after a host, and the bucket.
ODD = (
    ("", "##.x{ y }", "invalid"), ("||", "^$nosuch=1", "unsupported_options"), ("||", "^$domain=", "invalid"), ("", "##+js()", "unsupported_cosmetic"), ("", "#$#body", "unsupported_cosmetic"), ("! ", "", "unsupported"),
    ("", "##.a:has-text(b", "invalid"), ("", "##^script", "unsupported_cosmetic"), ("##.a:style(", ")", "unsupported_cosmetic"), ("[", "]", "unsupported"), ("||", "^$domain=a.test|b.test", "network"), ("/", "[0-9]+/", "network"),
    ("||", "^$redirect=noopjs", "network"), ("||", "^$csp=none", "network"), ("||", "^$redirect=nosuch", "redirects_removed"), ("||", "/ad*$image", "network"), ("||", "^$all", "network"), ("||", "/AD$image", "network"),
)


def _values(rows: tuple[tuple[str, ...], ...]) -> str:
    return ", ".join(f"({k}, " + ", ".join(f"'{x}'" for x in row) + ")" for k, row in enumerate(rows))


CORPORA: dict[str, str] = {
    # host and path rules
    "F1": f"""SELECT DISTINCT '||' || {_HOST} || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' || regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1)
        ELSE '/' || regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) END || '^' AS rule FROM {{pages}}""",
    # options, exceptions, badfilters
    "F2": f"""SELECT h.pre || h.host || '^' || o.opts AS rule FROM (SELECT CASE WHEN min(page_id) % 11 = 0 THEN '@@||' ELSE '||' END AS pre, {_HOST} AS host, min(page_id) AS n
        FROM {{pages}} GROUP BY {_HOST}) h CROSS JOIN (VALUES (0, ''), (1, '$script'), (2, '$third-party'), (3, '$script,~image'), (4, '$document'), (5, '$important'), (6, '$badfilter'),
        (7, '$document,badfilter'), (8, '$all'), (9, '$script,all'), (10, '$script,document')) AS o(k, opts) WHERE (h.n + o.k * 3) % 5 < 2""",
    # options to normalize, redirects
    "F3": f"""SELECT '||' || {_HOST} || '^$' || o.opts AS line FROM {{pages}} JOIN (VALUES (0, 'empty'), (1, 'mp4'), (2, 'redirect=noopjs'), (3, 'script,redirect-rule=noopmp4-1s'),
        (4, 'rewrite=abp-resource:blank-js'), (5, 'redirect=chartbeat.js'), (6, 'script'), (7, 'empty,script')) AS o(k, opts) ON page_id % 8 = o.k""",
    # hosts lines
    "F4": f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN '0.0.0.0 ' || host WHEN 1 THEN '127.0.0.1 localhost ' || host || ' # note' WHEN 2 THEN '# ' || host WHEN 3 THEN host
        WHEN 4 THEN '::1 ip6-localhost' ELSE '0.0.0.0 *.' || upper(host) || '. www.' || host END AS line FROM (SELECT page_id, {_HOST} AS host FROM {{pages}}) p""",
    # cosmetic rules and scriptlets
    "F5": f"""SELECT DISTINCT {_HOST} || o.sep || o.sel AS line FROM {{pages}} JOIN (VALUES (0, '##', '.ad'), (1, '##', '.ad:contains(buy)'), (2, '##', '.a, .b:has-text(x)'),
        (3, '#@#', '.ad:nth-ancestor(2)'), (4, '##', '.a:others()'), (5, '##', '.a:watch-attr(x):remove-class(y)'), (6, '##', '+js(set-constant, a, b)'), (7, '##', '.a, .b')) AS o(k, sep, sel)
        ON page_id % 8 = o.k""",
    # host-scoped cosmetic rules
    "F6": f"""SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '[^./]+[.][a-z]+[.](?:com|net|org)', 0) WHEN 1 THEN {_HOST} ELSE 'x.' || {_HOST} END
        || CASE WHEN page_id % 2 = 0 THEN '##' ELSE '#@#' END || '.ad' AS line FROM {{pages}}""",
    # host-scoped cosmetic rules under suffixes that no table names, lists of hosts, hosts that aren't plain
    "F7": """SELECT DISTINCT CASE page_id % 6 WHEN 0 THEN 'site' || k || '.ru' WHEN 1 THEN 'www.site' || k || '.ru' WHEN 2 THEN 'site' || k || '.jp,www.site' || k || '.jp' WHEN 3 THEN 'a_b.site' || k || '.ru'
        WHEN 4 THEN 'M.site' || k || '.jp' ELSE 'ru,m.site' || k || '.jp' END || '##.ad' AS line FROM (SELECT page_id, CAST(page_id % 37 AS STRING) AS k FROM {pages}) p""",
    # many host and path rules
    "F8": """SELECT DISTINCT '||' || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 's' || CAST(l_suppkey % 50 AS STRING) || '.' END || 'p' || CAST(l_partkey AS STRING) || '.example.com'
        || CASE WHEN l_quantity > 45 THEN '' ELSE '/o' || CAST(l_orderkey % 100 AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '/l' || CAST(l_linenumber AS STRING) END END || '^' AS rule
        FROM {lineitem}""",
    # an include graph with a diamond and a cycle
    "F9": "SELECT * FROM (VALUES ('root', 1, 'a'), ('root', 3, 'b'), ('a', 1, 'c'), ('b', 1, 'c'), ('c', 1, 'root'), ('c', 2, 'd')) AS e(parent, line_no, child)",
    # mixed case and wildcards
    "F10": f"""SELECT '||' || CASE WHEN page_id % 2 = 0 THEN upper(host) ELSE host END || '^' || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '$script' WHEN 2 THEN '$match-case' ELSE '$all' END AS rule
        FROM (SELECT page_id, {_HOST} AS host FROM {{pages}}) p UNION SELECT '*' || regexp_extract(url, '^https?://([^.]+)', 1) || CASE page_id % 3 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE '*$image' END FROM {{pages}}""",
    # rules of every form that matching knows
    "F11": f"""SELECT o.pre || h.host || o.post AS rule FROM (SELECT {_HOST} AS host, min(page_id) AS n FROM {{pages}} GROUP BY {_HOST}) h JOIN (VALUES {_values(MATCHED)}) AS o(k, pre, post) ON (h.n + o.k) % 4 = 0
        UNION ALL SELECT o.rule FROM (VALUES {_values(tuple((x,) for x in FREE))}) AS o(k, rule)""",
    # lines that aren't plain rules, and blank ones
    "F12": f"""SELECT DISTINCT CASE WHEN page_id % 19 = 18 THEN ' ' ELSE o.pre || {_HOST} || o.post END AS line FROM {{pages}} JOIN (VALUES {_values(tuple(r[:2] for r in ODD))}) AS o(k, pre, post) ON page_id % {len(ODD)} = o.k""",
    # host and path rules of which some are cancelled or excepted
    "F13": f"""SELECT DISTINCT o.pre || r.rule || o.post AS rule FROM (SELECT DISTINCT '||' || {_HOST} || CASE WHEN page_id % 3 = 0 THEN '' ELSE '/' || regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) END || '^' AS rule FROM {{pages}}) r
        JOIN (VALUES (0, '', ''), (1, '', '$badfilter'), (2, '@@', '')) AS o(k, pre, post) ON o.k = 0 OR (o.k = 1 AND length(r.rule) % 3 = 0) OR (o.k = 2 AND length(r.rule) % 5 = 0)""",
    # what a page of a host is to hide, run and spare
    "F14": f"""SELECT o.pre || h.host || o.post AS rule FROM (SELECT {_HOST} AS host, min(page_id) AS n FROM {{pages}} GROUP BY {_HOST}) h JOIN (VALUES (0, '', '##.ad'), (1, '', '#@#.ad'), (2, '', '##.x:has-text(y)'),
        (3, '', '##+js(a, b)'), (4, '', '#@#+js(a, b)'), (5, '@@||', '^$generichide'), (6, '', '##.b')) AS o(k, pre, post) ON (h.n + o.k) % 3 = 0""",
}


def corpus(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The corpora's rows in Spark, one after the other, as (rule) or (line)."""
    out = None
    for n in names:
        df = spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", CORPORA[n]))
        df = df.withColumnRenamed("line", "rule") if len(names) > 1 else df
        out = df if out is None else out.unionByName(df)
    return out


def sql(*names: str) -> str:
    """The same as DuckDB SQL with the tables as views; ``line`` is named rule if there are several."""
    texts = [re.sub(r"\{(\w+)\}", r"\1", CORPORA[n]) for n in names]
    if len(names) == 1:
        return texts[0]
    return " UNION ALL ".join(f"SELECT {'line' if n in ('F3', 'F5', 'F6') else 'rule'} AS rule FROM ({t})" for n, t in zip(names, texts, strict=True))
