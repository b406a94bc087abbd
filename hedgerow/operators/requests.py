"""Requests against rules of every form: anchors, wildcards, separators, regular expressions, options, exceptions,
``important`` and redirects.

A rule is filed under keys of which a request that it matches must have one: its host, and its path up to the last
separator that is sure to be there, if it is anchored to a whole host, else its longest word that stands free, else three
letters or one letter of its longest literal, else the sites that it is for, else the types that it covers. Requests have
all their keys of the kinds that rules have, so candidates come from one join on equal keys, which moves hashes of keys and
requests and the rules; a rule's pattern and options are then held against each request that it meets. Many rules and many
requests of one host meet by their paths. Only regular expressions and patterns of wildcards alone that name no site are
tried on all requests of a type.

A request is (url, source, type): source is the URL of the page that makes it; a type that isn't known, or null, is
``other``. A null source is no site, and third party to all. URLs that aren't ``scheme://...``, null ones included, match
nothing. Repeated requests and rules count once. Further columns are not looked at.

What options mean here: without types a rule covers all but ``document``, and that too if it is a host alone; types with a
tilde cover all but those and ``document``. ``domain`` holds at a site and below it. ``badfilter`` rules and those they
cancel are out. ``csp``, ``removeparam`` and ``generichide`` rules block nothing. ``redirect`` and ``rewrite`` block and
name a resource, ``redirect-rule`` names one alone; of several the first in order of text is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cosmetic, rules
from ..functions import tables as T
from .match import _URL, host_of
from .storage import stored
from .subsume import distinct_rules, registrable, strip_badfilters

TYPES = tuple(t for t in T.CONTENT_TYPES if t != "xhr")
#: What keys begin with.
KINDS = ("h:", "w:", "g:", "s:", "t:")
_PARTY = {"third-party": True, "3p": True, "~first-party": True, "~1p": True, "first-party": False, "1p": False, "~third-party": False, "~3p": False}
_BLOCKS_NOTHING = ("csp", "removeparam", "generichide")
_CUT = "(?=[^A-Za-z0-9_.%-])"
#: Pieces of a path, each from a separator on, that a key has at most.
PIECES = 16
_SPECIAL = r"([\\.+?(){}\[\]$|^*])"


def _name(option: Column) -> Column:
    return F.substring_index(option, "=", 1)


def _type(name: Column) -> Column:
    return F.when(name == "xhr", "xmlhttprequest").otherwise(name)


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern without ``@@``, for URLs without user names."""
    parts = r"(?s)\A(\|\|?)?(.*?)(\|)?\z"
    left, core, right = (F.regexp_extract(pattern, parts, i) for i in (1, 2, 3))
    escaped = F.regexp_replace(core, _SPECIAL, r"\\$1")
    body = F.replace(F.replace(escaped, F.lit(r"\*"), F.lit(".*")), F.lit(r"\^"), F.lit(r"(?:[^A-Za-z0-9_.%-]|\z)"))
    head = F.when(left == "||", r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#:]*\.)?").when(left == "|", r"\A").otherwise("")
    return F.concat(F.lit("(?s)"), head, body, F.when(right == "|", r"\z").otherwise(""))


def _paths(rest: Column) -> Column:
    """What follows a request's host, up to each of its first separators: '' first, all of it last if it is no longer."""
    pieces = F.slice(F.split(rest, _CUT, -1), 1, PIECES)
    return F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), ""))


def _path(pattern: Column) -> Column:
    """The path of a pattern with a whole host, as far as one of ``_paths`` of each request that it matches. What a caret
    or the URL's end follows is whole; another path can go on in any way from its last separator."""
    parts = r"(?s)\A\|\|[^/^|]*(/[^*^|]*)(\^|\|\z)?"
    pieces = F.split(F.regexp_extract(pattern, parts, 1), _CUT, -1)
    sure = F.when(F.regexp_extract(pattern, parts, 2) == "", F.size(pieces) - 1).otherwise(F.size(pieces))
    return F.array_join(F.slice(pieces, F.lit(1), F.least(sure, F.lit(PIECES))), "")


def _keys(pattern: Column, regex: Column, sites: Column, types: Column) -> Column:
    """The keys that a rule is filed under."""
    low = rules.ascii_lower(pattern)
    host = F.regexp_extract(low, r"\A\|\|([a-z0-9_-]+(?:\.[a-z0-9_-]+)*)(?:[/^]|\|\z)", 1)
    open_ends = F.concat(F.when(low.startswith("|"), "").otherwise("*"), low, F.when(low.endswith("|"), "").otherwise("*"))
    longest = lambda xs: F.element_at(F.array_sort(F.transform(xs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    words = F.regexp_extract_all(open_ends, F.lit(r"(?<![a-z0-9%*])([a-z0-9%]{2,})(?![a-z0-9%*])"), F.lit(1))
    literals = F.filter(F.split(low, r"[*^|]+", -1), lambda x: x != "")
    literal = longest(literals)
    gram = F.when(F.length(literal) >= 3, F.right(literal, F.lit(3))).otherwise(F.right(literal, F.lit(1)))
    marked = lambda mark, x: F.array(F.concat(F.lit(mark), x))
    wide = F.when(F.size(sites) > 0, F.transform(sites, lambda s: F.concat(F.lit("s:"), s))).otherwise(F.transform(types, lambda t: F.concat(F.lit("t:"), t)))
    plain = F.when(host != "", marked("h:", F.concat(host, _path(low)))).when(F.size(words) > 0, marked("w:", longest(words))).when(F.size(literals) > 0, marked("g:", gram)).otherwise(wide)
    return F.when(regex, wide).otherwise(plain)


def filed_rules(table: DataFrame, generichide: bool = False) -> DataFrame:
    """Network rules (or those with ``generichide`` alone) as what they look for and when, with an array of keys; rules that don't parse, and regular
    expressions that Java doesn't know, are left out."""
    live = strip_badfilters(distinct_rules(table).filter(rules.kind(F.col("rule")) == "network"), strict=True)
    bare = live.select("rule", F.col("rule").startswith("@@").alias("exception"), rules.is_full_regex(F.regexp_replace("rule", r"\A@@", "")).alias("is_regex"), rules.option_list(F.col("rule")).alias("o"), rules.pattern_of(F.regexp_replace("rule", r"\A@@", "")).alias("pattern"))
    scope = F.flatten(F.transform(F.filter("o", lambda o: _name(o).isin("domain", "from")), lambda o: F.split(rules.ascii_lower(F.regexp_extract(o, "=(.*)", 1)), r"\|", -1)))
    named = lambda *names: F.get(F.filter("o", lambda o: _name(o).isin(*names)), F.lit(0))
    every = F.array(*[F.lit(t) for t in TYPES])
    only = F.transform(F.filter("o", lambda o: o.isin(*T.CONTENT_TYPES)), _type)
    but = F.transform(F.filter("o", lambda o: o.startswith("~") & F.substring(o, F.lit(2), F.length(o)).isin(*T.CONTENT_TYPES)), lambda o: _type(F.substring(o, F.lit(2), F.length(o))))
    host_only = F.col("pattern").rlike(r"\A\|\|[^/^*|]+\^\z")
    types = every if generichide else (
        F.when(F.array_contains("o", "all"), every)
        .when(F.size(only) > 0, F.array_distinct(only))
        .when(F.size(but) > 0, F.array_except(F.array_except(every, but), F.array(F.lit("document"))))
        .otherwise(F.when(host_only, every).otherwise(F.array_except(every, F.array(F.lit("document")))))
    )
    party = F.coalesce(*[F.when(F.array_contains("o", k), F.lit(v)) for k, v in _PARTY.items()])
    scheme = F.when(F.array_contains("o", "http") | F.array_contains("o", "~https"), "http").when(F.array_contains("o", "https") | F.array_contains("o", "~http"), "https")
    text = F.when(F.col("is_regex"), F.concat(F.lit("(?s)"), F.expr("substring(pattern, 2, length(pattern) - 2)"))).otherwise(pattern_regex(F.col("pattern")))
    compiles = F.expr("try_reflect('java.util.regex.Pattern', 'compile', regex)").isNotNull()
    rows = bare.select(
        "rule", "exception", "is_regex", "pattern", types.alias("types"), party.alias("third"), scheme.alias("scheme"),
        F.filter(scope, lambda s: (s != "") & ~s.startswith("~")).alias("sites"), F.transform(F.filter(scope, lambda s: s.startswith("~")), lambda s: F.substring(s, F.lit(2), F.length(s))).alias("not_sites"),
        F.concat(F.when(F.array_contains("o", "match-case"), "").otherwise("(?i)"), text).alias("regex"),
        F.array_contains("o", "important").alias("important"), F.regexp_extract(named("redirect", "redirect-rule", "rewrite"), "=(.*)", 1).alias("resource"), named("redirect-rule").isNull().alias("blocks"),
        (named("generichide") if generichide else named(*_BLOCKS_NOTHING)).isNotNull().alias("other"),
    ).filter("other" if generichide else "not other").filter(~F.col("is_regex") | compiles).drop("other")
    return rows.withColumn("keys", _keys(F.col("pattern"), F.col("is_regex"), F.col("sites"), F.col("types"))).drop("pattern", "is_regex")


def asked(requests: DataFrame, suffixes: Sequence[str] = T.PUBLIC_SUFFIXES, kinds: Sequence[str] = KINDS) -> DataFrame:
    """The distinct requests with their sites, and an array of all their keys of some kinds."""
    rows = requests.select("url", "source", F.coalesce(F.when(_type(F.col("type")).isin(*TYPES), _type(F.col("type"))), F.lit("other")).alias("type")).distinct()
    base = rows.filter(F.col("url").rlike(r"(?i)\A[a-z][a-z0-9+.-]*://")).withColumn("text", F.regexp_replace("url", r"(?i)\A([a-z][a-z0-9+.-]*://)[^/?#@]*@", "$1"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("site", F.coalesce(host_of(F.col("source")), F.lit("")))
    base = base.withColumn("at", rules.label_suffixes(F.col("site"))).withColumn("third", ~F.coalesce(registrable(F.col("host"), suffixes), F.col("host")).eqNullSafe(F.coalesce(registrable(F.col("site"), suffixes), F.col("site"))))
    low = rules.ascii_lower(F.col("text"))
    marked = lambda mark, xs: F.transform(F.array_distinct(xs), lambda x: F.concat(F.lit(mark), x))
    grams = F.concat(F.regexp_extract_all(low, F.lit("(?s)(.)"), F.lit(1)), F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1)))
    rest = rules.ascii_lower(F.regexp_extract(F.col("url"), _URL, 2))
    at_host = F.flatten(F.transform(_paths(rest), lambda p: F.transform(rules.label_suffixes(F.col("host")), lambda h: F.concat(h, p))))
    each = {"h:": at_host, "w:": F.regexp_extract_all(low, F.lit("([a-z0-9%]+)"), F.lit(1)), "g:": grams, "s:": F.col("at"), "t:": F.array("type")}
    keys = F.concat(rules.none(), *[marked(k, each[k]) for k in kinds])
    return base.select("url", "source", "type", "text", "at", F.col("third").alias("is_third"), F.lower(F.substring_index("text", "://", 1)).alias("is_scheme"), keys.alias("keys"))


def _hits(requests: DataFrame, table: DataFrame, suffixes: Sequence[str], generichide: bool = False) -> DataFrame:
    """general_hits, some of them repeated."""
    # stored: the kinds of its keys are asked for before requests are given theirs
    filed = stored(filed_rules(table, generichide)).withColumn("key", F.explode("keys")).drop("keys")
    kinds = sorted(r.kind for r in filed.select(F.substring("key", 1, 2).alias("kind")).distinct().collect())
    rows = asked(requests, suffixes, kinds).withColumn("id", F.xxhash64("url", "source", "type"))
    # hashes alone meet; should two be equal, the pattern and the options tell
    keyed = rows.select("id", F.explode("keys").alias("key")).select("id", F.xxhash64("key").alias("key"))
    met = keyed.join(filed.withColumn("key", F.xxhash64("key")), "key").drop("key")
    found = met.join(rows.drop("keys"), "id")
    holds = (
        F.array_contains("types", F.col("type"))
        & (F.col("third").isNull() | (F.col("third") == F.col("is_third")))
        & (F.col("scheme").isNull() | (F.col("scheme") == F.col("is_scheme")))
        & ((F.size("sites") == 0) | F.arrays_overlap("sites", "at"))
        & ((F.size("not_sites") == 0) | ~F.arrays_overlap("not_sites", "at"))
    )
    fits = F.call_function("rlike", F.col("text"), F.col("regex"))
    return found.filter(holds).filter(fits).select("url", "source", "type", "rule", "exception", "important", "resource", "blocks")


def general_hits(requests: DataFrame, table: DataFrame, suffixes: Sequence[str] = T.PUBLIC_SUFFIXES, generichide: bool = False) -> DataFrame:
    """(url, source, type, rule, exception, important, resource, blocks): every match."""
    return _hits(requests, table, suffixes, generichide).distinct()


def check_requests(requests: DataFrame, table: DataFrame, suffixes: Sequence[str] = T.PUBLIC_SUFFIXES) -> DataFrame:
    """(url, source, type, hit, exception, important, redirect, blocked) of each distinct request. An exception keeps a
    request from being blocked and redirected, unless an ``important`` rule matches."""
    plain = ~F.col("exception")
    found = _hits(requests, table, suffixes).groupBy("url", "source", "type").agg(
        F.bool_or(plain & F.col("blocks")).alias("hit"), F.bool_or("exception").alias("exception"), F.bool_or(plain & F.col("important") & F.col("blocks")).alias("important"),
        F.min(F.when(plain & (F.col("resource") != ""), rules.canonical_resource(F.col("resource")))).alias("redirect"),
    )
    kinds = F.coalesce(F.when(_type(F.col("type")).isin(*TYPES), _type(F.col("type"))), F.lit("other"))
    rows = requests.select("url", "source", kinds.alias("type")).distinct().alias("q")
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("url", "source", "type")]
    joined = rows.join(found.alias("f"), same, "left")
    flag = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(False)).alias(c)
    flags = joined.select("q.url", "q.source", "q.type", flag("hit"), flag("exception"), flag("important"), F.col("f.redirect").alias("named"))
    blocked = F.col("important") | (F.col("hit") & ~F.col("exception"))
    return flags.select("url", "source", "type", "hit", "exception", "important", F.when(F.col("important") | ~F.col("exception"), F.col("named")).alias("redirect"), blocked.alias("blocked"))


def page_resources(pages: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
    """(url, hide, procedural, scripts, exceptions, generichide) of each distinct page: the selectors of rules for its host
    or a parent, plain, with operators, and script calls, each sorted and joined by line feeds, without those that an
    exception for the page spares; and whether an exception with ``generichide`` matches the page."""
    parts = cosmetic.split_rule(F.col("rule"))
    named = table.select(parts.alias("x")).filter("x is not null").select("x.sep", "x.selector", cosmetic.positive_hosts(F.col("x.host")).alias("hosts")).filter("hosts is not null").select("sep", "selector", F.explode("hosts").alias("up"))
    asked_pages = pages.select(F.col(url).alias("url")).distinct()
    # hosts are far fewer than pages, so rules meet each host once
    hosts = asked_pages.select(host_of(F.col("url")).alias("host")).distinct().select("host", F.explode(rules.label_suffixes(F.col("host"))).alias("up"))
    found = hosts.join(named, "up").groupBy("host", "selector").agg(F.bool_or(F.col("sep") == "##").alias("asked"), F.bool_or(F.col("sep") == "#@#").alias("spared"))
    what = F.when(F.col("selector").startswith("+js("), "scripts").when(F.col("selector").rlike(rules.any_of(T.RUNNABLE)), "procedural").otherwise("hide")
    text = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("selector")))), "\n")
    kinds = ("hide", "procedural", "scripts")
    each = found.withColumn("what", what).groupBy("host").agg(*[text(F.col("asked") & ~F.col("spared") & (F.col("what") == k)).alias(k) for k in kinds], text(F.col("spared")).alias("exceptions"))
    documents = asked_pages.select("url", F.col("url").alias("source"), F.lit("document").alias("type"))
    quiet = general_hits(documents, table, generichide=True).filter("exception").select("url").distinct().withColumn("quiet", F.lit(True))
    rows = asked_pages.withColumn("host", host_of(F.col("url"))).join(each, "host", "left").join(quiet, "url", "left")
    return rows.select("url", *[F.coalesce(k, F.lit("")).alias(k) for k in (*kinds, "exceptions")], F.coalesce("quiet", F.lit(False)).alias("generichide"))
