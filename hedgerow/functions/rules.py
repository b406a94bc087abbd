"""Column functions over rule text: normalization, hosts lines, options, the parser and the validation predicate."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

_EMPTY = "array<string>"


def trim(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def none() -> Column:
    return F.array().cast(_EMPTY)


def ascii_lower(s: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def any_of(parts: tuple[str, ...]) -> str:
    """A regular expression that finds any of the parts."""
    return "|".join(map(re.escape, parts))


# --- options -------------------------------------------------------------------------------------------------------


def pattern_of(rule: Column) -> Column:
    """What stands before the last dollar sign."""
    return F.when(rule.contains("$"), F.regexp_extract(rule, r"(?s)\A(.*)\$[^$]*\z", 1)).otherwise(rule)


def options_of(rule: Column) -> Column:
    """What stands after the last dollar sign; null without one."""
    return F.when(rule.contains("$"), F.substring_index(rule, "$", -1))


def option_list(rule: Column) -> Column:
    """The options, as an array."""
    return F.when(rule.contains("$"), F.split(F.substring_index(rule, "$", -1), ",", -1)).otherwise(none())


def with_options(pattern: Column, options: Column) -> Column:
    """The rule of a pattern and its options."""
    return F.when(F.size(options) == 0, pattern).otherwise(F.concat(pattern, F.lit("$"), F.array_join(options, ",")))


def canonical_resource(value: Column) -> Column:
    """A redirect resource's canonical name: without its prefix, aliases resolved."""
    known = F.create_map(*[F.lit(x) for pair in T.RESOURCE_ALIASES.items() for x in pair])
    bare = F.regexp_replace(value, r"\Aabp-resource:", "")
    return F.coalesce(F.try_element_at(known, bare), bare)


def translate_option(option: Column) -> Column:
    """An option in the form that the engine knows."""
    name, value = F.substring_index(option, "=", 1), F.regexp_extract(option, r"(?s)\A[^=]*=(.*)\z", 1)
    redirect = option.contains("=") & name.isin(*T.REDIRECTS)
    return F.when(option == "empty", "redirect=empty").when(option == "mp4", "redirect=noop-1s.mp4").when(redirect, F.concat(name, F.lit("="), canonical_resource(value))).otherwise(option)


def normalize_options(line: Column) -> Column:
    """A line with its options translated; any line with a dollar sign counts."""
    return F.when(line.contains("$"), F.concat(pattern_of(line), F.lit("$"), F.array_join(F.transform(option_list(line), translate_option), ","))).otherwise(line)


# --- hosts lines ---------------------------------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v6() -> str:
    """Every written form of an IPv6 address: eight groups, or fewer around one double colon; the last two may be IPv4."""
    h = "[0-9A-Fa-f]{1,4}"
    forms = [rf"(?:{h}:){{7}}{h}", rf"(?:{h}:){{6}}{_V4}"]
    for before in range(8):
        head = "" if not before else h if before == 1 else rf"(?:{h}:){{{before - 1}}}{h}"
        after = 7 - before
        tail = rf"(?:(?:{h}:){{0,{after - 1}}}{h})?" if after else ""
        forms.append(f"{head}::{tail}")
        if after >= 2:
            forms.append(rf"{head}::(?:{h}:){{0,{after - 2}}}{_V4}")
    return "|".join(forms)


_IP = rf"\A(?:{_V4}|{_v6()}|\[(?:{_V4}|{_v6()})\])\z"
_TOKENS = r"(?U)\s+"


def is_ip(token: Column) -> Column:
    """An IPv4 or IPv6 address, in brackets or not."""
    return F.length(token).between(2, 47) & token.rlike(_IP)


def is_hostname(s: Column) -> Column:
    """1 to 253 ASCII letters, digits, dots, hyphens and underscores."""
    return s.rlike(r"\A[A-Za-z0-9._-]{1,253}\z")


def hosts_domains(line: Column) -> Column:
    """The domains of a hosts line: every name up to a comment, but for the local machine's."""
    kept = F.regexp_replace(line, r"(?Us)\s#.*\z", "")
    names = F.slice(F.split(kept, _TOKENS, -1), 2, 1 << 30)
    clean = F.transform(names, lambda t: ascii_lower(F.regexp_replace(F.regexp_replace(t, r"\.+\z", ""), r"\A\*\.", "")))
    return F.filter(clean, lambda h: is_hostname(h) & ~h.isin(*T.LOCAL_NAMES))


def _blocked(domains: Column) -> Column:
    return F.transform(domains, lambda d: F.concat(F.lit("||"), d, F.lit("^")))


def _normalized(candidates: Column, converted: Column) -> Column:
    return F.struct(candidates.alias("lines"), converted.alias("hosts_converted"))


def normalize_line(line: Column) -> Column:
    """struct(lines, hosts_converted): the candidates of a line of an ordinary list."""
    t = trim(line)
    host_led, rules = is_ip(F.split(t, _TOKENS, 2)[0]), _blocked(hosts_domains(t))
    return F.when(host_led, _normalized(rules, F.size(rules) > 0)).otherwise(_normalized(F.array(normalize_options(t)), F.lit(False)))


def normalize_hosts_line(line: Column) -> Column:
    """struct(lines, hosts_converted): the candidates of a line of a hosts list."""
    t = trim(line)
    no_rule = (t == "") | t.startswith("#") | t.startswith("!")
    bare = ~is_ip(F.split(t, _TOKENS, 2)[0]) & is_hostname(t)
    return F.when(no_rule, _normalized(none(), F.lit(False))).when(bare, _normalized(F.array(F.concat(F.lit("||"), t, F.lit("^"))), F.lit(True))).otherwise(normalize_line(line))


# --- the parser ----------------------------------------------------------------------------------------------------
# Our own definition of the language, table-driven; see README for what it covers.

_SEPARATOR = r"#@?[?$%]?#|\$\$"


def separator(rule: Column) -> Column:
    """The cosmetic separator, '' for other rules. The exception form is looked for first."""
    return F.when(rule.contains("#@#"), "#@#").when(rule.contains("##"), F.when(rule.rlike(r"\A[^#]*[?]##"), "").otherwise("##")).otherwise(F.regexp_extract(rule, _SEPARATOR, 0))


def is_full_regex(rule: Column) -> Column:
    """The pattern is a regular expression between slashes."""
    return trim(pattern_of(rule)).rlike(r"(?s)\A/.*/\z")


def trim_wildcards(rule: Column) -> Column:
    """A rule without the wildcards at its pattern's edges; anchors and options stay."""
    parts = r"(?s)\A((?:@@)?(?:\|\|?)?)(.*?)(\|?)\z"
    pattern, options = pattern_of(rule), options_of(rule)
    anchor, right = F.regexp_extract(pattern, parts, 1), F.regexp_extract(pattern, parts, 3)
    core = F.regexp_replace(F.regexp_extract(pattern, parts, 2), r"\*+\z", "")
    core = F.when(anchor.contains("|"), core).otherwise(F.regexp_replace(core, r"\A\*+", ""))
    return F.concat(anchor, core, right, F.when(options.isNull(), "").otherwise(F.concat(F.lit("$"), options)))


def lowercase_pattern(rule: Column) -> Column:
    """A rule with its pattern in ASCII lower case; options stay."""
    return F.concat(ascii_lower(pattern_of(rule)), F.when(rule.contains("$"), F.concat(F.lit("$"), options_of(rule))).otherwise(""))


def _named(options: Column, *names: str) -> Column:
    """The values of options of these names (without a tilde), sorted, as one string; null if there are none."""
    found = F.filter(options, lambda o: F.substring_index(F.regexp_replace(o, r"\A~", ""), "=", 1).isin(*names))
    return F.when(F.size(found) > 0, F.array_join(F.array_sort(found), ","))


def _option_name(o: Column) -> Column:
    return F.substring_index(F.regexp_replace(o, r"\A~+", ""), "=", 1)


def kind(rule: Column) -> Column:
    """'network', 'cosmetic', or why a rule doesn't parse: 'empty', 'unsupported', 'unsupported_options',
    'unsupported_cosmetic', 'invalid'."""
    return let(trim(rule), lambda t: let(separator(t), lambda sep: _kind(t, sep)))


def _kind(t: Column, sep: Column) -> Column:
    selector = F.when(sep != "", F.substring(t, F.instr(t, sep) + F.length(sep), F.length(t)))
    host = F.when(sep != "", F.substring(t, F.lit(1), F.instr(t, sep) - 1))
    generic = (host == "") & (sep != "#@#")
    action = selector.rlike(r":(?:style|remove|remove-attr|remove-class)\(")
    opens = F.length(selector) - F.length(F.translate(selector, "(", ""))
    closes = F.length(selector) - F.length(F.translate(selector, ")", ""))
    bad_cosmetic = (
        sep.rlike(r"[$%]")
        | (trim(selector) == "")
        | selector.startswith("^")
        | (selector.startswith("+js(") & (generic | selector.rlike(r"\A\+js\(\s*\)\z")))
        | (generic & action)
        | selector.rlike(any_of(T.DEAD + T.EMPTY_ACTIONS))
    )
    options = F.when(is_full_regex(t) & ~t.rlike(r"/\$[^/]*\z"), none()).otherwise(option_list(t))
    known = F.forall(options, lambda o: _option_name(o).isin(*T.CONTENT_TYPES, *T.FLAGS) & ~o.contains("=") | F.substring_index(o, "=", 1).isin(*T.VALUED))
    bare = F.exists(options, lambda o: F.substring_index(o, "=", 1).isin("domain", "from") & (F.regexp_extract(o, "=(.+)", 1) == ""))
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"\A(?:!|\[.*\]\z|#(?:\s|\z|#{3}))"), "unsupported")
        .when(sep != "", F.when(bad_cosmetic, "unsupported_cosmetic").when((opens != closes) | selector.contains("{"), "invalid").otherwise("cosmetic"))
        .when(~known, "unsupported_options")
        .when(bare | (pattern_of(t).isin("", "@@", "|", "||") & (F.size(options) == 0)), "invalid")
        .otherwise("network")
    )


def signature(rule: Column) -> Column:
    """What a rule means, apart from its text; equal for equal rules. Rules that don't parse have none (null)."""
    return let(trim(rule), lambda t: let(kind(t), lambda what: F.when(what == "network", let(option_list(t), lambda o: _network_signature(t, o))).when(what == "cosmetic", _cosmetic_signature(t))))


def _network_signature(t: Column, options: Column) -> Column:
    pattern = F.when(is_full_regex(t), pattern_of(t)).otherwise(pattern_of(trim_wildcards(t)))
    exact = F.array_contains(options, "match-case")
    host_only = pattern.rlike(r"\A(?:@@)?\|\|[^/^*|]+\^\z")
    positive = F.filter(options, lambda o: o.isin(*T.CONTENT_TYPES))
    negative = F.filter(options, lambda o: o.startswith("~") & _option_name(o).isin(*T.CONTENT_TYPES))
    types = (
        F.when(F.array_contains(options, "all"), "*")
        .when(F.size(positive) > 0, F.array_join(F.array_sort(F.array_distinct(F.transform(positive, lambda o: F.when(o == "xhr", "xmlhttprequest").otherwise(o)))), ","))
        .when(F.size(negative) > 0, F.array_join(F.array_sort(F.array_distinct(negative)), ","))
        .when(host_only, "*")
        .otherwise("")
    )
    scope = F.transform(F.filter(options, lambda o: _option_name(o).isin("domain", "from")), lambda o: F.regexp_extract(o, "=(.*)", 1))
    domains = F.array_join(F.array_sort(F.flatten(F.transform(scope, lambda v: F.split(v, r"\|", -1)))), "|")
    party = F.array_join(F.array_sort(F.transform(F.filter(options, lambda o: _option_name(o).isin("third-party", "first-party", "3p", "1p", "http", "https")), lambda o: F.when(o == "3p", "third-party").when(o == "1p", "first-party").otherwise(o))), ",")
    rest = F.array_join(F.array_sort(F.filter(options, lambda o: _option_name(o).isin("important", "match-case", "badfilter", "generichide", "redirect", "redirect-rule", "rewrite", "csp", "removeparam"))), ",")
    return F.concat_ws("\x1f", F.when(is_full_regex(t), "x").otherwise("n"), F.when(exact, pattern).otherwise(ascii_lower(pattern)), types, domains, party, rest)


def _cosmetic_signature(t: Column) -> Column:
    sep = separator(t)
    hosts = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.substring(t, F.lit(1), F.instr(t, sep) - 1)), ",", -1))), ",")
    return F.concat_ws("\x1f", F.lit("c"), sep, hosts, trim(F.substring(t, F.instr(t, sep) + F.length(sep), F.length(t))))


def is_regex(rule: Column) -> Column:
    """The pattern needs more than a plain search: a separator or a wildcard inside, or a regular expression."""
    core = F.regexp_replace(F.regexp_replace(pattern_of(trim(rule)), r"\A(?:@@)?\|?\|?", ""), r"\|\z", "")
    return core.rlike(r"\^|\*") | is_full_regex(rule)


def mixed_case(rule: Column) -> Column:
    """The pattern has an upper-case ASCII letter."""
    return pattern_of(rule).rlike("[A-Z]")


def rank(rule: Column) -> Column:
    """How costly a rule's text is: struct(regex, mixed case, bytes); the least is best."""
    regex = F.when(kind(rule) == "network", is_regex(rule)).otherwise(F.lit(False))
    return F.struct(regex.cast("int").alias("regex"), mixed_case(rule).cast("int").alias("mixed"), F.octet_length(rule).alias("bytes"))


# --- predicates ----------------------------------------------------------------------------------------------------


def is_scriptlet(rule: Column, enabled: bool = True) -> Column:
    """A rule that injects a script."""
    sep = separator(rule)
    selector = F.substring(rule, F.instr(rule, sep) + F.length(sep), F.length(rule))
    return F.lit(enabled) & (sep != "") & (selector.startswith("+js(") | selector.contains("script:inject("))


def is_unsupported_redirect(rule: Column, allowed: tuple[str, ...] = T.REDIRECT_ALLOWLIST) -> Column:
    """A redirect to a resource that isn't allowed, or to none."""
    redirects = F.filter(option_list(rule), lambda o: F.substring_index(o, "=", 1).isin(*T.REDIRECTS))
    value = F.regexp_extract(F.get(redirects, F.lit(0)), r"(?s)\A[^=]*=(.*)\z", 1)
    return (F.size(redirects) > 0) & ~F.coalesce(canonical_resource(value).isin(*allowed), F.lit(False))


def bucket(rule: Column, scriptlets: bool = True, allowed: tuple[str, ...] = T.REDIRECT_ALLOWLIST) -> Column:
    """Where a candidate is counted; 'network' and 'cosmetic' rules are kept."""
    return let(
        kind(rule),
        lambda k: F.when((k == "network") & is_unsupported_redirect(rule, allowed), "redirects_removed").when((k == "cosmetic") & is_scriptlet(rule, scriptlets), "scriptlets_removed").otherwise(k),
    )


# --- simple rules --------------------------------------------------------------------------------------------------

_SIMPLE = r"(?s)\A\|\|([a-z0-9.-]*)(?:/(.*))?[\^/]\z"


def simple_rule(rule: Column) -> Column:
    """struct(host, path) of a rule that is a host and a path alone, else null."""
    fits = ~rule.rlike(r"[*$@]") & rule.rlike(_SIMPLE)
    return F.when(fits, F.struct(F.regexp_extract(rule, _SIMPLE, 1).alias("host"), F.regexp_extract(rule, _SIMPLE, 2).alias("path")))


def label_suffixes(host: Column) -> Column:
    """A host and its parents, longest first."""
    labels = F.split(host, r"\.", -1)
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), lambda s: s != "")


def path_prefixes(path: Column) -> Column:
    """'' and every prefix of a path that ends before a slash, and the path."""
    parts = F.split(path, "/", -1)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def caret_to_slash(rule: Column) -> Column:
    """A bare-host rule with its caret as a slash."""
    t, pattern = trim(rule), pattern_of(trim(rule))
    converts = pattern.rlike(r"(?s)\A\|\|[^/*@]+\^\z")
    return F.when(converts, F.concat(F.regexp_replace(pattern, r"\^\z", "/"), F.when(t.contains("$"), F.concat(F.lit("$"), options_of(t))).otherwise(""))).otherwise(rule)
