"""Rules by rule: normalization, parser buckets, predicates, rewriting."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from hedgerow.functions import cosmetic, rules
from hedgerow.operators import rewrite


def over(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_normalize_line(spark):
    lines = [
        "0.0.0.0 banner.test pixel.test", "::1 beacon.pixel.test", "127.0.0.1 ip6-loopback local x1.banner.test # why", "127.0.0.1 broadcasthost localhost",
        "fe00::0 ip6-mcastprefix", "0.0.0.0 ip6-allnodes ip6-allrouters", "# why", "||banner.test^$empty", "||banner.test^$mp4", "||banner.test^$empty,script", "||banner.test^$redirect=noopjs",
        "||e.com^$redirect-rule=noopmp4-1s", "||e.com^$rewrite=abp-resource:blank-mp4", "||e.com^$3p", "||e.com^$csp=script-src 'none'", "  x  ", "0.0.0.0 wide.banner.test", "[::1] a.b",
    ]
    got = over(spark, lines, lambda c: rules.normalize_line(c))
    assert [list(x["lines"]) for x in got] == [
        ["||banner.test^", "||pixel.test^"], ["||beacon.pixel.test^"], ["||x1.banner.test^"], [], [], [], ["# why"], ["||banner.test^$redirect=empty"], ["||banner.test^$redirect=noop-1s.mp4"],
        ["||banner.test^$redirect=empty,script"], ["||banner.test^$redirect=noop.js"], ["||e.com^$redirect-rule=noop-1s.mp4"], ["||e.com^$rewrite=noop-1s.mp4"], ["||e.com^$3p"],
        ["||e.com^$csp=script-src 'none'"], ["x"], ["||wide.banner.test^"], ["||a.b^"],
    ]
    assert [x["hosts_converted"] for x in got][:7] == [True, True, True, False, False, False, False]


def test_normalize_hosts_line(spark):
    got = over(spark, ["# c", "! c", "", "x2.pixel.test", "||banner.test^$image", "0.0.0.0 *.A.b. c # d", "localhost", "a.b # c"], lambda c: rules.normalize_hosts_line(c)["lines"])
    assert got == [[], [], [], ["||x2.pixel.test^"], ["||banner.test^$image"], ["||a.b^", "||c^"], ["||localhost^"], ["a.b # c"]]


def test_is_ip_agrees_with_python(spark):
    values = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "1:2::7:8", "::1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "g::", "12345::", "fe80::1%eth0", "example.com", "", ":1", "1:"]

    def want(v):
        try:
            return bool(ipaddress.ip_address(v)) and "%" not in v
        except ValueError:
            return False

    assert over(spark, values, rules.is_ip) == [want(v) for v in values]
    assert over(spark, [f"[{v}]" for v in values if v], rules.is_ip) == [want(v) for v in values if v]


def test_buckets(spark):
    cases = {
        "": "empty", "! note": "unsupported", "[Adblock Plus 2.0]": "unsupported", "||a.com^": "network", "||a.com^$csp=script-src 'none'": "network", "||a.com^$stealth": "unsupported_options",
        "||a.com^$redirect=noop.js": "network", "||a.com^$redirect=chartbeat.js": "redirects_removed", "||a.com^$redirect=abp-resource:blank-mp4": "network", "||a.com^$redirect=": "redirects_removed",
        "a.com##.ad": "cosmetic", "a.com##.ad > p": "cosmetic", "a.com#@#.ad": "cosmetic", "a.com##+js(set-cookie, q, 1)": "scriptlets_removed", "a.com#@#+js(x)": "scriptlets_removed",
        "a.com##script:inject(x)": "scriptlets_removed", "##+js(x)": "unsupported_cosmetic", "a.com#$#x": "unsupported_cosmetic", "a.com#%#x": "unsupported_cosmetic", "a.com$$div": "unsupported_cosmetic",
        "a.com##": "unsupported_cosmetic", "a.com##^div": "unsupported_cosmetic", "a.com##.a:has-text(x": "invalid", "||": "invalid",
    }
    assert dict(zip(cases, over(spark, list(cases), rules.bucket), strict=True)) == cases
    assert over(spark, ["a.com##+js(x)"], lambda c: rules.bucket(c, scriptlets=False)) == ["cosmetic"]


@pytest.mark.parametrize("flag", [True, False])
def test_scriptlet_switch(spark, flag):
    assert over(spark, ["a.com##+js(x)", "a.com##.b"], lambda c: rules.is_scriptlet(c, flag)) == [flag, False]


def test_rewrites(spark):
    cases = {
        "||Banner.test^$script": "||banner.test^$script", "*spot*": "spot", "*spot": "spot", "||banner.test^$all": "||banner.test^", "||banner.test^$script,all": "||banner.test^",
        "||banner.test^$all,domain=pixel.test": "||banner.test^$domain=pixel.test", "||Banner.test^$match-case": "||Banner.test^$match-case", "/spot/*": "/spot/*", "||banner.test^$script,third-party": "||banner.test^$script,third-party",
        "||banner.test^$script": "||banner.test^$script", "||banner.test^$document": "||banner.test^$document", "/spot/*$third-party,script": "/spot/*$third-party,script", "a.com##.Ad": "a.com##.Ad", "||x^$nope": "||x^$nope",
    }
    assert dict(zip(cases, over(spark, list(cases), rewrite.best_text), strict=True)) == cases


def test_ascii_case_only(spark):
    assert over(spark, ["ÀB$C", "ÀB"], rules.lowercase_pattern) == ["Àb$C", "Àb"]


def test_simple_rules(spark):
    values = ["||m.n.org.nz/one/two^", "@@||a^", "||a^$script", "||a*^", "||A.com^", "||a_b.com^", "^/foo", "a.com^", "||a.com/", "||a.com/foo/", "||a/b/^", "||a.com"]
    got = over(spark, values, rules.simple_rule)
    assert [tuple(x) if x else None for x in got] == [("m.n.org.nz", "one/two"), None, None, None, None, None, None, None, ("a.com", ""), ("a.com", "foo"), ("a", "b/"), None]


def test_carets(spark):
    assert over(spark, ["||banner.test^", "||banner.test^$script", "||banner.test/spot^", "@@||a^", "||a^b^", "||*^"], rules.caret_to_slash) == ["||banner.test/", "||banner.test/$script", "||banner.test/spot^", "@@||a^", "||a^b/", "||*^"]


def test_cosmetic_transform(spark):
    h = "banner.test##"
    cases = {
        ".a:contains(Anzeige):upward(3)": [".a:has-text(Anzeige):upward(3)"], ".a:nth-ancestor(2)": [".a:upward(2)"], ".a:-abp-contains(x)": [".a:has-text(x)"], ".a:others()": [], ".a:others(.b)": [], ".a:matches-media(screen)": [],
        ".a:-abp-properties(x)": [], ".a:matches-prop(x)": [], ".a:remove-attr()": [], ".a:has-text(x):others()": [], ".a:contains(one(two))": [], ".a:watch-attr(open):remove-class(shut)": [".a:remove-class(shut)"],
        ".a:watch-attr(x)": [".a"], ".a, .b:has-text(x)": [".a", ".b:has-text(x)"], ".a, .b, .c": [".a, .b, .c"], ".a:others(), .b": [".b"], ".a:style(margin: calc(1px,2px)), .c": [".a:style(margin: calc(1px,2px))", ".c"],
        ".a:has-text('x,y'), [b=\"c,d\"]": [".a:has-text('x,y')", "[b=\"c,d\"]"], ".a:contains(x": [],
    }
    got = over(spark, [h + c for c in cases], cosmetic.transform)
    assert dict(zip(cases, got, strict=True)) == {k: [h + x for x in v] for k, v in cases.items()}
    assert over(spark, ["banner.test#?#.a:-abp-properties(x)", "||a^", None], cosmetic.transform) == [["banner.test#?#.a:-abp-properties(x)"], ["||a^"], [None]]


def test_line_trim_is_unicode(spark):
    assert over(spark, [" \tx  "], rules.trim) == ["x"]
