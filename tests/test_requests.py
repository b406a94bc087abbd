"""Request matching, page resources, audit commands and run metrics."""

import json
import logging
import random
import re

from pyspark.sql import functions as F

from hedgerow.operators import requests
from hedgerow.plans import audits
from hedgerow.plans.build import build
from hedgerow.sources import lists

REQUEST = "url string, source string, type string"


def rule_rows(spark, rules):
    return spark.createDataFrame([(r, "extra") for r in rules], "rule string, url string")


def answers(spark, asked, rules):
    rows = requests.check_requests(spark.createDataFrame(asked, REQUEST), rule_rows(spark, rules)).collect()
    return {(r.url, r.source, r.type): (r.hit, r.exception, r.important, r.redirect, r.blocked) for r in rows}


def test_forms_and_options(spark):
    rules = ["||shop.test^", "/promo/*/pic^", "|http://edge.test/", "flv|", "@@||shop.test^$script", "||must.test^$important", "@@||must.test^", "/n[0-9]+z/$domain=in.test", "*$script,domain=on.test|~off.on.test",
             "||swap.test^$redirect=noopjs", "xyz", "||far.test^$third-party", "||gone.test^", "||gone.test^$badfilter", "Big$match-case", "/(/", "||soft.test^$redirect-rule=noopjs", "||quiet.test^$csp=none", "k|$image", "||s.test^$https", "##.x"]
    no, yes = (False, False, False, None, False), (True, False, False, None, True)
    want = {
        ("https://a.shop.test/x", "https://p.test/", "image"): yes,
        ("https://notshop.test/", "https://p.test/", "image"): no,
        ("https://shop.test:80/", "https://p.test/", "script"): (True, True, False, None, False),
        ("https://me@shop.test/", None, "document"): yes,
        ("https://me:shop.test/@other.test/", None, "other"): no,
        ("http://q/promo/a/pic?x", None, "image"): yes,
        ("http://q/promo/a/pics", None, "image"): no,
        ("http://edge.test/", None, "other"): yes,
        ("https://edge.test/", None, "other"): no,
        ("http://q/a.FLV", None, "media"): yes,
        ("https://must.test/", None, "other"): (True, True, True, None, True),
        ("http://z/n12z", "https://q.in.test/", "xmlhttprequest"): yes,
        ("http://z/n12z", "https://q.out.test/", "xmlhttprequest"): no,
        ("http://z/", "https://on.test/", "script"): yes,
        ("http://z/", "https://off.on.test/", "script"): no,
        ("http://swap.test/", None, "script"): (True, False, False, "noop.js", True),
        ("http://soft.test/", None, "script"): (False, False, False, "noop.js", False),
        ("http://zxyzz", "", "other"): yes,
        ("http://far.test/", "http://www.far.test/", "other"): no,
        ("http://far.test/", "http://www.near.test/", "other"): yes,
        ("http://gone.test/", None, "other"): no,
        ("http://o/aBigb", None, "other"): yes,
        ("http://o/abigb", None, "other"): no,
        ("http://quiet.test/", None, "other"): no,
        ("http://o/k", None, "image"): yes,
        ("http://s.test/", None, "other"): no,
        ("https://s.test/", None, "other"): yes,
        (None, None, "other"): no,
        ("no scheme", None, "other"): no,
    }
    assert answers(spark, [*want, *want], rules) == want
    assert answers(spark, [("http://z/(", None, "odd")], rules) == {("http://z/(", None, "other"): no}
    assert answers(spark, [("http://z/", None, None)], []) == {("http://z/", None, "other"): no}
    assert answers(spark, [], rules) == {}


def test_patterns_against_brute_force(spark):
    """Every rule on every request, one by one."""
    rng = random.Random(11)
    bit = lambda: "".join(rng.choice("abA1/.-_%?*^") for _ in range(rng.randint(1, 5)))
    rules = sorted({rng.choice(["", "", "||", "|"]) + bit() + rng.choice(["", "", "|"]) for _ in range(250)})
    rules = [r for r in rules if r not in ("|", "||") and not r.startswith(("/", "@@")) and len(r.strip("|")) > 0]
    urls = sorted({f"http://{rng.choice(['a', 'b', 'a.b', 'b1.a'])}{rng.choice([':8', ''])}/" + "".join(rng.choice("abA1/.-_%?") for _ in range(rng.randint(0, 8))) for _ in range(120)})

    def regex(rule):
        head, core, tail = re.fullmatch(r"(\|\|?)?(.*?)(\|)?", rule).groups()
        body = "".join({"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|\\Z)"}.get(c, re.escape(c)) for c in core)
        return re.compile({"||": r"\A[a-z]+://(?:[^/?#:]*\.)?", "|": r"\A"}.get(head, "") + body + (r"\Z" if tail else ""), re.IGNORECASE)

    table, asked = rule_rows(spark, rules), spark.createDataFrame([(u, None, "image") for u in urls], REQUEST)
    taken = {r.rule for r in requests.filed_rules(table).collect()}
    assert len(taken) > 150
    got = {(r.url, r.rule) for r in requests.general_hits(asked, table).collect()}
    assert got == {(u, r) for r in taken for u in urls if regex(r).search(u)}


def test_many_paths_of_one_host_meet_few_rules(spark):
    rules = [f"||one.test/en/{i}^" for i in range(300)] + ["||one.test^", "||test/en/7*x"]
    urls = [f"https://www.one.test/en/{i}{tail}" for i in range(300) for tail in ("", "?q=1")]
    table, asked = rule_rows(spark, rules), spark.createDataFrame([(u, None, "other") for u in urls], REQUEST)
    keyed = lambda rows, c: rows.select(c, F.explode("keys").alias("key"))
    met = keyed(requests.asked(asked), "url").join(keyed(requests.filed_rules(table), "rule"), "key").count()
    assert met == 3 * len(urls)  # the rule of its path, that of its host, and one that is open behind /en
    rows = requests.general_hits(asked, table).collect()
    assert len(rows) == 2 * len(urls) and {r.rule for r in rows} == set(rules[:-1])


def test_paths_against_brute_force(spark):
    """Rules for hosts and paths on every request, one by one."""
    rng = random.Random(12)
    bit = lambda most: "".join(rng.choice(["a", "b", "A", "/", "/", "?", "é", "😀", "-", "%2", "=", ":"]) for _ in range(rng.randint(0, most)))
    deep = "/a" * 20
    rules = {"||" + rng.choice(["a.test", "test", "w.a.test"]) + "/" + bit(3) + rng.choice(["", "^", "^", "|", "*", "*^", "^a", "/", "/^", "|b"]) for _ in range(400)}
    rules = sorted(rules | {f"||test{deep}^", f"||test{deep}/b", f"||test{deep}b^", f"||test{deep[:33]}^", f"||test{deep[:30]}|"})
    urls = {f"http://{rng.choice(['', 'me@'])}{rng.choice(['a.test', 'w.a.test', 'W.a.Test', 'x.test', 'test'])}{rng.choice(['', '', '', ':8'])}{rng.choice(['/', '/', '/', '?', ''])}{bit(5)}" for _ in range(400)}
    urls = sorted(urls | {f"http://a.test{deep}{x}" for x in ("", "b", "/b", "/bc", "?")} | {f"http://test{deep[:30]}"})

    def regex(rule):
        core, tail = re.fullmatch(r"\|\|(.*?)(\|)?", rule).groups()
        body = "".join({"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|\\Z)"}.get(c, re.escape(c)) for c in core)
        return re.compile(r"\A[a-z]+://(?:[^/?#:]*\.)?" + body + (r"\Z" if tail else ""), re.IGNORECASE | re.ASCII)

    table, asked = rule_rows(spark, rules), spark.createDataFrame([(u, None, "image") for u in urls], REQUEST)
    taken = {r.rule for r in requests.filed_rules(table).collect()}
    assert len(taken) > 150
    got = {(r.url, r.rule) for r in requests.general_hits(asked, table).collect()}
    want = {(u, r) for r in taken for u in urls if regex(r).search(re.sub("(?<=//)[^/?#@]*@", "", u))}
    assert len(want) > 300 and got == want


def test_page_resources(spark):
    pages = spark.createDataFrame([("https://w.a.test/x", 1), ("https://w.a.test/x", 2), ("http://b.test/", 3), (None, 4)], "url string, rule int")
    rules = ["a.test##.ad", "w.a.test#@#.ad", "a.test##.b", "a.test##.c:has-text(x)", "a.test##+js(f, 1)", "@@||b.test^$generichide", "b.test,a.test##.z", "a.test##.b"]
    got = {r.url: (r.hide, r.procedural, r.scripts, r.exceptions, r.generichide) for r in requests.page_resources(pages, rule_rows(spark, rules)).collect()}
    assert got == {"https://w.a.test/x": (".b\n.z", ".c:has-text(x)", "+js(f, 1)", ".ad", False), "http://b.test/": (".z", "", "", "", True), None: ("", "", "", "", False)}


def test_audit_commands(spark, tmp_path, capsys):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("[Adblock Plus 2.0]\n! note\n||a.test^\n||b.test/x^\n||w.a.test^\n||BIG.test^\na.test##.ad\nw.a.test##.ad\n")
    bad.write_text("||a.test^\n@@||a.test^\na.test##.x:contains(y)\n")
    assert audits.main(["liveness", str(good), "--baseline", str(bad)]) == 0
    assert "lines_more: 3" in (out := capsys.readouterr().out) and "dead: 0" in out and out.endswith("PASS\n")
    assert audits.main(["liveness", str(bad)]) == 1
    assert "contaminated: 1" in (out := capsys.readouterr().out) and "\ndead: 1" in out and out.endswith("FAIL\n")
    assert audits.main(["equivalence", str(good)]) == 0
    assert "cosmetic_removed: 1" in (out := capsys.readouterr().out) and "\nmismatches: 0" in out
    assert audits.main(["inefficiency", str(good)]) == 0 and "mixed-case 1: ||BIG.test^" in capsys.readouterr().out


def test_run_metrics(spark, tmp_path, caplog):
    texts = {"http://x/a": b"||a.test^\n||w.a.test^\n||a.test^\n"}
    config = lists.Config(lists=(lists.ListSource("one", "http://x/a"), lists.ListSource("two", "http://x/b")))
    with caplog.at_level(logging.INFO, logger="hedgerow.build"):
        build(spark, config, str(tmp_path / "out.txt"), lists.Fetcher(lists.FetchConfig(retries=0), lambda url: texts[url]))
    events = [json.loads(r.message) for r in caplog.records if r.name == "hedgerow.build"]
    assert [e["event"] for e in events] == ["analyzed", "failed", "optimized", "written"]
    assert events[0]["list"] == "one" and events[0]["network_rules"] == 3 and events[1]["list"] == "two"
    assert (events[2]["sources_fetched"], events[2]["sources_failed"], events[2]["duplicates"], events[2]["network_subsumed"], events[3]["final_rules"]) == (1, 1, 1, 1, 1)
