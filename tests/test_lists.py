"""Whole lists: subsumption, optimizing, matching, sources, includes, sink, streaming."""

import random
import urllib.error

import pytest

from hedgerow.operators import audit, classify, match, subsume
from hedgerow.plans.build import build
from hedgerow.plans.optimize import optimize
from hedgerow.sources import lists
from hedgerow.streaming.incremental import line_stream, store_rules


def table(spark, rules):
    return spark.createDataFrame([(r, r) for r in rules], "rule string, ord_key string")


def left(df):
    return sorted(r.rule for r in df.collect())


def brute_network(rules):
    """One by one: the shortest first, kept if nothing kept covers it."""
    simple = []
    for r in sorted(rules):
        body = r[2:-1]
        host, _, path = body.partition("/")
        simple.append((host, path.lower(), r))
    kept = []
    for h, p, r in sorted(simple, key=lambda x: (len(x[0]), len(x[1]))):
        covers = lambda a, b: (b == a or b.endswith("." + a))
        if not any(covers(h2, h) and (p2 in ("", p) or p.startswith(p2 + "/")) for h2, p2, _ in kept):
            kept.append((h, p, r))
    return sorted(r for _, _, r in kept)


def test_network_subsume_against_brute_force(spark):
    rng = random.Random(2)
    for _ in range(3):
        rules = {"||" + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + "".join("/" + rng.choice(["x", "Y", "xx"]) for _ in range(rng.randint(0, 3))) + "^" for _ in range(80)}
        got = left(subsume.network_subsume(table(spark, rules)))
        want = brute_network(rules)
        assert [g.lower() for g in got] == [w.lower() for w in want]
        assert left(subsume.network_subsume(table(spark, got))) == got


def test_network_subsume_passes_others(spark):
    rules = ["||com^", "||example.com^", "||a.example.com/x^", "||/", "@@||b^", "##.ad", "||z.org/foo^", "||z.org/foobar^", "||z.org/foo/bar^"]
    assert left(subsume.network_subsume(table(spark, rules))) == sorted(["||com^", "||/", "@@||b^", "##.ad", "||z.org/foo^", "||z.org/foobar^"])


def test_badfilters(spark):
    rules = ["||a^$document", "||a^$script", "||a^$document,badfilter", "||b^", "||b^$badfilter", "||c^$image,script", "||c^$script,image,badfilter"]
    assert left(subsume.strip_badfilters(table(spark, rules))) == ["||a^$script", "||c^$image,script"]


def test_strict(spark):
    rules = ["||a^", "||a/", "||b/", "||b^", "||c/x/", "||c/x^", "||c/x/y^", "||d/", "||s.d^", "||s.d/p^"]
    assert left(subsume.network_subsume(table(spark, rules), strict=True)) == sorted(["||a^", "||b^", "||c/x^", "||d/", "||s.d^"])
    rules = ["||c^$image,script", "||c^$script,image,badfilter"]
    assert left(subsume.strip_badfilters(table(spark, rules), strict=True)) == []


def test_scoped(spark):
    rules = ["||a^", "||a^$script", "||a^$~image,third-party", "||a^$document", "||a^$important", "||a^$script,document", "||b^$script"]
    assert left(subsume.scoped_subsume(table(spark, rules))) == sorted(["||a^", "||a^$document", "||a^$important", "||a^$script,document", "||b^$script"])


def test_cosmetic_subsume(spark):
    f = lambda rules: left(subsume.cosmetic_subsume(table(spark, rules)))
    assert f(["##.ad", "example.com##.ad", "www.example.com##.ad"]) == ["##.ad", "example.com##.ad"]
    assert f(["example.com##.ad", "www.example.com##.ad", "sub.www.example.com##.ad", "unrelated.com##.ad"]) == ["example.com##.ad", "unrelated.com##.ad"]
    same = ["pl##.ad", "android.com.pl##.ad", "co.uk##.x", "www.bbc.co.uk##.x"]
    assert f(same) == sorted(same)
    assert f(["example.com,www.example.com##.ad", "sub.example.com##.ad"]) == ["example.com,www.example.com##.ad"]
    keep = ["example.*##.ad", "~a.example.com##.ad", "www.example.com#@#.ad", "example.com##.ad", "www.example.com##.b:has-text(x)", "example.com##.b:has-text(x)", "b.com,a.com##.q", "a.com,b.com##.q"]
    assert f(keep) == sorted(keep)


def test_cosmetic_subsume_by_default_suffix_and_plain_hosts(spark):
    f = lambda rules, **k: left(subsume.cosmetic_subsume(table(spark, rules), **k))
    assert f(["shop.ru##.ad", "www.shop.ru##.ad", "ru##.ad"]) == ["ru##.ad", "shop.ru##.ad"]
    same = ["shop.jp##.ad", "a_b.shop.jp##.ad", "x.\u212aiosk.jp##.ad", "kiosk.jp##.ad"]  # not plain hosts: left alone
    assert f(same) == sorted(same)
    assert f(["a.b.ck##.x", "b.ck##.x", "c.www.ck##.x", "www.ck##.x"], suffixes=("*.ck", "!www.ck")) == ["a.b.ck##.x", "b.ck##.x", "www.ck##.x"]


def test_many_rules_with_one_popular_host(spark):
    """Each names one popular host and one of its own: covered only where the other is."""
    rules = [f"popular.com,h{i}.com##.ad" for i in range(300)] + ["popular.com,www.h7.com##.ad", "www.h9.com##.ad"]
    assert left(subsume.cosmetic_subsume(table(spark, rules))) == sorted(rules[:300])


def test_text_lines_and_suffix_file(tmp_path):
    from hedgerow.sources import lists

    assert lists.text_lines("a\r\nb\r\n") == ["a", "b"] and lists.text_lines("a\x0cb\x85c\u2028d\n\n") == ["a\x0cb\x85c\u2028d", ""]
    assert lists.text_lines("") == [] and lists.text_lines("a\rb\r\r\nc") == ["a\rb\r", "c"]
    assert lists.expand_includes("a\r\nb\r\n", "https://x.test/l.txt", lambda u: "", 2) == ("a\nb\n", 0)
    (tmp_path / "s").write_text("// note\ncom\n\nCO.uk extra\n*.ck\n!www.ck\n")
    assert lists.read_suffixes(str(tmp_path / "s")) == ("com", "co.uk", "*.ck", "!www.ck")


def test_optimize(spark):
    lines = lambda *r: spark.createDataFrame([(x,) for x in r], "rule string")
    done = optimize(lines("b", "a", "b", "c"), False, False)
    assert left(done.rules) == ["a", "b", "c"] and done.counted().first()["duplicates"] == 1
    done = optimize(lines("||example.com^", "||a.example.com^", "||b.a.example.com^"))
    assert left(done.rules) == ["||example.com/"] and done.counted().first()["network_subsumed"] == 2
    assert left(optimize(lines("||Example.com^", "||example.com^", "||EXAMPLE.com^$all")).rules) == ["||example.com/"]
    assert left(optimize(lines()).rules) == []


def test_match(spark):
    rules = ["||example.com^", "||a.org/ads^", "||b.org/", "@@||ok.example.com^", "||c.org/x^"]
    urls = ["https://example.com/", "https://www.example.com/x?y", "https://notexample.com/", "http://a.org/ADS?z", "http://a.org/adsx", "http://a.org/ads/b", "https://b.org/", "https://ok.example.com/", "https://c.org:8080/x", "https://u@c.org/x"]
    got = {r.url: r.blocked for r in match.network_match(spark.createDataFrame([(u,) for u in urls], "url string"), table(spark, rules)).collect()}
    assert [got[u] for u in urls] == [True, True, False, True, False, True, True, False, False, True]


def test_match_is_the_same_after_subsumption(spark):
    rng = random.Random(5)
    rules = table(spark, {"||" + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) + "".join("/" + rng.choice("xy") for _ in range(rng.randint(0, 2))) + "^" for _ in range(60)})
    probes = audit.probe_urls(rules).select("url")
    row = audit.compare_network(rules, subsume.network_subsume(rules), probes).first()
    assert row.requests > 100 and row.mismatches == 0


def test_contamination_and_tokens(spark):
    t = table(spark, ["a##.x:contains(y)", "a##.x, .y:has-text(z)", "a##.x", "a#?#.x:contains(y)", "a##.x.y-z #Q"])
    assert {tuple(r) for r in audit.contamination(t).collect()} == {("a##.x:contains(y)", "dead operator"), ("a##.x, .y:has-text(z)", "unsplit comma+op")}


CONFIG = """
[fetch]
retries = 1
retry_delay_ms = 1
[[lists]]
name = "one"
url = "http://x/one.txt"
[[lists]]
name = "hosts"
url = "http://x/hosts"
hosts = true
[[lists]]
name = "gone"
url = "http://x/none"
[[lists]]
name = "off"
url = "http://x/off"
enabled = false
"""
FILES = {
    "http://x/one.txt": "! c\n||a.com^\r\n||b.a.com^\n!#include sub.txt\n!#include sub.txt\nx.com##.a, .b:contains(q)\n",
    "http://x/sub.txt": "||inc.org/path^\n!#include one.txt\n!#include ftp://no\n",
    "http://x/hosts": "0.0.0.0 h.net\n# note\n",
}


def fetcher(config, fail=0):
    tries = []

    def get(url):
        tries.append(url)
        if len(tries) <= fail:
            raise urllib.error.URLError("down")
        if url not in FILES:
            raise urllib.error.HTTPError(url, 404, "gone", None, None)
        return FILES[url].encode()

    f = lists.Fetcher(config, get)
    f.tries = tries
    return f


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text(CONFIG)
    c = lists.Config.load(tmp_path / "c.toml")
    assert [s.name for s in c.lists] == ["one", "hosts", "gone", "off"] and c.fetch.concurrency == 16 and c.filter.scriptlets
    for bad, why in (("x = 1\nlists = []", "unknown"), ("[fetch]\nretries = 1", "missing"), ("[[lists]]\nname='a'\nurl='b'\nz=1", "unknown"), ("][", "parsing")):
        (tmp_path / "b.toml").write_text(bad)
        with pytest.raises(ValueError, match=why):
            lists.Config.load(tmp_path / "b.toml")
    with pytest.raises(OSError, match="reading"):
        lists.Config.load(tmp_path / "absent.toml")


def test_retries(tmp_path):
    config = lists.FetchConfig(retries=1, retry_delay_ms=1)
    assert fetcher(config, 1).text("http://x/hosts") == FILES["http://x/hosts"]
    with pytest.raises(urllib.error.URLError):
        fetcher(config, 2).text("http://x/hosts")
    f = fetcher(config)
    with pytest.raises(urllib.error.HTTPError):
        f.text("http://x/none")
    assert len(f.tries) == 1


def test_includes():
    text, n = fetcher(lists.FetchConfig()).fetch_list("http://x/one.txt")
    lines = text.split("\n")
    assert n == 1 and "||inc.org/path^" in lines and sum("seen before" in x for x in lines) == 2 and any("not resolved" in x for x in lines)
    shallow, n = fetcher(lists.FetchConfig(max_include_depth=0)).fetch_list("http://x/one.txt")
    assert n == 0 and sum("too deep" in x for x in shallow.split("\n")) == 2
    assert lists.include_reference("!#include <a b>") == "a b" and lists.include_reference("!#includex") == "x" and lists.include_reference("!#include  ") is None


def test_build_writes_a_list(spark, tmp_path):
    (tmp_path / "c.toml").write_text(CONFIG)
    config = lists.Config.load(tmp_path / "c.toml")
    out = tmp_path / "out.txt"
    counters = build(spark, config, str(out), fetcher(config.fetch)).first()
    lines = out.read_text().split("\n")
    body = [x for x in lines if x and not x.startswith(("!", "["))]
    assert body == ["x.com##.a", "x.com##.b:has-text(q)", "||a.com/", "||h.net/", "||inc.org/path^"]
    assert counters["network_subsumed"] == 1 and any("Sources (2/3)" in x for x in lines) and any("[fail] gone" in x for x in lines)
    empty = lists.Config(lists=(lists.ListSource("gone", "http://x/none"),))
    with pytest.raises(ValueError, match="no rules"):
        build(spark, empty, str(tmp_path / "none.txt"), fetcher(empty.fetch))
    assert not (tmp_path / "none.txt").exists()


def test_split_lines(spark):
    rows = spark.createDataFrame([(1, "a\r\nb\n\n"), (2, ""), (3, "x"), (4, None)], "k int, text string")
    assert sorted(tuple(r) for r in classify.split_lines(rows, "text", "k").collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (3, 0, "x")]


def test_stats(spark):
    lines = spark.createDataFrame([(0, i, x, False) for i, x in enumerate(["", "! c", "0.0.0.0 a.b c.d", "0.0.0.0 localhost", "x##.a, .b:has-text(q)", "x##.a:others()", "|| x", "||a^$zz"])], "list_id int, line_no int, raw string, hosts boolean")
    r = classify.stats(classify.classified(lines), "list_id").first().asDict()
    assert (r["total_lines"], r["hosts_converted"], r["cosmetic_rules"], r["cosmetic_transforms"], r["unsupported_cosmetic"], r["unsupported_options"], r["empty"], r["unsupported"]) == (8, 1, 2, 2, 1, 1, 1, 2)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("||a^\n! c\n0.0.0.0 h.net\n")
    store_rules(line_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert left(spark.read.parquet(str(tmp_path / "out"))) == ["||a^", "||h.net^"]


def test_read_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\nb\n")
    assert lists.read_lists(spark, str(tmp_path / "l.txt")).first().text == "a\nb\n"


def test_liveness_and_growth(spark):
    t = table(spark, ["||a.com^", "||b.com/x^", "@@||b.com/x^", "||c.com^$badfilter", "##.x:contains(q)"])
    probes = table(spark, ["||a.com^", "||b.com/x^", "||c.com^"])
    row = audit.liveness(t, probes).first()
    assert (row.sampled, row.expected_dead, row.dead, row.contaminated, row.passed) == (3, 1, 1, 1, False)
    assert audit.growth(110, 100) == (10, 10.0) and audit.growth(5, 0) == (5, 0.0)


def test_partition_and_comparison(spark):
    lines = table(spark, ["||a^", "x.com##.a", "y.com##.b", "z#?#.c"])
    assert left(audit.partition_lines(lines, table(spark, ["x.com##.a"]))) == ["x.com##.a", "||a^"]
    pages = spark.createDataFrame([("https://www.x.com/",), ("https://y.com/",)], "url string")
    diff = audit.compare_cosmetic(pages, lines, table(spark, ["x.com##.a", "y.com##.c"])).collect()
    assert [tuple(r) for r in diff] == [("y.com", ".b", ".c")]
