import hashlib
import random
import re

from pyspark.sql import functions as F

from hedgerow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": kind == "card" and 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base(t)
        r = rows[i]
        got = [s for s in r.spans.split(",") if s and s.split(":")[0] in PATTERNS]
        assert got == want, (t, got, want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in want) for k in PATTERNS)
    return rows


def test_edges(spark):
    check(
        spark,
        [None, "", "a@b.c_d@e.f", "a@b@c.d", "x@y", ".@a.b.c-", "é a@b.co 😀 c@d.ef", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.0004", "1.2.3.4444444444444",
         "4111 1111-1111 1111 and 4111111111111111", "card 41111111111111112", "+1 (243) 555-5526 +12 +1234567. +1(2)", "+49 30 1234567890123456", "1" * 3000, "a" * 50000 + "@b.c", "1." * 5000, "a.b" * 20000 + "@", "x@" + "a." * 4000 + "b"],
    )


def test_random(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "1", "23", "255", "256", " ", "-", "+", "(", ")", "_", "é", "\n", "4111111111111111", "a@b.co", "1.2.3.4", "+1 234 567 890"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(600)])


def test_added_kinds(spark):
    rows = check(spark, ["pay to GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 33", "my SSN is 123-45-6789", "part 123-45-6789 is blue", "ssn 000-12-3456", "DE89370400440532013000"])
    assert [rows[i].spans for i in range(6)] == ["iban:7:34", "", "ssn:10:21", "", "", "iban:0:22"]


def test_context_adjusts_the_score(spark):
    docs = spark.createDataFrame([(1, "call +1 234 567 890"), (2, "on +1 234 567 890")], "doc_id long, text string")
    score = {r[0]: r[1] for r in pii.find(docs).select("doc_id", F.col("spans")[0]["score"]).collect()}
    assert score[1] > score[2]


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_spans_in_a_long_text(spark):
    """Far more matches than a chunk holds, with others in between; positions and contexts hold at every chunk's edge."""
    rng = random.Random(8)
    parts = ["mail a@b.co", "x@y.zz", " 12 34 ", "ip 1.2.3.4", "300.1.1.1", "4111111111111111", "call +1 234 567 890", "SSN 123-45-6789", "123-45-6789", " word ", "é😀", ". "]
    texts = [" ".join(rng.choice(parts) for _ in range(n)) for n in (15, 16, 17, 33, 700, 6000)]
    rows = check(spark, texts)
    for i, t in enumerate(texts):
        want = [(m.start(), m.end()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t)]
        want = [f"ssn:{a}:{b}" for a, b in want if re.search(r"(?:^|\W)ssn", t[max(a - 40, 0) : a] + " " + t[b : b + 40], re.I)]
        assert [s for s in rows[i].spans.split(",") if s.startswith("ssn")] == want
        near = lambda a, b: t[max(a - 40, 0) : a] + " " + t[b : b + 40]
        for s, score in zip(rows[i].spans.split(","), rows[i].scores.split(","), strict=True):
            if s.startswith("ip"):
                a, b = map(int, s.split(":")[1:])
                assert int(score) == 60 + 30 * bool(re.search(r"(?:^|[^A-Za-z0-9_])(?:ip|address|host|server)(?:$|[^A-Za-z0-9_])", near(a, b), re.I))
