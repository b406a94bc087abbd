import hashlib
import zlib

import numpy as np
import pytest

from hedgerow.llm import bpe, tokens
from hedgerow.llm.queries import vocabulary

TEXTS = [
    None, "", " ", "  ", "a", "Hello world", " lead", "trail ", "a  b", "tab\tx", "\n\nx\n", "it's we'll 'tis ''s", "naïve café — 中文 日本 😀😀 ½²Ⅷ",
    "a <|endoftext|> b<|endoftext|><|endoftext|>", "x y z", "1234 5678,90.!?...", "_under_score_ é" * 50, "zzzz" * 3000, "\x1c\x85 a\x00b", "word\r\nnext", "é combining ́",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_whole_codec_equals_library(library):
    c = bpe.codec(vocabulary())
    rng = np.random.default_rng(0)
    odd = ["".join(chr(int(x)) for x in rng.integers(1, 0xD000, 40)) for _ in range(100)] + ["".join(rng.choice(list("ab ,.'\n12\té "), 60)) for _ in range(300)]
    for t in [x or "" for x in TEXTS] + odd:
        ids = library.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ids
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cut_equals_library_on_every_code_point(library):
    """Every code point beside random neighbours, and contractions, white space and special strings among them."""
    rng = np.random.default_rng(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    near = ["a", "1", "!", " ", "  ", "\n", "'s", "'", "'ll", "'re", "", "<|endoftext|>", "\u3000", "é", "²"]
    pick = rng.integers(0, len(near), 2 * len(points))
    shuffled = rng.permutation(len(points))
    parts = [near[pick[2 * i]] + chr(points[j]) + near[pick[2 * i + 1]] for i, j in enumerate(shuffled)]
    texts = ["".join(parts[i : i + 700]) for i in range(0, len(parts), 700)]
    texts.append("".join(map(chr, [0x69, 0x2000, 0x3E608, 0x8298, 0xBD, 0x1680, 0x080B])) + ")")
    cutter = library.pre_tokenizer.pre_tokenize_str
    words, counts = bpe.cut(texts)
    ends = np.cumsum(counts)
    got = words.to_pylist()
    for t, i, j in zip(texts, ends - counts, ends, strict=True):
        assert got[i:j] == [t[a:b] for _, (a, b) in cutter(t)]
    c = bpe.codec(vocabulary())
    cache = bpe.Words(lambda ws: [np.array(c.merge(w.encode()), np.int32).tobytes() for w in ws])
    own = tokens._encoder(vocabulary())
    for i in range(0, len(texts), 1600):
        part = texts[i : i + 100] + texts[-1:]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in bpe.with_special(c, cache, part)] == want
        assert [x.tolist() for x in own(part)] == want


def test_cut_equals_library_on_random_texts(library):
    """Short texts of awkward characters, a hundred thousand of them."""
    rng = np.random.default_rng(5)
    alphabet = list("ab'strevlmd ,.19\n\t\r\x0b\x1c\x85\xa0éßЖ中😀½²́\u2028\u3000\u1680\u200b\u080b") + ["'", " ", " "]
    texts = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 14, 100_000)]
    cutter = library.pre_tokenizer.pre_tokenize_str
    words, counts = bpe.cut(texts)
    ends, got = np.cumsum(counts), words.to_pylist()
    assert all(got[i:j] == [t[a:b] for _, (a, b) in cutter(t)] for t, i, j in zip(texts, ends - counts, ends, strict=True))


def test_query_equals_library(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted([tuple(r) for r in bpe.encode_decode_digest(docs, vocabulary()).collect()], key=repr)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    plain = bpe.encode_decode(docs.filter("doc_id = 5"), vocabulary()).collect()
    assert plain[0].decoded == TEXTS[5]


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    c = bpe.codec(vocabulary())
    from array import array

    cache = bpe.Words(lambda ws: [array("i", c.merge(w.encode())).tobytes() for w in ws])
    for i in range(30):
        texts = [f"word{i} and some words {i % 7}", "it's here", f"x{i} y z"]
        assert [x.tolist() for x in cache.texts(texts)] == [c.encode(t) for t in texts]
        assert len(cache.now) <= 40


def test_orc_files(spark, library, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(i), TEXTS[int(i) % len(TEXTS)], 7) for i in rng.permutation(500)] + [(9, TEXTS[9], 7), (9, "other text", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int").repartition(5)
    path = str(tmp_path / "tokens")
    tokens.write(docs, path, vocabulary())
    stored = tokens.read(spark, path)
    got = {(r.doc_id, r.start): r for r in tokens.with_start(tokens.checksums(stored), stored).collect()}
    at = 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        r = got[(i, at)]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)
    plan = stored.filter("doc_id = 77")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan and stored.filter("doc_id = 77").count() == 1


def test_orc_bloom_filters_and_indexes(spark, tmp_path):
    from pyarrow import orc

    docs = spark.createDataFrame([(i, "some text") for i in range(100)], "doc_id long, text string")
    tokens.write(docs, str(tmp_path / "t"), vocabulary())
    files = list((tmp_path / "t").glob("*.orc"))
    assert files and all(orc.ORCFile(f).nstripes >= 1 for f in files)
    raw = b"".join(f.read_bytes() for f in files)
    assert raw.startswith(b"ORC")


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(docs, vocabulary()).collect() == []
    tokens.write(docs, str(tmp_path / "e"), vocabulary())
    stored = tokens.read(spark, str(tmp_path / "e"))
    assert tokens.with_start(tokens.checksums(stored), stored).collect() == []
