"""Operator 6: byte-level BPE encoding and decoding.

Encoding keeps, for each pre-token, a doubly linked list of symbols and a priority queue of the ranks of its
adjacent pairs. The lowest rank is merged first (leftmost on ties); an entry whose pair has changed since it was
pushed is stale and skipped. Decoding concatenates vocabulary strings. Pre-tokens repeat, so each worker keeps a
bounded cache of what it has encoded.

Defined results: null text counts as empty (no ids, empty decoded text). Texts of any length are encoded whole.
Repeated rows give repeated rows, an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Pre-tokenization of the byte-level family (fixed value of the public tokenizer), which ``cut`` follows. Regular
#: expression engines disagree on what \p{L}, \p{N} and \s hold, so the classes are the library's own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, BLANK, LETTER, NUMBER, OTHER, UNKNOWN = range(6)
#: Pre-tokens that each generation of a worker's cache holds at most.
CACHE = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, by the byte-level rule: itself, or 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary: merges by pair of ids, byte strings by id, special strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.strings: dict[int, bytes] = {i: bytes(of[c] for c in s) for s, i in model["vocab"].items()}
        self.strings |= {i: s.encode() for s, i in special.items()}
        self.byte_id = [0] * 256
        for c, b in of.items():
            self.byte_id[b] = model["vocab"][c]
        self.width = max(self.strings) + 1
        self.decimals = {i: b"%d" % i for i in self.strings}
        self.merges: dict[int, int] = {}  # the rank of a pair of ids
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[model["vocab"][a] * self.width + model["vocab"][b]] = rank
            self.merged.append(model["vocab"][a + b])
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, width, merged = self.merges.get, self.width, self.merged
        queue = []
        a = ids[0]
        for i in range(1, n):
            b = ids[i]
            if (r := rank_of(a * width + b)) is not None:
                queue.append(r * n + i - 1)
            a = b
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            r = heappop(queue)
            i = r % n
            r //= n
            a, j = ids[i], after[i]
            if a < 0 or j >= n or rank_of(a * width + ids[j]) != r:
                continue  # stale
            ids[i] = new = merged[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new * width + ids[k])) is not None:
                    heappush(queue, r * n + i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] * width + new)) is not None:
                heappush(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        """All ids of a text, special strings included."""
        out: list[int] = []
        for part, is_special in self.parts(text):
            if is_special:
                out.append(self.special[part])
            else:
                for w in cut([part])[0].to_pylist():
                    out += self.merge(w.encode())
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings."""
        at = 0
        if self.split_special is not None and any(s in text for s in self.special):
            for m in self.split_special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text) or not at:
            yield text[at:], False

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, concatenated."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, Callable[[str], list]]:
    """A table of what the pattern tells apart, by code point, to be filled as points are met; and the library's cutter."""
    from tokenizers.pre_tokenizers import ByteLevel

    return np.full(0x110000, UNKNOWN, np.uint8), ByteLevel(add_prefix_space=False).pre_tokenize_str


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point. The library itself tells: a character that stays with a letter is a letter."""
    table, cutter = _classes()
    kind = table[points]
    if (kind == UNKNOWN).any():
        new = np.unique(points[kind == UNKNOWN])
        table[new] = BLANK
        for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            at = [a for _, (a, b) in cutter("".join(f"{before}{chr(c)}\n" for c in new.tolist())) if b == a + 2 and not a % 3]
            table[new[np.array(at, np.int64) // 3]] = k
        table[0x20] = SPACE
        kind = table[points]
    return kind


def cut(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The pre-tokens of all texts in a row, and how many each text has; by array operations equal to ``PATTERN``."""
    joined = "".join(texts)
    data, points = joined.encode(), np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths) - lengths
    kind = classes(points)
    first = np.zeros(n + 1, bool)  # of a text
    first[begin] = True
    first[n] = True
    blank = kind <= BLANK
    starts = first[:n].copy()
    # a run of white space gives its last character to what follows it in the text
    starts[1:] |= blank[1:] & ~blank[:-1]
    starts[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:n]
    # other runs begin where the class changes, unless a space before has begun them
    starts[1:] |= ~blank[1:] & (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
    _contractions(points, starts, first)
    at = np.flatnonzero(starts)
    wide = (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
    extra = np.cumsum(wide, dtype=np.int32)
    offsets = np.empty(len(at) + 1, np.int32)
    offsets[:-1] = at + np.where(at > 0, extra[at - 1], 0)
    offsets[-1] = len(data)
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    counts = np.diff(np.searchsorted(at, np.append(begin, n)))
    return tokens, counts


def _contractions(points: np.ndarray, starts: np.ndarray, first: np.ndarray) -> None:
    """Ends a pre-token that begins with an apostrophe where a contraction ends."""
    n = len(points)
    at = np.flatnonzero(starts & (points == 0x27))
    one = np.where((at + 1 < n) & ~first[np.minimum(at + 1, n)], points[np.minimum(at + 1, n - 1)], 0)
    two = np.where((one > 0) & (at + 2 < n) & ~first[np.minimum(at + 2, n)], points[np.minimum(at + 2, n - 1)], 0)
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    at, size = at[size > 0], size[size > 0]
    starts[at + 1] = False
    end = at + size + 1
    starts[end[end < n]] = True


class Words:
    """The ids of texts; what recurring pre-tokens encode to is kept in a bounded cache.

    ``encode`` takes pre-tokens that are not known yet, all at once, and gives the bytes of their ids as int32. A full
    cache becomes the old generation, whose entries come back when they are used again.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]]) -> None:
        self.encode = encode
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens."""
        values = list(map(self.now.get, words))
        gaps = [i for i, v in enumerate(values) if v is None]
        if not gaps:
            return values
        if len(self.now) + len(gaps) > CACHE:
            self.old, self.now = self.now, {}
        lost = []
        for i, v in zip(gaps, [self.old.get(words[i]) for i in gaps], strict=True):
            if v is None:
                lost.append(i)
            else:
                values[i] = v
        for i, v in zip(lost, self.encode([words[i] for i in lost]), strict=True):
            values[i] = v
        self.now.update((words[i], values[i]) for i in gaps)
        return values

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        tokens, counts = cut(texts)
        coded = tokens.dictionary_encode()
        values = self.known(coded.dictionary.to_pylist())
        ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) // 4)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(values), np.int32)))
        taken = lists.take(coded.indices)
        ids, bounds = taken.flatten().to_numpy(), taken.offsets.to_numpy()[np.append(0, np.cumsum(counts))]
        return [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One vocabulary for each worker process."""
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text.

    Returns ``(id_col, n_tokens, ids_text, decoded)``: ids_text holds the decimal ids joined by commas, decoded the
    text that their vocabulary strings spell.
    """
    return _mapped(docs, vocabulary, id_col, text_col, digest=False)


def encode_decode_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with SHA-256 of ids and decoded text in their place, so that neither leaves the worker."""
    return _mapped(docs, vocabulary, id_col, text_col, digest=True)


def _mapped(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids_text", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        cache = Words(lambda words: [array("i", c.merge(w.encode())).tobytes() for w in words])
        decimal, string = c.decimals.__getitem__, c.strings.__getitem__
        for b in slices(batches, "text"):
            n, ids, back = [], [], []
            for found in with_special(c, cache, [t or "" for t in b.column(1).to_pylist()]):
                x = found.tolist()
                n.append(len(x))
                a, d = b",".join(map(decimal, x)), b"".join(map(string, x)).decode("utf-8", errors="replace")
                ids.append(hashlib.sha256(a).hexdigest() if digest else a.decode())
                back.append(hashlib.sha256(d.encode()).hexdigest() if digest else d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", *names])

    return docs.select(docs[id_col], docs[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {names[0]} string, {names[1]} string")


def with_special(c: Codec, cache: Words, texts: list[str]) -> list[np.ndarray]:
    """cache.texts(), with texts that hold a special string cut at it."""
    odd = {k for k, t in enumerate(texts) if any(s in t for s in c.special)}
    parts = {k: list(c.parts(texts[k])) for k in odd}
    found = cache.texts(["" if k in odd else t for k, t in enumerate(texts)] + [p for ps in parts.values() for p, is_special in ps if not is_special])
    rest = iter(found[len(texts) :])
    for k, ps in parts.items():
        found[k] = np.concatenate([np.array([c.special[p]], np.int32) if is_special else next(rest) for p, is_special in ps])
    return found[: len(texts)]
