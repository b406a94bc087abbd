"""Configuration, list texts and their includes.

Lists are few and fetched by the driver (threads, retries); what they hold is rows from then on. Texts that are files
already are read by Spark (``read_lists``).
"""

from __future__ import annotations

import time
import tomllib
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import REDIRECT_ALLOWLIST


@dataclass(frozen=True)
class FetchConfig:
    """How lists are fetched."""

    concurrency: int = 16
    timeout_secs: int = 30
    retries: int = 2
    retry_delay_ms: int = 500
    max_redirects: int = 5
    expand_includes: bool = True
    max_include_depth: int = 4
    user_agent: str = "hedgerow/0.1"


@dataclass(frozen=True)
class OutputConfig:
    """What the written list says of itself."""

    file: str = "output/list.txt"
    title: str = "Combined list"
    description: str = "Rules of several lists, merged"
    expires: str = "1 day"
    homepage: str = ""


@dataclass(frozen=True)
class FilterConfig:
    """Which rules stay, and which passes run."""

    scriptlets: bool = True
    redirect_allowlist: tuple[str, ...] = REDIRECT_ALLOWLIST
    cosmetic_compat: bool = True
    network_optimize: bool = True


@dataclass(frozen=True)
class ListSource:
    """One list."""

    name: str
    url: str
    enabled: bool = True
    hosts: bool = False


@dataclass(frozen=True)
class Config:
    """A whole configuration; only the lists are mandatory."""

    lists: tuple[ListSource, ...]
    fetch: FetchConfig = field(default_factory=FetchConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    filter: FilterConfig = field(default_factory=FilterConfig)

    @staticmethod
    def of(data: dict[str, Any]) -> Config:
        """From parsed TOML; an unknown key is an error."""

        def made(kind: type, values: dict[str, Any]) -> Any:  # noqa: ANN401
            if unknown := set(values) - {f.name for f in fields(kind)}:
                raise ValueError(f"unknown keys of {kind.__name__}: {', '.join(sorted(unknown))}")
            return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

        parts = {"fetch": FetchConfig, "output": OutputConfig, "filter": FilterConfig}
        if unknown := set(data) - {*parts, "lists"}:
            raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
        if "lists" not in data:
            raise ValueError("lists are missing")
        return Config(lists=tuple(made(ListSource, x) for x in data["lists"]), **{k: made(t, data[k]) for k, t in parts.items() if k in data})

    @staticmethod
    def load(path: str | Path) -> Config:
        """From a TOML file; the error says whether reading or parsing failed."""
        try:
            raw = Path(path).read_bytes()
        except OSError as e:
            raise OSError(f"reading {path}: {e}") from e
        try:
            return Config.of(tomllib.loads(raw.decode()))
        except (tomllib.TOMLDecodeError, ValueError, TypeError) as e:
            raise ValueError(f"parsing {path}: {e}") from e


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, most: int) -> None:
        self.max_redirections = self.max_repeats = most


class Fetcher:
    """Fetches texts over HTTP, or from local files in tests."""

    def __init__(self, config: FetchConfig, get: Callable[[str], bytes] | None = None) -> None:
        self.config, self.bytes_transferred = config, 0
        self._get = get or self._http

    def _http(self, url: str) -> bytes:
        opener = urllib.request.build_opener(_Redirects(self.config.max_redirects))
        request = urllib.request.Request(url, headers={"User-Agent": self.config.user_agent})  # noqa: S310
        with opener.open(request, timeout=self.config.timeout_secs) as r:
            return r.read()

    def text(self, url: str) -> str:
        """One text. Server errors and failures to connect are tried again, each time after twice the delay."""
        delay = self.config.retry_delay_ms / 1000
        for left in range(self.config.retries, -1, -1):
            try:
                return self._get(url).decode("utf-8", errors="replace")
            except urllib.error.HTTPError as e:
                if e.code < 500 or not left:
                    raise
            except urllib.error.URLError:
                if not left:
                    raise
            time.sleep(delay)
            delay *= 2
        raise AssertionError

    def fetch_list(self, url: str) -> tuple[str, int]:
        """(text with its includes, number of included files)."""
        text, included = self.text(url), 0
        if self.config.expand_includes:
            text, included = expand_includes(text, url, self.text, self.config.max_include_depth)
        self.bytes_transferred += len(text.encode())
        return text, included

    def fetch_all(self, spark: SparkSession, lists: tuple[ListSource, ...]) -> DataFrame:
        """(list_id, name, hosts, ok, error, text, bytes, included_files) of the enabled lists, in their order."""

        def one(item: tuple[int, ListSource]) -> tuple:
            i, s = item
            try:
                text, included = self.fetch_list(s.url)
            except Exception as e:  # noqa: BLE001  a list that fails is a row that says so
                return i, s.name, s.hosts, False, str(e), None, None, 0
            return i, s.name, s.hosts, True, None, text, len(text.encode()), included

        with ThreadPoolExecutor(max(self.config.concurrency, 1)) as pool:
            rows = list(pool.map(one, [(i, s) for i, s in enumerate(lists) if s.enabled]))
        return spark.createDataFrame(rows, "list_id int, name string, hosts boolean, ok boolean, error string, text string, bytes long, included_files long")


def include_reference(line: str) -> str | None:
    """What an include line names, or None."""
    t = line.strip()
    if not t.startswith("!#include"):
        return None
    return t[len("!#include") :].strip().lstrip("<").rstrip(">").strip() or None


def include_url(base: str, reference: str) -> str | None:
    """The URL of an include; HTTP alone."""
    try:
        url = urljoin(base, reference)
    except ValueError:
        return None
    return url if urlsplit(url).scheme in ("http", "https") else None


def text_lines(text: str) -> list[str]:
    """The lines of a text: they end at a line feed, with or without a carriage return before it, and nowhere else."""
    lines = text.split("\n")
    return [x.removesuffix("\r") for x in (lines if lines[-1] else lines[:-1])]


def expand_includes(text: str, url: str, get: Callable[[str], str], depth: int) -> tuple[str, int]:
    """A text with each include line replaced by what it names, depth first. A file is included once for each list;
    what can't be included becomes a comment that says why."""
    seen, count = {url}, 0

    def walk(text: str, url: str, level: int) -> list[str]:
        nonlocal count
        out = []
        for line in text_lines(text):
            reference = include_reference(line)
            if reference is None:
                out.append(line)
                continue
            child = include_url(url, reference)
            if child is None:
                out.append(f"! include not resolved: {reference}")
            elif level >= depth:
                out.append(f"! include too deep: {child}")
            elif child in seen:
                out.append(f"! include seen before: {child}")
            else:
                seen.add(child)
                try:
                    inner = get(child)
                except Exception as e:  # noqa: BLE001  as above
                    out.append(f"! include failed: {child}: {e}")
                    continue
                count += 1
                out += walk(inner, child, level + 1)
        return out

    lines = walk(text, url, 0)
    return "\n".join(lines) + "\n" if lines else "", count


def read_suffixes(path: str) -> tuple[str, ...]:
    """The public suffixes of a file, one a line; comments and what stands after white space are skipped. The forms
    ``*.x`` (every label below x) and ``!y.x`` (not this one) are kept as they are."""
    with open(path, encoding="utf-8") as f:
        rows = [x.split()[0] for x in text_lines(f.read()) if x.split() and not x.lstrip().startswith("//")]
    return tuple(dict.fromkeys(x.lower().strip(".") for x in rows))


def read_lists(spark: SparkSession, paths: list[str] | str, hosts: bool = False) -> DataFrame:
    """(path, text, hosts): whole list files, read by Spark."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.lit(hosts).alias("hosts"))


def expand_edges(edges: DataFrame, root: str, depth: int = 4) -> DataFrame:
    """(order_key, file, level): the visits of an include walk whose edges(parent, line_no, child) are a table.

    Each level is a join; a file's first visit in depth-first order counts. order_key orders the visits.
    """
    spark = edges.sparkSession
    level = spark.createDataFrame([("", root, 0, [root])], "order_key string, file string, level int, path array<string>")
    every = level
    for i in range(1, depth + 1):
        step = level.join(edges, F.col("file") == F.col("parent")).filter(~F.array_contains("path", F.col("child")))
        level = step.select(F.concat("order_key", F.lit("/"), F.lpad(F.col("line_no").cast("string"), 9, "0")).alias("order_key"), F.col("child").alias("file"), F.lit(i).alias("level"), F.concat("path", F.array("child")).alias("path"))
        every = every.unionByName(level)
    return every.groupBy("file").agg(F.min_by(F.struct("order_key", "level"), "order_key").alias("x")).select("x.order_key", "file", "x.level")
