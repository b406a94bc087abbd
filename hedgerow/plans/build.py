"""The build run: configuration to written list."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify
from ..operators.storage import stored
from ..sources.lists import Config, Fetcher
from ..sources.sink import header, write_list
from .optimize import optimize

LOG = logging.getLogger("hedgerow.build")


def event(what: str, **values: object) -> None:
    """One event of the run as a line of JSON."""
    LOG.info(json.dumps({"event": what, **values}))


def summaries(fetched: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each list with its counters (zero for lists that failed)."""
    counted = classify.stats(found, "list_id")
    return fetched.drop("text").join(counted, "list_id", "left").fillna(0, list(classify.COUNTERS)).orderBy("list_id")


def build(spark: SparkSession, config: Config, output: str | None = None, fetcher: Fetcher | None = None) -> DataFrame:
    """Fetches, classifies, optimizes and writes; returns the one row of optimizer counters."""
    fetcher = fetcher or Fetcher(config.fetch)
    fetched = fetcher.fetch_all(spark, config.lists)
    lines = classify.split_lines(fetched.filter("ok"), "text", "list_id", "hosts")
    f = config.filter
    found = stored(classify.classified(lines, f.cosmetic_compat, f.scriptlets, f.redirect_allowlist))  # feeds rules and counters
    done = optimize(classify.kept(found), f.cosmetic_compat, f.network_optimize)
    rows, counters = summaries(fetched, found).collect(), done.counted()
    for r in rows:
        if r["ok"]:
            event("analyzed", list=r["name"], bytes=r["bytes"], included_files=r["included_files"], **{c: r[c] for c in classify.COUNTERS})
        else:
            event("failed", list=r["name"])
    totals = {c: sum(r[c] for r in rows) for c in classify.COUNTERS} | counters.first().asDict()
    ok = sum(r["ok"] for r in rows)
    event("optimized", sources_fetched=ok, sources_failed=len(rows) - ok, bytes_transferred=fetcher.bytes_transferred, **totals)
    final = write_list(done.rules, output or config.output.file, header(config.output, rows, totals))
    event("written", final_rules=final)
    return counters


def totals(stats: DataFrame) -> DataFrame:
    """Sums of all lists' counters."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classify.COUNTERS])


def main(argv: list[str] | None = None) -> None:
    """The command line."""
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("-c", "--config", default="lists.toml")
    args.add_argument("-o", "--output")
    found = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    build(SparkSession.builder.getOrCreate(), Config.load(found.config), found.output).show(truncate=False)


if __name__ == "__main__":
    main()
