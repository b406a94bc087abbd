"""Audits of a written list, as commands that end with 0 if the list passes and with 1 if not.

    python -m hedgerow.plans.audits liveness list.txt [--baseline older.txt]
    python -m hedgerow.plans.audits equivalence list.txt
    python -m hedgerow.plans.audits inefficiency list.txt
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, rewrite, subsume
from ..operators.storage import stored
from .optimize import optimize, rule_lines


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, ord_key): a list file's distinct rules."""
    return stored(subsume.distinct_rules(rule_lines(spark.read.text(path).select(F.col("value").alias("raw")).filter("not startswith(value, '[Adblock')"))))


def run_liveness(table: DataFrame, baseline: DataFrame | None = None, n: int = audit.SAMPLE) -> tuple[dict[str, object], bool]:
    """Whether sampled simple rules block what they name and no cosmetic rule is of a form that can't run; lines against
    those of an older list, and what subsumption would still save."""
    found = audit.liveness(table, audit.systematic_sample(audit.audit_simple(table), n)).first().asDict()
    found |= audit.subsumable(table).first().asDict()
    if baseline is not None:
        found["lines_more"], found["percent_more"] = audit.growth(table.count(), baseline.count())
    return found, bool(found["passed"])


def run_equivalence(table: DataFrame) -> tuple[dict[str, object], bool]:
    """Whether a list does the same once cosmetic rules are subsumed and network rules optimized: cosmetic results on
    sampled hosts, then requests at the edges of every rule that went or was written anew."""
    cosmetic_after = stored(subsume.cosmetic_subsume(table))
    pages = audit.sample_hosts(table).select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"))
    hosts = audit.compare_cosmetic(pages, table, cosmetic_after).count()
    after = stored(optimize(cosmetic_after, cosmetic_compat=False).rules)
    urls = audit.adversarial_corpus(cosmetic_after, rewrite.rewritten(cosmetic_after).filter("sig is not null").select("rule", "best"), after)
    found = audit.compare_network(cosmetic_after, after, urls).first().asDict()
    sizes = {f"{k}_{c}": v for k, t in (("before", table), ("after", after)) for c, v in audit.serialized(t).select("rules", "bytes").first().asDict().items()}
    found |= {"cosmetic_mismatches": hosts, "cosmetic_removed": table.count() - cosmetic_after.count()} | sizes
    return found, not hosts and not found["mismatches"]


def run_inefficiency(table: DataFrame) -> tuple[dict[str, object], bool]:
    """The report and its samples; it always passes."""
    report = rewrite.inefficiency(table).first().asDict()
    return report | {f"{r['category']} {r['n']}": r["rule"] for r in rewrite.samples(table).orderBy("category", "n").collect()}, True


def main(argv: list[str] | None = None) -> int:
    """The command line."""
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("audit", choices=("liveness", "equivalence", "inefficiency"))
    args.add_argument("list")
    args.add_argument("--baseline")
    asked = args.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    table = read_rules(spark, asked.list)
    if asked.audit == "liveness":
        found, passed = run_liveness(table, read_rules(spark, asked.baseline) if asked.baseline else None)
    else:
        found, passed = (run_equivalence if asked.audit == "equivalence" else run_inefficiency)(table)
    for k, v in found.items():
        print(f"{k}: {v}")
    print("PASS" if passed else "FAIL")
    return 0 if passed else 1


if __name__ == "__main__":
    sys.exit(main())
