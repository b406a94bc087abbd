"""Writes a list with its audit header, as one file that readers see whole or not at all."""

from __future__ import annotations

import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row

from ..operators.classify import COUNTERS
from ..operators.storage import stored
from .lists import OutputConfig

_NOTES = (
    "Rules of all sources, merged; duplicates and rules without effect are gone.",
    "Redirects outside the allowed resources and injected scripts are left out.",
    "Cosmetic rules are in the form that the engine runs.",
    "Rules that broader ones cover are left out.",
)


def header(config: OutputConfig, summaries: list[Row], totals: dict[str, int], now: datetime | None = None) -> list[str]:
    """The lines above the rules. summaries: name, ok, bytes, included_files and the counters of each enabled list."""
    now = now or datetime.now(UTC)
    stamp = f"{now:%Y-%m-%d %H:%M:%S} UTC"
    out = ["[Adblock Plus 2.0]", f"! Title: {config.title}", f"! Version: {now:%Y%m%d%H%M}", f"! Description: {config.description}", f"! Expires: {config.expires}", f"! Homepage: {config.homepage}", f"! Last modified: {stamp}", "!", f"! Generated: {stamp}", "!"]
    out.append(f"! Sources ({sum(s['ok'] for s in summaries)}/{len(summaries)}):")
    for s in summaries:
        if s["ok"]:
            counts = ", ".join(f"{s[c] or 0} {c}" for c in COUNTERS)
            out.append(f"!   [ok] {s['name']}: {s['bytes'] or 0} bytes, {s['included_files']} included files, {counts}")
        else:
            out.append(f"!   [fail] {s['name']}")
    out.append("! Totals: " + ", ".join(f"{v} {k}" for k, v in totals.items()))
    return [*out, "!", *(f"! {n}" for n in _NOTES), "!"]


def write_list(rules: DataFrame, path: str, lines: list[str]) -> int:
    """Writes header lines and rules(rule, ord_key) in order; an empty list is an error and writes nothing.

    The rules are stored first, so what made them runs once. They stream to the driver partition by partition, so none
    of its memory grows with the list.
    """
    ordered = stored(rules.select("ord_key", "rule")).orderBy("ord_key", "rule").select("rule")
    if ordered.isEmpty():
        raise ValueError("no rules to write")
    part, n = Path(f"{path}.part"), 0
    with part.open("w", encoding="utf-8", newline="\n") as f:
        f.writelines(f"{x}\n" for x in lines)
        for row in ordered.toLocalIterator():
            f.write(f"{row[0]}\n")
            n += 1
    os.replace(part, path)
    return n
