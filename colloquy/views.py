"""Results of one board as Markdown: small tables, formatted where they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order in which severities are shown.
SEVERITIES = ["high", "medium", "low", "unknown", "none"]


def table(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of the rows as they come; null cells are empty."""
    out = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(*columns).toLocalIterator()]
    return "\n".join(out)


def modes(found: DataFrame, room: str) -> str:
    """The ten modes of a room, gravest first."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return f"# {room}\n\n" + table(found.where(F.col("room") == room).orderBy(rank, "mode"), ["mode", "severity", "count", "confidence"])


def facts(found: DataFrame, seats: DataFrame, room: str) -> str:
    """A room's seats and findings."""
    of = lambda d: d.where(F.col("room") == room)
    first = table(of(seats).orderBy("who"), ["who", "posts", "commands", "failed_commands", "test_runs"])
    return first + "\n\n" + table(of(found).orderBy("seq", "fact"), ["seq", "who", "fact", "pattern", "why"])


def findings(found: DataFrame, room: str) -> str:
    """A list of kickstart findings."""
    rows = found.where(F.col("room") == room).orderBy("seq", "signal").toLocalIterator()
    return "\n".join(f"- #{r.seq} {r.who} {r.signal} → {r.pattern} ({r.group}): {r.excerpt}" for r in rows)
