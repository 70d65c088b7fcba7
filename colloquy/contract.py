"""Annotators and sources by name: what a plugin must bring, and the record that an annotation is kept in.

An annotator is a class with ``name``, ``version``, ``schema`` (DDL of its findings), and ``annotate(board)`` that returns a DataFrame; with
``taxonomy`` it names the choice its patterns are grouped by. Plugins come through the entry points below; one that can't be loaded is
skipped with a warning.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.operators import facts, modes, taxonomy
from colloquy.operators.board import Board
from colloquy.sources import files, tables  # noqa: F401

RECORD = "colloquy/record.v1"
GROUPS = {"annotators": "colloquy.annotators", "sources": "colloquy.sources"}
NAME = re.compile(r"^[a-z][a-z0-9_]{1,40}$")


class ModesAnnotator:
    """Ten modes from the wording of posts."""

    name, version, taxonomy = "modes_v1", "1.0.0", "ten_modes"
    schema = "room string, mode string, present boolean, severity string, count bigint, confidence double"

    def annotate(self, board: Board) -> DataFrame:
        return modes.Modes(board).modes()

    def patterns_in(self, output: DataFrame) -> DataFrame:
        return output.where("present").select(F.col("mode").alias("pattern")).distinct()


class FactsAnnotator:
    """What was said against what was done; nothing where the source has no actions."""

    name, version, taxonomy = "facts_v1", "1.0.0", "ten_modes"
    schema = "room string, seq bigint, fact string, who string, excerpt string, why string, pattern string, turn bigint, op int"

    def annotate(self, board: Board) -> DataFrame:
        return facts.findings(board)

    def patterns_in(self, output: DataFrame) -> DataFrame:
        return output.select("pattern").distinct()


class KickstartAnnotator:
    """Open questions and bare claims: a start for one's own."""

    name, version, taxonomy = "kickstart", "1.0.0", "state_gap"
    schema = "pattern string, room string, seq bigint, who string, signal string, excerpt string, group string"

    def annotate(self, board: Board) -> DataFrame:
        return taxonomy.kickstart(board.posts, self.taxonomy)

    def patterns_in(self, output: DataFrame) -> DataFrame:
        return output.select("pattern").distinct()


_BUILTIN = (ModesAnnotator, FactsAnnotator, KickstartAnnotator)
_SOURCES: dict[str, Callable] = {"record": files.load_record, "room_ndjson": files.load_room_ndjson, "share": files.load_share, "chat_jsonl": files.load_chat_jsonl, "auto": files.load}


def _plugins(group: str) -> dict:
    out = {}
    for e in entry_points(group=group):
        try:
            out[e.name] = e.load()
        except Exception as problem:  # a broken plugin must not take the others with it
            warnings.warn(f"{group}: {e.name} can't be loaded: {problem}", stacklevel=3)
    return out


def registry() -> dict[str, type]:
    """All annotators by name; a plugin that replaces a built-in one is reported."""
    out = {c.name: c for c in _BUILTIN}
    for name, cls in _plugins(GROUPS["annotators"]).items():
        if name in out:
            warnings.warn(f"annotator {name} is replaced by a plugin", stacklevel=2)
        out[name] = cls
    return out


def sources() -> dict[str, Callable]:
    return _SOURCES | _plugins(GROUPS["sources"])


def get_annotator(name: str):
    found = registry()
    if name not in found:
        raise KeyError(f"no annotator {name!r}; there are {sorted(found)}")
    return found[name]()


def get_source(name: str) -> Callable:
    found = sources()
    if name not in found:
        raise KeyError(f"no source {name!r}; there are {sorted(found)}")
    return found[name]


def run(name: str, board: Board) -> DataFrame:
    return get_annotator(name).annotate(board)


def _is_ddl(x) -> bool:
    try:
        return bool(StructType.fromDDL(x).fields)
    except Exception:
        return False


#: What an annotator's class must bring: attribute, its test (of None where it is missing), and how a lack is told.
DEMANDS = (
    ("name", lambda x: isinstance(x, str) and NAME.fullmatch(x), "a name of lower-case letters, digits and underscores, two to 41 long, a letter first"),
    ("version", lambda x: isinstance(x, str) and x, "a version as text"),
    ("annotate", callable, "a method annotate(board)"),
    ("schema", _is_ddl, "a schema: the columns of its findings as DDL"),
    ("taxonomy", lambda x: x is None or x in taxonomy.CHOICES, f"no taxonomy, or one of {', '.join(sorted(taxonomy.CHOICES))}"),
)


def check_annotator(annotator) -> list[str]:
    """What an annotator (or its class) lacks of :data:`DEMANDS`."""
    cls = annotator if isinstance(annotator, type) else type(annotator)
    return [f"{attribute}: needs {told}" for attribute, holds, told in DEMANDS if not holds(getattr(cls, attribute, None))]


def validate_output(annotator, output: DataFrame) -> list[str]:
    """Differences of an output's columns and types from the annotator's schema."""
    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(annotator.schema)}
    have = dict(output.dtypes)
    return [f"missing column {c}" for c in sorted(want.keys() - have.keys())] + [f"unknown column {c}" for c in sorted(have.keys() - want.keys())] + [f"column {c} is {have[c]}, not {t}" for c, t in sorted(want.items()) if c in have and have[c] != t]


def records(annotator, board: Board, output: DataFrame) -> DataFrame:
    """One record per finding: ``record, annotator, source, output`` as structs, ready for a JSON sink."""
    source = board.rooms.select("room", F.struct(F.col("source_kind").alias("kind"), F.col("room").alias("room_id")).alias("source"))
    label = F.struct(F.lit(annotator.name).alias("name"), F.lit(annotator.version).alias("version"), F.lit(annotator.schema).alias("schema"))
    return output.join(source, "room", "left").select(F.lit(RECORD).alias("record"), label.alias("annotator"), "source", F.struct(*(F.col(c) for c in output.columns)).alias("output"))


def validate_records(rows: DataFrame) -> DataFrame:
    """``n, problem`` of records read back: wrong tag, unknown annotator, another schema than the installed one's, an output that breaks it."""
    known = {n: c.schema for n, c in registry().items()}
    schema = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    name, text = F.col("annotator.name"), F.to_json("output")
    fits = F.lit(True)
    for n, ddl in known.items():
        read = F.from_json(text, f"{ddl}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        extra = F.array_except(F.json_object_keys(text), F.array(*(F.lit(f.name) for f in StructType.fromDDL(ddl))))
        fits = F.when(name == n, read["_bad"].isNull() & (F.size(extra) == 0)).otherwise(fits)
    problem = (
        F.when(F.coalesce(F.col("record") != RECORD, F.lit(True)), "wrong record tag")
        .when(schema[name].isNull(), "annotator isn't installed")
        .when(schema[name] != F.col("annotator.schema"), "schema differs from the installed annotator's")
        .when(~F.coalesce(fits, F.lit(False)), "output breaks its schema")
    )
    return rows.select(problem.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


def check_codebook(codebook: dict) -> list[str]:
    """Problems of a codebook: ``id, version, labels`` with unique string ids."""
    errs = [f"the codebook needs a string {k!r}" for k in ("id", "version") if not isinstance(codebook.get(k), str) or not codebook[k]]
    ids = [x.get("id") for x in codebook.get("labels", []) if isinstance(x, dict)]
    if not ids or len(ids) != len(codebook.get("labels", [])) or not all(isinstance(i, str) and i for i in ids):
        errs.append("every label needs a string id")
    elif len(set(ids)) != len(ids):
        errs.append("label ids must be unique")
    return errs


def codebook(choice: str, by_group: bool = False) -> dict:
    """A codebook from a taxonomy choice, by pattern or by class."""
    names = {p: (n, d) for p, n, _, d in taxonomy.PATTERNS}
    groups = taxonomy.CHOICES[choice]
    labels = [{"id": g, "name": g.replace("_", " "), "definition": ", ".join(ps.split())} for g, ps in groups.items()] if by_group else [{"id": p, "name": names[p][0], "definition": names[p][1]} for ps in groups.values() for p in ps.split()]
    return {"id": choice + (":groups" if by_group else ""), "version": "1", "labels": labels}
