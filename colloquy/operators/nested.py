"""Deeply nested records as flat tables: infer a merged schema, then explode one array level after the other.

A record is JSON text. Its fields are optional and change their type from record to record, so everything stays a
VARIANT (no type is guessed and no record is lost) until a leaf is written out. Each array level becomes a child
table that carries the parent's surrogate key and the entry's ordinal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from colloquy.functions.json_values import LIST, MAP, as_text, decoded, entries, field, once, strict_json, whole_number
from colloquy.session import cut


def allow_repeated_keys(df: DataFrame) -> DataFrame:
    """Let the session's JSON parser take objects that repeat a key."""
    # a repeated key is valid JSON; its last value counts
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df


def parse_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row ``key, value VARIANT`` for each distinct key whose text is valid JSON; null, empty and broken texts give none."""
    one = allow_repeated_keys(df).select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null and _text is not null")
    one = one.dropDuplicates(["_key"]).select(F.col("_key").alias(key), strict_json(F.col("_text")).alias("value"))
    return one.where(F.col("value").isNotNull())


def child_level(parent: DataFrame, keys: list[str], value: Column, ordinal: str) -> DataFrame:
    """The child table of one array level: the parent's ``keys``, the entry's ``ordinal`` from 0, its ``value``.

    A list that is itself JSON text is read, a lone value is a list of one, and null entries keep their place.
    """
    return parent.select(*keys, F.posexplode(entries(decoded(value))).alias(ordinal, "value")).withColumn("value", decoded(F.col("value"))).withColumn(ordinal, F.col(ordinal).cast("bigint"))


def events(turn_lines: DataFrame) -> DataFrame:
    """``line_id, event_pos, value``: the events of every valid line (a line holds one event or a list of them)."""
    return child_level(parse_lines(turn_lines, "line_id", "line"), ["line_id"], F.col("value"), "event_pos")


def items(ev: DataFrame) -> DataFrame:
    return ev.select("line_id", "event_pos", decoded(field(F.col("value"), "item")).alias("value")).where(F.col("value").isNotNull() & ~F.is_variant_null("value"))


def changes(ev: DataFrame) -> DataFrame:
    """``line_id, event_pos, change_pos, value``: entries of ``item.changes``, null entries counted."""
    return child_level(items(ev), ["line_id", "event_pos"], field(F.col("value"), "changes"), "change_pos")


@dataclass
class TurnTables:
    """The flat tables of raw turn lines; each child's leading columns are its way to the parent."""

    turns: DataFrame
    events: DataFrame
    items: DataFrame
    changes: DataFrame
    usage: DataFrame


def turn_tables(turn_lines: DataFrame) -> TurnTables:
    """Turns, events, items, changes and usage of ``turn_lines``.

    Repeated lines count once; null and broken lines still count in ``turns.n_lines`` but have no children.
    """
    lines = turn_lines.dropDuplicates(["line_id"])
    ev = events(turn_lines)
    it = items(ev)
    text = lambda v, name: as_text(field(v, name))
    v = F.col("value")
    turns = lines.groupBy("room_id", "seat", "turn").agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_line_id"), F.max("line_no").alias("last_line_no"))
    usage = decoded(field(v, "usage"))
    return TurnTables(
        turns,
        ev.select("line_id", "event_pos", text(v, "type").alias("event_type"), text(v, "thread_id").alias("thread_id")),
        it.select("line_id", "event_pos", *(text(v, x).alias(y) for x, y in (("id", "item_id"), ("type", "item_type"), ("status", "status"), ("command", "command"), ("aggregated_output", "aggregated_output"), ("text", "text"), ("query", "query"))), whole_number(field(v, "exit_code")).alias("exit_code")),
        changes(ev).where(F.col("value").isNotNull() & ~F.is_variant_null("value")).select("line_id", "event_pos", "change_pos", text(v, "path").alias("path"), text(v, "kind").alias("kind")),
        ev.select("line_id", "event_pos", *(whole_number(field(usage, x)).alias(x) for x in ("input_tokens", "cached_input_tokens", "output_tokens"))).where("coalesce(input_tokens, cached_input_tokens, output_tokens) is not null"),
    )


def nested_values(turn_lines: DataFrame) -> DataFrame:
    """Every ``item.type``, ``item.changes.path`` and ``usage.input_tokens`` with its place: the rows of ``p1_found``.

    Selected from the flat tables that :func:`flatten` makes of the merged schema; a level or field that no record has gives no rows.
    """
    flat = flatten(turn_lines, "line_id", "line", leaf=lambda v: v)
    empty = F.lit(None).cast("variant")
    # lines are events or lists of events; entries of changes lie one array level below
    event, change = flat.get("$[]", flat["$"]), flat.get("$[].item.changes[]")
    at = F.col("pos_1") if "pos_1" in event.columns else F.lit(0).cast("bigint")
    col = lambda df, name: F.col(f"`{name}`") if name in df.columns else empty
    values = F.array(
        F.struct(F.lit("item").alias("child_kind"), as_text(col(event, "item.type")).alias("child_value")),
        F.struct(F.lit("usage").alias("child_kind"), whole_number(col(event, "usage.input_tokens")).cast("string").alias("child_value")),
    )
    out = event.select("line_id", at.alias("event_pos"), F.explode(values).alias("x")).select("line_id", "event_pos", "x.child_kind", F.lit(0).cast("bigint").alias("child_pos"), "x.child_value")
    if change is not None:
        out = out.unionByName(change.select("line_id", F.col("pos_1").alias("event_pos"), F.lit("change").alias("child_kind"), F.col("pos_2").alias("child_pos"), as_text(col(change, "path")).alias("child_value")))
    return out.where("child_value is not null")


#: An object with more keys than this in all records is a map: its keys are data, and become rows.
MAP_KEYS = 256
_NESTED = ("ARRAY", "OBJECT")
#: Paths of a level that the driver reads at once; of more it reads only what is left when the keys of maps are put together.
FEW = 10_000
Path = tuple[str, ...]


def _levels(parsed: DataFrame, map_keys: int) -> Iterator[tuple[list, DataFrame]]:
    """Level by level: ``path, kind, n`` of the values there, and the values. It ends where nothing is nested any more, however deep that is."""
    shape = lambda v: F.struct(v.alias("value"), F.coalesce(F.schema_of_variant(v), F.lit("VOID")).alias("shape"))
    # the shape is looked up once for each value, and once more for JSON text inside a string
    inner = lambda x: once(strict_json(as_text(x["value"])), lambda v: F.when(v.isNotNull(), shape(v)))
    read = once(shape(F.col("value")), lambda x: F.coalesce(F.when((x["shape"] == "STRING") & as_text(x["value"]).rlike(r"^\s*[\[{]"), inner(x)), x))
    kind = F.regexp_extract("x.shape", r"^\w+", 0)

    def keep(df: DataFrame) -> DataFrame:
        df = df.select("parent", "key", read.alias("x")).select("parent", "key", kind.alias("kind"), "x.value")
        return cut(df.withColumn("value", F.when(F.col("kind").isin(*_NESTED), F.col("value"))))

    level = keep(parsed.select(F.array().cast("array<string>").alias("parent"), F.lit("$").alias("key"), "value"))
    while True:
        per = level.groupBy("parent", "key", "kind").agg(F.count("*").alias("n"))
        is_map, step = F.lit(False), F.col("key")
        few = per.limit(FEW + 1).collect()
        keys: dict[Path, set[str]] = {}
        for r in few:
            if r.key != "[]":
                keys.setdefault(tuple(r.parent), set()).add(r.key)
        if len(few) <= FEW and all(len(k) <= map_keys for k in keys.values()):
            found = [Row(path=[*r.parent, r.key], kind=r.kind, n=r.n) for r in few]
        else:
            # counted where the keys are: of a map only its place goes to the driver
            many = per.where("key <> '[]'").groupBy("parent").agg(F.count_distinct("key").alias("k")).where(F.col("k") > map_keys)
            for m in many.select("parent").collect():
                is_map = is_map | ((F.col("parent") == F.array(*map(F.lit, m.parent))) & (F.col("key") != "[]"))
            step = F.when(is_map, "{}").otherwise(F.col("key"))
            found = per.withColumn("path", F.concat("parent", F.array(step))).groupBy("path", "kind").agg(F.sum("n").alias("n")).collect()
        yield found, level
        if not any(r.kind in _NESTED for r in found):
            return
        here = F.concat("parent", F.array(step))
        inside = F.coalesce(
            F.transform(F.map_entries(F.try_variant_get("value", "$", MAP)), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("key"), e["value"].alias("value"))),
            F.transform(F.try_variant_get("value", "$", LIST), lambda x: F.struct(F.lit("[]").alias("key"), x.alias("value"))),
        )
        level = keep(level.where(F.col("value").isNotNull()).select(here.alias("parent"), F.explode(inside).alias("x")).select("parent", "x.key", "x.value"))


def merged_schema(parsed: DataFrame, map_keys: int = MAP_KEYS) -> dict[Path, dict[str, int]]:
    """The paths of all records, as steps (``$``, ``.name``, ``[]`` for a list's entries, ``{}`` for a map's values), with how often each kind of value stands there.

    It is as large as the schema, not the data: objects whose keys are data count as maps.
    """
    out: dict[Path, dict[str, int]] = {}
    for found, _ in _levels(parsed, map_keys):
        for r in found:
            kinds = out.setdefault(tuple(r.path), {})
            kinds[r.kind] = kinds.get(r.kind, 0) + r.n
    return out


def infer_schema(df: DataFrame, key: str, text: str, map_keys: int = MAP_KEYS) -> DataFrame:
    """The merged schema of all records: ``path, kinds, n``.

    Every level is walked by an explode of the one above, whatever the depth; a path with several kinds is a field that changes its type. JSON text inside
    a string is read on. Null, empty and broken texts give nothing; an empty table gives no rows.
    """
    paths = merged_schema(cut(parse_lines(df, key, text)), map_keys)
    return df.sparkSession.createDataFrame([("".join(p), sorted(k), sum(k.values())) for p, k in paths.items()], "path string, kinds array<string>, n bigint")


def flatten(df: DataFrame, key: str, text: str, map_keys: int = MAP_KEYS, leaf: Callable[[Column], Column] = as_text) -> dict[str, DataFrame]:
    """All related flat tables of arbitrary nested records, by path (``$`` is the root table).

    From the merged schema each array becomes a child table, and so on inside it. A table has the record's ``key``, an ordinal ``pos_1, pos_2, ...`` (or, of a
    map, ``key_1, ...``) for each level above it, a surrogate key ``row_id`` with that of its parent row ``parent_id``, and a column per
    leaf that is not below a further array (by ``leaf``, as text if not said otherwise). A path that is an object in some records and a list in others is an array.
    """
    parsed = cut(parse_lines(df, key, text))
    raw = merged_schema(parsed, map_keys)
    listed = {p for p, k in raw.items() if "ARRAY" in k}

    def canonical(path: Path) -> Path:
        # a lone object where other records have a list belongs to the list's entries
        out: Path = ()
        for n, part in enumerate(path):
            if n and path[:n] in listed and part != "[]":
                out += ("[]",)
            out += (part,)
        return out

    paths = {canonical(p) for p in raw}
    arrays, maps = {canonical(p) for p in listed}, {canonical(p)[:-1] for p in raw if p[-1] == "{}"}
    tables: dict[str, DataFrame] = {}

    def below(p: Path, root: Path) -> bool:
        return p[: len(root)] == root and all(x[0] == "." for x in p[len(root) :])

    def walk(root: Path, frame: DataFrame, keys: list[str], depth: int) -> None:
        def at(p: Path) -> Column:
            v = F.col("value")
            for name in p[len(root) :]:
                v = decoded(field(v, name[1:]))
            return v

        inner = [p for p in paths if len(p) > len(root) and below(p, root) and p not in arrays | maps]
        cols = sorted(p for p in inner if not any(below(q, p) and len(q) > len(p) for q in inner))
        ids = [x for x in keys if x != key]
        own = [leaf(F.col("value")).alias("value")] if root not in arrays | maps and not any(len(p) > len(root) and p[: len(root)] == root for p in paths) else [leaf(at(p)).alias("".join(p[len(root) :])[1:]) for p in cols]
        name = lambda cs: F.concat_ws("/", *(F.col(c).cast("string") for c in cs))
        # a step of a child table names its array too: siblings' rows are told apart by their table
        tables["".join(root)] = frame.where(F.col("value").isNotNull() & ~F.is_variant_null("value")).select(*keys, name(keys).alias("row_id"), (name(keys[:-1]) if ids else F.lit(None).cast("string")).alias("parent_id"), *own)
        for a in sorted(x for x in arrays | maps if below(x, root)):
            if a in arrays:
                walk((*a, "[]"), child_level(frame, keys, at(a), f"pos_{depth}"), [*keys, f"pos_{depth}"], depth + 1)
            else:
                each = F.explode(F.try_variant_get(at(a), "$", MAP)).alias(f"key_{depth}", "value")
                walk((*a, "{}"), frame.select(*keys, each).withColumn("value", decoded(F.col("value"))), [*keys, f"key_{depth}"], depth + 1)

    walk(("$",), parsed.withColumn("value", decoded(F.col("value"))), [key], 1)
    return tables
