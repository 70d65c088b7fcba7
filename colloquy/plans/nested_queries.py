"""Problem 1: nested turn lines as flat tables."""

from __future__ import annotations

from colloquy.operators import nested
from colloquy.sources.tables import table


def _lines(spark, d):
    return table(spark, d, "turn_lines")


def _flat(spark, d, path, columns):
    """A table of the merged schema; its columns are named by their path below it."""
    t = nested.flatten(_lines(spark, d), "line_id", "line")[path]
    return t.select("line_id", *(t[f"`{c}`"].alias(c.replace(".", "_")) for c in columns))


QUERIES = {
    "p1_found": lambda spark, d: nested.nested_values(_lines(spark, d)),
    "p1_turns": lambda spark, d: nested.turn_tables(_lines(spark, d)).turns,
    "p1_items": lambda spark, d: nested.turn_tables(_lines(spark, d)).items,
    "p1_changes": lambda spark, d: nested.turn_tables(_lines(spark, d)).changes,
    "p1_usage": lambda spark, d: nested.turn_tables(_lines(spark, d)).usage,
    "p1_flat_events": lambda spark, d: _flat(spark, d, "$[]", ["parent_id", "row_id", "type", "item.type", "item.id", "usage.output_tokens"]),
    "p1_flat_changes": lambda spark, d: _flat(spark, d, "$[].item.changes[]", ["parent_id", "row_id", "path", "kind"]),
    "p1_schema": lambda spark, d: nested.infer_schema(_lines(spark, d), "line_id", "line").selectExpr("path", "concat_ws('|', kinds) as kinds", "n"),
}

_EVENTS = """
WITH lines AS (SELECT DISTINCT line_id, line FROM turn_lines WHERE json_valid(line)),
ev AS (
  SELECT line_id, CAST(u.pos - 1 AS BIGINT) AS event_pos, u.value AS value
  FROM (SELECT line_id, CASE WHEN json_type(line) = 'ARRAY' THEN CAST(line AS JSON)[:] ELSE NULL END AS l, line,
               CASE WHEN json_type(line) = 'ARRAY' THEN json_extract(line, '$[*]') ELSE [CAST(line AS JSON)] END AS es FROM lines),
       UNNEST(es) WITH ORDINALITY AS u(value, pos)),
it AS (
  SELECT line_id, event_pos, CASE WHEN json_type(value, '$.item') = 'VARCHAR' AND json_valid(json_extract_string(value, '$.item'))
         THEN CAST(json_extract_string(value, '$.item') AS JSON) ELSE json_extract(value, '$.item') END AS item, value FROM ev),
ch AS (
  SELECT line_id, event_pos, CASE WHEN json_type(item, '$.changes') = 'VARCHAR' AND json_valid(json_extract_string(item, '$.changes'))
         THEN CAST(json_extract_string(item, '$.changes') AS JSON) ELSE json_extract(item, '$.changes') END AS c FROM it),
chx AS (
  SELECT line_id, event_pos, CAST(u.pos - 1 AS BIGINT) AS change_pos, u.value AS value
  FROM (SELECT line_id, event_pos, CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END AS cs FROM ch WHERE json_type(c) IN ('ARRAY', 'OBJECT')),
       UNNEST(cs) WITH ORDINALITY AS u(value, pos))
"""
_EVENTS = _EVENTS.replace("CASE WHEN json_type(line) = 'ARRAY' THEN CAST(line AS JSON)[:] ELSE NULL END AS l, line,\n               ", "")
_TOKENS = "CAST(TRY_CAST(json_extract_string(value, '$.usage.{0}') AS DOUBLE) AS BIGINT)"

ORACLE = {
    "p1_found": _EVENTS
    + f"""
SELECT line_id, event_pos, 'item' AS child_kind, CAST(0 AS BIGINT) AS child_pos, json_extract_string(item, '$.type') AS child_value FROM it WHERE json_extract_string(item, '$.type') IS NOT NULL
UNION ALL SELECT line_id, event_pos, 'change', change_pos, json_extract_string(value, '$.path') FROM chx WHERE json_extract_string(value, '$.path') IS NOT NULL
UNION ALL SELECT line_id, event_pos, 'usage', CAST(0 AS BIGINT), CAST({_TOKENS.format("input_tokens")} AS VARCHAR) FROM ev WHERE {_TOKENS.format("input_tokens")} IS NOT NULL
""",
    "p1_flat_events": _EVENTS
    + """SELECT line_id, CAST(line_id AS VARCHAR) AS parent_id, line_id || '/' || event_pos AS row_id, json_extract_string(value, '$.type') AS type, json_extract_string(item, '$.type') AS item_type,
  json_extract_string(item, '$.id') AS item_id, json_extract_string(value, '$.usage.output_tokens') AS usage_output_tokens FROM it WHERE json_type(value) <> 'NULL'""",
    "p1_flat_changes": _EVENTS
    + """SELECT line_id, line_id || '/' || event_pos AS parent_id, line_id || '/' || event_pos || '/' || change_pos AS row_id, json_extract_string(value, '$.path') AS path, json_extract_string(value, '$.kind') AS kind FROM chx WHERE json_type(value) <> 'NULL'""",
    "p1_turns": "SELECT room_id, seat, turn, COUNT(*) AS n_lines, MIN(line_id) AS first_line_id, MAX(line_no) AS last_line_no FROM (SELECT DISTINCT line_id, room_id, seat, turn, line_no FROM turn_lines) GROUP BY ALL",
    "p1_items": _EVENTS
    + """SELECT line_id, event_pos, json_extract_string(item, '$.id') AS item_id, json_extract_string(item, '$.type') AS item_type, json_extract_string(item, '$.status') AS status,
  json_extract_string(item, '$.command') AS command, json_extract_string(item, '$.aggregated_output') AS aggregated_output, json_extract_string(item, '$.text') AS text, json_extract_string(item, '$.query') AS query,
  CAST(json_extract_string(item, '$.exit_code') AS BIGINT) AS exit_code FROM it WHERE json_type(item) = 'OBJECT'""",
    "p1_changes": _EVENTS + "SELECT line_id, event_pos, change_pos, json_extract_string(value, '$.path') AS path, json_extract_string(value, '$.kind') AS kind FROM chx WHERE json_type(value) = 'OBJECT'",
    "p1_usage": _EVENTS + f"SELECT * FROM (SELECT line_id, event_pos, {', '.join(_TOKENS.format(x) + ' AS ' + x for x in ('input_tokens', 'cached_input_tokens', 'output_tokens'))} FROM ev) WHERE coalesce(input_tokens, cached_input_tokens, output_tokens) IS NOT NULL",
}
