"""Audit, incidents and taxonomies over the label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import audit, facts, incidents, taxonomy
from colloquy.operators import board as B
from colloquy.plans.board_queries import LINKED, OPS, _board, _posts
from colloquy.plans.sql import LABELS, POSTS, WAKES, seat
from colloquy.sources import tables


def _pass(spark, d, record):
    one = incidents.records(tables.table(spark, d, "incidents"), record)
    usable = F.regexp_replace(F.lower("class"), r"[^\p{L}]", "")
    return one.withColumn("class", F.when(usable.isin(*incidents.CLASSES), usable)).withColumn("severity", F.when(F.col("severity").between(1, 5), F.col("severity")))


def _both(f):
    return lambda spark, d: f(_pass(spark, d, "A"), _pass(spark, d, "B"))


def _raw(spark, d):
    one = tables.table(spark, d, "incidents").dropDuplicates(["annotation_id"])
    return one.withColumn("incident_id", F.col("annotation_id")).withColumnRenamed("room_id", "room")


QUERIES = {
    "audit_samples": lambda spark, d: audit.export(_posts(spark, d), ["R1", "B1", "D1"], "salt").select("sample_id", "episode_id", "room", "seq", "actor", F.size("context_before").alias("n_context"), "digest", "sort_key"),
    "audit_trace_digests": lambda spark, d: audit.trace_digests(_posts(spark, d)),
    "audit_class_kappa": lambda spark, d: audit.class_kappa(tables.labels(tables.table(spark, d, "incidents")), list(incidents.CLASSES)),
    "incident_matches": _both(lambda a, b: incidents.greedy(incidents.candidates(a, b))),
    "incident_candidates": _both(incidents.candidates),
    "incident_agreement": _both(incidents.agreement),
    "incident_problems": lambda spark, d: incidents.problems(_raw(spark, d), B.from_tables(spark, d)),
    "posts_seen": _board(incidents.seen),
    "evidence_levels": _board(incidents.evidence_levels),
    "bundle_posts": _board(lambda b: incidents.bundle_index(b)[0]),
    "timeline": _board(lambda b: incidents.timeline(b)),
    "action_list": _board(lambda b: incidents.action_list(b.ops)),
    "labels_usable": lambda spark, d: tables.labels(tables.table(spark, d, "incidents")).select("incident_id", "annotator", "record", "class", "severity"),
    "incidents_by_class": lambda spark, d: tables.labels(tables.table(spark, d, "incidents")).groupBy("record", "class").agg(F.count("*").alias("n"), F.sum("severity").alias("severity_sum")),
    "regrouped_facts": _board(lambda b: _regrouped(b)),
}


def _regrouped(b):
    n = facts.findings(b).groupBy("room", "pattern").agg(F.count("*").alias("n"))
    return taxonomy.regroup(n, "decision_point")


_REC = """
rec AS (SELECT room_id AS room, record, incident_id, list_distinct(list_filter(posts, lambda x: x IS NOT NULL)) AS posts, anchor FROM incidents WHERE incident_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY room_id, incident_id, record ORDER BY annotated_at DESC NULLS LAST, annotation_id DESC) = 1),
cand AS (SELECT a.room, a.incident_id AS a, b.incident_id AS b, a.anchor = b.anchor AS same, len(list_intersect(a.posts, b.posts)) / len(list_distinct(list_concat(a.posts, b.posts))) AS j
  FROM rec a JOIN rec b USING (room) WHERE a.record = 'A' AND b.record = 'B')
"""

ORACLE = {
    "labels_usable": f"WITH {LABELS} SELECT incident_id, annotator, record, class, severity FROM lab",
    "incidents_by_class": f"WITH {LABELS} SELECT record, class, count(*) AS n, sum(severity) AS severity_sum FROM lab GROUP BY ALL",
    "audit_class_kappa": f"""WITH {LABELS}, j AS (SELECT a.ca, b.cb FROM (SELECT incident_id, min(class) AS ca FROM lab WHERE record = 'A' AND class IS NOT NULL GROUP BY ALL) a
      JOIN (SELECT incident_id, min(class) AS cb FROM lab WHERE record = 'B' AND class IS NOT NULL GROUP BY ALL) b USING (incident_id)),
      g AS (SELECT k AS class, count(*) AS n, count_if(ca = k) AS pa, count_if(cb = k) AS pb, count_if(ca = k AND cb = k) AS ab FROM j, (SELECT unnest(['unsaid', 'unreceived', 'misread', 'disagreement', 'ungrounded', 'stalled']) AS k) GROUP BY k)
      SELECT class, n AS decisions, pa AS positives_a, pb AS positives_b,
        round(((ab + n - pa - pb + ab) / n - (pa * pb + (n - pa) * (n - pb)) / (n * n)) / nullif(1 - (pa * pb + (n - pa) * (n - pb)) / (n * n), 0), 4) AS kappa FROM g""",
    "incident_candidates": f"WITH {_REC} SELECT room, a, b, CASE WHEN same THEN 1 + j ELSE j END AS score FROM cand WHERE same OR j >= 0.5",
    "timeline": f"""WITH {POSTS}, {WAKES}, cut AS (SELECT room_id AS room, {seat("seat")} AS who, turn, min(cut_by_end) AS c FROM wakes GROUP BY ALL)
      SELECT room, at_ms, CASE WHEN role = 'goal' THEN 0 ELSE 1 END AS rank, 'P' || seq || ' ' || who || ': ' || text AS line FROM posts
      UNION ALL SELECT room, start_ms, 0, '--- ' || who || ' turn ' || turn || ' starts' FROM turns
      UNION ALL SELECT room, coalesce(end_ms, 1152921504606846976), 2, '--- ' || who || ' turn ' || turn || ' ends' || CASE WHEN c THEN ' (cut by the end of the run)' ELSE '' END FROM turns JOIN cut USING (room, who, turn)""",
}

_SEEN = """
lk AS (SELECT room, posted AS seq, x.who, x.turn, x.i FROM (SELECT room, posted, max({'who': who, 'turn': turn, 'i': i}) AS x FROM linked WHERE posted IS NOT NULL GROUP BY ALL)),
ag AS (SELECT p.room, p.seq, p.who, p.at_ms, lk.turn AS l_turn, lk.i AS l_i, lk.seq IS NOT NULL AS has_link, lk.who = p.who AS own FROM posts p LEFT JOIN lk USING (room, seq) WHERE role = 'agent'),
fr AS (SELECT a.room, a.seq, a.who, arg_max({'turn': t.turn, 'e': coalesce(t.end_ms, 1152921504606846976), 'h': coalesce(t.through_sequence, 1)}, t.start_ms) AS w, any_value(a.at_ms) AS at_ms
  FROM ag a JOIN turns t ON t.room = a.room AND t.who = a.who AND t.start_ms <= a.at_ms WHERE NOT a.has_link GROUP BY ALL)
"""
ORACLE |= {
    "posts_seen": f"""WITH {LINKED}, {WAKES}, {_SEEN}
      SELECT a.room, a.seq, a.who, CASE WHEN t.turn IS NOT NULL THEN a.l_turn END AS turn, CASE WHEN t.turn IS NOT NULL THEN greatest(coalesce(t.through_sequence, 1), (SELECT max(o.read_max) FROM ops o WHERE o.room = a.room AND o.who = a.who AND o.turn = a.l_turn AND o.i < a.l_i)) END AS seen FROM ag a LEFT JOIN turns t ON t.room = a.room AND t.who = a.who AND t.turn = a.l_turn WHERE a.has_link AND a.own
      UNION ALL SELECT a.room, a.seq, a.who, CASE WHEN f.at_ms <= f.w.e + 1000 THEN f.w.turn END, CASE WHEN f.at_ms <= f.w.e + 1000 THEN f.w.h END FROM ag a LEFT JOIN fr f USING (room, seq) WHERE NOT a.has_link""",
    "evidence_levels": f"WITH {POSTS}, {OPS} SELECT DISTINCT room, CASE WHEN room IN (SELECT room FROM ops) THEN 'E3' WHEN room IN (SELECT room_id FROM wakes) THEN 'E2' ELSE 'E1' END AS level FROM posts",
}

_LEVELS = "CASE WHEN room IN (SELECT room FROM ops) THEN 'E3' WHEN room IN (SELECT room_id FROM wakes) THEN 'E2' ELSE 'E1' END"
_SEEN_ROWS = ORACLE["posts_seen"][ORACLE["posts_seen"].index("SELECT a.room, a.seq, a.who, CASE WHEN t.turn") :]
ORACLE["bundle_posts"] = f"""WITH {LINKED}, {WAKES}, {_SEEN}, sn AS ({_SEEN_ROWS}) SELECT p.room, p.seq, p.who, p.role, p.created_at, sn.seen, {_LEVELS.replace("room IN", "p.room IN")} AS level FROM posts p LEFT JOIN sn USING (room, seq)"""
_OP_PATHS = """pathlist AS (SELECT line_id, event_pos, 0 AS content_pos, list_transform(list_filter(CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') WHEN json_type(c) = 'OBJECT' THEN [c] ELSE [] END, lambda x: json_type(x) = 'OBJECT'), lambda x: json_extract_string(x, '$.path')) AS paths FROM (
      SELECT line_id, event_pos, CASE WHEN json_type(item, '$.changes') = 'VARCHAR' THEN CAST(json_extract_string(item, '$.changes') AS JSON) ELSE json_extract(item, '$.changes') END AS c FROM it WHERE event_type = 'item.completed' AND json_extract_string(item, '$.type') = 'file_change')
    UNION ALL SELECT line_id, event_pos, content_pos, [coalesce(json_extract_string(c, '$.input.file_path'), json_extract_string(c, '$.input.notebook_path'))] FROM con WHERE event_type = 'assistant' AND json_extract_string(c, '$.name') IN ('Edit', 'Write', 'MultiEdit', 'NotebookEdit')),
  words AS (SELECT line_id, event_pos, 0 AS content_pos, CASE WHEN event_type <> 'item.completed' THEN coalesce(json_extract_string(value, '$.error.message'), json_extract_string(value, '$.message')) WHEN json_extract_string(item, '$.type') = 'web_search' THEN json_extract_string(item, '$.query')
      WHEN json_extract_string(item, '$.type') = 'mcp_tool_call' THEN concat_ws('.', json_extract_string(item, '$.server'), json_extract_string(item, '$.tool')) WHEN json_extract_string(item, '$.type') = 'error' THEN json_extract_string(item, '$.message') ELSE json_extract_string(item, '$.text') END AS w FROM it WHERE event_type IN ('item.completed', 'turn.failed', 'error')
    UNION ALL SELECT line_id, event_pos, content_pos, CASE WHEN json_extract_string(c, '$.type') = 'text' THEN json_extract_string(c, '$.text') WHEN json_extract_string(c, '$.name') = 'WebSearch' THEN json_extract_string(c, '$.input.query') ELSE json_extract_string(c, '$.name') END FROM con WHERE event_type = 'assistant')"""
ORACLE["action_list"] = f"""WITH {LINKED}, {_OP_PATHS} SELECT room, concat_ws(':', who, turn, i) AS action_id, who, turn, i, kind,
    CASE WHEN posted IS NOT NULL THEN 'posted P' || posted WHEN read_max IS NOT NULL THEN 'read the board: up to P' || read_max WHEN kind = 'command' THEN 'command [exit ' || coalesce(CAST(exit_code AS VARCHAR), 'none') || ']: ' || substr(coalesce(command, ''), 1, 400)
      WHEN kind = 'file_change' THEN 'file change: ' || array_to_string(list_filter(coalesce(paths, []), lambda x: x IS NOT NULL), ', ') WHEN kind = 'message' THEN 'final text of the turn: ' || substr(coalesce(w, ''), 1, 400) ELSE substr(kind || ': ' || coalesce(w, ''), 1, 240) END AS line
    FROM linked LEFT JOIN pathlist USING (line_id, event_pos, content_pos) LEFT JOIN words USING (line_id, event_pos, content_pos)"""


def _rule(condition: str, problem: str) -> str:
    return f"SELECT room, incident_id, record, '{problem.replace("'", "''")}' AS problem FROM i WHERE {condition}"


_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_RULES = [
    ("len(posts) = 0", "posts must be a non-empty list"),
    ("NOT coalesce(list_contains(posts, anchor), false)", "the anchor must be one of its posts"),
    (f"NOT coalesce(class IN ({_quoted(incidents.CLASSES)}), false)", "unknown class"),
    ("NOT coalesce(severity BETWEEN 1 AND 5, false)", "severity must be from 1 to 5"),
    ("severity BETWEEN 1 AND 5 AND NOT coalesce(starts_with(trim(severity_reason), CAST(severity AS VARCHAR)), false)", "severity_reason must begin with the level"),
    *((f"length(trim(coalesce({c}, ''))) < 10", f"{c} must say what happened") for c in ("class_reason", "cause", "consequence")),
    ("repaired IS NULL", "repaired must be true or false"),
    (f"NOT coalesce(source IN ({_quoted(incidents.SOURCES)}), false)", "unknown source"),
    (f"NOT coalesce(confidence IN ({_quoted(incidents.CONFIDENCES)}), false)", "unknown confidence"),
    ("len(actions) > 0 AND room IN (SELECT room FROM lv WHERE level <> 'E3')", "actions without agents' logs"),
    ("class = 'unsaid' AND room IN (SELECT room FROM lv WHERE level <> 'E3')", "unsaid needs the agents' logs"),
]
ORACLE["incident_problems"] = f"""WITH {LINKED}, {WAKES}, {_SEEN}, sn AS ({_SEEN_ROWS}), lv AS (SELECT room, {_LEVELS} AS level FROM (SELECT DISTINCT room FROM posts)),
  i AS (SELECT DISTINCT ON (annotation_id) room_id AS room, annotation_id AS incident_id, record, coalesce(posts, []) AS posts, anchor, actions, class, class_reason, cause, consequence, severity, severity_reason, repaired, source, confidence FROM incidents),
  each AS (SELECT *, unnest(posts) AS seq FROM i)
  {" UNION ALL ".join(_rule(*r) for r in _RULES)}
  UNION ALL SELECT DISTINCT room, incident_id, record, 'a post does not exist' FROM each e WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.room = e.room AND p.seq = e.seq)
  UNION ALL SELECT e.room, e.incident_id, e.record, 'unreceived, but its author had received every other post' FROM each e JOIN sn s ON s.room = e.room AND s.seq = e.anchor AND s.seen IS NOT NULL JOIN posts p ON p.room = e.room AND p.seq = e.seq
    WHERE e.class = 'unreceived' AND e.source = 'agents' GROUP BY ALL HAVING NOT bool_or(p.who <> s.who AND ((e.seq > s.seen AND e.seq < e.anchor) OR e.seq > e.anchor))"""
