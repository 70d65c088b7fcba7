"""SQL of the shared relations, for checking the Spark queries against another engine."""

from __future__ import annotations

from colloquy.functions.patterns import BOARD_VERBS, CASED, CASELESS, PROGRAMS

QUERIES: dict = {}
ORACLE: dict = {}


def ms(text: str) -> str:
    t = f"trim({text})"
    zoned = rf"CASE WHEN regexp_matches(substr({t}, 17), '([Zz]|[+-]\d\d(:?\d\d)?)$') THEN {t} ELSE {t} || 'Z' END"
    return rf"(CASE WHEN regexp_full_match({t}, '\d{{13}}') THEN CAST({t} AS BIGINT) WHEN regexp_matches({t}, '^\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d') THEN epoch_ms(TRY_CAST({zoned} AS TIMESTAMPTZ)) END)"


def has(text: str, name: str) -> str:
    p = (CASELESS.get(name) or CASED[name]).replace("'", "''")
    flags = ("(?im)" if name == "ask" else "(?i)") if name in CASELESS else ""
    return f"regexp_matches({text}, '{flags}{p}')"


#: The names of the board's program, as one alternative: a program that is told to say something and answers with a posted message.
PROG = rf"""prog AS (SELECT string_agg(name, '|') AS p FROM (SELECT name FROM (SELECT regexp_extract(line, '[\s''"/;&|(]([A-Za-z][A-Za-z0-9_-]*)\s+(?:say|post)\b', 1) AS name, count(*) AS n FROM turn_lines
  WHERE regexp_matches(line, 'message\\?"\s*:\s*\{{') AND regexp_matches(line, 'id\\?"\s*:\s*\\?"msg_') GROUP BY ALL) WHERE name <> '' QUALIFY n >= 0.01 * sum(n) OVER () UNION SELECT unnest({list(PROGRAMS)})))"""


def has_board(text: str, name: str) -> str:
    """Needs :data:`PROG`."""
    return rf"""regexp_matches({text}, '(?:^|[\s''"/;&|(])(?:' || (SELECT p FROM prog) || ')\s+{BOARD_VERBS[name]}')"""


_TRIM = r"'^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$'"


def seat(name: str) -> str:
    return f"nullif(lower(regexp_replace({name}, {_TRIM}, '', 'g')), '')"


POSTS = f"""
raw AS (SELECT *, {ms("created_at")} AS ms, {seat("sender.name")} AS s, row_number() OVER (PARTITION BY id ORDER BY received_at NULLS FIRST, created_at NULLS FIRST) AS rn FROM room WHERE id IS NOT NULL),
per AS (SELECT id, max(ms) AS at_ms, max(s) AS s1 FROM raw GROUP BY id),
one AS (SELECT raw.* EXCLUDE (ms, s, rn), per.at_ms, per.s1 FROM raw JOIN per USING (id) WHERE rn = 1),
inst AS (SELECT room_id, sender_instance_id, arg_max(s1, n) AS s2 FROM (SELECT room_id, sender_instance_id, s1, count(*) AS n FROM one WHERE s1 IS NOT NULL GROUP BY ALL) GROUP BY ALL),
seated AS (SELECT one.*, coalesce(s1, s2) AS seat FROM one LEFT JOIN inst USING (room_id, sender_instance_id)),
mem AS (SELECT DISTINCT room_id, a.member_id AS member_id, {seat("a.name")} AS name FROM (SELECT room_id, unnest(agents) AS a FROM episodes)),
posts AS (
  SELECT p.room_id AS room, p.sequence AS seq, p.id, coalesce(m.name, p.seat, p.sender_instance_id, p.sender.member_id, '?') AS who, coalesce(p.content, '') AS text, p.created_at, p.at_ms,
    coalesce(p.reply_to_sequence, CASE WHEN p.reply_to_sequence IS NULL THEN t.sequence END) AS reply_to, coalesce(p.type, 'message') AS type,
    CASE WHEN p.id IN (SELECT goal.message_id FROM episodes WHERE goal.message_id IS NOT NULL) THEN 'goal'
         WHEN p.sender.kind = 'runner' OR coalesce(m.name, p.seat) = 'runner' THEN 'runner' WHEN p.sender.kind = 'human' THEN 'other'
         WHEN EXISTS (SELECT 1 FROM mem l WHERE l.room_id = p.room_id AND l.name = coalesce(m.name, p.seat)) OR p.room_id NOT IN (SELECT room_id FROM mem) THEN 'agent' ELSE 'other' END AS role
  FROM seated p LEFT JOIN (SELECT room_id, member_id, min(name) AS name FROM mem WHERE member_id IS NOT NULL GROUP BY ALL) m ON m.room_id = p.room_id AND m.member_id = coalesce(p.sender_instance_id, p.sender.member_id)
  LEFT JOIN one t ON t.id = p.reply_to_message_id AND t.room_id = p.room_id)
"""
MESSAGES = POSTS + ", msgs AS (SELECT * FROM posts WHERE type = 'message' AND role NOT IN ('goal', 'runner'))"
WAKES = f"turns AS (SELECT room_id AS room, {seat('seat')} AS who, turn, min({ms('started_at')}) AS start_ms, min({ms('ended_at')}) AS end_ms, min(through_sequence) AS through_sequence FROM wakes GROUP BY ALL)"
EVENTS = """
lines AS (SELECT DISTINCT line_id, room_id, seat, turn, line_no, line FROM turn_lines WHERE json_valid(line)),
ev AS (SELECT line_id, room_id, seat, turn, line_no, CAST(u.pos - 1 AS BIGINT) AS event_pos, u.value AS value
  FROM (SELECT *, CASE WHEN json_type(line) = 'ARRAY' THEN json_extract(line, '$[*]') ELSE [CAST(line AS JSON)] END AS es FROM lines), UNNEST(es) WITH ORDINALITY AS u(value, pos)),
it AS (SELECT * EXCLUDE (value), json_extract_string(value, '$.type') AS event_type, CASE WHEN json_type(value, '$.item') = 'VARCHAR' AND json_valid(json_extract_string(value, '$.item'))
  THEN CAST(json_extract_string(value, '$.item') AS JSON) ELSE json_extract(value, '$.item') END AS item, value FROM ev)
"""
LABELS = """
latest AS (SELECT * FROM incidents WHERE incident_id IS NOT NULL AND annotator IS NOT NULL QUALIFY row_number() OVER (PARTITION BY incident_id, annotator ORDER BY annotated_at DESC NULLS LAST, annotation_id DESC) = 1),
lab AS (SELECT incident_id, annotator, record, room_id, CASE WHEN regexp_replace(lower(class), '[^\\p{L}]', '', 'g') IN ('unsaid', 'unreceived', 'misread', 'disagreement', 'ungrounded', 'stalled')
  THEN regexp_replace(lower(class), '[^\\p{L}]', '', 'g') END AS class, CASE WHEN severity BETWEEN 1 AND 5 THEN severity END AS severity FROM latest)
"""
