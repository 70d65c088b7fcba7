"""Boards, speech acts, modes and facts over the board tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.patterns import CASED, CASELESS, has
from colloquy.operators import board as B
from colloquy.operators import facts, modes, taxonomy
from colloquy.plans.sql import EVENTS, MESSAGES, POSTS, PROG, WAKES, has_board, ms, seat
from colloquy.plans.sql import has as sql_has
from colloquy.session import cut
from colloquy.sources import tables


def _posts(spark, d):
    return B.posts(tables.table(spark, d, "room"), tables.episodes(tables.table(spark, d, "episodes")))


def _board(f):
    return lambda spark, d: f(B.from_tables(spark, d))


def _of_posts(f):
    return lambda spark, d: f(_posts(spark, d))


def _flagged(f):
    return lambda spark, d: f(modes.flags(_posts(spark, d)))


def _modes(f):
    return lambda spark, d: f(modes.Modes(B.from_tables(spark, d, written=True)))


_ACTS = ["accept", "hedge", "done", "review", "review_unread", "ask", "proxy", "wait", "pause", "pay", "upload", "push", "identity", "authorized", "role_claim", "heartbeat"]


def _ends(p):
    return p.groupBy("room").agg(F.max("seq").alias("last_seq"))


QUERIES = {
    "board_posts": _of_posts(lambda p: p),
    "board_seats": _board(lambda b: b.seats.select("room", "who", "driver", "model", "member_id")),
    "board_rooms": _board(lambda b: b.rooms),
    "board_checks": _board(lambda b: b.checks),
    "board_wakes": _board(lambda b: b.wakes.select("room", "who", "turn", "through_sequence", "start_ms", "end_ms")),
    "board_actions": _board(lambda b: b.ops.groupBy("room", "who", "turn", "kind").agg(F.count("*").alias("n"))),
    "board_commands": lambda spark, d: B.commands(B.from_tables(spark, d).ops).select("room", "who", "turn", "i", "command", "exit_code", "posted"),
    "post_links": _board(lambda b: B.post_ops(b.ops)),
    "board_summary": _board(lambda b: B.summary(b).select("room", "posts", "agent_posts", "seats", "checks", "checks_passed", "wakes", "ended_by")),
    "role_counts": _of_posts(lambda p: p.groupBy("room", "role", "type").agg(F.count("*").alias("n"))),
    "speech_acts": _flagged(lambda f: f.select("room", "seq", *_ACTS)),
    "speech_act_counts": _flagged(lambda f: f.groupBy("room").agg(F.count("*").alias("posts"), *(F.count_if(a).alias(a) for a in _ACTS))),
    "post_items": _flagged(lambda f: f.select("room", "seq", F.explode("items").alias("item"))),
    "post_citations": _of_posts(lambda p: p.select("room", "seq", F.explode(T.cites(F.col("text"))).alias("cited"))),
    "post_mentions": _of_posts(lambda p: p.select("room", "seq", F.explode(T.mentions(F.col("text"))).alias("handle"))),
    "post_files": _of_posts(lambda p: p.select("room", "seq", F.explode(T.files(F.col("text"))).alias("file"))),
    "post_redacted": _of_posts(lambda p: p.select("room", "seq", T.redact(F.col("text")).alias("excerpt"), T.scrub(F.col("text")).alias("scrubbed"))),
    "unanswered_asks": _flagged(lambda f: modes.unanswered(f, _ends(f)).select("room", "seq", "who")),
    "near_duplicates": _flagged(lambda f: modes.near_duplicates(cut(f.select("room", "seq", "who", "text"))).select("room", "seq", "who", "of_seq", "of_who")),
    "item_states": _flagged(lambda f: modes.item_states(modes.item_events(f)).select("room", "item", "first_mention", "claims", "dones", "reviews", "uploads", "status_at_end")),
    "re_claims": _modes(lambda m: modes.reclaims(m.placed(), m.ends, m.board.seats).select("room", "item", "seq", "who", "own", "done_seq", "mode")),
    "reviews_of_nothing": _modes(lambda m: modes.reviews_of_nothing(m.flagged, m.placed()).select("room", "seq", "who", "why")),
    "role_conflicts": _flagged(lambda f: modes.role_conflicts(f).drop("first_seq")),
    "mode_metrics": _modes(lambda m: m.metrics()),
    "mode_severities": _modes(lambda m: m.modes()),
    "mode_evidence": _modes(lambda m: m.evidence()),
    "modes_regrouped": _modes(lambda m: taxonomy.regroup(m.modes().select("room", F.col("mode").alias("pattern"), F.col("count").alias("n")), "state_gap")),
    "kickstart_findings": _of_posts(lambda p: taxonomy.kickstart(p).select("room", "seq", "who", "signal", "pattern", "group")),
    "kickstart_groups": _of_posts(lambda p: taxonomy.kickstart(p).groupBy("room", "group").agg(F.count("*").alias("n"))),
    "fact_findings": _board(facts.findings),
    "fact_counts": _board(lambda b: facts.counts(facts.findings(b), b.rooms)),
    "fact_seats": _board(lambda b: facts.seat_stats(b).select("room", "who", "posts", "linked_posts", "turns", "commands", "failed_commands", "test_runs", "n_files_changed")),
    "checks_failed_after_claim": _board(lambda b: facts.findings(b).where("fact = 'check_failed_after_done'").select("room", "seq", "who").distinct()),
    "files_changed": _board(lambda b: facts.changed_files(b.ops)),
    "success_claims": _of_posts(lambda p: B.agent_posts(p).where(T.success(F.col("text"))).select("room", "seq", "who")),
    "work_commands": _board(lambda b: B.commands(b.ops).groupBy("room", "who").agg(F.count_if(B.is_work(F.col("kind"), F.col("command"), b.programs)).alias("work"), F.count_if(has(F.col("command"), "test")).alias("tests"), F.count_if(has(F.col("command"), "write")).alias("writes"), F.count("*").alias("n"))),
}

_FLAGS = ", ".join(f"{sql_has('substr(text, 1, 220)' if a == 'heartbeat' else 'text', 'role' if a == 'role_claim' else a)} AS {a}" for a in _ACTS)
FLAGGED = MESSAGES + f", flagged AS (SELECT *, {_FLAGS} FROM msgs)"
_ITEM = CASELESS["item"]
ITEMS = FLAGGED + f""", items AS (SELECT DISTINCT room, seq, who, item, accept AS claims, done, hedge, review, upload OR pay OR push AS delivers FROM
  (SELECT *, lower(trim(replace(unnest(regexp_extract_all(text, '(?i){_ITEM}')), '`', ''))) AS item FROM flagged) WHERE length(item) >= 2)"""
_ANSWERED = """answered AS (SELECT room, CAST(unnest(regexp_extract_all(text, '#(\\d{1,4})\\b', 1)) AS BIGINT) AS seq FROM flagged UNION SELECT room, reply_to FROM flagged WHERE reply_to <> 0)"""

_AT = '"at"'
ORACLE = {
    "board_posts": f"WITH {POSTS} SELECT * FROM posts",
    "board_checks": f'SELECT DISTINCT room_id AS room, "at", {ms(_AT)} AS at_ms, trigger, command, cause, exit_code, passed, sequence, output FROM checks',
    "board_wakes": f"WITH {WAKES} SELECT * FROM turns",
    "role_counts": f"WITH {POSTS} SELECT room, role, type, count(*) AS n FROM posts GROUP BY ALL",
    "speech_acts": f"WITH {FLAGGED} SELECT room, seq, {', '.join(_ACTS)} FROM flagged",
    "speech_act_counts": f"WITH {FLAGGED} SELECT room, count(*) AS posts, {', '.join(f'count_if({a}) AS {a}' for a in _ACTS)} FROM flagged GROUP BY room",
    "post_items": f"WITH {ITEMS} SELECT room, seq, item FROM items",
    "post_citations": f"WITH {POSTS} SELECT DISTINCT room, seq, CAST(regexp_extract(m, '(\\d+)$', 1) AS BIGINT) AS cited FROM (SELECT room, seq, unnest(regexp_extract_all(text, '(?:^|[^\\w&])#\\d{{1,6}}\\b')) AS m FROM posts)",
    "post_mentions": f"WITH {POSTS} SELECT DISTINCT room, seq, regexp_replace(regexp_extract(m, '@(.*)$', 1), '\\.+$', '') AS handle FROM (SELECT room, seq, unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_.@])@[A-Za-z0-9][\\p{{L}}\\p{{N}}_.-]{{0,63}}')) AS m FROM posts)",
    "unanswered_asks": f"WITH {FLAGGED}, {_ANSWERED} SELECT f.room, f.seq, f.who FROM flagged f JOIN (SELECT room, max(seq) AS last FROM flagged GROUP BY room) l USING (room) WHERE ask AND f.seq < last - 2 AND NOT EXISTS (SELECT 1 FROM answered a WHERE a.room = f.room AND a.seq = f.seq)",
    "item_states": f"""WITH {ITEMS} SELECT * FROM (SELECT room, item, min(seq) AS first_mention, count_if(claims) AS claims, count_if(done) AS dones, count_if(review) AS reviews, count_if(delivers) AS uploads,
      CASE WHEN count_if(review) > 0 AND count_if(done) > 0 THEN 'reviewed' WHEN count_if(done) > 0 THEN 'done' WHEN count_if(claims AND NOT hedge) > 0 THEN 'claimed' ELSE 'mentioned' END AS status_at_end
      FROM items GROUP BY room, item) WHERE claims > 0 OR dones > 0 OR reviews > 0""",
    "re_claims": f"""WITH {ITEMS}, prior AS (SELECT c.room, c.item, c.seq, c.who, max(d.seq) FILTER (d.who <> c.who) AS other_seq, max(d.seq) AS any_seq FROM items c JOIN items d ON d.room = c.room AND d.item = c.item AND d.seq < c.seq AND d.done WHERE c.claims GROUP BY ALL)
      SELECT room, item, seq, who, other_seq IS NULL AS own, coalesce(other_seq, any_seq) AS done_seq, 'R1' AS mode FROM prior""",
    "reviews_of_nothing": f"""WITH {ITEMS}, nothing AS (SELECT r.room, r.seq FROM (SELECT * FROM items WHERE review) r LEFT JOIN items d ON d.room = r.room AND d.item = r.item AND d.seq <= r.seq AND (d.done OR d.delivers) GROUP BY ALL HAVING count(d.seq) = 0)
      SELECT f.room, f.seq, f.who, CASE WHEN f.review_unread THEN 'review given on a description, not the artifact' ELSE 'review of items without a visible prior delivery' END AS why
      FROM flagged f LEFT JOIN nothing n USING (room, seq) WHERE f.review AND (f.review_unread OR n.seq IS NOT NULL)""",
    "near_duplicates": f"""WITH {MESSAGES}, w AS (SELECT room, seq, who, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '') AS w FROM msgs),
      sh AS (SELECT room, seq, who, list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS sh FROM w WHERE len(w) >= 4),
      e AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY seq) AS r FROM sh WHERE len(sh) >= 8),
      h AS (SELECT x.room, x.seq, x.who, min(y.seq) AS of_seq, arg_min(y.who, y.seq) AS of_who FROM e x JOIN e y ON x.room = y.room AND y.r < x.r AND y.r >= x.r - 80
        WHERE len(list_intersect(x.sh, y.sh)) / len(list_distinct(list_concat(x.sh, y.sh))) >= 0.6 GROUP BY ALL) SELECT * FROM h""",
    "kickstart_findings": f"""WITH {POSTS}, ag AS (SELECT *, regexp_replace(text, '\\s+$', '') AS t FROM posts WHERE role = 'agent'),
      answered AS (SELECT room, CAST(regexp_extract(m, '(\\d+)$', 1) AS BIGINT) AS seq FROM (SELECT room, unnest(regexp_extract_all(text, '(?:^|[^\\w&])#\\d{{1,6}}\\b')) AS m FROM ag) UNION SELECT room, reply_to FROM ag WHERE reply_to <> 0)
      SELECT room, seq, who, 'open_question' AS signal, 'B1' AS pattern, 'disagreement' AS "group" FROM ag WHERE t LIKE '%?' AND NOT EXISTS (SELECT 1 FROM answered a WHERE a.room = ag.room AND a.seq = ag.seq)
      UNION ALL SELECT room, seq, who, 'bare_claim', 'D1', 'ungrounded' FROM ag WHERE {sql_has("t", "bare_done")} AND NOT {sql_has("t", "checkable")}""",
    "checks_failed_after_claim": f"""WITH {POSTS} SELECT DISTINCT p.room, p.seq, p.who FROM posts p JOIN checks c ON c.room_id = p.room AND c.sequence = p.seq
      WHERE c.cause = 'claim' AND c.passed = false AND p.role = 'agent' AND p.room IN (SELECT room_id FROM turn_lines WHERE json_valid(line) AND (line LIKE '%item.completed%' OR line LIKE '%"assistant"%' OR line LIKE '%turn.failed%' OR line LIKE '%"error"%'))""",
    "files_changed": f"""WITH {EVENTS}, ch AS (SELECT room_id, seat, CASE WHEN json_type(item, '$.changes') = 'VARCHAR' THEN CAST(json_extract_string(item, '$.changes') AS JSON) ELSE json_extract(item, '$.changes') END AS c FROM it WHERE event_type = 'item.completed' AND json_extract_string(item, '$.type') = 'file_change'),
      p1 AS (SELECT room_id, seat, json_extract_string(unnest(CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END), '$.path') AS path FROM ch WHERE json_type(c) IN ('ARRAY', 'OBJECT')),
      p2 AS (SELECT room_id, seat, unnest(json_extract(value, '$.message.content[*]')) AS c FROM it WHERE event_type = 'assistant'),
      p3 AS (SELECT room_id, seat, coalesce(json_extract_string(c, '$.input.file_path'), json_extract_string(c, '$.input.notebook_path')) AS path FROM p2 WHERE json_extract_string(c, '$.type') = 'tool_use' AND json_extract_string(c, '$.name') IN ('Edit', 'Write', 'MultiEdit', 'NotebookEdit'))
      SELECT DISTINCT room_id AS room, {seat("seat")} AS who, regexp_extract(path, '([^/]*)$', 1) AS file FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p3) WHERE path IS NOT NULL""",
}
ORACLE["kickstart_groups"] = f'SELECT room, "group", count(*) AS n FROM ({ORACLE["kickstart_findings"]}) GROUP BY ALL'

# ---- actions, metrics and severities

_kind = "json_extract_string(item, '$.type')"
OPS = PROG + "," + EVENTS + f""",
con AS (SELECT line_id, room_id, seat, turn, line_no, event_pos, event_type, CAST(u.pos - 1 AS BIGINT) AS content_pos, u.value AS c FROM (SELECT *, json_extract(value, '$.message.content[*]') AS cs FROM it WHERE event_type IN ('assistant', 'user')), UNNEST(cs) WITH ORDINALITY AS u(value, pos)),
op0 AS (
  SELECT room_id, seat, turn, line_no, line_id, event_pos, 0 AS content_pos,
    CASE WHEN event_type IN ('turn.failed', 'error') THEN 'error' ELSE map {{'command_execution': 'command', 'file_change': 'file_change', 'web_search': 'web_search', 'mcp_tool_call': 'tool', 'agent_message': 'message', 'error': 'error'}}[{_kind}] END AS kind,
    json_extract_string(item, '$.command') AS command, CAST(json_extract_string(item, '$.exit_code') AS BIGINT) AS code, json_extract_string(item, '$.aggregated_output') AS output, NULL AS tool_id
  FROM it WHERE event_type IN ('item.completed', 'turn.failed', 'error')
  UNION ALL SELECT room_id, seat, turn, line_no, line_id, event_pos, content_pos,
    CASE WHEN json_extract_string(c, '$.type') = 'text' THEN 'message' WHEN json_extract_string(c, '$.type') = 'tool_use' THEN CASE WHEN json_extract_string(c, '$.name') = 'Bash' THEN 'command' WHEN json_extract_string(c, '$.name') IN ('Edit', 'Write', 'MultiEdit', 'NotebookEdit') THEN 'file_change' WHEN json_extract_string(c, '$.name') = 'WebSearch' THEN 'web_search' ELSE 'tool' END END,
    CASE WHEN json_extract_string(c, '$.name') = 'Bash' THEN json_extract_string(c, '$.input.command') END, NULL, NULL, CASE WHEN json_extract_string(c, '$.name') = 'Bash' THEN json_extract_string(c, '$.id') END
  FROM con WHERE event_type = 'assistant'),
res AS (SELECT room_id, {seat("seat")} AS who, turn, json_extract_string(c, '$.tool_use_id') AS tool_id, arg_max(CASE WHEN json_extract_string(c, '$.is_error') = 'true' THEN 1 ELSE 0 END, (line_no, event_pos, content_pos)) AS result FROM con WHERE event_type = 'user' AND json_extract_string(c, '$.type') = 'tool_result' GROUP BY ALL),
op1 AS (SELECT room_id AS room, {seat("seat")} AS who, turn, line_no, line_id, event_pos, content_pos, kind, command, code, output, tool_id FROM op0 WHERE kind IS NOT NULL),
ops AS (SELECT o.room, o.who, o.turn, CAST(row_number() OVER (PARTITION BY o.room, o.who, o.turn ORDER BY line_no, line_id, event_pos, content_pos) - 1 AS INT) AS i, kind, command, CASE WHEN o.tool_id IS NOT NULL THEN res.result ELSE code END AS exit_code,
  CASE WHEN {has_board("coalesce(command, '')", "board_say")} THEN nullif(regexp_extract(coalesce(output, ''), '"message"\\s*:\\s*\\{{\\s*"id"\\s*:\\s*"(msg_[A-Za-z0-9_-]+)"', 1), '') END AS posted_id,
  CASE WHEN {has_board("coalesce(command, '')", "board_read")} THEN list_max(list_transform(regexp_extract_all(coalesce(output, ''), '"sequence"\\s*:\\s*(\\d+)', 1), lambda x: TRY_CAST(x AS BIGINT))) END AS read_max, right(output, 500) AS output, o.line_id, o.event_pos, o.content_pos
  FROM op1 o LEFT JOIN res ON res.room_id = o.room AND res.who = o.who AND res.turn = o.turn AND res.tool_id = o.tool_id)
"""
LINKED = POSTS + "," + OPS + ", linked AS (SELECT o.*, p.seq AS posted FROM ops o LEFT JOIN posts p ON p.room = o.room AND p.id = o.posted_id)"
_TALK = has_board("coalesce(command, '')", "board_talk")

ORACLE |= {
    "board_actions": f"WITH {OPS} SELECT room, who, turn, kind, count(*) AS n FROM ops GROUP BY ALL",
    "board_commands": f"WITH {LINKED} SELECT room, who, turn, i, command, exit_code, posted FROM linked WHERE kind = 'command'",
    "post_links": f"WITH {LINKED} SELECT room, posted AS seq, x.who, x.turn, x.i FROM (SELECT room, posted, max({{'who': who, 'turn': turn, 'i': i}}) AS x FROM linked WHERE posted IS NOT NULL GROUP BY ALL)",
    "work_commands": f"WITH {OPS} SELECT room, who, count_if(NOT {_TALK}) AS work, count_if({sql_has('command', 'test')}) AS tests, count_if({sql_has('command', 'write')}) AS writes, count(*) AS n FROM ops WHERE kind = 'command' GROUP BY ALL",
    "board_seats": f"SELECT room_id AS room, {seat('a.name')} AS who, arg_min(a.driver, k) AS driver, arg_min(a.model, k) AS model, arg_min(a.member_id, k) AS member_id FROM (SELECT room_id, u.a AS a, (coalesce(goal.started_at, ''), u.pos, u.a.member_id) AS k FROM episodes, UNNEST(agents) WITH ORDINALITY AS u(a, pos) WHERE goal.message_id IS NOT NULL) GROUP BY ALL",
    "board_summary": f"""WITH {POSTS}, {WAKES}, {OPS} SELECT r.room, r.posts, r.agent_posts, coalesce(s.n, 0) AS seats, coalesce(c.n, 0) AS checks, coalesce(c.ok, 0) AS checks_passed, coalesce(w.n, 0) AS wakes, e.t AS ended_by
      FROM (SELECT room, count(*) AS posts, count_if(role = 'agent') AS agent_posts FROM posts GROUP BY room) r
      LEFT JOIN (SELECT room_id, count(DISTINCT {seat('a.name')}) AS n FROM (SELECT room_id, unnest(agents) AS a FROM episodes) GROUP BY room_id) s ON s.room_id = r.room
      LEFT JOIN (SELECT room_id, count(*) AS n, count_if(passed) AS ok FROM (SELECT DISTINCT * FROM checks) GROUP BY room_id) c ON c.room_id = r.room
      LEFT JOIN (SELECT room, count(*) AS n FROM turns GROUP BY room) w ON w.room = r.room
      LEFT JOIN (SELECT room_id, arg_max(coalesce(ended_by.trigger, '~'), (coalesce(goal.sequence, 0), goal.message_id)) AS t0, nullif(t0, '~') AS t FROM episodes GROUP BY room_id) e ON e.room_id = r.room""",
    "mode_severities": f"""WITH {ITEMS}, {_ANSWERED}, ends AS (SELECT room, max(seq) AS last, arg_max(text, seq) AS t, count(*) AS posts FROM flagged GROUP BY room),
      prior AS (SELECT DISTINCT c.room, c.item, c.seq FROM items c JOIN items d ON d.room = c.room AND d.item = c.item AND d.seq < c.seq AND d.done WHERE c.claims),
      una AS (SELECT f.room, count(*) AS n FROM flagged f JOIN ends USING (room) WHERE ask AND f.seq < last - 2 AND NOT EXISTS (SELECT 1 FROM answered a WHERE a.room = f.room AND a.seq = f.seq) GROUP BY f.room),
      st AS (SELECT room, count_if(claims > 0 AND firm = 0 AND dones = 0) AS hedged, count_if(firm > 0 AND dones = 0 ) AS opened FROM (SELECT room, item, count_if(claims) AS claims, count_if(done) AS dones, count_if(claims AND NOT hedge) AS firm FROM items GROUP BY ALL) GROUP BY room),
      nothing AS (SELECT r.room, r.seq FROM (SELECT * FROM items WHERE review) r LEFT JOIN items d ON d.room = r.room AND d.item = r.item AND d.seq <= r.seq AND (d.done OR d.delivers) GROUP BY ALL HAVING count(d.seq) = 0),
      d2 AS (SELECT f.room, count(*) AS n FROM flagged f LEFT JOIN nothing x USING (room, seq) WHERE f.review AND (f.review_unread OR x.seq IS NOT NULL) GROUP BY f.room),
      dup AS (SELECT room, count(*) AS n FROM ({{near}}) GROUP BY room),
      base AS (SELECT room, count_if(ask) AS asks, count_if(wait) AS waits, count_if(review) AS reviews, count_if(heartbeat) AS hb, count_if(identity) AS ident, count_if(upload OR pay OR push) AS acts, count_if(ask AND proxy) AS d4 FROM flagged GROUP BY room),
      m AS (SELECT b.*, e.posts, coalesce((SELECT count(*) FROM items i WHERE i.room = b.room AND i.claims), 0) AS claims, coalesce((SELECT count(*) FROM prior p WHERE p.room = b.room), 0) AS r1, coalesce(una.n, 0) AS una, coalesce(st.hedged, 0) AS hedged, coalesce(st.opened, 0) AS opened, coalesce(d2.n, 0) AS d2, coalesce(dup.n, 0) AS dup,
        CASE WHEN {sql_has("e.t", "pause")} THEN 'pause' WHEN {sql_has("e.t", "ask")} THEN 'ask' WHEN {sql_has("e.t", "heartbeat")} THEN 'heartbeat' WHEN {sql_has("e.t", "done")} THEN 'done' ELSE 'other' END AS lk
        FROM base b JOIN ends e USING (room) LEFT JOIN una USING (room) LEFT JOIN st USING (room) LEFT JOIN d2 USING (room) LEFT JOIN dup USING (room)),
      x AS (SELECT *, (opened > 0 OR lk IN ('ask', 'heartbeat', 'pause') OR waits >= greatest(3, posts // 20)) AS d3, ((hb / posts >= 0.15 OR lk IN ('pause', 'ask')) AND (opened > 0 OR waits >= 3)) AS d3h FROM m),
      u AS (SELECT room, 'R1' AS mode, r1 AS c, r1 / greatest(claims, 1) AS rate, 0.4 AS h, 0.2 AS md, 0.05 AS l, 0.4 AS confidence FROM x
        UNION ALL SELECT room, 'R2', 0, 0, 0.4, 0.2, 0.05, 0.35 FROM x
        UNION ALL SELECT room, 'B1', least(una, 40) + hedged, una / greatest(asks, 1), 0.5, 0.25, 0.08, 0.55 FROM x
        UNION ALL SELECT room, 'B2', ident, ident / posts, 0.05, 0.02, 0.004, 0.5 FROM x
        UNION ALL SELECT room, 'D2', d2, d2 / greatest(reviews, 1), 0.5, 0.25, 0.08, 0.3 FROM x
        UNION ALL SELECT room, 'D4', d4, d4 / greatest(asks, 1), 0.3, 0.1, 0.02, 0.4 FROM x
        UNION ALL SELECT room, 'REP', least(dup, 40), dup / posts, 0.15, 0.07, 0.02, 0.85 FROM x
        UNION ALL SELECT room, 'HB', hb, hb / posts, 0.15, 0.07, 0.02, 0.9 FROM x)
      SELECT room, mode, c > 0 AS present, CASE WHEN rate >= h THEN 'high' WHEN rate >= md THEN 'medium' WHEN rate >= l THEN 'low' ELSE 'none' END AS severity, CAST(c AS BIGINT) AS count, CAST(confidence AS DOUBLE) AS confidence FROM u
      UNION ALL SELECT room, 'D1', acts > 0, 'unknown', least(acts, 10), 0.3 FROM x
      UNION ALL SELECT room, 'D3', d3, CASE WHEN d3h THEN 'high' WHEN d3 THEN 'medium' ELSE 'none' END, CAST(d3 AS BIGINT), 0.6 FROM x""".replace("{near}", ORACLE["near_duplicates"]),
}

_UNI = r"[\p{L}\p{M}\p{N}_"
_SECRET = CASED["secret"]
_MAIL = _UNI + r".+-]+@" + _UNI + r"-]+\." + _UNI + r".]+"
_ONE_LINE = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '<url>', 'g'), '{_MAIL}', '<email>', 'g'), '{_SECRET}', '<token>', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
ORACLE |= {
    "post_redacted": f"WITH {POSTS}, o AS (SELECT room, seq, {_ONE_LINE} AS s, regexp_replace(regexp_replace(text, '{_SECRET}', '<token>', 'g'), '{_MAIL}', '<email>', 'g') AS scrubbed FROM posts) SELECT room, seq, CASE WHEN length(s) > 160 THEN substr(s, 1, 160) || '…' ELSE s END AS excerpt, scrubbed FROM o",
    "role_conflicts": f"""WITH {FLAGGED}, said AS (SELECT room, lower(regexp_extract(text, '(?i){CASELESS["role"].replace("'", "''")}', 1)) AS role_word, who FROM flagged WHERE role_claim UNION SELECT room, 'authorized', who FROM flagged WHERE authorized)
      SELECT room, role_word, string_agg(who, ', ' ORDER BY who) AS who FROM said GROUP BY room, role_word HAVING count(*) >= 2""",
    "modes_regrouped": f"""SELECT room, CASE WHEN mode IN ('R1', 'R2') THEN 'misread' WHEN mode IN ('B1', 'B2') THEN 'disagreement' WHEN mode IN ('D1', 'D2') THEN 'ungrounded' WHEN mode IN ('D3', 'D4') THEN 'stalled' ELSE 'overhead' END AS "group",
      CAST(sum(count) AS BIGINT) AS n FROM ({ORACLE["mode_severities"]}) GROUP BY ALL""",
}

ORACLE |= {
    "board_rooms": f"""WITH {POSTS}, e AS (SELECT room_id AS room, max({{'s': coalesce(goal.sequence, 0), 'm': goal.message_id, 'n': name, 'c': goal.started_at, 'st': state, 'e': ended_by.trigger}}) AS x, max(len(agents)) AS a FROM episodes WHERE goal.message_id IS NOT NULL GROUP BY room_id)
      SELECT room, x.n AS name, x.c AS created_at, latest_sequence, CASE WHEN x.e IS NOT NULL THEN 'closed' ELSE x.st END AS state, CASE WHEN a > 0 THEN 'goal-run' ELSE 'goal-export' END AS source_kind, x.e AS ended_by
      FROM e FULL JOIN (SELECT room, max(seq) AS latest_sequence FROM posts GROUP BY room) USING (room)""",
    "fact_seats": f"""WITH {LINKED}, s AS (SELECT DISTINCT room_id AS room, {seat("a.name")} AS who FROM (SELECT room_id, unnest(agents) AS a FROM episodes)),
      lk AS (SELECT room, posted, max({{'who': who, 'turn': turn, 'i': i}}) AS x FROM linked WHERE posted IS NOT NULL GROUP BY ALL),
      c AS (SELECT room, who, count(DISTINCT turn) AS turns, count_if(kind = 'command') AS commands, count_if(kind = 'command' AND coalesce(exit_code, 0) <> 0) AS failed, count_if(kind = 'command' AND {sql_has("coalesce(command, '')", "test")}) AS tests FROM ops GROUP BY ALL)
      SELECT s.room, s.who, coalesce(p.n, 0) AS posts, coalesce(l.n, 0) AS linked_posts, coalesce(turns, 0) AS turns, coalesce(commands, 0) AS commands, coalesce(failed, 0) AS failed_commands, coalesce(tests, 0) AS test_runs, coalesce(f.n, 0) AS n_files_changed
      FROM s LEFT JOIN (SELECT room, who, count(*) AS n FROM posts WHERE role = 'agent' GROUP BY ALL) p USING (room, who) LEFT JOIN (SELECT room, x.who AS who, count(*) AS n FROM lk GROUP BY ALL) l USING (room, who)
      LEFT JOIN c USING (room, who) LEFT JOIN (SELECT room, who, count(*) AS n FROM ({ORACLE["files_changed"]}) GROUP BY ALL) f USING (room, who) WHERE s.who IS NOT NULL""",
}
