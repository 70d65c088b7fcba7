"""SQL for the evidence and metrics of the modes, the facts and the files of posts; and the log of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.patterns import CASED, CASELESS
from colloquy.operators import facts, modes
from colloquy.plans.board_queries import _ANSWERED, _ITEM, _ONE_LINE, FLAGGED, LINKED, _flagged, _modes
from colloquy.plans.board_queries import ORACLE as BOARD
from colloquy.plans.sql import POSTS, has, has_board

METRICS = [
    "posts", "seats", "principals", "span_hours", "asks", "asks_unanswered", "wait_signals", "claims", "claim_posts", "re_claims", "self_contradicting_re_claims", "done_claims", "reviews", "action_claims",
    "action_claims_unverifiable", "duplicate_posts", "heartbeat_posts", "heartbeat_share", "open_items_at_end", "last_post_kind", *(f"{x}_{b}" for b in modes.BUCKETS for x in ("claims", "re_claims")),
]

QUERIES = {
    "mode_metrics": _modes(lambda m: m.metrics().select("room", *METRICS)),
    "item_log": _flagged(lambda f: modes.item_log(modes.item_events(f))),
    "item_places": _flagged(lambda f: modes.item_states(modes.item_events(f)).select("room", "item", F.col("first_place.seq").alias("first_seq"), F.col("first_claim.seq").alias("claim_seq"), F.col("first_claim.who").alias("claim_who"), "firm_claims")),
}


def redact(text: str, n: int = 160) -> str:
    s = _ONE_LINE.replace("(text, 'https", f"(coalesce({text}, ''), 'https")
    return f"CASE WHEN length({s}) > {n} THEN substr({s}, 1, {n}) || '…' ELSE {s} END"


_PLACED = FLAGGED + f""", itp AS (SELECT room, seq, who, text, item, min(pos) AS pos, accept AS claims, done, hedge, review, upload OR pay OR push AS delivers FROM (
    SELECT f.*, lower(trim(replace(u.x, '`', ''))) AS item, u.pos FROM flagged f, UNNEST(regexp_extract_all(text, '(?i){_ITEM}')) WITH ORDINALITY AS u(x, pos)) WHERE length(item) >= 2 GROUP BY ALL),
  st AS (SELECT room, item, min({{'s': seq, 'p': pos}}) AS place, count_if(claims) AS claims, count_if(done) AS dones, count_if(review) AS reviews, count_if(claims AND NOT hedge) AS firm, min({{'s': seq, 'w': who}}) FILTER (claims) AS first_claim FROM itp GROUP BY ALL),
  ends AS (SELECT room, max(seq) AS last, arg_max(text, seq) AS t, count(*) AS n, first(at_ms ORDER BY seq) AS a, last(at_ms ORDER BY seq) AS b FROM flagged GROUP BY room),
  prior AS (SELECT c.room, c.item, c.seq, c.who, c.text, c.pos, max(d.seq) FILTER (d.who <> c.who) AS other_seq, arg_max(d.who, d.seq) FILTER (d.who <> c.who) AS other_who, max(d.seq) AS any_seq
    FROM itp c JOIN itp d ON d.room = c.room AND d.item = c.item AND d.seq < c.seq AND d.done WHERE c.claims GROUP BY ALL),
  {_ANSWERED},
  una AS (SELECT f.room, f.seq, f.who, f.text, row_number() OVER (PARTITION BY f.room ORDER BY f.seq) AS k FROM flagged f JOIN ends USING (room) WHERE ask AND f.seq < last - 2 AND NOT EXISTS (SELECT 1 FROM answered a WHERE a.room = f.room AND a.seq = f.seq)),
  dup AS ({BOARD["near_duplicates"]}),
  kinds AS (SELECT room, last, t, n, a, b, CASE WHEN {has("t", "pause")} THEN 'pause' WHEN {has("t", "ask")} THEN 'ask' WHEN {has("t", "heartbeat")} THEN 'heartbeat' WHEN {has("t", "done")} THEN 'done' ELSE 'other' END AS lk FROM ends),
  open AS (SELECT room, count_if(firm > 0 AND dones = 0) AS n_open FROM st GROUP BY room),
  waits AS (SELECT room, count_if(wait) AS n_wait FROM flagged GROUP BY room)
"""

_ROLE = CASELESS["role"].replace("'", "''")
_EVIDENCE = f"""WITH {_PLACED},
  roles AS (SELECT room, role_word, string_agg(who, ', ' ORDER BY who) AS who, min(seq) AS s, count(*) AS n FROM (SELECT room, role_word, who, min(seq) AS seq FROM (
      SELECT room, lower(regexp_extract(text, '(?i){_ROLE}', 1)) AS role_word, who, seq FROM flagged WHERE role_claim UNION ALL SELECT room, 'authorized', who, seq FROM flagged WHERE authorized) GROUP BY ALL) GROUP BY room, role_word),
  nothing AS ({BOARD["reviews_of_nothing"]}),
  rows AS (
    SELECT room, 'R1' AS mode, 0 AS g, seq AS p0, pos AS p1, seq, who, text, CASE WHEN other_seq IS NULL THEN 're-claims ''' || item || ''' that it reported done itself at #' || any_seq ELSE 'claims ''' || item || ''', reported done by ' || other_who || ' at #' || other_seq END AS why FROM prior
    UNION ALL SELECT room, 'B1', 0, seq, 0, seq, who, text, 'no later post replies to or cites this ask' FROM una WHERE k <= 40
    UNION ALL SELECT room, 'B1', 1, place.s, place.p, first_claim.s, first_claim.w, 'hedged claim on ''' || item || '''', 'never firmed up or delivered' FROM st WHERE claims > 0 AND firm = 0 AND dones = 0
    UNION ALL SELECT room, 'B2', 0, seq, 0, seq, who, text, 'identity or seat ambiguity being negotiated on the board' FROM flagged WHERE identity
    UNION ALL SELECT room, 'B2', 1, s, CASE WHEN role_word = 'authorized' THEN 1 ELSE 0 END, 0, who, '', 'two or more seats claim the role ''' || role_word || '''' FROM roles WHERE n >= 2
    UNION ALL SELECT room, 'D1', 0, seq, 0, seq, who, text, 'action claimed; this source has no artifact rows to check it against' FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY seq) AS k FROM flagged WHERE upload OR pay OR push) WHERE k <= 10
    UNION ALL SELECT n.room, 'D2', 0, n.seq, 0, n.seq, n.who, f.text, n.why FROM nothing n JOIN flagged f USING (room, seq)
    UNION ALL SELECT room, 'D3', 0, last, 0, last, '', t, 'ends with a ' || lk || '; ' || coalesce(n_open, 0) || ' claimed item(s) never reported done; ' || n_wait || ' waiting/blocked signals' FROM kinds LEFT JOIN open USING (room) JOIN waits USING (room)
      WHERE coalesce(n_open, 0) > 0 OR lk IN ('ask', 'heartbeat', 'pause') OR n_wait >= greatest(3, n // 20)
    UNION ALL SELECT room, 'D4', 0, seq, 0, seq, who, text, 'asks the holder to act instead of taking the item over' FROM flagged WHERE ask AND proxy
    UNION ALL SELECT d.room, 'REP', 0, d.seq, 0, d.seq, d.who, f.text, 'near-duplicate of #' || of_seq || ' by ' || of_who FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY seq) AS k FROM dup) d JOIN flagged f USING (room, seq) WHERE k <= 40)
  SELECT room, mode, CAST(seq AS BIGINT) AS seq, who, {redact("text")} AS excerpt, why, CAST(k AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY room, mode ORDER BY g, p0, p1, who, why) AS k FROM rows) WHERE k <= 25"""

_bucket = "CASE WHEN {0} <= 20 THEN '1-20' WHEN {0} <= 40 THEN '21-40' WHEN {0} <= 60 THEN '41-60' ELSE '61+' END"
_BY = ", ".join(f"""coalesce(c."c{b}", 0) AS "claims_{b}", coalesce(p."c{b}", 0) AS "re_claims_{b}" """ for b in modes.BUCKETS)
_COUNTS = ", ".join(f"""count_if({_bucket.format("seq")} = '{b}') AS "c{b}" """ for b in modes.BUCKETS)
ORACLE = {
    "mode_evidence": _EVIDENCE,
    "item_log": f"""WITH {_PLACED} SELECT room, item, 'claims' AS log, seq, who, NOT hedge AS firm FROM itp WHERE claims UNION ALL SELECT room, item, 'done', seq, who, NULL FROM itp WHERE done
      UNION ALL SELECT room, item, 'reviews', seq, who, NULL FROM itp WHERE review UNION ALL SELECT room, item, 'uploads', seq, who, NULL FROM itp WHERE delivers""",
    "item_places": f"WITH {_PLACED} SELECT room, item, place.s AS first_seq, first_claim.s AS claim_seq, first_claim.w AS claim_who, firm AS firm_claims FROM st WHERE claims > 0 OR dones > 0 OR reviews > 0",
    "mode_metrics": f"""WITH {_PLACED},
      pr AS (SELECT room_id AS room, member_id, arg_min(sender_principal_id, sequence) AS principal FROM (SELECT *, coalesce(sender_instance_id, sender.member_id) AS member_id FROM one) WHERE sender_principal_id IS NOT NULL GROUP BY ALL),
      se AS ({BOARD["board_seats"]}),
      sc AS (SELECT se.room, count(*) AS seats, nullif(count(DISTINCT pr.principal), 0) AS principals FROM se LEFT JOIN pr USING (room, member_id) GROUP BY se.room),
      c AS (SELECT room, count(*) AS n, {_COUNTS} FROM itp WHERE claims GROUP BY room), p AS (SELECT room, count(*) AS n, count_if(other_seq IS NULL) AS own, {_COUNTS} FROM prior GROUP BY room),
      m AS (SELECT room, count_if(ask) AS asks, count_if(wait) AS waits, count_if(review) AS reviews, count_if(heartbeat) AS hb, count_if(upload OR pay OR push) AS acts FROM flagged GROUP BY room),
      posts_of AS (SELECT room, count(DISTINCT seq) FILTER (claims) AS claim_posts, count(DISTINCT seq) FILTER (done) AS done_claims FROM itp GROUP BY room)
      SELECT k.room, k.n AS posts, coalesce(sc.seats, 0) AS seats, sc.principals, CASE WHEN k.n > 1 THEN round_even((k.b - k.a) / 3600000, 1) END AS span_hours, asks, coalesce(u.n, 0) AS asks_unanswered, waits AS wait_signals,
        coalesce(c.n, 0) AS claims, coalesce(claim_posts, 0) AS claim_posts, coalesce(p.n, 0) AS re_claims, coalesce(p.own, 0) AS self_contradicting_re_claims, coalesce(done_claims, 0) AS done_claims, reviews, acts AS action_claims, acts AS action_claims_unverifiable,
        coalesce(d.n, 0) AS duplicate_posts, hb AS heartbeat_posts, round_even(hb / k.n, 3) AS heartbeat_share, coalesce(n_open, 0) AS open_items_at_end, lk AS last_post_kind, {_BY}
      FROM kinds k JOIN m USING (room) LEFT JOIN sc USING (room) LEFT JOIN (SELECT room, count(*) AS n FROM una GROUP BY room) u USING (room) LEFT JOIN c USING (room) LEFT JOIN p USING (room) LEFT JOIN posts_of USING (room)
      LEFT JOIN (SELECT room, count(*) AS n FROM dup GROUP BY room) d USING (room) LEFT JOIN open USING (room)""",
}

# ---- files, success claims and facts

_EXT = CASED["file"].split(r"\.(?:")[1].split(")")[0]
# quoted names first; the rest is cut into words, of which the longest beginning that ends with a known suffix counts
_W = r"[^\p{L}\p{M}\p{N}_./-]+"
FILES = rf"""tok AS (SELECT room, seq, who, unnest(list_concat(list_transform(regexp_extract_all(text, '`[^`\s]{{2,80}}`'), lambda x: trim(x, '`')),
    list_transform(regexp_split_to_array(regexp_replace(text, '`[^`\s]{{2,80}}`', ' ', 'g'), '{_W}'), lambda x: regexp_extract(x, '^([A-Za-z0-9_./-]+\.(?:{_EXT}))(?:[./-].*)?$', 1)))) AS f FROM posts),
  files AS (SELECT DISTINCT room, seq, who, regexp_extract(g, '([^/]*)$', 1) AS file FROM (SELECT *, rtrim(trim(f), '.,;:') AS g FROM tok) WHERE contains(g, '.') AND NOT regexp_matches(g, '^(http|#|-)') AND NOT regexp_full_match(g, 'v?\d+(\.\d+)+'))"""


def _before(pattern: str, flags: str) -> str:
    """Of each match, it and what stands before it."""
    p = pattern.replace("'", "''")
    return f"""(SELECT room, seq, u.m AS m, array_to_string(list_concat(list_transform(range(1, u.k), lambda i: pieces[i] || found[i]), [pieces[u.k]]), '') AS before
      FROM (SELECT room, seq, regexp_split_to_array(text, '{flags}{p}') AS pieces, regexp_extract_all(text, '{flags}{p}') AS found FROM posts WHERE role = 'agent'), UNNEST(found) WITH ORDINALITY AS u(m, k))"""


_MARK = r"(?:^|[^A-Za-z])(?:DONE|FINAL)\b"
_neg, _cond = CASELESS["negated"].replace("'", "''"), CASELESS["condition"].replace("'", "''")
SUCCESS = f"""said AS (SELECT room, seq, m, before FROM {_before(CASELESS["success"], "(?i)")} UNION ALL SELECT room, seq, 'x', before || regexp_extract(m, '^[^A-Za-z]?') FROM {_before(_MARK, "")}),
  succ AS (SELECT DISTINCT room, seq FROM said WHERE NOT regexp_matches(right(before, 24), '(?i){_neg}') AND NOT regexp_matches(right(before, 48), '(?i){_cond}') AND NOT regexp_matches(m, '(?i)\\bnot\\b'))"""

def _runs(command: str) -> str:
    """Whether a command runs a program: what the pattern's look-aheads rule out is taken away first."""
    p = CASED["run"].replace(r"(?!-m\s+pip)", "").replace(r"(?!sn\b)", "").replace("'", "''")
    return rf"regexp_matches(regexp_replace({command}, '\b(?:python3?|node|ruby|bash|sh)\s+-m\s+pip|\./sn\b', '', 'g'), '{p}')"


_cmd = "coalesce(command, '')"
_WORK = f"(kind = 'command' AND NOT {has_board(_cmd, 'board_talk')})"
_LINKS = "lk AS (SELECT room, posted AS seq, max({'who': who, 'turn': turn, 'i': i}) AS x FROM linked WHERE posted IS NOT NULL GROUP BY ALL)"
_FACTS = f"""WITH {LINKED}, {FILES}, {SUCCESS}, {_LINKS}, ag AS (SELECT p.*, {has("text", "fact_claim")} AS claims, {has("text", "fact_review")} AND NOT {has("text", "future_review")} AS reviews, {has("text", "handover")} AS gives, (room, seq) IN (SELECT (room, seq) FROM succ) AS success
    FROM posts p WHERE role = 'agent' AND room IN (SELECT room FROM ops)),
  cl AS (SELECT a.room, a.seq, a.who, a.text, a.reply_to, f.file FROM ag a JOIN files f USING (room, seq) WHERE claims),
  fi AS (SELECT room, file, min({{'seq': seq, 'who': who}}) AS f FROM cl GROUP BY ALL),
  ops2 AS (SELECT *, {_WORK} AS work FROM linked),
  did AS (SELECT room, who, command FROM ops2 WHERE kind = 'command' AND NOT {has_board(_cmd, 'board_command')} AND {has(_cmd, "write")}),
  fc AS ({BOARD["files_changed"]}),
  b AS (SELECT a.room, a.seq, a.text, a.success, a.reviews, lk.x AS x, coalesce(bool_or(o.kind = 'file_change' OR (o.work AND coalesce(o.exit_code = 0, false))), false) AS looks, coalesce(bool_or(o.work AND ({has("coalesce(o.command, '')", "test")} OR {_runs("coalesce(o.command, '')")})), false) AS runs,
      max({{'t': o.turn, 'i': o.i, 'code': coalesce(o.exit_code, 0), 'command': coalesce(o.command, '')}}) FILTER (o.work) AS w
    FROM ag a JOIN lk USING (room, seq) LEFT JOIN ops2 o ON o.room = a.room AND o.who = lk.x.who AND (o.turn < lk.x.turn OR (o.turn = lk.x.turn AND o.i < lk.x.i)) GROUP BY ALL),
  msg AS (SELECT room, who, turn, arg_max(text, i) AS said FROM (SELECT o.room, o.who, o.turn, o.i, m.text FROM ops o JOIN texts m USING (room, who, turn, i)) WHERE {has("text", "failure")} GROUP BY ALL),
  rows AS (
    SELECT c.room, 'overlapping_claim' AS fact, c.seq, c.who, c.text, 'claims ' || c.file || ', which ' || f.who || ' claimed at #' || f.seq || '; no hand-over in between' AS why FROM cl c JOIN fi USING (room, file)
      WHERE c.seq > f.seq AND c.who <> f.who AND NOT coalesce(c.reply_to = f.seq, false) AND NOT EXISTS (SELECT 1 FROM ag g WHERE g.room = c.room AND g.who = fi.f.who AND g.gives AND g.seq > fi.f.seq AND g.seq < c.seq)
    UNION ALL SELECT c.room, 'claim_without_action', c.seq, c.who, c.text, 'claims ' || c.file || '; this seat''s log shows no change to it in the whole run' FROM cl c WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.room = c.room AND fc.who = c.who AND fc.file = c.file)
      AND NOT EXISTS (SELECT 1 FROM did d WHERE d.room = c.room AND d.who = c.who AND contains(d.command, c.file))
    UNION ALL SELECT b.room, 'review_without_reading', b.seq, a.who, b.text, 'reviews before this seat opened, ran or changed any file' || CASE WHEN w IS NOT NULL THEN '; its last attempt, `' || {redact("w.command", 80)} || '`, exited ' || w.code ELSE '' END FROM b JOIN ag a USING (room, seq) WHERE b.reviews AND NOT looks
    UNION ALL SELECT b.room, 'success_without_run', b.seq, a.who, b.text, 'claims success; this seat had run no test and no program before it' FROM b JOIN ag a USING (room, seq) WHERE b.success AND NOT runs
    UNION ALL SELECT b.room, 'success_after_failure', b.seq, a.who, b.text, 'claims success right after its last work command, `' || {redact("w.command", 80)} || '`, exited ' || w.code FROM b JOIN ag a USING (room, seq) WHERE b.success AND w.code <> 0
    UNION ALL SELECT b.room, 'private_contradiction', b.seq, a.who, b.text, 'claims success; in the same turn its own final text says: ' || {redact("m.said", 120)} FROM b JOIN ag a USING (room, seq) JOIN msg m ON m.room = b.room AND m.who = b.x.who AND m.turn = b.x.turn WHERE b.success
    UNION ALL SELECT a.room, 'check_failed_after_done', a.seq, a.who, a.text, 'the check `' || {redact("c.command", 60)} || '` run because of this claim exited ' || coalesce(CAST(c.exit_code AS VARCHAR), '?') || ': ' || {redact("c.output", 100)}
      FROM ag a JOIN (SELECT DISTINCT * FROM checks) c ON c.room_id = a.room AND c.sequence = a.seq WHERE c.cause = 'claim' AND c.passed = false)
"""
_TEXTS = """texts AS (SELECT op.room, op.who, op.turn, op.i, m.text FROM (SELECT room, who, turn, line_no, line_id, event_pos, content_pos, CAST(row_number() OVER (PARTITION BY room, who, turn ORDER BY line_no, line_id, event_pos, content_pos) - 1 AS INT) AS i FROM op1) op
    JOIN (SELECT line_id, event_pos, 0 AS content_pos, json_extract_string(item, '$.text') AS text FROM it WHERE event_type = 'item.completed' AND json_extract_string(item, '$.type') = 'agent_message'
      UNION ALL SELECT line_id, event_pos, content_pos, json_extract_string(c, '$.text') FROM con WHERE event_type = 'assistant' AND json_extract_string(c, '$.type') = 'text') m USING (line_id, event_pos, content_pos))"""
_FACTS = _FACTS.replace("  msg AS (", f"  {_TEXTS},\n  msg AS (")
_pattern = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in facts.FACTS.items()) + "}[fact]"
_ROWS = _FACTS + f" SELECT r.room, fact, {_pattern} AS pattern, r.seq, r.who, lk.x.turn AS turn, lk.x.i AS op, {redact('r.text')} AS excerpt, why FROM rows r LEFT JOIN lk USING (room, seq)"
ORACLE |= {
    "post_files": f"WITH {POSTS}, {FILES} SELECT room, seq, file FROM files",
    "success_claims": f"WITH {POSTS}, {SUCCESS} SELECT room, seq, who FROM posts JOIN succ USING (room, seq) WHERE role = 'agent'",
    "fact_findings": _ROWS,
    "fact_counts": f"SELECT r.room, k.fact, k.pattern, CAST(count(f.fact) AS BIGINT) AS n FROM (WITH {POSTS} SELECT DISTINCT room FROM posts) r CROSS JOIN (SELECT unnest({list(facts.FACTS)}) AS fact, unnest({list(facts.FACTS.values())}) AS pattern) k LEFT JOIN ({_ROWS}) f ON f.room = r.room AND f.fact = k.fact GROUP BY ALL",
}
_GROUP = "map {'R1': 'claim', 'D1': 'report_and_verify', 'D2': 'report_and_verify', 'claim_without_action': 'progress_and_close'}[pattern]"
ORACLE["regrouped_facts"] = f'SELECT room, {_GROUP} AS "group", CAST(count(*) AS BIGINT) AS n FROM ({_ROWS}) GROUP BY ALL'
