"""The registered queries of this subpackage."""

from __future__ import annotations

from colloquy.llm import consensus, conversations, leaks, nearest, packing, personal, runs, sentences
from colloquy.plans.sql import POSTS, WAKES
from colloquy.sources.tables import table


def _t(name, f):
    return lambda spark, d: f(table(spark, d, name))


QUERIES = {
    "p2_found": lambda spark, d: nearest.nearest_turns(table(spark, d, "room"), table(spark, d, "wakes")).select("message_id", "room_id", "seat", "turn"),
    "p2_nearest": lambda spark, d: nearest.nearest_turns(table(spark, d, "room"), table(spark, d, "wakes")),
    "p3_found": lambda spark, d: personal.found(table(spark, d, "room"), table(spark, d, "turn_lines")),
    "p3_redacted": lambda spark, d: personal.redacted(table(spark, d, "room"), table(spark, d, "turn_lines")),
    "p4_found": _t("incidents", consensus.found),
    "p4_agreement": _t("incidents", consensus.agreement),
    "p4_reliability": _t("incidents", consensus.reliability),
    "p5_found": _t("room", lambda r: conversations.conversations(r, ()).select("root_message_id", "position", "message_id")),
    "p5_conversations": _t("room", conversations.conversations),
    "p7_containers": _t("documents", packing.containers),
    "p7_summary": _t("documents", packing.summary),
    "p8_found": lambda spark, d: leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p8_leaks": lambda spark, d: leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p9_found": _t("documents", lambda x: sentences.split(x).select("doc_id", "sent_start", "sent_end")),
    "p9_sentences": _t("documents", sentences.split),
    "p6_found": _t("room", lambda r: runs.runs(r).select("room_id", "first_sequence", "last_sequence", "n_posts")),
    "p6_runs": _t("room", runs.runs),
}

_BLANK = r"regexp_full_match({0}, '[\s\p{{Z}}\p{{Cf}}\p{{Cc}}\x{{115F}}\x{{1160}}\x{{3164}}\x{{FFA0}}\x{{2800}}\x{{034F}}\x{{FE00}}-\x{{FE0F}}]*')"
_CONTENT_BLANK = f"(content IS NULL OR {_BLANK.format('content')})"

ORACLE = {
    "p2_found": f"""WITH {POSTS}, {WAKES}, d AS (SELECT s.id, s.room_id, s.seat, t.turn, CASE WHEN s.at_ms BETWEEN t.start_ms AND coalesce(t.end_ms, t.start_ms) THEN 0 ELSE least(abs(s.at_ms - t.start_ms), abs(s.at_ms - coalesce(t.end_ms, t.start_ms))) END AS dist
      FROM seated s JOIN turns t ON t.room = s.room_id AND t.who = s.seat WHERE s.at_ms IS NOT NULL AND t.start_ms IS NOT NULL)
      SELECT id AS message_id, room_id, seat, arg_min(turn, {{'d': dist, 't': turn}}) AS turn FROM d WHERE dist <= 120000 GROUP BY id, room_id, seat""",
    "p5_found": f"""WITH RECURSIVE {POSTS}, link AS (
        SELECT s.id, s.sequence, s.seat, s.content, s.reply_to_message_id IS NULL AND s.reply_to_sequence IS NULL AS is_root, t.id AS parent
        FROM seated s LEFT JOIN one t ON t.room_id = s.room_id AND t.sequence < s.sequence AND (t.id = s.reply_to_message_id OR (s.reply_to_message_id IS NULL AND t.sequence = s.reply_to_sequence))),
      tree AS (SELECT id, id AS root FROM link WHERE is_root UNION ALL SELECT l.id, tree.root FROM link l JOIN tree ON l.parent = tree.id),
      member AS (SELECT tree.root, link.* FROM tree JOIN link USING (id)),
      good AS (SELECT root FROM member GROUP BY root HAVING bool_or(id = root AND NOT {_CONTENT_BLANK}) AND count(DISTINCT seat) FILTER (NOT {_CONTENT_BLANK}) > 1)
      SELECT root AS root_message_id, row_number() OVER (PARTITION BY root ORDER BY sequence) AS position, id AS message_id FROM member WHERE NOT {_CONTENT_BLANK} AND root IN (SELECT root FROM good)""",
}
ORACLE["p2_nearest"] = ORACLE["p2_found"].replace("AS turn FROM d", "AS turn, min(dist) AS distance_ms FROM d")
_KEPT = ORACLE["p5_found"]
ORACLE["p5_conversations"] = _KEPT[: _KEPT.rindex("SELECT root AS root_message_id")].replace("s.id, s.sequence, s.seat, s.content,", "s.id, s.sequence, s.seat, s.content, s.room_id, s.at_ms, s.sender.kind AS sender_kind,") + f"""SELECT root AS root_message_id, row_number() OVER (PARTITION BY root ORDER BY sequence) AS position, id AS message_id,
      CASE WHEN sender_kind = 'runner' THEN 'runner' WHEN seat = (SELECT max(a.seat) FROM member a WHERE a.root = m.root AND a.id = a.root) THEN 'author' ELSE 'participant' END AS role, room_id, seat, at_ms, content FROM member m WHERE NOT {_CONTENT_BLANK} AND root IN (SELECT root FROM good)"""
