"""Streams over the post table, run to their end; the SQL is that of the same batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.plans.board_queries import _ITEM
from colloquy.plans.sql import has, ms, seat
from colloquy.streaming import board_stream as S

_ms = lambda c: F.unix_millis(c).alias(f"{c}_ms")

QUERIES = {
    "stream_sessions": lambda spark, d: S.run_available(S.sessions(S.timed(S.read_posts(spark, d)))).select("room", "who", _ms("first"), _ms("closed"), "posts"),
    "stream_hourly_acts": lambda spark, d: S.run_available(S.hourly_acts(S.timed(S.read_posts(spark, d)))).select("room", _ms("hour"), "posts", "ask", "accept", "done", "heartbeat"),
    "stream_reclaims": lambda spark, d: S.run_available(S.reclaims(S.timed(S.read_posts(spark, d)))),
}

_TIMED = f"""timed AS (SELECT room_id AS room, id, min(sequence) AS seq, max({seat("sender.name")}) AS who, any_value(coalesce(content, '')) AS text, max({ms("created_at")}) AS t FROM room WHERE id IS NOT NULL AND {ms("created_at")} IS NOT NULL GROUP BY ALL)"""
ORACLE = {
    "stream_sessions": f"""WITH {_TIMED}, s AS (SELECT *, sum(CASE WHEN t - before < 1800000 THEN 0 ELSE 1 END) OVER (PARTITION BY room, who ORDER BY t, id) AS k FROM (SELECT *, lag(t) OVER (PARTITION BY room, who ORDER BY t, id) AS before FROM timed WHERE who IS NOT NULL))
      SELECT room, who, min(t) AS first_ms, max(t) + 1800000 AS closed_ms, count(*) AS posts FROM s GROUP BY room, who, k""",
    "stream_hourly_acts": f"WITH {_TIMED} SELECT room, t - t % 3600000 AS hour_ms, count(*) AS posts, {', '.join(f'count_if({has("text", a)}) AS {a}' for a in ('ask', 'accept', 'done', 'heartbeat'))} FROM timed GROUP BY ALL",
    "stream_reclaims": f"""WITH {_TIMED}, it AS (SELECT DISTINCT room, seq, coalesce(who, '?') AS who, item, claims, done FROM (SELECT *, {has("text", "accept")} AS claims, {has("text", "done")} AS done, lower(trim(replace(unnest(regexp_extract_all(text, '(?i){_ITEM}')), '`', ''))) AS item FROM timed) WHERE length(item) >= 2)
      SELECT c.room, c.item, c.seq, c.who, arg_max(d.who, d.seq) AS done_by, max(d.seq) AS done_seq FROM it c JOIN it d ON d.room = c.room AND d.item = c.item AND d.seq < c.seq AND d.done WHERE c.claims GROUP BY ALL""",
}
