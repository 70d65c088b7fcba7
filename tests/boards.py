"""Boards made for the tests."""

from pyspark.sql import functions as F

from colloquy.operators import board as B
from colloquy.sources.files import CHECK, EPISODE, MESSAGE, WAKE

ROOM = MESSAGE + ", received_at timestamp"
LINES = "line_id bigint, room_id string, seat string, turn bigint, line_no bigint, line string"
WAKES = "room_id string, " + WAKE.replace("`from`", "from_sequence").replace("through ", "through_sequence ")


def message(seq, who, text, reply=None, room="r1", mid=None, kind="guest", at=None, type_="message", reply_id=None, received=None):
    at = at or f"2026-05-01T10:{seq:02d}:00Z"
    return (mid or f"{room}-m{seq}", room, seq, None, f"i-{who}", text, reply_id, reply, at, type_, (f"i-{who}", who, kind), received)


def posts(spark, *rows, room="r1"):
    """Posts of agents: (seq, who, text[, reply_to])."""
    full = [(room, r[0], f"{room}-{r[0]}", r[1], r[2], f"2026-05-01T10:{r[0] % 60:02d}:00Z", 1777629600000 + r[0] * 60000, r[3] if len(r) > 3 else None, "message", "agent") for r in rows]
    return spark.createDataFrame(full, B.EMPTY["posts"])


def board(spark, rows, ops=(), checks=(), seats=(), artifacts=(), kind="goal-run"):
    p = rows if not isinstance(rows, list) else posts(spark, *rows)
    rooms = p.groupBy("room").agg(F.max("seq").alias("latest_sequence")).withColumn("source_kind", F.lit(kind))
    make = lambda name, data: spark.createDataFrame(list(data), B.EMPTY[name])
    return B.Board(B.shaped(rooms, "rooms"), make("seats", seats), p, make("artifacts", artifacts), make("ops", ops), make("checks", checks), B.empty(spark, "wakes"))


def op(who, turn, i, kind, command=None, code=None, posted=None, paths=None, text=None, output=None, room="r1"):
    return (room, who, turn, i, kind, command, code, output, posted, paths, None, None, text, None)


def relations(spark, room=(), episodes=(), lines=(), checks=(), wakes=()):
    c = lambda data, ddl: spark.createDataFrame(list(data), ddl)
    return c(room, ROOM), c(episodes, EPISODE), c(lines, LINES), c(checks, "room_id string, " + CHECK), c(wakes, WAKES)
