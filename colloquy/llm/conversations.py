"""Problem 5: conversations rebuilt from message rows by pointer jumping over parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.pointers import jump
from colloquy.operators.ordered import position
from colloquy.session import cut
from colloquy.sources.tables import is_blank, posts


def links(room: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each post (with the columns in ``keep``) with ``parent`` (by a good link), ``is_root`` (no reference) and ``broken`` (a reference that isn't good).

    A reference by id counts before one by number. A reference by number is looked up on the post's own board.
    Null content or sender are kept as they are; repeated deliveries are one post.
    """
    # written once: it is read for both kinds of reference, for the nodes and for the result
    room = room.select("*", is_blank(F.col("content")).alias("_blank"), F.col("sender.kind").alias("_kind"))
    need = ["room_id", "sequence", "reply_to_message_id", "reply_to_sequence", "_blank", "_kind"]
    p = cut(posts(room, [*need, *keep]).select("id", "room_id", "sequence", "seat", "at_ms", *keep, F.col("_kind").alias("sender_kind"), F.col("_blank").alias("blank"), "reply_to_message_id", "reply_to_sequence"))
    known = p.select(F.col("id").alias("t_id"), F.col("room_id").alias("t_room"), F.col("sequence").alias("t_seq"))
    by_id = p.where("reply_to_message_id is not null").join(known, F.col("reply_to_message_id") == F.col("t_id"))
    by_no = p.where("reply_to_message_id is null and reply_to_sequence is not null").join(known, (F.col("room_id") == F.col("t_room")) & (F.col("reply_to_sequence") == F.col("t_seq")))
    good = by_id.unionByName(by_no).where((F.col("t_room") == F.col("room_id")) & (F.col("t_seq") < F.col("sequence"))).select(F.col("id").alias("_id"), F.col("t_id").alias("parent"))
    out = p.join(good, F.col("id") == F.col("_id"), "left").drop("_id")
    is_root = F.col("reply_to_message_id").isNull() & F.col("reply_to_sequence").isNull()
    return out.withColumn("is_root", is_root).withColumn("broken", ~is_root & F.col("parent").isNull())


def conversations(room: DataFrame, keep: tuple[str, ...] = ("content",)) -> DataFrame:
    """``root_message_id, position, message_id, role, room_id, seat, at_ms`` and the columns in ``keep`` of every kept conversation.

    Dropped are conversations with a blank root, with fewer than two speakers among their posts that aren't blank, and posts
    whose chain meets a broken link (missing parent, other board, not smaller sequence; so no cycle can pass). A post
    whose speaker is unknown counts for no speaker. ``role`` is ``author`` for the root's speaker, ``runner`` for a
    runner's notice, else ``participant``.
    """
    p = cut(links(room, keep))
    # a root without children is a conversation of one speaker: only roots that are somebody's parent matter
    parents = p.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    nodes = p.where("parent is not null or is_root or broken").select("id", F.col("parent").alias("_p"), "is_root", "broken")
    nodes = nodes.join(parents.withColumn("_has", F.lit(True)), "id", "left").where("_p is not null or _has")
    # a broken node points to nobody that exists, so its chain ends in null
    ends = jump(nodes.select("id", F.when(F.col("broken"), F.concat(F.lit("?"), F.col("id"))).otherwise(F.col("_p")).alias("ptr")))
    member = ends.where("end is not null").select("id", F.col("end").alias("root_message_id")).join(p, "id")
    facts = member.groupBy("root_message_id").agg(
        F.bool_or((F.col("id") == F.col("root_message_id")) & ~F.col("blank")).alias("root_ok"),
        F.min(F.when(~F.col("blank"), F.col("seat"))).alias("s1"),
        F.max(F.when(~F.col("blank"), F.col("seat"))).alias("s2"),
        F.max(F.when(F.col("id") == F.col("root_message_id"), F.col("seat"))).alias("author"),
    )
    kept = member.where(~F.col("blank")).join(facts.where("root_ok and s1 <> s2"), "root_message_id")
    placed = position(kept, ["root_message_id"], "sequence")
    role = F.when(F.col("sender_kind") == "runner", "runner").when(F.col("seat") == F.col("author"), "author").otherwise("participant")
    return placed.select("root_message_id", "position", F.col("id").alias("message_id"), role.alias("role"), "room_id", "seat", "at_ms", *keep)
