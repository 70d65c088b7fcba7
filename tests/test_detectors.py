import boards

from colloquy.operators import board as B
from colloquy.operators import facts, modes, taxonomy

ROOM = [
    (1, "a", "I'll take `parser.py`"),
    (2, "b", "`parser.py` is done, tests pass"),
    (3, "a", "I'll take `parser.py` now"),
    (4, "b", "I'll take `parser.py` again"),
    (5, "c", "maybe I'll take `lexer.py`?"),
    (6, "c", "LGTM on `other.md`"),
    (7, "a", "could you run the tests for me"),
    (8, "b", "no new messages, still waiting"),
    (9, "c", "who is this? which seat posted"),
    (10, "a", "I am the lead"),
    (11, "b", "I'm the lead"),
    (12, "a", "one two three four five six seven eight nine ten eleven twelve"),
    (13, "b", "one two three four five six seven eight nine ten eleven twelve"),
    (14, "c", "see #5"),
    (15, "a", "pausing here"),
]


def test_ten_modes(spark):
    m = modes.Modes(boards.board(spark, ROOM, kind="share-file"))
    got = {r.mode: r for r in m.modes().collect()}
    assert len(got) == 10 and {k for k, r in got.items() if not r.present} == {"R2"}
    assert got["D1"].severity == "unknown"
    x = m.metrics().first()
    assert (x.posts, x.re_claims, x.self_contradicting_re_claims, x.duplicate_posts, x.last_post_kind) == (15, 2, 1, 1, "pause")
    again = {r.seq: (r.own, r.done_seq, r.other_who) for r in m.parts()["reclaims"].collect()}
    assert again == {3: (False, 2, "b"), 4: (True, 2, None)}
    assert {r.seq for r in m.parts()["unanswered"].collect()} == {7}
    assert [r.seq for r in m.evidence().where("mode = 'REP'").collect()] == [13]


def test_evidence_rows(spark):
    m = modes.Modes(boards.board(spark, ROOM, kind="share-file"))
    n = {r["mode"]: r["count"] for r in m.modes().collect()}
    rows = m.evidence().collect()
    got = {k: [(r.seq, r.who) for r in sorted(rows, key=lambda r: r.n) if r["mode"] == k] for k in n}
    assert all(len(v) == min(n[k], 25) for k, v in got.items() if k != "HB") and got["HB"] == []
    assert got["B1"] == [(7, "a"), (5, "c")] and got["B2"] == [(9, "c"), (0, "a, b")] and got["D3"] == [(15, "")]
    assert next(r.why for r in rows if r["mode"] == "D3") == "ends with a pause; 0 claimed item(s) never reported done; 1 waiting/blocked signals"


def test_caps_and_no_caps(spark):
    rows = [(n, "a", f"uploaded `x{n}.py`, can you check it?") for n in range(1, 61)] + [(61, "b", "fine"), (62, "b", "fine"), (63, "b", "fine")]
    caps = lambda **k: modes.Modes(boards.board(spark, rows), modes.Caps(**k))
    some, all_ = caps(), caps(rows=None, d1=None, rep=None, b1=None)
    count = lambda m: {r["mode"]: r["count"] for r in m.modes().collect()}
    assert (count(some)["D1"], count(some)["B1"]) == (10, 40) and (count(all_)["D1"], count(all_)["B1"]) == (60, 60)
    by = lambda m: {r["mode"]: r.n for r in m.evidence().groupBy("mode").agg(modes.F.count("*").alias("n")).collect()}
    assert (by(some)["D1"], by(some)["B1"]) == (10, 25) and (by(all_)["D1"], by(all_)["B1"]) == (60, 60)
    recorded = boards.board(spark, rows, kind="episode")
    assert {r["mode"]: r["count"] for r in modes.Modes(recorded).modes().collect()}["D1"] == 60
    assert modes.Modes(recorded).evidence().where("mode = 'D1'").count() == 25


def test_item_log(spark):
    got = {(r.item, r.log, r.seq, r.who, r.firm) for r in modes.item_log(modes.item_events(modes.flags(boards.posts(spark, *ROOM[:6])))).collect()}
    assert got == {("parser.py", "claims", 1, "a", True), ("parser.py", "done", 2, "b", None), ("parser.py", "uploads", 2, "b", None), ("parser.py", "claims", 3, "a", True), ("parser.py", "claims", 4, "b", True), ("lexer.py", "claims", 5, "c", False), ("other.md", "reviews", 6, "c", None)}


def test_rare_modes(spark):
    """R2, B2, D2 and D4, of which the tables hold none."""
    seats = [("r1", "b", 1, None, None, None, "2026-05-01T10:01:30Z", "p2", None)]
    rows = [(1, "a", "`x.py` is done"), (2, "b", "I'll take `x.py`"), (3, "c", "LGTM on `y.py`"), (4, "c", "can you run it for me"), (5, "a", "which seat is it"), (6, "a", "i am the lead"), (7, "b", "I'm the lead"), (8, "b", "ok"), (9, "b", "ok")]
    got = {r["mode"]: (r["count"], r.severity) for r in modes.Modes(boards.board(spark, rows, seats=seats)).modes().collect()}
    assert (got["R2"], got["B2"], got["D2"], got["D4"]) == ((1, "high"), (2, "high"), (1, "high"), (1, "high"))


def test_reclaim_names_the_last_other(spark):
    rows = [(1, "b", "`x.py` is done"), (2, "a", "`x.py` is done"), (3, "a", "`x.py` is done"), (4, "a", "I'll take `x.py`")]
    r = modes.Modes(boards.board(spark, rows)).parts()["reclaims"].first()
    assert (r.own, r.done_seq, r.other_who) == (False, 1, "b")


def test_late_joiner(spark):
    seats = [("r1", "a", 0, None, None, None, "2026-05-01T09:00:00Z", "p1", None), ("r1", "b", 1, None, None, None, "2026-05-01T10:03:30Z", "p2", None)]
    rows = [(1, "a", "`x.py` is done"), (4, "b", "I'll take `x.py`")]
    assert [r["mode"] for r in modes.Modes(boards.board(spark, rows, seats=seats)).parts()["reclaims"].collect()] == ["R2"]


def test_near_duplicates_window(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(12))
    rows = [(1, "a", words(0))] + [(n, "a", words(n)) for n in range(2, 81)] + [(81, "b", words(0)), (82, "b", words(1)), (83, "c", "short one")]
    got = [(r.seq, r.of_seq) for r in modes.near_duplicates(modes.flags(boards.posts(spark, *rows))).collect()]
    assert got == [(81, 1)]
    rows = [(1, "a", words(0))] + [(n, "a", words(n)) for n in range(2, 82)] + [(82, "b", words(0))]
    assert modes.near_duplicates(modes.flags(boards.posts(spark, *rows))).count() == 0


def test_modes_of_nothing(spark):
    m = modes.Modes(boards.board(spark, boards.posts(spark)))
    assert m.modes().count() == m.evidence().count() == 0


def test_facts(spark):
    rows = [
        (1, "a", "I'll write `a.py`"),
        (2, "b", "I'll write `a.py`"),
        (3, "b", "LGTM, reviewed it"),
        (4, "a", "`a.py` is done"),
        (5, "b", "all tests pass"),
        (6, "a", "DONE"),
        (7, "a", "take it, all yours"),
        (8, "b", "I'll fix `a.py`"),
    ]
    ops = [
        boards.op("a", 1, 0, "file_change", paths=["src/a.py"]),
        boards.op("a", 1, 1, "command", "pytest -q", 1),
        boards.op("a", 1, 2, "command", "sn say x", 0, posted=4),
        boards.op("a", 1, 3, "message", text="two tests failed"),
        boards.op("b", 1, 0, "command", "sn say y", 0, posted=3),
        boards.op("b", 1, 1, "command", "sn say z", 0, posted=5),
    ]
    checks = [("r1", None, None, "t", "check.sh", "claim", 1, False, 6, "bad")]
    b = boards.board(spark, rows, ops, checks, seats=[("r1", "a", 0, None, None, None, None, None, None)])
    f = facts.findings(b)
    got = {(r.seq, r.fact) for r in f.collect()}
    assert got == {(2, "overlapping_claim"), (2, "claim_without_action"), (3, "review_without_reading"), (4, "success_after_failure"), (4, "private_contradiction"), (5, "success_without_run"), (6, "check_failed_after_done"), (8, "claim_without_action")}
    s = facts.seat_stats(b).first()
    assert (s.posts, s.linked_posts, s.turns, s.commands, s.failed_commands, s.test_runs, s.files_changed) == (4, 1, 1, 2, 1, 1, ["a.py"])
    assert {r.fact: r.n for r in facts.counts(f, b.rooms).collect()}["claim_without_action"] == 2


def test_programs_that_only_sound_like_the_board(spark):
    rows = [(1, "a", "I'll write `a.py`"), (2, "a", "I'll write `b.py`"), (3, "a", "I'll write `.c`"), (4, "a", "all tests pass")]
    ops = [
        boards.op("a", 1, 0, "command", "dotnet build > a.py", 0),
        boards.op("a", 1, 1, "command", "telnet read host; kubenet join", 0),
        boards.op("a", 1, 2, "command", "sn say x > b.py", 0),
        boards.op("a", 1, 3, "command", "cp x.c y", 0, posted=4),
    ]
    b = boards.board(spark, rows, ops)
    assert {(r.seq, r.fact) for r in facts.findings(b).where("fact like 'claim%'").collect()} == {(2, "claim_without_action")}
    assert [r.i for r in b.ops.where(B.is_work(b.ops.kind, b.ops.command, b.programs)).orderBy("i").collect()] == [0, 1, 3]


def test_board_programs_of_the_logs(spark):
    answer = '{\\n \\"message\\": {\\n  \\"id\\": \\"msg_0001\\"}}'
    line = lambda c, out: '{"type":"item.completed","item":{"type":"command_execution","command":"' + c + '","aggregated_output":"' + out + '"}}'
    lines = [(1, "r", "a", 1, 1, line("roomctl say hello", answer)), (2, "r", "a", 1, 2, line("dotnet post build", "ok")), (3, "r", "a", 1, 3, None)]
    df = spark.createDataFrame(lines, boards.LINES)
    assert B.board_programs(df) == ("roomctl", "sn")
    assert B.board_programs(df.limit(0)) == ("sn",)


def test_hand_overs(spark):
    rows = [(1, "a", "all yours"), (2, "a", "I'll write `a.py`"), (3, "b", "I'll write `a.py`"), (4, "a", "take it"), (5, "b", "I'll write `a.py`"), (6, "a", "go ahead"), (7, "c", "I'll write `a.py`")]
    said = facts.speech(boards.posts(spark, *rows))
    assert sorted(r.seq for r in facts.overlapping_claims(said).collect()) == [3]


def test_long_turns_keep_their_order(spark):
    ops = [boards.op("a", 1, 0, "command", "pytest", 1), boards.op("a", 1, 2_000_000, "command", "pytest -x", 0), boards.op("a", 2, 0, "command", "sn say x", 0, posted=1)]
    b = boards.board(spark, [(1, "a", "all tests pass")], ops)
    got = facts.before_posts(b.ops, B.post_ops(b.ops), b.programs).first()
    assert (got.looks, got.runs, got.last_command) == (True, True, "pytest -x")


def test_no_actions_no_facts(spark):
    assert facts.findings(boards.board(spark, ROOM)).count() == 0


def test_kickstart_and_regroup(spark):
    p = boards.posts(spark, (1, "a", "what now? "), (2, "b", "why?"), (3, "a", "see #2"), (4, "b", "it is done"), (5, "b", "`x` is done"))
    assert {(r.seq, r.signal, r.group) for r in taxonomy.kickstart(p).collect()} == {(1, "open_question", "disagreement"), (4, "bare_claim", "ungrounded")}
    n = spark.createDataFrame([("R1", 2), ("D1", 3), ("stale_act", 1)], "pattern string, n bigint")
    assert {r.group: r.n for r in taxonomy.regroup(n, "state_gap").collect()} == {"misread": 2, "ungrounded": 3, "unreceived": 1}
    assert {r.group: r.n for r in taxonomy.regroup(n, "ten_modes").collect()} == {"not_read": 2, "never_done": 3, None: 1}


def test_taxonomies_are_complete(spark):
    cat = taxonomy.patterns(spark)
    assert cat.count() == 43 and taxonomy.check_catalog(cat).count() == 0
    for c in taxonomy.CHOICES:
        out = spark.createDataFrame([(p,) for p in taxonomy.OUT_OF_SCOPE[c]], "pattern string")
        placed = taxonomy.resolved(spark, c).select("pattern")
        assert taxonomy.check_choice(placed, cat, out, c in taxonomy.COMPLETE).count() == 0
    bad = taxonomy.check_choice(spark.createDataFrame([("R1",), ("nope",)], "pattern string"), cat, spark.createDataFrame([("R1",)], "pattern string"), True)
    assert {"not in the catalog", "both placed and out of scope", "not placed"} == {r.problem for r in bad.collect()}


def test_session_boards(spark):
    assert B.message_posts(boards.posts(spark, *ROOM)).count() == 15


def test_near_duplicates_across_blocks(spark):
    same = "one two three four five six seven eight nine ten eleven twelve"
    other = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    at = {1: "a", 719: "a", 799: "b", 801: "c", 879: "d", 960: "e"}
    rows = [(i, at.get(i, "z"), same if i in at else other(i)) for i in range(1, 1000)]
    got = modes.near_duplicates(modes.flags(boards.board(spark, rows).posts)).select("seq", "of_seq", "of_who").collect()
    assert sorted(map(tuple, got)) == [(799, 719, "a"), (801, 799, "b"), (879, 799, "b")]
