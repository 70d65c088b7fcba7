import boards
import pytest
from pyspark.sql import functions as F

from colloquy.operators import audit, incidents


def export(spark, salt="s", context=2):
    p = boards.posts(spark, *[(n, "ab"[n % 2], f"post {n} by me@x.example") for n in range(1, 7)])
    return audit.export(p, ["R1", "D1"], salt, context)


def labelled(rows, labels, uncertain=None):
    lab = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if labels else F.lit(None)
    none = F.array().cast("array<string>")
    return rows.withColumn("labels", F.coalesce(lab[F.col("seq")], none) if labels else none).withColumn("uncertain", F.when(F.col("seq") == (uncertain or -1), F.array(F.lit("D1"))).otherwise(none))


def test_blind_rows(spark):
    a, b, c = export(spark), export(spark), export(spark, "t")
    ids = lambda d: [r.sample_id for r in d.orderBy("sort_key").collect()]
    assert ids(a) == ids(b) and not set(ids(a)) & set(ids(c)) and len(ids(a)) == 6
    ctx = {r.seq: [x.seq for x in r.context_before] for r in a.collect()}
    assert ctx == {1: [], 2: [1], 3: [1, 2], 4: [2, 3], 5: [3, 4], 6: [4, 5]}
    assert a.where(F.col("content").contains("@x")).count() == 0
    assert export(spark, context=0).where("size(context_before) > 0").count() == 0


def test_check_labels(spark):
    rows = export(spark)
    good = labelled(rows, {1: ["R1"]})
    assert audit.check_labels(good).count() == 0
    edited = good.withColumn("content", F.when(F.col("seq") == 2, "other").otherwise(F.col("content")))
    assert [r.problem for r in audit.check_labels(edited).collect()] == ["a fixed field was edited"]
    wrong = labelled(rows, {1: ["ZZ"], 2: ["D1"]}, uncertain=2)
    assert {r.problem for r in audit.check_labels(wrong).collect()} == {"unknown label", "label both given and uncertain"}
    assert audit.check_labels(good.unionByName(good.where("seq = 1"))).where("problem = 'sample twice'").count() == 2


def test_compare_and_finalize(spark):
    rows = export(spark)
    a, b = labelled(rows, {1: ["R1"], 2: ["R1"], 3: ["D1"]}), labelled(rows, {1: ["R1"], 3: ["D1"]}, uncertain=4)
    r = {x.label: x for x in audit.compare(a, b).collect()}
    assert (r["D1"].decisions, r["D1"].uncertain_excluded, r["D1"].positives_a, r["D1"].positives_b, r["D1"].kappa) == (5, 1, 1, 1, 1.0)
    assert r["R1"].kappa == pytest.approx(0.5714)
    open_ = audit.to_adjudicate(a, b)
    assert open_.count() == 2
    key = rows.select("sample_id", "episode_id", "room", "trace_digest", "seq") if False else rows.select("sample_id", "room", "trace_digest", "seq")
    judged = open_.select("sample_id", F.array(F.lit("D1"), F.lit("R1")).alias("labels"), F.array().cast("array<string>").alias("uncertain"))
    gold, problems = audit.finalize(a, b, judged, key)
    assert problems.count() == 0 and {x.seq: x.labels for x in gold.collect()}[2] == ["R1", "D1"]
    _, problems = audit.finalize(a, b, judged.limit(1), key)
    assert [x.problem for x in problems.collect()] == ["not adjudicated"]
    _, missing = audit.pair(a, b.where("seq < 6"))
    assert [x.problem for x in missing.collect()] == ["missing in the second file"]


def test_kappa_value(spark):
    one = spark.range(1).select(audit.kappa(F.lit(4), F.lit(1), F.lit(1), F.lit(10)).alias("k"), audit.kappa(F.lit(0), F.lit(0), F.lit(0), F.lit(5)).alias("n")).first()
    assert one.k == pytest.approx(0.6) and one.n is None


INC = "room string, incident_id string, posts array<bigint>, anchor bigint, class string, severity bigint"


def test_matching_is_greedy(spark):
    a = spark.createDataFrame([("r", "A1", [1, 2], 1, "unsaid", 3), ("r", "A2", [1, 2, 3], 3, "misread", 2)], INC)
    b = spark.createDataFrame([("r", "B1", [1, 2, 3], 1, "unsaid", 3), ("r", "B2", [1, 2], 9, "stalled", 5), ("s", "B3", [1], 1, "unsaid", 1)], INC)
    got = {(r.a, r.b): r.score for r in incidents.greedy(incidents.candidates(a, b)).collect()}
    assert got == {("A1", "B1"): pytest.approx(1 + 2 / 3), ("A2", "B2"): pytest.approx(2 / 3)}
    r = {x.room: x for x in incidents.agreement(a, b).collect()}
    assert (r["r"].n_a, r["r"].n_b, r["r"].matched, r["r"].matched_same_class, r["r"].incident_f1) == (2, 2, 2, 1, 0.5)
    assert (r["s"].n_a, r["s"].matched, r["s"].incident_f1, r["s"].class_kappa) == (0, 0, 0.0, None)
    none = spark.createDataFrame([], INC)
    assert incidents.agreement(none, none).count() == 0 and incidents.greedy(incidents.candidates(none, none)).count() == 0


def test_greedy_against_loop(spark):
    import random

    rnd = random.Random(5)
    pairs = [("r", f"a{i}", f"b{j}", rnd.choice([0.5, 0.6, 0.75, 1.0, 1.5])) for i in range(12) for j in range(12) if rnd.random() < 0.4]
    used, want = set(), set()
    for _, a, b, s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = incidents.greedy(spark.createDataFrame(pairs, "room string, a string, b string, score double")).collect()
    assert {(r.a, r.b) for r in got} == want


def test_seen_and_problems(spark):
    from colloquy.operators import board as B

    ops = [boards.op("a", 1, 0, "command", "sn read", 0), boards.op("a", 1, 1, "command", "boardnet say", 0, posted=4)]
    ops[0] = (*ops[0][:-1], 3)
    b = boards.board(spark, [(1, "b", "x"), (2, "b", "y"), (3, "b", "z"), (4, "a", "w"), (5, "b", "v")], ops)
    t = 1777629600000
    wakes = spark.createDataFrame([("r1", "a", 1, None, None, 2, None, t, t + 999999, None, None, None, None), ("r1", "b", 7, None, None, None, None, t + 4 * 60000, t + 5 * 60000 - 500, None, None, None, None)], B.EMPTY["wakes"])
    b = B.replace(b, wakes=wakes)
    got = {r.seq: (r.turn, r.seen) for r in incidents.seen(b).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (1, 3), 5: (7, 1)}
    cols = "room string, incident_id bigint, record string, posts array<bigint>, anchor bigint, actions array<string>, class string, pattern string, class_reason string, cause string, consequence string, severity bigint, severity_reason string, repaired boolean, source string, confidence string"
    long = "it went like this"
    rows = [("r1", 1, "A", [2, 4], 4, [], "unreceived", "x", long, long, long, 3, "3: so", True, "agents", "low"), ("r1", 2, "A", [9], 8, [], "zzz", "x", "no", long, long, 7, None, None, "me", None), ("r1", 3, "A", None, None, None, None, None, None, None, None, None, None, None, None, None)]
    p = incidents.problems(spark.createDataFrame(rows, cols), b)
    by = {}
    for r in p.collect():
        by.setdefault(r.incident_id, set()).add(r.problem)
    assert by[1] == {"unreceived, but its author had received every other post"}
    assert {"a post does not exist", "the anchor must be one of its posts", "unknown class", "class_reason must say what happened"} <= by[2]
    assert "posts must be a non-empty list" in by[3]


def test_accounting_and_sweep(spark):
    ab = lambda *ids: spark.createDataFrame([("r", i) for i in ids], "room string, id string")
    judged = spark.createDataFrame([("r", ["A:1", "B:1"]), ("r", ["A:1", "B:9"])], "room string, `from` array<string>")
    rejected = spark.createDataFrame([("r", "A:2")], "room string, `from` string")
    got = {r.id: r.problem for r in incidents.accounting(judged, rejected, ab("1", "2", "3"), ab("1")).collect()}
    assert got == {"A:1": "used twice", "A:3": "neither kept nor rejected", "B:9": "does not exist"}
    sweep = spark.createDataFrame([("r1", 1, ["I1"], "ok"), ("r1", 2, [], "")], "room string, seq bigint, incidents array<string>, note string")
    inc = spark.createDataFrame([("r1", "I1", [2, 3])], "room string, id string, posts array<bigint>")
    p = boards.posts(spark, (1, "a", "x"), (2, "a", "y"), (3, "a", "z"))
    assert {(r.seq, r.problem) for r in incidents.sweep_gaps(p, sweep, inc).collect()} == {(3, "missing"), (2, "no note"), (1, "names an incident that doesn't include it"), (2, "an incident includes it, the entry doesn't say so"), (3, "an incident includes it, the entry doesn't say so")}
    g = spark.createDataFrame([("r", 1, 50.0), ("r", 2, 100.0), ("r", 3, 0.0)], "room string, index int, score double")
    assert [r["index"] for r in incidents.grade_gaps(g, spark.createDataFrame([("r", 1)], "room string, index int")).collect()] == [3]
    s = incidents.batch_summary(spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "completed")], "run string, status string")).first()
    assert tuple(s) == (3, 2, 1, 0)


def test_annotation_verdict_batch(spark):
    c = spark.createDataFrame
    items = c([("r", "I", "n"), ("r", "", "x")], "room string, id string, name string")
    inc = c([("r", "a", ["I"]), ("r", "a", ["J"]), ("r", None, [])], "room string, id string, items array<string>")
    und = c([("r", "zzz")], "room string, class string")
    got = {x.problem for x in incidents.annotation_problems(items, inc, und, c([("r", "E1"), ("s", "E3")], "room string, level string")).collect()}
    assert len(got) == 6
    v = c([("r", 1, "incident", ["a"]), ("r", 2, "incident", []), ("r", 3, "luck", None), ("r", 4, "incident", ["q"])], "room string, index int, kind string, incidents array<string>")
    assert {(x["index"], x.problem) for x in incidents.verdict_problems(v, inc).collect()} == {(2, "an incident cause must list incidents"), (3, "unknown kind of cause"), (4, "no such incident")}
    runs = c([("x", "E3"), ("y", "E3"), ("z", "E1")], "run string, level string")
    arts = c([(r, n) for r in "xyz" for n in ("A", "B")], "run string, name string")
    agr = c([("x", 0.5, None), ("y", 0.5, 0.1), ("z", 1.0, 1.0)], "run string, incident_f1 double, class_kappa double")
    rec = c([("x", 0.5, None), ("y", 0.5, 0.2), ("z", 1.0, 1.0)], "run string, incident_f1 double, class_kappa double")
    assert {x.run: x.ok for x in incidents.accepted(runs, arts, ["A", "B"], agr, rec).collect()} == {"x": True, "y": False, "z": False}


def test_index_and_views(spark):
    from colloquy import views
    from colloquy.operators import facts, modes, taxonomy

    b = boards.board(spark, [(1, "a", "who? "), (2, "b", "it | is done")], [boards.op("a", 1, 0, "command", "ls", 0)], seats=[("r1", "a", 0, None, None, None, None, None, None)])
    p, a = incidents.bundle_index(b)
    assert {(r.seq, r.level) for r in p.collect()} == {(1, "E3"), (2, "E3")} and a.first().action_id == "a:1:0"
    assert views.modes(modes.Modes(b).modes(), "r1").count("\n") == 13
    assert "| a | 1 | 1 |" in views.facts(facts.findings(b), facts.seat_stats(b), "r1")
    assert "open_question" in views.findings(taxonomy.kickstart(b.posts), "r1")
