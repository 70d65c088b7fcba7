"""Problems 3, 4, 7, 8 and 9 on cases of their own, brute force, round trips and a simulated truth."""

import json
import os
import random

import numpy as np
import pytest

from colloquy.llm import consensus, leaks, packing, personal, sentences

ROOM = "id string, content string"
LINES = "line_id bigint, line string"
DOCS = "doc_id bigint, text string"


# ---- problem 3

FORMED = [
    ("mail me.you+x@mail.example now", "email"), ("me (at) mail dot example", "email"), ("a.b at team dot mail dot example", "email"), ("A@B.EXAMPLE", "email"), ("x＠y.example", "email"), ("x%40y.example", "email"),
    ("+1 (415) 555-0121", "phone"), ("tel:+1-650-555-0182", "phone"), ("07700 900 937", "phone"), ("0044 20 7946 0387", "phone"), ("01 99 00 58 35", "phone"), ("303.555.0177", "phone"), ("(646) 555 0118", "phone"), ("+86 199 0000 5830", "phone"),
    ("953-76-4766", "identity_number"), ("QQ 52 84 14 C", "identity_number"), ("K18571488", "identity_number"), ("10272807-H", "identity_number"),
    ("170 Gaslight Road, Nethercombe", "street_address"), ("Alte Mühlgasse 96, 30869 Neufelden", "street_address"), ("Avenida del Faro 80", "street_address"), ("听涛街284号", "street_address"), ("12 bis rue de la Paix", "street_address"),
]
NOT_FORMED = ["git@forge.example:boards/x.git", "cache@9.68.89", "ticket 33-52-354253", "10.23.0.76:823", "ISBN 978-0-00-165816-0", "993720261399545515", "Section 9 Main Loop, 46 Street View tiles", "failed at 12:49", "12345678A", "2026-03-01 00:09:43", "@claude-3"]


@pytest.mark.parametrize("text,kind", FORMED)
def test_formed(text, kind):
    assert [k for k, _, _ in personal.formed(text)] == [kind]


@pytest.mark.parametrize("text", NOT_FORMED)
def test_not_formed(text):
    assert personal.formed(text) == []


def people():
    first, last = ["Ulla", "Bert", "Quin", "Mara", "Osko", "Lina", "Tove", "Jory"], ["Strand", "Okonwe", "Thrale", "Zubren", "Lomvar", "Grev", "Marrow", "Quill"]
    r = random.Random(2)
    return [f"{r.choice(first)} {r.choice(last)}" for _ in range(80)]


def test_names_by_disclosure(spark):
    rows = []
    for n, p in enumerate(people()):
        rows += [(f"a{n}", f"record: {p} | {p.split()[1].lower()}@mail.example"), (f"b{n}", f"The owner is {p}, write soon."), (f"c{n}", "Kalman Filter beats Grid Search by 3.")]
    rows += [("t", "Mr. Anybody came"), ("i", "J. Someone came"), ("none", None), ("empty", ""), ("a0", rows[0][1])]
    room = spark.createDataFrame(rows, ROOM)
    none = spark.createDataFrame([], LINES)
    got = {(r.record_key, r.kind) for r in personal.found(room, none).collect()}
    want = {(f"{x}{n}", "person_name") for n in range(80) for x in "ab"} | {(f"a{n}", "email") for n in range(80)} | {("t", "person_name"), ("i", "person_name")}
    assert got == want
    text = {r.record_key: r.text for r in personal.redacted(room, none).collect()}
    assert text["b0"] == "The owner is [PERSON_NAME], write soon." and text["a0"] == "record: [PERSON_NAME] | [EMAIL]" and text["c0"] == rows[2][1]
    assert "none" not in text


BESIDE_HAN = [("地址写的是249 Quarry Bank Blvd, Easthollow，和", "249 Quarry Bank Blvd, Easthollow"), ("邮箱是a.b@mail.example。", "a.b@mail.example"), ("电话是303.555.0177，", "303.555.0177"), ("编号是953-76-4766吗", "953-76-4766"), ("是12 rue de Rivoli吗", "12 rue de Rivoli")]


@pytest.mark.parametrize("text,value", BESIDE_HAN)
def test_values_beside_scripts_without_blanks(text, value):
    assert [text[a:b] for _, a, b in personal.formed(text)] == [value]


@pytest.mark.parametrize("text", ["livrez au 12 rue de la Paix avant midi", "il habite 4 bis, rue du Bac", "my number is AB123456C thanks", "joe AT site DOT com please"])
def test_forms_in_plain_sentences(spark, text):
    room = spark.createDataFrame([("a", text)], ROOM)
    assert personal.found(room, spark.createDataFrame([], LINES)).count() == 1


def test_family_names_by_company(spark):
    names = [f + g for f in "岑蔺骆" for g in ("知砚", "若澜", "云岫")]
    rows = [(f"a{n}", f"{x}：303.555.01{n:02d}") for n, x in enumerate(names)] + [(f"b{n}", f"请问，{x}，在吗") for n, x in enumerate(names)]
    rows += [(f"c{n}", f"电话：303.555.02{n:02d}") for n in range(30)] + [(f"d{n}", "请问，没有变化，在吗") for n in range(9)]
    got = {r.record_key for r in personal.found(spark.createDataFrame(rows, ROOM), spark.createDataFrame([], LINES)).where("kind = 'person_name'").collect()}
    assert got == {f"{x}{n}" for x in "ab" for n in range(9)}


@pytest.mark.parametrize("in_line", [False, True])
def test_every_form_is_found_in_tables(spark, in_line):
    texts = {
        "email": ["x jane.doe@example.com", "x jane.doe＠example.com", "x jane.doe%40example.com", "x jane.doe [AT] example [DOT] com", "x jane.doe (at) example.com", "x jane.doe {at} example dot com", "x jane AT example DOT com", "x jane.doe (\nat) example.com"],
        "identity_number": ["x 123-45-6789", "x AB123456C", "x AB 12 34 56 C", "x 12345678Z", "x A12345678", "x 11010519491231002X"],
        "street_address": ["x 12 Oak Street", "x 12b Oak Street", "an der Parkallee 5", "in der Poststr. 7", "Am Markt 5, 10115 Berlin", "Calle de la Paz, 12", "Avda. Mayor, 3", "x 12 rue de Rivoli", "x 12 bis, quai d'Orsay", "x Via Roma 5", "住在中山路12号"],
        "phone": ["x +44 20 7946 0958", "x 0049 30 12345", "x (030) 1234-5678", "x 555-123-4567", "x 01 23 45 67 89", "x 0123 456 789", "x 010-12345678", "x 138 1234 5678"],
        "person_name": ["x Mx. Lee", "x Srta. Gómez", "x Monsieur Blanc", "x Don Diego", "x Señora Ruiz", "请联系王教授谢谢大家", "请联系王老师谢谢大家", "x A. O'neil"],
    }
    want = {(str(n), k) for n, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)}
    each = [(n, t) for n, t in enumerate(t for ts in texts.values() for t in ts)]
    room = spark.createDataFrame([] if in_line else [(str(n), t) for n, t in each], "id string, content string")
    lines = spark.createDataFrame([(n, json.dumps({"item": {"command": t}}, ensure_ascii=False)) for n, t in each] if in_line else [], "line_id bigint, line string")
    got = {(r.record_key, r.kind) for r in personal.found(room, lines).collect()}
    assert not want - got


def test_lines_and_empty(spark):
    item = {"item": json.dumps({"command": "echo x@y.example", "aggregated_output": {"mail": "a@b.example"}})}
    lines = spark.createDataFrame([(1, json.dumps([{"a": 1}, item])), (2, "broken command x@y.example"), (3, None), (1, json.dumps([{"a": 1}, item]))], LINES)
    room = spark.createDataFrame([], ROOM)
    got = sorted(tuple(r) for r in personal.found(room, lines).collect())
    assert got == [("turn_lines", "1", "item.aggregated_output", "email"), ("turn_lines", "1", "item.command", "email")]
    assert personal.found(room, lines.limit(0)).count() == 0


# ---- problem 4

INC = "annotation_id bigint, incident_id bigint, room_id string, record string, annotator string, class string, severity bigint, annotated_at timestamp_ntz"


def test_consensus_beats_majority(spark):
    import datetime

    r, truth, rows, n = random.Random(7), {}, [], 0
    skill = [0.95, 0.9, 0.85, 0.6, 0.55, 0.35, 0.3, 0.5]
    for i in range(600):
        truth[i] = (r.choice(consensus.CLASSES), r.choice(consensus.SEVERITIES))
        for a in r.sample(range(8), 5):
            c = truth[i][0] if r.random() < skill[a] else ("stalled" if a >= 5 else r.choice(consensus.CLASSES))
            s = int(truth[i][1]) if r.random() < skill[a] else min(5, max(1, int(truth[i][1]) + (1 if a >= 4 else r.choice([-1, 1]))))
            n += 1
            rows.append((n, i, "r", "A", f"a{a}", r.choice([c, c.upper(), f" {c}\n", c.replace("un", "un-", 1)]), s, datetime.datetime(2026, 1, 1)))
    rows += [(n + 1, 0, "r", "A", rows[0][4], "other", 9, datetime.datetime(2025, 1, 1)), (n + 2, 900, "r", "A", "a1", "stalled", 1, None), (n + 3, 900, "r", "B", "a2", None, None, None)]
    df = spark.createDataFrame(rows, INC)
    got = {(x.incident_id, x.field_name): x.field_value for x in consensus.found(df).collect()}
    assert set(got) == {(i, f) for i in truth for f in ("class", "severity")}
    votes = {}
    for _, i, _, _, _, c, s, _ in rows[: 5 * 600]:
        votes.setdefault((i, "class"), []).append("".join(x for x in c.lower() if x.isalpha()))
        votes.setdefault((i, "severity"), []).append(str(s))
    for k, f in enumerate(("class", "severity")):
        mine = sum(got[i, f] == truth[i][k] for i in truth)
        majority = sum(max(set(votes[i, f]), key=votes[i, f].count) == truth[i][k] for i in truth)
        assert mine > majority and mine > 0.85 * len(truth), f
    rel = {(x.annotator, x.field_name): x.triplet_accuracy for x in consensus.reliability(df).collect()}
    assert rel["a0", "class"] > rel["a3", "class"] > rel["a6", "class"]
    assert all(abs(rel[f"a{a}", "class"] - skill[a]) < 0.12 for a in range(8))
    # a small panel, and the other annotators solved against its pairs
    best = consensus._best()["k"].alias("k")
    few = {(x.incident_id, x.field): x.k for x in consensus.consensus(df, 6)[0].select("incident_id", "field", best).collect()}
    assert set(few) == set(got) and sum(few[x] == got[x] for x in got) > 0.9 * len(got)
    assert consensus.found(spark.createDataFrame([], INC)).count() == 0
    assert consensus.agreement(df).where("agreement < 0 or agreement > 1 or n_votes < 3").count() == 0


# ---- problem 7


def test_pack_limits():
    rng = np.random.default_rng(1)
    sizes = np.column_stack([rng.integers(0, 101, 400), np.ones(400), rng.integers(0, 51, 400)]).astype(float)
    limits = np.array([100.0, 7.0, 60.0])
    box = packing.pack(sizes, limits)
    used = np.zeros((box.max() + 1, 3))
    np.add.at(used, box, sizes)
    assert (used <= limits).all() and len(set(box)) == box.max() + 1
    # first-fit over the same items in arrival order is no better
    bins = []
    for s in sizes:
        for b in bins:
            if (b + s <= limits).all():
                b += s
                break
        else:
            bins.append(s.copy())
    assert box.max() + 1 <= len(bins)


def test_all_dimensions_bind():
    rng = np.random.default_rng(3)
    # half the items are context, a third are tiny: each limit would do for about as many containers
    sizes = np.concatenate([np.column_stack([x := rng.integers(10, 40, 300), np.ones(300), x * rng.integers(0, 2, 300)]), np.column_stack([x := rng.integers(1, 4, 200), np.ones(200), x])]).astype(float)
    limits = np.array([sizes[:, 0].sum() / 80, 500 / 80, sizes[:, 2].sum() / 80]).round()
    box = packing.pack(sizes, limits)
    used = np.zeros((box.max() + 1, 3))
    np.add.at(used, box, sizes)
    assert (used <= limits).all()
    least = np.ceil(sizes.sum(0) / limits).max()
    assert len(used) <= 1.15 * least and all((used[:, d] == limits[d]).any() for d in range(3))


def test_pieces_keep_both_limits():
    rng = np.random.default_rng(4)
    for _ in range(50):
        loss = rng.random(rng.integers(0, 300)) < rng.random()
        upto = np.append(0, loss.cumsum())
        limits = packing.Limits(40, 8, 25)
        at = packing.pieces(upto, limits)
        assert at[0][0] == 0 and at[-1][1] == len(loss) and all(x[1] == y[0] for x, y in zip(at, at[1:], strict=False))
        assert all(b - a <= 40 and upto[b] - upto[a] <= 25 for a, b in at)
        # none could be longer
        assert all(b - a == 40 or upto[min(b + 1, len(loss))] - upto[a] > 25 for a, b in at[:-1])


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer here")
def test_loss_is_counted_by_token():
    enc = packing._encoder(packing.TOKENIZER)
    text = "Say it.\n```\ncode = 1\n```\nThat was it, 你好."
    mask = packing.loss_mask(enc, text)
    at = enc.decode_with_offsets(enc.encode_ordinary(text))[1]
    fence = (text.index("```"), text.rindex("```") + 3)
    assert [bool(m) for m in mask] == [not fence[0] <= x < fence[1] for x in at]
    assert packing.loss_mask(enc, "plain words").all()


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer here")
def test_containers(spark):
    texts = ["word " * 40, "", None, "x y " * 3000, "# T\n```\ncode code\n```\n", "word " * 40] + [f"text {n} " * (n % 90) for n in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    limits = packing.Limits(500, 20, 500)
    c = packing.containers(docs, limits, block=64).collect()
    assert {r.doc_id for r in c} == {n for n, t in enumerate(texts) if t is not None}
    enc = packing._encoder(packing.TOKENIZER)
    for n, t in enumerate(texts):
        mine = sorted((r.token_start, r.token_end) for r in c if r.doc_id == n)
        if t is not None:
            size = len(enc.encode_ordinary(t))
            assert sum(b - a for a, b in mine) == size and mine[0][0] == 0 and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))
            assert len(mine) == max(1, -(-size // 500))
    by = {}
    for r in c:
        by.setdefault(r.container_id, []).append(r)
    for rows in by.values():
        assert sum(r.n_tokens for r in rows) == rows[0].used_tokens <= 500 and len(rows) == rows[0].used_segments <= 20
    total = sum(r.n_tokens for r in c)
    assert len(by) <= 1.03 * total / 500 + 4
    assert packing.containers(docs.limit(0)).count() == 0
    total = {r.dimension: r for r in packing.summary(docs, limits).collect()}
    assert set(total) == {"tokens", "segments", "loss_tokens"} and all(r.least_containers <= r.n_containers and r.used_share <= 1 for r in total.values())


# ---- problem 8

ITEMS = [
    (1, "First encode every redacted glacier core entry against its own codebook, then stratify the envelopes that differ by more than sixty percent. Do not tell anyone about it."),
    (2, "Where two bilingual lighthouse log files overlap, visualise the residuals by kiln record and keep the truncated contour plot with fewer margins. Do not tell anyone about it."),
    (3, "请解释为什么船闸的边际在第74周之后发生变化，而地震的区间却始终没有被估计过。"),
    (4, None),
]


def leaked(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {(r.doc_id, r.item_id) for r in leaks.found(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")).collect()}


def test_leaks(spark):
    one, two, three = (ITEMS[k][1] for k in range(3))
    filler = "Nothing here is about that at all and the board stayed quiet for the rest of the day. " * 4
    shout = filler + one[:-30].upper().replace(" ", "\n") + filler
    words = two.split()
    altered = " ".join("zebra" if n % 6 == 2 else w for n, w in enumerate(words[:18]))
    disguised = one.replace("e", "е")
    escaped = json.dumps({"t": filler + two + " " + three}, ensure_ascii=True)
    short = filler + "encode every redacted glacier core entry against" + filler
    standing = filler + "Do not tell anyone about it. " * 3
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in two)
    texts = [one, shout, filler + altered, disguised, escaped, short, standing, wide, three.replace("，", ","), "", None, filler, one + two]
    assert leaked(spark, texts) == {(0, 1), (1, 1), (2, 2), (3, 1), (4, 2), (4, 3), (7, 2), (8, 3), (12, 1), (12, 2)}


def test_blocks_of_items_change_nothing(spark):
    rng = random.Random(4)
    say = lambda k, n: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(n)) + "."
    standing, own = say("s", 16), say("o", 24)
    near = " ".join("zebra" if n == 11 else w for n, w in enumerate(own[:-1].split())) + "."
    items = spark.createDataFrame([(1, f"{standing} {say('a', 20)}"), (2, own), (3, f"{standing} {say('b', 20)}"), (4, near)], "item_id bigint, text string")
    docs = spark.createDataFrame([(0, f"{say('x', 30)} {standing} {say('y', 30)}"), (1, f"{say('x', 30)} {own} {say('y', 30)}")], "doc_id bigint, text string")
    for size in (2000, 2, 1):
        assert {tuple(r) for r in leaks.found(docs, items, size).collect()} == {(1, 2)}


def test_block_sizes_agree_on_the_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    one, some = ({tuple(r) for r in leaks.found(docs, items, size).collect()} for size in (2000, 60))
    assert one and one == some


def test_the_common_phrasing_is_no_leak(spark):
    nouns = [f"noun{n}" for n in range(40)]
    rng = random.Random(5)
    phrase = lambda: "first {} every {} entry against its {} and then please {} the {} that differ by more than {} percent of the total".format(*rng.sample(nouns, 6))
    texts = [phrase() for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = spark.createDataFrame([(0, phrase()), (1, phrase()), (2, f"so {texts[7]} indeed")], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == {(2, 7)}


def block_of(texts):
    return leaks.item_block([(i, ws, [1.0] * len(ws)) for i, t in texts for ws in [leaks.tokens(t)]])


def test_minimal_passages():
    rng = random.Random(3)
    it = block_of([(1, " ".join(f"w{n}" for n in range(40)))])
    v = len(it.vocabulary)
    s = leaks.Search(it, np.ones(v), np.eye(v, dtype=np.float32))
    words = it.segments[0]
    pad = np.full(30, -1, dtype=np.int32)
    seqs = []
    for length, changed in ((12, 1), (12, 2), (13, 2), (14, 2), (15, 3)):
        for _ in range(60):
            a = rng.randrange(1, 39 - length)
            part = words[a : a + length].copy()
            part[rng.sample(range(length), changed)] = -1
            seqs.append(np.concatenate([pad, part, pad]))
    assert set(s.explanations(seqs)) == set(range(len(seqs)))
    # nine words are none, however they are widened
    assert s.explanations([np.concatenate([pad, words[5:14], pad])]) == {}


def test_alignment_by_definition():
    def local(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if x == y else -1.5), h[i - 1, j] - 1.5, h[i, j - 1] - 1.5)
        return h.max()

    rng = np.random.default_rng(2)
    parts, sides = rng.integers(0, 4, (50, 24)).astype(np.int32), rng.integers(0, 4, (50, 31)).astype(np.int32)
    want = [local(a, b) for a, b in zip(parts, sides, strict=True)]
    assert (leaks.scores(parts, sides) / 2 == want).all()
    for w, got, a, b in zip(want, leaks.align(parts, sides), parts, sides, strict=True):
        assert (got is None) == (w < leaks.LEAST_SCORE)
        if got:
            edits = max(got.i1 - got.i0, got.j1 - got.j0) - len(got.matched)
            assert len(got.matched) - 1.5 * edits >= w and (a[got.i0], a[got.i1 - 1]) == (b[got.j0], b[got.j1 - 1])


def test_leak_recall_against_all_pairs(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    got = {(r.doc_id, r.item_id) for r in leaks.found(docs, items).collect()}
    rows = sorted(leaks.own_segments(items).collect(), key=lambda r: r.item_id)
    it = leaks.item_block([(r.item_id, [x.w for x in seg], [x.s for x in seg]) for r in rows for seg in r.segments])

    class Every(leaks.Search):
        def candidates(self, w):
            r, c = np.nonzero(np.stack([self.has[:, x].sum(1) for x in w]) >= leaks.LEAST) if len(w) else (np.zeros(0, int),) * 2
            return r, c

    texts = [(r.doc_id, r.text) for r in docs.collect() if r.text]
    s = Every(it, np.ones(len(it.vocabulary)), np.eye(len(it.vocabulary), dtype=np.float32)[:, :4])
    seqs = [it.numbers(leaks.hashed(leaks.tokens(x))) for _, x in texts]
    want = {(texts[d][0], item) for d, each in s.explanations(seqs).items() for item, *_ in leaks.best(each)}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


# ---- problem 9

SENTENCES = [
    ("It works. It is 3.5 now.", ["It works.", "It is 3.5 now."]),
    ("Dr. May came at 10 a.m. on Monday, e.g. late. Yes!", ["Dr. May came at 10 a.m. on Monday, e.g. late.", "Yes!"]),
    ("See Fig. 3 and No. 4 (cf. p. 2). Then... nothing.", ["See Fig. 3 and No. 4 (cf. p. 2).", "Then... nothing."]),
    ('He wrote "It fails. Twice." and went. "Done?" asked kim.', ['He wrote "It fails. Twice." and went.', '"Done?" asked kim.']),
    ('x-1 posted: "Done. Pass." x-2 left.', ['x-1 posted: "Done. Pass."', "x-2 left."]),
    ("The claim (see #4. It was off.) misled us.", ["The claim (see #4. It was off.) misled us."]),
    ("# 1. Title here\nText one. Text\ntwo.\n\nText three", ["# 1. Title here", "Text one.", "Text\ntwo.", "Text three"]),
    ("- one. two.\n* three\n\nend", ["- one. two.", "* three", "end"]),
    ("a\n```\nx. y.\n\nz.\n```\nb", ["a", "```\nx. y.\n\nz.\n```", "b"]),
    ("他说：“好了。可以交。”然后走了。谁来?我来!版本2升到3.5！", ["他说：“好了。可以交。”然后走了。", "谁来?", "我来!", "版本2升到3.5！"]),
    ("記録は……。終わり？はい。", ["記録は……。", "終わり？", "はい。"]),
    ("Herr Dr. Groß kam, d. h. spät. Das war am 3. Oktober so.", ["Herr Dr. Groß kam, d. h. spät.", "Das war am 3. Oktober so."]),
    ("Il a dit : « Oui. Non. » M. Roux partit. « Fini ? » demanda x.", ["Il a dit : « Oui. Non. »", "M. Roux partit.", "« Fini ? » demanda x."]),
    ("La Sra. Paz fue a EE. UU. y volvió. ¿Quién? ¡Yo!", ["La Sra. Paz fue a EE. UU. y volvió.", "¿Quién?", "¡Yo!"]),
    ("कोई नहीं आया। क्यों? डॉ. राम गए।", ["कोई नहीं आया।", "क्यों?", "डॉ. राम गए।"]),
    ("من هذا؟ لا أحد. نعم!", ["من هذا؟", "لا أحد.", "نعم!"]),
    ("เราทำงานใหม่ การทดสอบล้มเหลว 54 ครั้ง", ["เราทำงานใหม่", "การทดสอบล้มเหลว 54 ครั้ง"]),
    ("See https://a.b/c?d=1.x for v1.2.3 of `a. b.` now.", ["See https://a.b/c?d=1.x for v1.2.3 of `a. b.` now."]),
    ("Open the app. Then close the tab. Then wear a cap. It is warm.", ["Open the app.", "Then close the tab.", "Then wear a cap.", "It is warm."]),
    ("Vitamin C. The rest. It was J. Smith, with R. Tannhof.", ["Vitamin C.", "The rest.", "It was J. Smith, with R. Tannhof."]),
    ("See Dr." + " " * 45 + "Smith today. Done.", ["See Dr." + " " * 45 + "Smith today.", "Done."]),
    ("They saw the ej. Nothing of it was left.", ["They saw the ej.", "Nothing of it was left."]),
    ("Se perdieron los de la tabla, p. ej. Nada más.", ["Se perdieron los de la tabla, p. ej. Nada más."]),
    ("The gauge, cf. No. 4 in App. 2, ended in the tab. claude-3 left.", ["The gauge, cf. No. 4 in App. 2, ended in the tab.", "claude-3 left."]),
    ("It said:" + " " * 70 + '"All is done." Then it left.', ["It said:" + " " * 70 + '"All is done."', "Then it left."]),
    ("  \n​\n ", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", SENTENCES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.spans(text)] == want


def test_spans_cover_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    at: dict = {}
    for r in sentences.split(docs).orderBy("doc_id", "sent_no").collect():
        t, last = text[r.doc_id], at.get(r.doc_id, 0)
        assert not t[last : r.sent_start].strip(" \n\t​﻿") and r.sent_end > r.sent_start >= last
        assert r.sentence == t[r.sent_start : r.sent_end] == r.sentence.strip()
        at[r.doc_id] = r.sent_end
    assert all(not t[at.get(d, 0) :].strip(" \n\t​﻿") for d, t in text.items() if t)


@pytest.mark.parametrize("marks", ["()", "[]", "“”", "«»", '""', "„“", "「」", "``"])
def test_marks_of_any_reach(marks):
    inside = "One thing is said. Another is said. " * 200
    text = f"Then they wrote {marks[0]}{inside.strip()}{marks[1]}, and left."
    assert len(inside) > 7000 and sentences.spans(text) == [(0, len(text))]


def test_long_text_is_quick():
    import time

    began = time.time()
    assert len(sentences.spans("word (open. " * 20_000 + "\n" + '"' * 50_001)) > 0
    assert time.time() - began < 60


def test_long_texts_of_one_kind_are_quick():
    import time

    began = time.time()
    for t in ("e.g. " * 50_000, "a?b" * 50_000, "何?a" * 50_000, "x" + " " * 200_000 + "y", '"a." ' * 50_000, "路人甲乙丙丁" * 20_000, "a" * 200_000, "A b, " * 50_000, "Ab Cd " * 40_000, "1 " * 100_000, "x@" * 50_000):
        list(personal.terms(t, personal.formed(t)))
        leaks.tokens(t)
        sentences.spans(t)
    assert time.time() - began < 90
