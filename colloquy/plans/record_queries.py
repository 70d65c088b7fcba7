"""Accounts of passes over the incidents, audits by two raters, and a board as it stood; with SQL for these and for matches, agreement, samples and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.patterns import CASED
from colloquy.operators import audit, board, incidents, modes
from colloquy.plans.board_queries import FLAGGED, LINKED, _posts
from colloquy.plans.board_queries import ORACLE as BOARD
from colloquy.plans.label_queries import _REC, _pass
from colloquy.plans.sql import POSTS, WAKES
from colloquy.session import cut

CHOICES = ["B1", "D1", "R1"]
_none = "array<string>"


def _raters(spark, d):
    """Two raters' files over the blind samples: each takes other wordings for a label, and is uncertain where a post hedges."""
    p = cut(_posts(spark, d).select("room", "seq", "who", "text", "at_ms", "type", "role"))
    rows = cut(audit.export(p, CHOICES, "salt", 0))
    f = modes.flags(p).select("room", "seq", "accept", "done", "ask", "wait", "push", "upload", "hedge")
    j = cut(rows.join(f, ["room", "seq"]))
    given = lambda **k: F.filter(F.array(*(F.when(F.col(c), F.lit(x)) for x, c in k.items())), lambda x: x.isNotNull())
    file = lambda labels, unsure: j.select("sample_id", "digest", "choices", "episode_id", "schema", *(c for c in audit.FIXED if c not in ("sample_id", "choices", "episode_id", "schema")), F.when(unsure, F.array().cast(_none)).otherwise(labels).alias("labels"), F.when(unsure, F.array(F.lit("R1"))).otherwise(F.array().cast(_none)).alias("uncertain"))
    return file(given(B1="ask", D1="push", R1="accept"), F.col("hedge") & F.col("accept")), file(given(B1="ask", D1="upload", R1="done"), F.col("hedge") & F.col("done")), rows


def _finalized(files, all_judged=True):
    a, b, rows = files
    judged = audit.to_adjudicate(a, b).where(F.lit(all_judged) | (F.size("la") > 0)).select("sample_id", F.array_sort(F.array_union("la", "lb")).alias("labels"), F.array().cast(_none).alias("uncertain"))
    return audit.finalize(a, b, judged, rows.select("sample_id", "room", "trace_digest", "seq"))


def _problems(files):
    return audit.check_labels(files[0]).unionByName(_finalized(files, False)[1])


def _accounting(spark, d):
    c = _pass(spark, d, "C").select("room", F.array(F.concat(F.lit("A:"), "incident_id"), F.concat(F.lit("B:"), "incident_id")).alias("from"))
    out = _pass(spark, d, "D").select("room", F.concat(F.lit("A:"), "incident_id").alias("from"))
    ids = lambda r: _pass(spark, d, r).select("room", F.col("incident_id").cast("string").alias("id"))
    return incidents.accounting(c, out, ids("A"), ids("B"))


def _sweep(spark, d):
    a, b = _pass(spark, d, "A"), _pass(spark, d, "B")
    sweep = b.where("anchor is not null").select("room", F.col("anchor").alias("seq"), F.array(F.col("incident_id").cast("string")).alias("incidents"), F.col("class_reason").alias("note"))
    listed = a.select("room", F.col("incident_id").cast("string").alias("id"), F.coalesce("posts", F.array().cast("array<bigint>")).alias("posts"))
    return incidents.sweep_gaps(_posts(spark, d), sweep, listed).distinct()


def _grades(spark, d):
    grade = _pass(spark, d, "A").select("room", F.col("incident_id").alias("index"), (F.col("severity") * 20).alias("score"))
    return incidents.grade_gaps(grade, _pass(spark, d, "C").select("room", F.col("incident_id").alias("index")))


def _view(spark, d):
    b = board.from_tables(spark, d)
    v = board.view_at(b, b.rooms.agg(F.min("room")).first()[0], 20)
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
    return n("posts", v.posts).unionByName(n("wakes", v.wakes)).unionByName(n("ops", v.ops)).unionByName(n("checks", v.checks)).unionByName(n("seats", v.seats))


QUERIES = {
    "judged_accounting": _accounting,
    "sweep_gaps": _sweep,
    "grade_gaps": _grades,
    "board_view": _view,
    "audit_pairs": lambda spark, d: audit.pair(*_raters(spark, d)[:2])[0].select("sample_id", "la", "lb", "ua", "ub"),
    "audit_compare": lambda spark, d: audit.compare(*_raters(spark, d)[:2]),
    "audit_report": lambda spark, d: audit.compare_summary(*_raters(spark, d)[:2]),
    "audit_final": lambda spark, d: _finalized(_raters(spark, d))[0].select("sample_id", "room", "seq", "labels", "adjudicated"),
    "audit_problems": lambda spark, d: _problems(_raters(spark, d)),
}

# ---- samples and digests, as canonical JSON hashed

_UNI = r"[\p{L}\p{M}\p{N}_"
_SECRET = CASED["secret"]
_SCRUBBED = f"regexp_replace(regexp_replace(text, '{_SECRET}', '<token>', 'g'), '{_UNI}.+-]+@{_UNI}-]+\\.{_UNI}.]+', '<email>', 'g')"
_HANDLES = r"list_transform(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_.@])@[A-Za-z0-9][\p{L}\p{N}_.-]{0,63}'), lambda m: regexp_replace(regexp_extract(m, '@(.*)$', 1), '\.+$', ''))"
_JSON = "to_json([CAST(seq AS VARCHAR), who, text])"
DIGESTS = f"""hashed AS (SELECT room, seq, seq // 1024 AS part, sha256({_JSON}) AS h FROM posts),
  trace AS (SELECT room, 'sha256:' || sha256(string_agg(h, '' ORDER BY part)) AS trace_digest FROM (SELECT room, part, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM hashed GROUP BY ALL) GROUP BY room)"""


def _samples(context: int, choices: list[str]) -> str:
    before = f"coalesce((SELECT list(c ORDER BY c.seq) FROM (SELECT {{'seq': q.seq, 'actor': q.who, 'content': q.scrubbed}} AS c FROM placed q WHERE q.room = p.room AND q.place < p.place AND q.place >= p.place - {context})), [])" if context else "CAST([] AS STRUCT(seq BIGINT, actor VARCHAR, content VARCHAR)[])"
    return f"""placed AS (SELECT *, {_SCRUBBED} AS scrubbed, row_number() OVER (PARTITION BY room ORDER BY seq) AS place FROM posts),
  s0 AS (SELECT p.room, p.seq, p.who AS actor, p.role, {_HANDLES} AS hs, list_filter(hs, lambda x, i: list_position(hs, x) = i) AS addressed_to, {before} AS context_before, p.scrubbed AS content, trace_digest,
      'sample-' || substr(sha256('salt|' || trace_digest || '|' || seq), 1, 16) AS sample_id, 'episode-' || substr(sha256('salt|' || trace_digest), 1, 12) AS episode_id FROM placed p JOIN trace USING (room)),
  samples AS (SELECT *, 'sha256:' || sha256(to_json({{'actor': actor, 'addressed_to': addressed_to, 'choices': {choices}, 'codebook': 'ten_modes', 'content': content, 'context_before': context_before, 'episode_id': episode_id, 'sample_id': sample_id, 'schema': '{audit.SCHEMA_TAG}', 'seq': seq}})) AS digest,
      sha256('salt:order:' || sample_id) AS sort_key FROM s0 WHERE role = 'agent')"""


_RATED = f"""WITH {FLAGGED}, {DIGESTS}, {_samples(0, CHOICES)}, rated AS (SELECT s.sample_id, s.room, s.seq, CASE WHEN hedge AND accept THEN [] ELSE list_filter([CASE WHEN ask THEN 'B1' END, CASE WHEN push THEN 'D1' END, CASE WHEN accept THEN 'R1' END], lambda x: x IS NOT NULL) END AS la,
    CASE WHEN hedge AND done THEN [] ELSE list_filter([CASE WHEN ask THEN 'B1' END, CASE WHEN upload THEN 'D1' END, CASE WHEN done THEN 'R1' END], lambda x: x IS NOT NULL) END AS lb, CASE WHEN hedge AND accept THEN ['R1'] ELSE [] END AS ua, CASE WHEN hedge AND done THEN ['R1'] ELSE [] END AS ub FROM samples s JOIN flagged f USING (room, seq)),
  differ AS (SELECT *, la <> lb OR len(ua) > 0 OR len(ub) > 0 AS open FROM rated)"""
_BY_LABEL = """(SELECT label, count_if(NOT un) AS decisions, count_if(a) AS positives_a, count_if(b) AS positives_b, count_if(un) AS uncertain_excluded, count_if(NOT un AND a AND b) AS ab, count_if(NOT un AND a AND NOT b) AS oa, count_if(NOT un AND b AND NOT a) AS ob FROM (
  SELECT l.label, list_contains(la, l.label) AS a, list_contains(lb, l.label) AS b, list_contains(ua, l.label) OR list_contains(ub, l.label) AS un FROM rated, (SELECT unnest(['B1', 'D1', 'R1']) AS label) l) GROUP BY label)"""
_P = "(ab + decisions - ab - oa - ob) / decisions"
_E = "((ab + oa) / decisions * (ab + ob) / decisions + (1 - (ab + oa) / decisions) * (1 - (ab + ob) / decisions))"
_GREEDY = f"""{_REC}, pairs AS (SELECT room, a, b, CASE WHEN same THEN 1 + j ELSE j END AS score FROM cand WHERE same OR j >= 0.5),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, a, b) AS r FROM pairs),
  walk AS (SELECT DISTINCT room, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ta, CAST([] AS BIGINT[]) AS tb, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS score FROM ranked
    UNION ALL SELECT k.room, k.r, CASE WHEN free THEN list_append(ta, k.a) ELSE ta END, CASE WHEN free THEN list_append(tb, k.b) ELSE tb END, CASE WHEN free THEN k.a END, CASE WHEN free THEN k.b END, CASE WHEN free THEN k.score END
    FROM (SELECT k.*, w.ta, w.tb, NOT list_contains(w.ta, k.a) AND NOT list_contains(w.tb, k.b) AS free FROM walk w JOIN ranked k ON k.room = w.room AND k.r = w.r + 1) k)"""
_VAL = """val AS (SELECT room_id AS room, record, incident_id AS id, CASE WHEN regexp_replace(lower(class), '[^\\p{L}]', '', 'g') IN ('unsaid', 'unreceived', 'misread', 'disagreement', 'ungrounded', 'stalled') THEN regexp_replace(lower(class), '[^\\p{L}]', '', 'g') END AS class,
    CASE WHEN severity BETWEEN 1 AND 5 THEN severity END AS sev, anchor, coalesce(posts, []) AS posts, class_reason FROM incidents WHERE incident_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY room_id, incident_id, record ORDER BY annotated_at DESC NULLS LAST, annotation_id DESC) = 1)"""


def _kappa(x: str, weight: str, name: str) -> str:
    return f"""{name} AS (SELECT c.room, CASE WHEN e.exp <> 0 THEN round(1 - c.obs * c.t / e.exp, 3) END AS {name} FROM (SELECT room, sum(n) AS t, sum(n * {weight}) AS obs FROM {x} GROUP BY room) c
      JOIN (SELECT room, sum(na * nb * {weight}) AS exp FROM (SELECT room, i, sum(n) AS na FROM {x} GROUP BY ALL) JOIN (SELECT room, j, sum(n) AS nb FROM {x} GROUP BY ALL) USING (room) GROUP BY room) e USING (room))"""


ORACLE = {
    "audit_trace_digests": f"WITH {POSTS}, {DIGESTS} SELECT room, trace_digest FROM trace",
    "audit_samples": f"WITH {POSTS}, {DIGESTS}, {_samples(8, ['R1', 'B1', 'D1'])} SELECT sample_id, episode_id, room, seq, actor, len(context_before) AS n_context, digest, sort_key FROM samples",
    "audit_pairs": _RATED + " SELECT sample_id, la, lb, ua, ub FROM rated",
    "audit_compare": _RATED + f" SELECT label, decisions, positives_a, positives_b, uncertain_excluded, round_even(({_P} - {_E}) / nullif(1 - {_E}, 0), 4) AS kappa FROM {_BY_LABEL}",
    "audit_report": _RATED + " SELECT count(*) AS samples, count(DISTINCT episode_id) AS episodes, count_if(la = lb AND len(ua) = 0 AND len(ub) = 0) AS agreed, count_if(open) AS to_adjudicate, round_even(count_if(NOT open) / count(*), 4) AS exact_agreement FROM differ JOIN samples USING (sample_id)",
    "audit_final": _RATED + " SELECT sample_id, room, seq, list_filter(['B1', 'D1', 'R1'], lambda c: list_contains(CASE WHEN open THEN list_concat(la, lb) ELSE la END, c)) AS labels, open AS adjudicated FROM differ",
    "audit_problems": _RATED + " SELECT sample_id, 'not adjudicated' AS problem FROM differ WHERE open AND len(la) = 0",
    "judged_accounting": f"""WITH {_VAL}, used AS (SELECT room, id, count(*) AS n FROM (SELECT room, unnest(['A:' || id, 'B:' || id]) AS id FROM val WHERE record = 'C' UNION ALL SELECT room, 'A:' || id FROM val WHERE record = 'D') GROUP BY ALL),
      want AS (SELECT DISTINCT room, record || ':' || id AS id FROM val WHERE record IN ('A', 'B'))
      SELECT coalesce(w.room, u.room) AS room, coalesce(w.id, u.id) AS id, CASE WHEN u.n IS NULL THEN 'neither kept nor rejected' WHEN w.id IS NULL THEN 'does not exist' ELSE 'used twice' END AS problem FROM want w FULL JOIN used u ON w.room = u.room AND w.id = u.id WHERE u.n IS NULL OR w.id IS NULL OR u.n > 1""",
    "sweep_gaps": f"""WITH {POSTS}, {_VAL}, ag AS (SELECT room, seq FROM posts WHERE role = 'agent'), sw AS (SELECT room, anchor AS seq, id, class_reason AS note FROM val WHERE record = 'B' AND anchor IS NOT NULL), li AS (SELECT DISTINCT room, id, unnest(posts) AS seq FROM val WHERE record = 'A')
      SELECT room, seq, 'missing' AS problem FROM ag WHERE (room, seq) NOT IN (SELECT (room, seq) FROM sw) UNION SELECT room, seq, 'more than once' FROM sw GROUP BY room, seq HAVING count(*) > 1
      UNION SELECT room, seq, 'no such post' FROM sw WHERE (room, seq) NOT IN (SELECT (room, seq) FROM posts) UNION SELECT room, seq, 'no note' FROM sw WHERE trim(coalesce(note, '')) = ''
      UNION SELECT room, seq, 'names an incident that doesn''t include it' FROM sw WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.room = sw.room AND li.id = sw.id AND li.seq = sw.seq)
      UNION SELECT li.room, li.seq, 'an incident includes it, the entry doesn''t say so' FROM li JOIN ag USING (room, seq) WHERE NOT EXISTS (SELECT 1 FROM sw WHERE li.room = sw.room AND li.id = sw.id AND li.seq = sw.seq)""",
    "grade_gaps": f"""WITH {_VAL} SELECT room, id AS "index" FROM val a WHERE record = 'A' AND sev * 20 < 100 AND NOT EXISTS (SELECT 1 FROM val b WHERE b.record = 'C' AND b.room = a.room AND b.id = a.id)""",
    "board_view": f"""WITH {LINKED}, {WAKES}, r AS (SELECT min(room) AS room FROM posts), p AS (SELECT * FROM posts WHERE room = (SELECT room FROM r) AND seq <= 20), w AS (SELECT * FROM turns WHERE room = (SELECT room FROM r) AND end_ms <= (SELECT arg_max(at_ms, seq) FROM p))
      SELECT 'posts' AS relation, count(*) AS n FROM p UNION ALL SELECT 'wakes', count(*) FROM w UNION ALL SELECT 'ops', count(*) FROM ops o WHERE EXISTS (SELECT 1 FROM w WHERE w.room = o.room AND w.who = o.who AND w.turn = o.turn)
      UNION ALL SELECT 'checks', count(*) FROM (SELECT DISTINCT * FROM checks) WHERE room_id = (SELECT room FROM r) AND coalesce(sequence, 0) <= 20 UNION ALL SELECT 'seats', (SELECT count(*) FROM ({{seats}}) WHERE room = (SELECT room FROM r))""",
    "incident_matches": f"WITH RECURSIVE {_GREEDY} SELECT room, a, b, score FROM walk WHERE a IS NOT NULL",
    "incident_agreement": f"""WITH RECURSIVE {_GREEDY}, {_VAL}, m AS (SELECT w.room, x.class AS ca, y.class AS cb, x.sev AS sa, y.sev AS sb FROM walk w JOIN val x ON x.room = w.room AND x.id = w.a AND x.record = 'A' JOIN val y ON y.room = w.room AND y.id = w.b AND y.record = 'B' WHERE w.a IS NOT NULL),
      cc AS (SELECT room, ca AS i, cb AS j, count(*) AS n FROM m WHERE ca IS NOT NULL AND cb IS NOT NULL GROUP BY ALL), cs AS (SELECT room, sa AS i, sb AS j, count(*) AS n FROM m WHERE sa IS NOT NULL AND sb IS NOT NULL GROUP BY ALL),
      {_kappa("cc", "CAST(i <> j AS DOUBLE)", "class_kappa")}, {_kappa("cs", "((i - j) * (i - j) / 16)", "severity_weighted_kappa")},
      s AS (SELECT room, count_if(record = 'A') AS n_a, count_if(record = 'B') AS n_b, round(avg(sev) FILTER (record = 'A'), 2) AS mean_a, round(avg(sev) FILTER (record = 'B'), 2) AS mean_b FROM val WHERE record IN ('A', 'B') GROUP BY room),
      mm AS (SELECT room, count(*) AS matched, count_if(ca = cb) AS same FROM m GROUP BY room)
      SELECT s.room, n_a, n_b, mean_a, mean_b, coalesce(matched, 0) AS matched, coalesce(same, 0) AS matched_same_class, class_kappa, severity_weighted_kappa, CASE WHEN n_a + n_b > 0 THEN round(2 * coalesce(same, 0) / (n_a + n_b), 3) END AS incident_f1
      FROM s LEFT JOIN mm USING (room) LEFT JOIN class_kappa USING (room) LEFT JOIN severity_weighted_kappa USING (room)""",
}
ORACLE["board_view"] = ORACLE["board_view"].replace("{seats}", BOARD["board_seats"])
