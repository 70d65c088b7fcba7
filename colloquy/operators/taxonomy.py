"""The catalog of failure patterns, ways to group it, and the kickstart detector that reports under any of them.

The tables are small and fixed; they are literals in the plan and are joined as broadcasts of that fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.patterns import has
from colloquy.functions.text import cites, redact
from colloquy.operators.board import agent_posts

KINDS = ("missing", "wrong", "timing", "excess")
# Identifiers, names and kinds of the patterns; the descriptions are ours.
PATTERNS = [
    ("R1", "Open-set decay", "missing", "takes up an item that the board shows as settled"),
    ("R2", "Replacement re-does work", "missing", "a late seat takes up what was settled before it came"),
    ("REP", "Step repetition", "excess", "says nearly the same again"),
    ("B1", "Belief without commitment", "wrong", "an ask or a half promise that nobody takes on"),
    ("B2", "Identity drift", "wrong", "who is who, or who leads, is unclear"),
    ("D1", "Unattested action", "wrong", "reports an act that the record doesn't show"),
    ("D2", "Review of nothing", "wrong", "reviews what was not delivered or not read"),
    ("D3", "Closure before budget", "timing", "the board ends with work open"),
    ("D4", "Capability not routed", "missing", "asks the holder to act and doesn't take over"),
    ("HB", "Heartbeat cost", "excess", "posts that only say that nothing is new"),
    ("withheld_information", "Withheld information", "missing", "knows what others need and doesn't say it"),
    ("unannounced_delivery", "Unannounced delivery", "missing", "delivers without telling"),
    ("unasked_question", "Unasked question", "missing", "goes on in doubt without asking"),
    ("late_disclosure", "Late disclosure", "timing", "says it when it no longer helps"),
    ("verbosity", "Verbosity", "excess", "says far more than is needed"),
    ("silent_drop", "Silent drop", "missing", "lets a task fall without a word"),
    ("misrouted_post", "Misrouted post", "wrong", "tells the wrong seat"),
    ("missed_post", "Missed post", "missing", "never takes in a post that was there"),
    ("crossed_posts", "Crossed posts", "timing", "two seats write past each other"),
    ("stale_act", "Stale act", "timing", "acts on an old state"),
    ("premature_final", "Premature final", "timing", "declares the end too early"),
    ("stale_review", "Stale review", "timing", "reviews an old version"),
    ("duplicate_delivery", "Duplicate delivery", "excess", "delivers what another delivered"),
    ("over_reading", "Over-reading", "excess", "reads more into a post than it says"),
    ("buried_signal", "Buried signal", "excess", "the point is lost among other matter"),
    ("ambiguous_reference", "Ambiguous reference", "wrong", "it is unclear what a post refers to"),
    ("status_word_mismatch", "Status-word mismatch", "wrong", "a status word means different things to two seats"),
    ("divergent_assumptions", "Divergent assumptions", "missing", "seats assume different things and don't notice"),
    ("term_drift", "Term drift", "timing", "a term changes its meaning on the way"),
    ("conflicting_authority", "Conflicting authority", "wrong", "two seats decide the same matter"),
    ("undeclared_decision", "Undeclared decision", "missing", "decides without telling"),
    ("off_spec_delivery", "Off-spec delivery", "wrong", "delivers something other than agreed"),
    ("workspace_race", "Workspace race", "timing", "two seats change the same thing at once"),
    ("error_cascade", "Error cascade", "missing", "an error is passed on unchecked"),
    ("overwrite", "Overwrite", "excess", "destroys another's work"),
    ("deliberation_stall", "Deliberation stall", "missing", "talks on and decides nothing"),
    ("waiting_cycle", "Waiting cycle", "wrong", "seats wait for each other"),
    ("claim_without_action", "Claim without action", "missing", "claims a task and does nothing for it"),
    ("never_closes", "Never closes", "missing", "is done and doesn't end"),
    ("runs_on_after_done", "Runs on after done", "excess", "works on after the end"),
    ("redundant_verification", "Redundant verification", "excess", "checks again what is checked"),
    ("anchoring", "Anchoring", "wrong", "the first proposal wins without being weighed"),
    ("injection", "Injection", "wrong", "a text smuggles in orders"),
]
# The groups of each choice, with the patterns they hold.
CHOICES = {
    "ten_modes": {"not_read": "R1 R2 REP", "not_binding": "B1 B2", "never_done": "D1 D2 D3 D4 HB"},
    "state_gap": {
        "unsaid": "withheld_information unannounced_delivery unasked_question late_disclosure",
        "unreceived": "silent_drop misrouted_post missed_post crossed_posts stale_act premature_final stale_review duplicate_delivery",
        "misread": "R1 R2 over_reading buried_signal",
        "disagreement": "B1 B2 ambiguous_reference status_word_mismatch divergent_assumptions term_drift conflicting_authority undeclared_decision",
        "ungrounded": "D1 D2 off_spec_delivery workspace_race error_cascade overwrite",
        "stalled": "D3 D4 deliberation_stall waiting_cycle claim_without_action never_closes runs_on_after_done",
        "overhead": "REP HB verbosity redundant_verification",
    },
    "decision_point": {
        "disclose": "withheld_information unannounced_delivery unasked_question late_disclosure",
        "claim": "R1 R2 B1 B2 D4 conflicting_authority",
        "specify": "divergent_assumptions term_drift ambiguous_reference premature_final over_reading anchoring",
        "hand_off": "silent_drop misrouted_post missed_post crossed_posts stale_act stale_review workspace_race duplicate_delivery buried_signal overwrite",
        "report_and_verify": "D1 D2 status_word_mismatch error_cascade off_spec_delivery",
        "progress_and_close": "D3 deliberation_stall waiting_cycle claim_without_action undeclared_decision never_closes runs_on_after_done",
        "overhead": "REP HB verbosity redundant_verification",
    },
}
COMPLETE = ("state_gap", "decision_point")
OUT_OF_SCOPE = {"state_gap": ("anchoring", "injection"), "decision_point": ("injection",), "ten_modes": ()}
REMOVED_BY = {"R1": "view", "R2": "view", "REP": "view", "B1": "naming", "B2": "check", "D1": "check", "D2": "check", "D3": "none", "D4": "none", "HB": "none"}
SIGNALS = {"open_question": "B1", "bare_claim": "D1"}


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "pattern string, name string, kind string, description string")


def placements(spark: SparkSession, choices: dict = CHOICES) -> DataFrame:
    """``choice, group, pattern``."""
    return spark.createDataFrame([(c, g, p) for c, gs in choices.items() for g, ps in gs.items() for p in ps.split()], "choice string, group string, pattern string")


def resolved(spark: SparkSession, choice: str) -> DataFrame:
    """A choice's modes: every placed pattern as the catalog defines it, with its group."""
    if choice not in CHOICES:
        raise KeyError(f"no taxonomy choice {choice!r}; the choices are {sorted(CHOICES)}")
    return placements(spark).where(F.col("choice") == choice).join(patterns(spark), "pattern").drop("choice")


def regroup(counts: DataFrame, choice: str) -> DataFrame:
    """Pattern counts (``pattern, n`` and any keys) summed by the groups of a choice; patterns it leaves out under null."""
    keys = [c for c in counts.columns if c not in ("pattern", "n")]
    place = F.broadcast(placements(counts.sparkSession).where(F.col("choice") == choice).select("pattern", "group"))  # fixed size
    return counts.join(place, "pattern", "left").groupBy(*keys, "group").agg(F.sum("n").alias("n"))


def check_catalog(catalog: DataFrame) -> DataFrame:
    """Problems of a catalog (``pattern, name, kind, description``): empty fields, unknown kinds, repeated ids."""
    bad = catalog.select("pattern", F.explode(F.array(
        F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name"), F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "no description"),
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind"),
    )).alias("problem")).where("problem is not null")
    return bad.unionByName(catalog.groupBy("pattern").agg(F.count("*").alias("n")).where("n > 1").select("pattern", F.lit("defined twice").alias("problem")))


def check_choice(placed: DataFrame, catalog: DataFrame, out_of_scope: DataFrame, complete: bool) -> DataFrame:
    """Problems of a choice: unknown patterns, patterns placed and left out, and, if complete, patterns not placed."""
    row = lambda df, problem: df.select("pattern", F.lit(problem).alias("problem"))
    out = row(placed.join(catalog, "pattern", "left_anti"), "not in the catalog")
    out = out.unionByName(row(out_of_scope.join(catalog, "pattern", "left_anti"), "out of scope, but not in the catalog"))
    out = out.unionByName(row(placed.join(out_of_scope, "pattern", "left_semi"), "both placed and out of scope"))
    out = out.unionByName(row(placed.groupBy("pattern").count().where("count > 1"), "placed twice"))
    if complete:
        out = out.unionByName(row(catalog.join(placed, "pattern", "left_anti").join(out_of_scope, "pattern", "left_anti"), "not placed"))
    return out


def kickstart(posts: DataFrame, choice: str = "state_gap") -> DataFrame:
    """Open questions and bare claims: ``room, seq, who, signal, pattern, group, excerpt``.

    An open question ends in a question mark and is neither replied to nor cited by any agent post; a bare claim says that something is done and
    names nothing that could be checked.
    """
    p = agent_posts(posts)
    text = F.regexp_replace("text", r"(?dU)\s+$", "")
    answered = p.select("room", F.explode(F.array_append(cites(F.col("text")), F.when(F.col("reply_to") != 0, F.col("reply_to")))).alias("seq")).where("seq is not null").distinct()
    asks = p.where(text.endswith("?")).join(answered, ["room", "seq"], "left_anti").withColumn("signal", F.lit("open_question"))
    bare = p.where(has(text, "bare_done") & ~has(text, "checkable")).withColumn("signal", F.lit("bare_claim"))
    pattern = F.create_map(*(F.lit(x) for kv in SIGNALS.items() for x in kv))
    rows = asks.unionByName(bare).select("room", "seq", "who", "signal", pattern[F.col("signal")].alias("pattern"), redact(F.col("text")).alias("excerpt"))
    place = F.broadcast(placements(posts.sparkSession).where(F.col("choice") == choice).select("pattern", "group"))  # fixed size
    return rows.join(place, "pattern")
