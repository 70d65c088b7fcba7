"""No job of a query that gathers many parts is planned all at once: the driver's memory goes with the size of a plan, not with the rows."""

import boards
import pytest

from colloquy.operators import audit, board, modes, taxonomy
from colloquy.plans import board_queries, record_queries
from colloquy.sources import tables

ROWS = [(1, "a", "I'll take `x.py`"), (2, "b", "`x.py` is done, uploaded"), (3, "c", "I'll take `x.py`, can you review `y.py`?"), (4, "a", "I am the lead. LGTM `y.py`"), (5, "b", "who is this? which seat?"), (6, "c", "bye")]


@pytest.fixture
def joins(monkeypatch):
    """``of``: the joins in a plan; ``cuts``: those of the plans that were written on the way."""

    class Joins:
        cuts = []

        @staticmethod
        def of(df):
            return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    for m in (modes, board_queries, record_queries, audit):
        if hasattr(m, "cut"):
            monkeypatch.setattr(m, "cut", lambda df, cut=m.cut: (Joins.cuts.append(Joins.of(df)), cut(df))[1])
    Joins.cuts = []
    return Joins


def most(spark, joins, f):
    last = joins.of(f(modes.Modes(boards.board(spark, ROWS))))
    return max([last, *joins.cuts])


def test_mode_metrics_in_small_jobs(spark, joins):
    assert most(spark, joins, lambda m: m.metrics()) <= 4


def test_near_duplicates_in_small_jobs(spark, sf, joins):
    last = joins.of(board_queries.QUERIES["near_duplicates"](spark, sf))
    assert max([last, *joins.cuts]) <= 7


def test_audit_problems_in_small_jobs(spark, sf, joins):
    last = joins.of(record_queries.QUERIES["audit_problems"](spark, sf))
    assert max([last, *joins.cuts]) <= 7


def test_mode_evidence_in_small_jobs(spark, joins):
    assert most(spark, joins, lambda m: m.evidence()) <= 4


def test_modes_regrouped_in_small_jobs(spark, joins):
    assert most(spark, joins, lambda m: taxonomy.regroup(m.modes().selectExpr("room", "mode AS pattern", "count AS n"), "state_gap")) <= 4


def test_mode_severities_in_small_jobs(spark, joins):
    assert most(spark, joins, lambda m: m.modes()) <= 4


@pytest.mark.parametrize("name", ["mode_severities", "modes_regrouped"])
def test_modes_of_tables_in_small_jobs(spark, sf, joins, monkeypatch, name):
    if hasattr(board, "cut"):
        monkeypatch.setattr(board, "cut", lambda df, cut=board.cut: (joins.cuts.append(joins.of(df)), cut(df))[1])
    last = joins.of(board_queries.QUERIES[name](spark, sf))
    assert max([last, *joins.cuts]) <= 7


def test_near_duplicates_meet_without_a_join(spark, joins):
    last = joins.of(modes.near_duplicates(modes.flags(boards.board(spark, ROWS).posts)))
    assert last <= 2


def test_modes_regrouped_plans_no_actions_and_small_jobs(spark, sf, monkeypatch):
    """What modes don't read isn't planned, and what the posts are joined with is written before."""
    monkeypatch.setattr(board, "actions", lambda *_: pytest.fail("actions were planned"))
    sizes = []
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ")
    for m in (modes, board, tables):
        monkeypatch.setattr(m, "cut", lambda df, cut=m.cut: (sizes.append(size(df)), cut(df))[1])
    out = board_queries.QUERIES["modes_regrouped"](spark, sf)
    assert max([*sizes, size(out)]) <= 4


def test_actions_are_planned_once_they_are_read(spark):
    lines = [(1, "r1", "a", 1, 1, '{"type": "item.completed", "item": {"type": "command_execution", "command": "ls", "exit_code": 0, "aggregated_output": "x"}}')]
    b = board.from_relations(*boards.relations(spark, room=[boards.message(1, "a", "hi")], lines=lines))
    assert b.ops is b.ops and [r.command for r in b.ops.collect()] == ["ls"]
