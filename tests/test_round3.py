"""Faults that tables of the tests' usual sizes do not show."""

from __future__ import annotations

from cohortspark.operators import checks, counts, epi, funnel
from cohortspark.plans import tables as t
from cohortspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def chosen(df) -> str:
    """The plan as it is before any stage has run."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_tables_of_events_are_not_broadcast(spark):
    """Sorted ids compress so far that the files of millions of events look small enough."""
    records, built = t.written_load(spark, "/root/testdata/sf0.001")
    for found in (
        checks.orphan_links(built),
        checks.day_checks(built, records),
        checks.outside_period(built.measurement, "measurement_date", built.observation_period, "rule"),
    ):
        assert "SortMergeJoin" in chosen(found) and "BroadcastHashJoin" not in chosen(found)
    by_person = [x for x in chosen(funnel.criteria_from_cdm(built)).splitlines() if "Join [person_id" in x]
    assert len(by_person) == 3 and all("SortMergeJoin" in x for x in by_person)


def test_crude_fits_round_as_counts_do(spark):
    """An odds ratio of 53/64 lies between two numbers of five digits."""
    keys = [*counts.FIT_KEYS, "level"]
    crude = epi.crude(counts.level_counts(t.cells(spark, SF), t.GRID), counts.FIT_KEYS)
    wanted = {tuple(r[k] for k in keys): r.odds for r in crude.selectExpr(*keys, "round(odds_ratio, 5) AS odds").collect()}
    found = {tuple(r[k] for k in keys): r.odds_ratio for r in QUERIES["crude_fits"](spark, SF).collect()}
    held = {k: v for k, v in found.items() if v is not None}
    assert len(held) > 100 and held == {k: wanted[k] for k in held}


def test_levels_are_rated_after_the_cells_are_summed(spark):
    """Cells, sums that no rating tells apart, sums of each cut-off, and analyses: an aggregation each, in two parts."""
    cells = t.cells(spark, "/root/testdata/sf0.001")
    alone, rated = chosen(cells).count("HashAggregate"), chosen(counts.level_counts(cells, t.GRID)).count("HashAggregate")
    assert rated - alone == 6


def test_published_tables_judge_the_records_once(spark, monkeypatch):
    seen, real = [], t.records
    monkeypatch.setattr(t, "records", lambda *given: seen.append(given) or real(*given))
    QUERIES["published_tables"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1
