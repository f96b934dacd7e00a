"""How a load is written: what of its records, in which tasks, and which tables at a time."""

from __future__ import annotations

import threading

import pytest

from cohortspark import session
from cohortspark.operators import cdm
from cohortspark.plans import tables as t

SF = "/root/testdata/sf0.001"


def test_a_load_stores_what_it_reads_of_its_records(spark):
    records, built = t.written_load(spark, SF)
    assert records.columns == cdm.LOAD_INPUTS
    assert records.count() == t.records(spark, SF).count()
    plain = cdm.build(t.records(spark, SF))
    for name, table in vars(built).items():
        expected = getattr(plain, name)
        assert table.columns == expected.columns
        assert not table.exceptAll(expected).take(1) and not expected.exceptAll(table).take(1)


def test_event_tables_are_written_side_by_side(spark, monkeypatch):
    """Each writer waits for all others; one after another they would never meet."""
    meeting = threading.Barrier(6, timeout=60)
    monkeypatch.setattr(t, "written", lambda df, name: meeting.wait() >= 0 and df)
    built = cdm.Cdm(*[spark.range(n) for n in range(6)])
    assert [df.count() for df in vars(t.written_together(built)).values()] == list(range(6))


def test_records_are_cut_finer_only_while_a_load_is_written(spark):
    files, shuffle = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = [spark.conf.get(key) for key in (files, shuffle)]
    spark.conf.set(shuffle, "1m")
    try:
        with pytest.raises(ZeroDivisionError), session.smaller_tasks(spark):
            inside = [session.in_bytes(spark.conf.get(key)) for key in (files, shuffle)]
            1 / 0
        assert inside == [16 << 20, 1 << 20]
        assert [spark.conf.get(files), spark.conf.get(shuffle)] == [before[0], "1m"]
    finally:
        spark.conf.set(shuffle, before[1])
    assert [session.in_bytes(x) for x in ("134217728b", "64MB", "8m", "1g", "77")] == [1 << 27, 1 << 26, 1 << 23, 1 << 30, 77]
