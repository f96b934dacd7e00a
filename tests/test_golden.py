"""Hand-worked registries through the whole path, from raw text and from the event tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from cohortspark.catalogue import CODE_MAP, SETTINGS, VOCABULARY_TARGETS
from cohortspark.functions import exposure
from cohortspark.operators import cdm, checks, counts, funnel, typed
from cohortspark.plans import tables as t


def exits_of(spark, years, *parts, from_cdm=False):
    records = typed.typed_records(fx.staged(spark, *parts))
    if from_cdm:
        built = cdm.build(records, bucket_rows=3)
        subjects = funnel.criteria_from_cdm(built, None, years)
        out = (
            records.filter("NOT loaded")
            .groupBy("source_year")
            .agg(F.expr("count(*) AS n"))
            .withColumn("loaded", F.lit(False))
        )
        return funnel.exit_summary(funnel.exits(subjects)).unionByName(
            out, allowMissingColumns=True
        )
    return funnel.exit_summary(funnel.exits(funnel.criteria(records, years)))


def steps(summary, definition, year=2023):
    rows = (
        funnel.attrition(summary)
        .filter(f"cohort_definition_id = {definition} AND source_year = {year}")
        .orderBy("step")
        .collect()
    )
    assert [r.step for r in rows] == list(range(len(rows)))
    return [(r.remaining, r.excluded) for r in rows]


COUNTS = {1: 8, 2: 10, 3: 11, 4: 11, 5: 11, 6: 9}


@pytest.mark.parametrize("from_cdm", [False, True])
def test_steps_of_every_definition(spark, from_cdm):
    found = exits_of(spark, (fx.YEAR,), (fx.YEAR, fx.records()), from_cdm=from_cdm)
    for definition, count in COUNTS.items():
        if definition == 1 or not from_cdm:
            assert steps(found, definition, fx.YEAR) == fx.remaining(definition, count), definition


def test_two_years_and_one_without_records(spark):
    parts = ((fx.YEAR, fx.records()), (2020, [fx.typical(born="01/02/2020")] * 3))
    found = exits_of(spark, (fx.YEAR, 2020), *parts)
    assert steps(found, 2, fx.YEAR) == fx.remaining(2, 10)
    assert steps(found, 2, 2020) == [(3, None)] + [(3, 0)] * 9
    rows = funnel.attrition(found, years=spark.createDataFrame([(2021,)], "source_year int"))
    empty = rows.filter("source_year = 2021").collect()
    assert len(empty) == sum(COUNTS.values()) and {r.remaining for r in empty} == {0}


def test_cohort_rows(spark):
    records = typed.typed_records(fx.staged(spark, (fx.YEAR, fx.records())))
    rows = funnel.cohort(funnel.exits(funnel.criteria(records, (fx.YEAR,)))).collect()
    kept = {}
    for r in rows:
        kept.setdefault(r.cohort_definition_id, set()).add(r.subject_id % SETTINGS.ids.rows_per_year)
    for definition in fx.DEFINITIONS:
        want = {n for n, (_, exits) in enumerate(fx.RECORDS, 1) if exits[definition] is None}
        assert kept[definition] == want


def test_excluded_profile(spark):
    """Shares of the births before a step, counted again from the records."""
    found = exits_of(spark, (fx.YEAR,), (fx.YEAR, fx.records()))
    rows = [r for r in funnel.excluded_profile(found).collect() if r.cohort_definition_id == 1]
    for r in rows:
        gone = r.subject_group == "excluded"
        births = [
            record
            for record, exits in fx.RECORDS
            if (exits[1] == r.step if gone else exits[1] is None or exits[1] > r.step)
        ]
        assert r.births == len(births)
    assert {(r.step, r.subject_group) for r in rows} >= {(4, "excluded"), (5, "retained")}


def test_exposure_rows(spark):
    records = typed.typed_records(fx.staged(spark, (fx.YEAR, fx.records())))
    rows = exposure.exposure_rows(funnel.exits(funnel.criteria(records, (fx.YEAR,)))).collect()
    found = {r.subject_id % SETTINGS.ids.rows_per_year: tuple(r)[1:] for r in rows}
    for n, (record, exits) in enumerate(fx.RECORDS, 1):
        if exits[1] == 1:
            assert n not in found
            continue
        visits, trimester, level, first = found[n]
        known = record["visits"] not in (None, "99")
        assert visits == (int(record["visits"]) if known else None)
        assert trimester == (int(record["start"]) if record["start"] in list("0123") else None)
        bands = ((0, "0"), (4, "1-4"), (7, "5-7"), (90, "8+"))
        assert level == (next(name for top, name in bands if visits <= top) if known else None)
        assert first == (None if trimester is None else trimester == 1)


def test_values_and_rules(spark):
    for field, cases in fx.ODD_VALUES.items():
        rows = [fx.typical(**{field: text}) for text, _ in cases]
        found = typed.typed_records(fx.staged(spark, (fx.YEAR, rows))).orderBy("source_row")
        assert [r[0] for r in found.select(field).collect()] == [value for _, value in cases]
        count = {
            r.rule: r.row_count
            for r in typed.rule_counts(found).filter("cdm_table <> 'person'").collect()
        }
        assert count["rows"] == len(cases)


def test_dates(spark):
    texts = ["29/02/2020", "29/02/2019", "31/04/2019", "01/01/0000", "01/01/0001", "1/1/2019", "2019-01-01"]
    rows = [fx.typical(born=text) for text in texts]
    found = typed.typed_records(fx.staged(spark, (fx.YEAR, rows))).orderBy("source_row").collect()
    assert [r.delivery_date is not None for r in found] == [True, False, False, False, True, False, False]


def test_ids_stay_apart_above_ten_million_rows(spark):
    from cohortspark.sources.proxy import PROXY_SETTINGS

    staged = fx.staged(spark, (1995, [fx.typical()]), (1996, [fx.typical()]))
    rows = [10**7, 10**7 + 1, 2 * 10**7, 10**11]
    frame = staged.withColumn("source_row", F.explode(F.array(*[F.lit(n).cast("long") for n in [1, *rows]])))
    found = typed.typed_records(frame, PROXY_SETTINGS)
    inside = found.filter("source_row < 100000000000").select("person_id", "newborn_person_id").collect()
    ids = [i for r in inside for i in r]
    assert len(set(ids)) == len(ids) == 16
    refused = typed.unloadable(found, PROXY_SETTINGS).collect()
    assert {(r.source_row, r.problem) for r in refused} == {(10**11, "source_row does not fit person_id")}
    narrow = typed.unloadable(typed.typed_records(frame)).filter("problem LIKE 'source_row%'")
    assert narrow.count() == 8


def test_load(spark):
    later = [fx.typical(born="01/02/2020", state="09"), fx.typical(born="03/02/2020", state="31")]
    parts = ((fx.YEAR, fx.records()), (2020, later))
    records = typed.typed_records(fx.staged(spark, *parts)).cache()
    built = cdm.build(records, bucket_rows=4).map(lambda name, df: df.cache())
    loaded = {
        fx.YEAR: sum(exits[1] != 1 for _, exits in fx.RECORDS),
        2020: 2,
    }
    rows = {
        (r.source_year, r.cdm_table, r.rule): r.row_count
        for r in counts.table_rows(built, records, SETTINGS.ids).collect()
    }
    for year, n in loaded.items():
        assert rows[year, "person", "rows:mother"] == rows[year, "person", "rows:newborn"] == n
        assert rows[year, "measurement", "rows"] == rows[year, "observation", "rows"] == 4 * n
        assert rows[year, "fact_relationship", "rows"] == 2 * n
    ids = [r[0] for r in built.measurement.select("measurement_id").orderBy("person_id", "measurement_id").collect()]
    assert ids == list(range(1, 4 * sum(loaded.values()) + 1))
    source = cdm.cdm_source(
        spark.createDataFrame(
            [(2020, "late.csv", "7", "d2", "2021-03-04"), (fx.YEAR, "first.csv", "3", "d1", "2020-03-04")],
            "source_year int, name string, version string, sha256 string, retrieved string",
        ),
        "v",
    )
    assert source.first().source_description == (
        "Record files loaded: 2019: first.csv?V=3, sha256 d1; 2020: late.csv?V=7, sha256 d2"
    )
    staged = spark.createDataFrame(
        [(fx.YEAR, "table", len(fx.RECORDS)), (2020, "table", 2)],
        "source_year int, stage string, row_count bigint",
    )
    vocabularies = spark.createDataFrame([(v,) for v in VOCABULARY_TARGETS], "vocabulary_id string")
    found = checks.post_load_checks(
        built, records, t.concepts(spark), cdm.code_map_table(spark, CODE_MAP, VOCABULARY_TARGETS),
        vocabularies, staged, source,
    ).collect()
    assert len(found) == len({r.rule for r in found}) == 28
    assert {r.violations for r in found} == {0}


def test_unloadable(spark):
    records = [
        fx.typical(born="31/02/2023"), fx.typical(born=None), fx.typical(school="1" * 51), fx.typical(),
        fx.typical(weeks="12345678901234567890123456789012345678901234567"),
    ]
    found = typed.typed_records(fx.staged(spark, (2023, records)))
    rows = typed.first_with_total(typed.unloadable(found), ["source_row"]).collect()
    assert [(r.source_row, r.total) for r in rows] == [(1, 3), (2, 3), (3, 3)]
    assert rows[0].problem == "FECHANACIMIENTO '31/02/2023' is not a valid dd/mm/yyyy date"
    assert rows[1].problem == "FECHANACIMIENTO blank is not a valid dd/mm/yyyy date"
    weeks = found.filter("source_row = 5").first()
    assert (weeks.weeks_rule, weeks.weeks) == ("too_long", None)


def test_refused_load_keeps_the_previous_one(spark):
    from cohortspark.operators import publish
    from cohortspark.session import run_path

    target = run_path(spark, "current")
    good, bad = spark.range(3), spark.range(9)

    def check(tables):
        if tables["t"].count() > 5:
            raise checks.LoadRefused("too many rows")

    publish.load_and_promote({"t": good}, check, target, spark)
    with pytest.raises(checks.LoadRefused):
        publish.load_and_promote({"t": bad}, check, target, spark)
    assert publish.current(spark, target, ["t"])["t"].count() == 3
