"""What a gated load reads and writes before it is refused, and how it knows that its persons are as called for."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortspark import session
from cohortspark.operators import cdm, checks, load, publish
from cohortspark.plans import queries
from cohortspark.plans import tables as t
from cohortspark.sources.proxy import PROXY_SETTINGS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    return t.written_load(spark, SF)


@pytest.fixture(scope="module")
def staged(spark):
    return session.written(t.staged(spark, SF), "staged")


def gated(spark, staged, target, added=0, concepts=None):
    counts = queries._replaced(queries._load_counts(staged), row_count=f"row_count + {added}")
    return load.gated_load(
        staged, target, t.concepts(spark) if concepts is None else concepts, t.code_map(spark),
        queries._vocabularies(spark), counts, t.files_of(staged), "v1", PROXY_SETTINGS,
    )


def refuse_to_write(*given, **named):
    raise AssertionError("a load that its records refuse has no tables")


def test_a_load_that_its_records_refuse_writes_nothing(spark, staged, monkeypatch):
    monkeypatch.setattr(load, "written", refuse_to_write)
    monkeypatch.setattr(load.cdm, "build", refuse_to_write)
    target = session.run_path(spark, "refused")
    for given, added, reason in (
        (queries.damaged(staged), 0, "unloadable: "),
        (staged.unionByName(staged.filter("source_row % 1000 = 7")), 0, "keys: {'records': 2}"),
        (staged, 1, "staging_rows_not_load_counts: 7"),
    ):
        with pytest.raises(checks.LoadRefused, match=f"^{reason}"):
            gated(spark, given, target, added)


def test_records_are_stored_once_and_a_refused_load_leaves_them(spark, staged, monkeypatch):
    names = []
    monkeypatch.setattr(load, "written", lambda df, name: names.append(name) or session.written(df, name))
    target = session.run_path(spark, "gated")
    path = gated(spark, staged, target)
    assert sorted(names) == ["location_keys", "ranked"]
    held = publish.commits.snapshot(spark, target)
    assert held.entries == {name: f"{path}/{name}" for name in ("records", *cdm.Cdm.__dataclass_fields__)}
    assert publish.current(spark, target, ["records"])["records"].count() == staged.count()
    with pytest.raises(checks.LoadRefused, match="^concept_not_in_vocabulary:measurement: 1; concept_not"):
        gated(spark, staged, target, concepts=t.concepts(spark).filter("concept_id <> 32879"))
    build = cdm.build
    lost = lambda *a, **k: replace(built := build(*a, **k), measurement=built.measurement.filter("measurement_id <> 4"))
    monkeypatch.setattr(load.cdm, "build", lost)
    with pytest.raises(checks.LoadRefused, match="^mother_without_three_measurements: 1$"):
        gated(spark, staged, target)
    assert publish.commits.snapshot(spark, target) == held


def test_a_clean_load_is_as_its_records_call_for(stored):
    records, built = stored
    assert checks.unlike_records(built, records).count() == 0


MOTHER = "person_id % 97 = 5 AND person_id < 10000000000000000"
NEWBORN = "person_id % 97 = 5 AND person_id > 10000000000000000"


def changed(**columns):
    """Some rows with other values, by a test."""

    def change(df):
        return queries._replaced(df, **{c: f"if({test}, {value}, {c})" for c, (test, value) in columns.items()})

    return change


def lost(test):
    return lambda df: df.filter(f"NOT ({test})")


def doubled(test):
    return lambda df: df.unionByName(df.filter(test))


LINK = "fact_id_1 % 97 = 5"
NULL_DAY = "CAST(NULL AS date)"
DAMAGES = [
    ("person", lost(MOTHER)),
    ("person", lost(NEWBORN)),
    ("person", doubled(NEWBORN)),
    ("person", changed(person_id=(NEWBORN, "person_id + 1"))),
    ("person", changed(person_id=(NEWBORN, "NULL"))),
    ("person", changed(day_of_birth=(NEWBORN, "pmod(day_of_birth, 28) + 1"))),
    ("person", changed(day_of_birth=(NEWBORN, "NULL"))),
    # the same number of ten thousands, hundreds and ones, but no date
    ("person", changed(year_of_birth=(NEWBORN, "year_of_birth - 1"), month_of_birth=(NEWBORN, "month_of_birth + 100"))),
    ("observation_period", lost(MOTHER)),
    ("observation_period", doubled(MOTHER)),
    ("observation_period", changed(observation_period_start_date=(MOTHER, "date_sub(observation_period_start_date, 1)"))),
    ("observation_period", changed(observation_period_end_date=(NEWBORN, NULL_DAY))),
    ("observation_period", changed(observation_period_id=(NEWBORN, "7"))),
    ("measurement", lost("measurement_id = 5")),
    ("measurement", doubled(NEWBORN)),
    ("measurement", changed(measurement_date=("measurement_id = 5", "date_add(measurement_date, 1)"))),
    ("measurement", changed(measurement_date=("measurement_id = 5", NULL_DAY))),
    ("measurement", changed(person_id=("measurement_id = 5", "-1"))),
    ("observation", lost("observation_id = 5")),
    ("observation", changed(person_id=("observation_id = 5", "person_id + 10000000000000000"))),
    ("observation", changed(observation_date=("observation_id = 5", "date_sub(observation_date, 1)"))),
    ("fact_relationship", lost(LINK)),
    ("fact_relationship", doubled(LINK)),
    ("fact_relationship", changed(fact_id_1=(LINK, "NULL"))),
    ("fact_relationship", changed(fact_id_2=(LINK, "NULL"))),
    ("fact_relationship", changed(fact_id_2=(LINK, "fact_id_2 + 1"))),
    ("fact_relationship", changed(relationship_concept_id=(LINK, "999"))),
    ("fact_relationship", changed(domain_concept_id_1=(LINK, "domain_concept_id_1 + 1"))),
    ("fact_relationship", changed(domain_concept_id_2=(LINK, "CAST(NULL AS int)"))),
]


def test_every_damage_of_a_person_is_found(spark, stored):
    """Each damage on a load of its own."""
    records, built = stored
    for name, damage in DAMAGES:
        broken = replace(built, **{name: damage(getattr(built, name))})
        assert not checks.unlike_records(broken, records).isEmpty(), (name, damage)


def test_records_that_share_a_person_are_found(stored):
    records, _ = stored
    twice = records.unionByName(records.filter("source_row % 100 = 7"))
    assert checks.unlike_records(cdm.build(twice), twice).count() > 0


def test_many_rows_of_a_kind_do_not_read_as_another(spark, stored):
    """256 rows of a person count as a row of the next kind does, but are more rows."""
    records, built = stored
    one = built.person.filter(NEWBORN).limit(1)
    many = built.person.unionByName(one.crossJoin(spark.range(256)).drop("id"))
    less = built.observation_period.join(one.select("person_id"), "person_id", "left_anti").select(built.observation_period.columns)
    broken = replace(built, person=many, observation_period=less)
    assert checks.unlike_records(broken, records).count() == 1


def test_checks_known_to_hold_are_given_as_zeros(spark, stored):
    records, built = stored
    inputs = (
        t.concepts(spark), t.code_map(spark), queries._vocabularies(spark), queries._load_counts(records),
        cdm.cdm_source(t.source_files(spark, SF), "v1"),
    )
    plain, known = (
        {r.rule: r.violations for r in checks.post_load_checks(built, records, *inputs, as_called_for=known).collect()}
        for known in (False, True)
    )
    assert plain == known and len(known) == 28 and set(checks.PERSON_RULES) < known.keys()
    assert set(known.values()) == {0}


def test_concepts_are_made_into_rows_after_they_are_distinct(spark):
    """Six concepts of each of a thousand rows are a row a column only once."""
    table = spark.range(1000).select(*[F.lit(i).alias(c) for i, c in enumerate(checks.CONCEPT_COLUMNS["measurement"])])
    plan = checks.distinct_concepts({"measurement": table})._jdf.queryExecution().sparkPlan().toString()
    assert plain_order(plan) == ["HashAggregate", "HashAggregate", "Generate", "HashAggregate", "HashAggregate"]


def plain_order(plan: str) -> list[str]:
    return [word for line in plan.splitlines() for word in ("HashAggregate", "Generate") if f"{word}(" in line or f"{word} explode" in line]
