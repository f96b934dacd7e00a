"""Checks that count what breaks a rule. Each gives rows; a clean load has none, or zeros."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.catalogue import CONCEPT_IDS, FIELD_DOMAINS, OWN_TABLE_DOMAINS
from cohortspark.functions.text import array, cases, quoted, struct
from cohortspark.operators.cdm import Cdm, links
from cohortspark.operators.counts import step_changes
from cohortspark.session import shuffled_side

#: The concept columns of each table the load writes.
CONCEPT_COLUMNS: Mapping[str, tuple[str, ...]] = {
    "person": (
        "gender_concept_id",
        "race_concept_id",
        "ethnicity_concept_id",
        "gender_source_concept_id",
    ),
    "observation_period": ("period_type_concept_id",),
    "measurement": (
        "measurement_concept_id",
        "measurement_type_concept_id",
        "operator_concept_id",
        "unit_concept_id",
        "measurement_source_concept_id",
    ),
    "observation": (
        "observation_concept_id",
        "observation_type_concept_id",
        "value_as_concept_id",
        "observation_source_concept_id",
    ),
    "fact_relationship": ("domain_concept_id_1", "domain_concept_id_2", "relationship_concept_id"),
    "location": ("country_concept_id",),
    "cdm_source": ("cdm_version_concept_id",),
    "source_to_concept_map": ("source_concept_id", "target_concept_id"),
}

LINK_COLUMNS = [
    "domain_concept_id_1",
    "fact_id_1",
    "domain_concept_id_2",
    "fact_id_2",
    "relationship_concept_id",
]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_concepts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The distinct concept ids each table holds, over all its concept columns.

    A table's distinct rows of concepts are found first; they are few, and only they are made into a row a column.
    """
    return _union(
        [
            table.select(*CONCEPT_COLUMNS[name])
            .distinct()
            .selectExpr(
                f"{quoted(name)} AS cdm_table",
                f"explode(array({', '.join(CONCEPT_COLUMNS[name])})) AS concept_id",
            )
            for name, table in tables.items()
            if name in CONCEPT_COLUMNS
        ]
    ).distinct()


def _long(wide: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """One row of named counts to (rule, violations) rows; an empty sum is 0."""
    rows = array(
        struct(rule=quoted(rule), violations=f"CAST(coalesce({text}, 0) AS bigint)")
        for rule, text in rules.items()
    )
    return wide.selectExpr(f"inline({rows})")


def concept_checks(tables: Mapping[str, DataFrame], concept: DataFrame) -> DataFrame:
    """Per table, the distinct concept ids the vocabulary does not hold."""
    missing = (
        distinct_concepts(tables)
        .filter("concept_id IS NOT NULL")
        .join(concept.select("concept_id"), "concept_id", "left_anti")
    )
    names = [name for name in CONCEPT_COLUMNS if name in tables]
    wide = missing.agg(
        *[F.expr(f"count_if(cdm_table = {quoted(n)}) AS n{i}") for i, n in enumerate(names)]
    )
    return _long(wide, {f"concept_not_in_vocabulary:{n}": f"n{i}" for i, n in enumerate(names)})


def roles(records: DataFrame) -> DataFrame:
    """The two persons of each loaded record with the day both were observed."""
    both = array(
        [
            struct(person_id="person_id", role="'mother'"),
            struct(person_id="newborn_person_id", role="'newborn'"),
        ]
    )
    return records.filter("loaded").selectExpr("delivery_date", f"inline({both})")


def person_checks(cdm: Cdm, records: DataFrame) -> DataFrame:
    """Orphans, rows per person and persons against staging, in one shuffle on the person.

    Every table gives one counted row per event, and partial sums shrink repeated persons before
    the shuffle, so one damaged person with many rows is one row by then.
    """

    def counted(table: DataFrame, column: str, test: str = "true") -> DataFrame:
        return table.filter(test).selectExpr("person_id", f"1L AS {column}")

    expected = roles(records)
    columns = ["persons", "periods", "measured", "observed", "mothers", "newborns"]
    rows = _union(
        [
            counted(cdm.person, "persons"),
            counted(cdm.observation_period, "periods"),
            counted(cdm.measurement, "measured"),
            counted(cdm.observation, "observed"),
            counted(expected, "mothers", "role = 'mother'"),
            counted(expected, "newborns", "role = 'newborn'"),
        ]
    )
    per_person = rows.groupBy("person_id").agg(
        *[F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in columns]
    )
    held = "persons * greatest(mothers + newborns, 1)"
    sums = {
        "orphan_person:observation_period": "if(persons = 0, periods, 0)",
        "orphan_person:measurement": "if(persons = 0, measured, 0)",
        "orphan_person:observation": "if(persons = 0, observed, 0)",
        "person_without_one_observation_period": f"if(periods <> 1, {held}, 0)",
        "mother_without_three_measurements": "if(measured <> 3, persons * mothers, 0)",
        "mother_without_four_observations": "if(observed <> 4, persons * mothers, 0)",
        "newborn_without_one_measurement": "if(measured <> 1, persons * newborns, 0)",
        "newborn_with_an_observation": "if(observed <> 0, persons * newborns, 0)",
        "person_not_matched_to_staging": "if(persons = 0, mothers + newborns, 0) "
        "+ if(mothers + newborns = 0, persons, 0)",
    }
    wide = per_person.agg(*[F.expr(f"sum({t}) AS n{i}") for i, t in enumerate(sums.values())])
    return _long(wide, {rule: f"n{i}" for i, rule in enumerate(sums)})


def orphan_links(cdm: Cdm) -> DataFrame:
    """Links with either end missing from the persons, each counted once.

    Those whose first end is missing, and those whose second is, less those with both. Links are counted
    by end before they meet the persons, so an end that many links share is one row of each join; the
    links of missing first ends are a semi join of plain sides, whose large keys can be split.
    """
    known = cdm.person.select("person_id").distinct()
    links = cdm.fact_relationship

    def missing(ends: DataFrame, end: str) -> DataFrame:
        return (
            ends.groupBy(end)
            .agg(F.expr("count(*) AS n"))
            .join(shuffled_side(known.withColumnRenamed("person_id", end)), end, "left_anti")
        )

    first = missing(links, "fact_id_1")
    of_missing = links.join(shuffled_side(first.select("fact_id_1")), "fact_id_1", "left_semi")
    both = missing(of_missing, "fact_id_2")
    wide = (
        first.select("n")
        .unionByName(missing(links, "fact_id_2").select("n"))
        .unionByName(both.selectExpr("-n AS n"))
        .agg(F.expr("sum(n) AS n"))
    )
    return _long(wide, {"orphan_person:fact_relationship": "n"})


def orphan_locations(cdm: Cdm) -> DataFrame:
    """Persons whose location is not in the location table, counted per location first."""
    wide = (
        cdm.person.filter("location_id IS NOT NULL")
        .groupBy("location_id")
        .agg(F.expr("count(*) AS n"))
        .join(cdm.location.select("location_id"), "location_id", "left_anti")
        .agg(F.expr("sum(n) AS n"))
    )
    return _long(wide, {"orphan_location:person": "n"})


def day_checks(cdm: Cdm, records: DataFrame) -> DataFrame:
    """Periods and newborn births against the delivery day of their record."""
    expected = roles(records)
    periods = (
        cdm.observation_period.join(
            shuffled_side(expected.select("person_id", "delivery_date")), "person_id", "left"
        )
        .agg(
            F.expr(
                "count_if(observation_period_start_date <> observation_period_end_date "
                "OR NOT (observation_period_start_date <=> delivery_date)) AS n"
            )
        )
    )
    births = (
        cdm.person.join(shuffled_side(expected.filter("role = 'newborn'")), "person_id")
        .selectExpr(
            "try_cast(format_string('%04d-%02d-%02d', year_of_birth, month_of_birth, day_of_birth)"
            " AS date) AS born",
            "delivery_date",
        )
        .agg(F.expr("count_if(NOT (born <=> delivery_date)) AS n"))
    )
    return _long(periods, {"observation_period_not_the_delivery_day": "n"}).unionByName(
        _long(births, {"newborn_birth_not_the_delivery_day": "n"})
    )


def bag_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of either table beyond the other's copies: (columns, side, copies), in one shuffle.

    The same as subtracting each bag from the other, without shuffling both tables twice.
    """
    both = a.selectExpr(*columns, "1L AS _n").unionByName(b.selectExpr(*columns, "-1L AS _n"))
    return (
        both.groupBy(*columns)
        .agg(F.expr("sum(_n) AS _n"))
        .filter("_n <> 0")
        .selectExpr(*columns, "if(_n > 0, 'first', 'second') AS side", "abs(_n) AS copies")
    )


def link_check(cdm: Cdm, records: DataFrame, concepts=CONCEPT_IDS) -> DataFrame:
    """Links missing from, or added to, the two of each loaded record."""
    wide = bag_difference(links(records, concepts), cdm.fact_relationship, LINK_COLUMNS).agg(
        F.expr("sum(copies) AS n")
    )
    return _long(wide, {"fact_relationship_not_the_record_pair": "n"})


def outside_period(events: DataFrame, day: str, periods: DataFrame, rule: str) -> DataFrame:
    """Events dated outside a period of their person.

    Both sides are counted per person and day first, so repeated rows multiply as counts.
    """
    wide = (
        events.selectExpr("person_id", f"{day} AS day")
        .groupBy("person_id", "day")
        .agg(F.expr("count(*) AS n"))
        .join(
            shuffled_side(
                periods.groupBy(
                    "person_id", "observation_period_start_date", "observation_period_end_date"
                ).agg(F.expr("count(*) AS m"))
            ),
            "person_id",
        )
        .filter(
            "day NOT BETWEEN observation_period_start_date AND observation_period_end_date"
        )
        .agg(F.expr("sum(n * m) AS n"))
    )
    return _long(wide, {rule: "n"})


#: What each person has a row of, in the order of the digits of its count (base 256).
_KINDS = ("person", "observation_period", "measurement", "observation", "mother", "newborn", "fact_relationship")
_MOTHER = {"person": 1, "observation_period": 1, "measurement": 3, "observation": 4, "mother": 1, "fact_relationship": 1}
_NEWBORN = {"person": 1, "observation_period": 1, "measurement": 1, "newborn": 1, "fact_relationship": 1}

#: The rules of ``post_load_checks`` that no load breaks whose persons are all as their records call for.
PERSON_RULES = (
    "orphan_person:observation_period",
    "orphan_person:measurement",
    "orphan_person:observation",
    "person_without_one_observation_period",
    "mother_without_three_measurements",
    "mother_without_four_observations",
    "newborn_without_one_measurement",
    "newborn_with_an_observation",
    "person_not_matched_to_staging",
    "orphan_person:fact_relationship",
    "observation_period_not_the_delivery_day",
    "newborn_birth_not_the_delivery_day",
    "fact_relationship_not_the_record_pair",
    "event_outside_observation_period:measurement",
    "event_outside_observation_period:observation",
)


def _packed(year: str, month: str, day: str) -> str:
    return f"{year} * 10000 + {month} * 100 + {day}"


def unlike_records(cdm: Cdm, records: DataFrame, concepts: Mapping[str, int] = CONCEPT_IDS) -> DataFrame:
    """``person_id``: the persons that do not hold exactly what the loaded records call for, in one shuffle.

    A person is as called for who is one record's mother or newborn, is in the persons once, has one period under its
    own id and the number of events of its role, all on the delivery day, and one link, that of the record; a newborn
    is born on that day. If all are, ``PERSON_RULES`` count 0, and the ids of persons and periods are unique. The
    converse does not hold: a person found here need not break a rule.

    A person's rows are counted by kind as digits of one number. A sum of too many rows of a kind could read as other
    digits, but not with as few rows, so number and rows together say what there is. Two links are compared by an
    exclusive or, which is 0 for equal ones only, as each side has one.
    """
    place = {kind: 256**i for i, kind in enumerate(_KINDS)}

    def rows(table: DataFrame, kind: str, **columns: str) -> DataFrame:
        return table.selectExpr(*[f"{v} AS {k}" for k, v in {"person_id": "person_id", "kind": kind, **columns}.items()])

    def digit(kind: str) -> str:
        return f"{place[kind]}L"

    def link(**first: str) -> dict[str, str]:
        return {
            "person_id": "fact_id_1",
            **first,
            "partner": "coalesce(fact_id_2, -1L)",
            "relationship": "coalesce(relationship_concept_id, -1)",
            "domains": "coalesce(domain_concept_id_1 * 4294967296L + domain_concept_id_2, -1L)",
        }

    dated = "year_of_birth BETWEEN 1 AND 9999 AND month_of_birth BETWEEN 1 AND 12 AND day_of_birth BETWEEN 1 AND 31"
    born = f"CASE WHEN {dated} THEN {_packed('year_of_birth', 'month_of_birth', 'day_of_birth')} END"
    start, end = "observation_period_start_date", "observation_period_end_date"
    one_day = f"CASE WHEN {start} = {end} AND observation_period_id = person_id THEN {start} END"
    role = f"if(fact_id_1 = person_id, {digit('mother')}, {digit('newborn')})"
    held = _union(
        [
            rows(cdm.person, digit("person"), born=born),
            rows(cdm.observation_period, digit("observation_period"), day=one_day),
            rows(cdm.measurement, digit("measurement"), day="measurement_date"),
            rows(cdm.observation, digit("observation"), day="observation_date"),
            rows(links(records, concepts, ("delivery_date", "person_id")), role, **link(day="delivery_date")),
            rows(cdm.fact_relationship, digit("fact_relationship"), **link()),
        ]
    )
    found = held.groupBy("person_id").agg(
        F.expr("try_sum(kind) AS kinds"),
        F.expr("count(*) AS n"),
        F.expr("min(day) AS first"),
        F.expr("max(day) AS last"),
        F.expr("count(day) AS days"),
        F.expr("max(born) AS born"),
        *[F.expr(f"bit_xor({c}) AS {c}") for c in ("partner", "relationship", "domains")],
    )

    def holds(wanted: Mapping[str, int]) -> str:
        kinds = sum(place[kind] * n for kind, n in wanted.items())
        undated = wanted["person"] + wanted["fact_relationship"]
        n = sum(wanted.values())
        return f"kinds = {kinds}L AND n = {n} AND days = {n - undated}"

    birthday = f"born = {_packed('year(first)', 'month(first)', 'day(first)')}"
    called_for = (
        "person_id IS NOT NULL AND first = last AND partner = 0 AND relationship = 0 AND domains = 0 "
        f"AND (({holds(_MOTHER)}) OR ({holds(_NEWBORN)} AND {birthday}))"
    )
    return found.filter(f"NOT coalesce({called_for}, false)").select("person_id")


def staged_checks(
    records: DataFrame,
    code_map: DataFrame,
    vocabulary: DataFrame,
    load_counts: DataFrame,
    cdm_source: DataFrame,
) -> DataFrame:
    """The checks of a load that read none of its person and event tables, so that it may fail them before it has any."""
    unregistered = (
        code_map.selectExpr("source_vocabulary_id AS vocabulary_id")
        .distinct()
        .join(vocabulary.select("vocabulary_id"), "vocabulary_id", "left_anti")
        .agg(F.expr("count(*) AS n"))
    )
    staged = records.groupBy("source_year").agg(F.expr("count(*) AS staged"))
    uncounted = (
        staged.join(
            load_counts.filter("stage = 'table'").select("source_year", "row_count"),
            "source_year",
            "left",
        ).agg(F.expr("count_if(NOT (row_count <=> staged)) AS n"))
    )
    return _union(
        [
            _long(unregistered, {"vocabulary_not_registered": "n"}),
            _long(uncounted, {"staging_rows_not_load_counts": "n"}),
            _long(cdm_source.agg(F.expr("count(*) AS n")), {"cdm_source_rows_not_one": "abs(n - 1)"}),
        ]
    )


def post_load_checks(
    cdm: Cdm,
    records: DataFrame,
    concept: DataFrame,
    code_map: DataFrame,
    vocabulary: DataFrame,
    load_counts: DataFrame,
    cdm_source: DataFrame,
    visits: DataFrame | None = None,
    as_called_for: bool = False,
) -> DataFrame:
    """The 28 checks of a load as (rule, violations); every count must be 0.

    The tables are read several times: pass written tables, not plans. ``as_called_for`` says that ``unlike_records``
    found no person, so that ``PERSON_RULES`` are known to count 0.
    """
    tables = {**vars(cdm), "cdm_source": cdm_source, "source_to_concept_map": code_map}
    visit_rows = (
        _long(visits.agg(F.expr("count(*) AS n")), {"visit_occurrence_rows": "n"})
        if visits is not None
        else _long(cdm_source.agg(F.expr("0L AS n")), {"visit_occurrence_rows": "n"})
    )
    if as_called_for:
        of_persons = [_long(cdm_source.agg(F.expr("0L AS n")), dict.fromkeys(PERSON_RULES, "n"))]
    else:
        of_persons = [
            person_checks(cdm, records),
            orphan_links(cdm),
            day_checks(cdm, records),
            link_check(cdm, records),
            outside_period(
                cdm.measurement,
                "measurement_date",
                cdm.observation_period,
                "event_outside_observation_period:measurement",
            ),
            outside_period(
                cdm.observation,
                "observation_date",
                cdm.observation_period,
                "event_outside_observation_period:observation",
            ),
        ]
    return _union(
        [
            concept_checks(tables, concept),
            *of_persons,
            orphan_locations(cdm),
            visit_rows,
            staged_checks(records, code_map, vocabulary, load_counts, cdm_source),
        ]
    )


class LoadRefused(ValueError):
    """A load whose checks, or records, do not allow it to replace the previous one."""


def failed(checks: DataFrame) -> DataFrame:
    return checks.filter("violations <> 0")


def require_clean(checks: DataFrame) -> None:
    """Raise with the failed checks; the list of checks is fixed and short."""
    found = failed(checks).orderBy("rule").collect()
    if found:
        raise LoadRefused("; ".join(f"{r.rule}: {r.violations}" for r in found))


# ---------------------------------------------------------------------------------------------
# Attrition and profile


def attrition_problems(attrition: DataFrame, cohort_rows: DataFrame) -> DataFrame:
    """Every invariant an attrition table breaks: (definition, year, step, problem).

    ``cohort_rows`` holds (cohort_definition_id, source_year, n). Steps run from 0 without a gap,
    step 0 excludes nobody, counts are not negative and never grow, each step excludes exactly the
    difference, and the last step leaves the rows of the cohort.
    """
    keys = ["cohort_definition_id", "source_year"]
    whole = Window.partitionBy(*keys)
    numbered = (
        step_changes(attrition)
        .withColumns(
            {
                "gap": F.max(
                    F.expr("NOT (step = coalesce(previous_step + 1, 0))")
                ).over(whole),
                "last": F.max("step").over(whole),
            }
        )
        .join(cohort_rows, keys, "left")
        .withColumn("n", F.expr("coalesce(n, 0)"))
    )
    whole_steps = "NOT gap"
    later = f"{whole_steps} AND previous_step IS NOT NULL"
    rules = [
        ("gap AND step = last", "'the steps do not run from 0 without a gap'"),
        (f"{whole_steps} AND remaining < 0", "'remaining is negative'"),
        (
            f"{whole_steps} AND previous_step IS NULL AND excluded IS NOT NULL",
            "'step 0 excludes nobody'",
        ),
        (f"{later} AND excluded IS NULL", "'excluded is missing'"),
        (f"{later} AND excluded < 0", "'excluded is negative'"),
        (
            f"{later} AND excluded IS NOT NULL AND remaining > previous_remaining",
            "'more remain than before the step'",
        ),
        (
            f"{later} AND excluded <> previous_remaining - remaining",
            "'excluded is not the difference'",
        ),
        (f"{whole_steps} AND step = last AND remaining <> n", "'the cohort holds other rows'"),
    ]
    found = numbered.selectExpr(
        *keys, "step", f"explode({array(cases(r) for r in rules)}) AS problem"
    ).filter("problem IS NOT NULL")
    alone = cohort_rows.join(attrition.select(*keys).distinct(), keys, "left_anti").selectExpr(
        *keys, "CAST(NULL AS int) AS step", "'the cohort has no attrition' AS problem"
    )
    return found.unionByName(alone)


def profile_problems(
    profile: DataFrame, attrition: DataFrame, kind: str = "validity"
) -> DataFrame:
    """Where a profile and an attrition disagree on the births of a step's two groups."""
    keys = ["cohort_definition_id", "step", "subject_group"]
    groups = array(
        [
            struct(subject_group="'excluded'", n="coalesce(excluded, 0)"),
            struct(subject_group="'retained'", n="remaining"),
        ]
    )
    expected = (
        attrition.filter(F.col("kind") == kind)
        .selectExpr("cohort_definition_id", "step", f"inline({groups})")
        .groupBy(*keys)
        .agg(F.expr("sum(n) AS expected"))
    )
    problem = cases(
        ("births IS NULL", "'the profile has no row'"),
        ("expected IS NULL", "'the step is not one of validity'"),
        ("births <> expected", "'the births differ'"),
    )
    return (
        profile.select(*keys, "births")
        .join(expected, keys, "full")
        .selectExpr(*keys, f"{problem} AS problem")
        .filter("problem IS NOT NULL")
    )


def births_not_cohort(cells: DataFrame, cohort_rows: DataFrame) -> DataFrame:
    """Definitions whose aggregated births are not the rows of their cohort."""
    births = cells.groupBy("definition").agg(F.expr("sum(births) AS births"))
    rows = cohort_rows.selectExpr("cohort_definition_id AS definition", "n").groupBy(
        "definition"
    ).agg(F.expr("sum(n) AS cohort_rows"))
    return births.join(rows, "definition", "full").filter("NOT (births <=> cohort_rows)")


def years_not_attrition(births: DataFrame, last: DataFrame) -> DataFrame:
    """Years of delivery whose births are not what the attrition of that file year leaves."""
    return (
        births.join(last.withColumnRenamed("source_year", "year"), "year", "full")
        .filter("NOT (births <=> remaining)")
        .select("year", "births", "remaining")
    )


# ---------------------------------------------------------------------------------------------
# Keys, code maps and concepts


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their rows; copies are summed before the shuffle."""
    return df.groupBy(*key).agg(F.expr("count(*) AS copies")).filter("copies > 1")


def header_problems(found: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Missing, extra or reordered columns."""
    problems = [f"column {c} is missing" for c in wanted if c not in found]
    problems += [f"column {c} is not expected" for c in found if c not in wanted]
    if not problems and list(found) != list(wanted):
        problems.append("the columns are in another order")
    return problems


def vocabulary_version(vocabulary: DataFrame, expected: str | None = None) -> DataFrame:
    """The version of the package row, and what is wrong with it."""
    problem = cases(
        ("n <> 1", "concat('expected one package row, found ', n)"),
        ("version IS NULL OR version = ''", "'the package row has no version'"),
        *([(f"version <> {quoted(expected)}", "'another version than declared'")] if expected else []),
    )
    return (
        vocabulary.filter("vocabulary_id = 'None'")
        .agg(F.expr("count(*) AS n"), F.expr("max(vocabulary_version) AS version"))
        .selectExpr("n", "version", f"{problem} AS problem")
    )


def code_map_problems(code_map: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """Every rule a code map of text columns breaks: (vocabulary, code, problem).

    ``vocabularies`` holds (vocabulary_id, target_domain_id), NULL where a vocabulary has no
    targets. Copies of a key are found by counting, so a hot vocabulary is never one group.
    """
    key = ["source_vocabulary_id", "source_code"]
    copies = duplicate_keys(code_map, key).selectExpr(
        *key, "'mapped more than once' AS problem"
    )
    date = "try_cast({} AS date)".format
    start, end = date("valid_start_date"), date("valid_end_date")
    unmatched = "try_cast(target_concept_id AS bigint) = 0"
    numeric = r"target_concept_id RLIKE '^[0-9]+\\z'"
    rules = [
        ("declared IS NULL", "'vocabulary not declared'"),
        ("length(source_code) NOT BETWEEN 1 AND 50 OR source_code IS NULL", "'code length'"),
        ("NOT (source_concept_id <=> '0')", "'source concept is not 0'"),
        ("length(source_code_description) > 255", "'description too long'"),
        (f"NOT coalesce({numeric}, false)", "'target is not a concept id'"),
        (
            f"{numeric} AND ({unmatched}) <> (coalesce(target_vocabulary_id, '') = 'None')",
            "'target vocabulary is None exactly for target 0'",
        ),
        (
            f"declared AND target_domain_id IS NULL AND {numeric} AND NOT ({unmatched})",
            "'vocabulary without targets'",
        ),
        (f"{start} IS NULL OR {end} IS NULL", "'validity dates'"),
        (f"{end} < {start}", "'validity ends before it starts'"),
        ("coalesce(invalid_reason, '') NOT IN ('', 'D', 'U')", "'invalid reason'"),
    ]
    declared = vocabularies.selectExpr(
        "vocabulary_id AS source_vocabulary_id", "target_domain_id", "true AS declared"
    )
    rows = code_map.join(declared, "source_vocabulary_id", "left").selectExpr(
        *key, f"explode({array(cases(r) for r in rules)}) AS problem"
    ).filter("problem IS NOT NULL")
    empty = vocabularies.join(
        code_map.selectExpr("source_vocabulary_id AS vocabulary_id").distinct(),
        "vocabulary_id",
        "left_anti",
    ).selectExpr(
        "vocabulary_id AS source_vocabulary_id",
        "CAST(NULL AS string) AS source_code",
        "'vocabulary has no rows' AS problem",
    )
    return _union([copies, rows, empty])


def domain_problems(uses: DataFrame, concept: DataFrame) -> DataFrame:
    """Concept uses (concept_id, field) whose domain the field does not take."""
    required = cases(
        *[(f"field = {quoted(f)}", quoted(d)) for f, d in FIELD_DOMAINS.items()],
        ("field LIKE '%\\\\_type\\\\_concept\\\\_id'", "'Type Concept'"),
    )
    own = ", ".join(quoted(d) for d in OWN_TABLE_DOMAINS)
    problem = cases(
        ("required IS NOT NULL AND domain_id <> required", "concat('takes ', required)"),
        (
            f"field = 'observation.observation_concept_id' AND domain_id IN ({own})",
            "'has a table of its own'",
        ),
    )
    return (
        uses.join(concept.select("concept_id", "domain_id"), "concept_id")
        .selectExpr("*", f"{required} AS required")
        .selectExpr("concept_id", "field", "domain_id", f"{problem} AS problem")
        .filter("problem IS NOT NULL")
    )


def concept_problems(expected: DataFrame, concept: DataFrame) -> DataFrame:
    """What the loaded concepts say against what each use expects of them.

    ``expected``: (used_by, concept_id, standard, domain_id, vocabulary_id, concept_code), where a
    NULL domain or code accepts any.
    """
    loaded = concept.selectExpr(
        "concept_id",
        "true AS found",
        "domain_id AS l_domain",
        "vocabulary_id AS l_vocabulary",
        "concept_code AS l_code",
        "standard_concept AS l_standard",
        "invalid_reason AS l_invalid",
    )
    rules = [
        ("found IS NULL", "'not in the loaded vocabulary'"),
        ("found AND l_invalid IS NOT NULL", "'not valid'"),
        ("found AND standard AND NOT (l_standard <=> 'S')", "'not standard'"),
        ("found AND domain_id IS NOT NULL AND NOT (l_domain <=> domain_id)", "'domain'"),
        ("found AND NOT (l_vocabulary <=> vocabulary_id)", "'vocabulary'"),
        ("found AND concept_code IS NOT NULL AND NOT (l_code <=> concept_code)", "'code'"),
    ]
    return expected.join(loaded, "concept_id", "left").selectExpr(
        "used_by", "concept_id", f"explode({array(cases(r) for r in rules)}) AS problem"
    ).filter("problem IS NOT NULL")


def lookup_problems(needed: DataFrame, code_map: DataFrame) -> DataFrame:
    """Needed (vocabulary, code) pairs the map does not take to exactly one valid concept."""
    key = ["source_vocabulary_id", "source_code"]
    valid = (
        code_map.filter("invalid_reason IS NULL AND target_concept_id <> 0")
        .groupBy(*key)
        .agg(F.expr("count(*) AS targets"))
    )
    return (
        needed.join(valid, key, "left")
        .selectExpr(*key, "coalesce(targets, 0) AS targets")
        .filter("targets <> 1")
    )


def missing_keys(needed: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return needed.join(held.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------------------------------------
# Reconciliation


def count_mismatch(stages: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Keys whose stages hold different numbers of rows, with each stage's count."""
    counted = _union(
        [
            df.groupBy(key).agg(F.expr("count(*) AS n")).withColumn("stage", F.lit(stage))
            for stage, df in stages.items()
        ]
    )
    wide = counted.groupBy(key).agg(
        *[F.expr(f"coalesce(max(if(stage = {quoted(s)}, n, NULL)), 0) AS {s}_rows") for s in stages]
    )
    first, *others = [f"{s}_rows" for s in stages]
    return wide.filter(" OR ".join(f"{o} <> {first}" for o in others))


def sample_differences(
    expected: DataFrame, found: DataFrame, key: Sequence[str], row: str, every: int, file: str
) -> DataFrame:
    """Cells that differ, for every Nth row of each file and its last one in ``expected``.

    The last rows are one small map of the files; both sides are filtered before the join.
    """
    columns = [c for c in expected.columns if c not in key]
    last = (
        expected.groupBy(file)
        .agg(F.max(row).alias("last"))
        .agg(F.map_from_entries(F.collect_list(F.struct(file, "last"))).alias("lasts"))
        .scalar()
    )

    def sampled(df: DataFrame, value: str) -> DataFrame:
        cells = array(struct(column=quoted(c), value=c) for c in columns)
        return (
            df.filter((F.col(row) % every == 0) | (F.col(row) == F.try_element_at(last, F.col(file))))
            .selectExpr(*key, f"inline({cells})")
            .withColumnRenamed("value", value)
        )

    return (
        sampled(expected, "wanted")
        .withColumn("in_expected", F.lit(True))
        .join(
            sampled(found, "got").withColumn("in_found", F.lit(True)), [*key, "column"], "full"
        )
        .filter("in_expected AND (in_found IS NULL OR NOT (wanted <=> got))")
        .selectExpr(*key, "column", "wanted", "got", "in_found IS NULL AS row_missing")
    )
