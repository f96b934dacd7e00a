"""Nested cohorts: criteria per subject, the first failed step, attrition and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.catalogue import (
    ANALYSIS,
    BASE,
    CONCEPT_IDS,
    LANDMARKS,
    MULTIPLES,
    PRETERM_WEEKS,
    SETTINGS,
    THIRD_TRIMESTER_WEEK,
    VIABLE_WEEKS,
    Settings,
)
from cohortspark.functions.text import array, cases, known_true, map_literal, quoted, struct
from cohortspark.operators.cdm import Cdm
from cohortspark.session import shuffled_side

FIRST_STEP = 2


@dataclass(frozen=True)
class Step:
    """One criterion of a definition: met only where its condition is known and true."""

    kind: str
    description: str
    condition: str


def definitions(
    landmarks: Mapping[int, int] = LANDMARKS, viable_weeks: int = VIABLE_WEEKS
) -> dict[int, list[Step]]:
    """The six definitions as lists of steps; later ones extend or edit the earlier lists."""
    base = [
        Step("coverage", "Born in the study period", "born_in_period"),
        Step("coverage", "Mother resident in Mexico", "resident"),
        Step("validity", "Gestational age specified", "weeks IS NOT NULL"),
        Step("validity", "Multiplicity specified", "plurality IS NOT NULL"),
        Step("design", "Singleton", "plurality = 1"),
        Step("design", f"{viable_weeks} completed weeks or more", f"weeks >= {viable_weeks}"),
    ]
    analysis = [
        *base,
        Step("validity", "Prenatal care data known and coherent", "care_known"),
        Step("validity", "Covariates known", "covariates_known"),
    ]
    result = {BASE: base, ANALYSIS: analysis}
    for definition, week in landmarks.items():
        result[definition] = [*analysis, Step("design", f"Reached week {week}", f"weeks >= {week}")]
    result[MULTIPLES] = [step for step in analysis if step.description != "Singleton"]
    return result


DEFINITIONS = definitions()


def care_known(week: int = THIRD_TRIMESTER_WEEK) -> str:
    """Trimester and visits known and coherent with each other and with the weeks."""
    return known_true(
        "trimester IS NOT NULL AND visits IS NOT NULL AND (trimester = 0) = (visits = 0) "
        f"AND NOT (trimester = 3 AND weeks < {week})"
    )


def _with_criteria(
    subjects: DataFrame, years: Sequence[int] | None, settings: Settings
) -> DataFrame:
    """The flags the steps read, from the values of each subject."""
    period = "true"
    if years is not None:
        period = f"year(delivery_date) IN ({', '.join(str(y) for y in years)})"
    concepts = map_literal(settings.trimester_concepts())
    return subjects.withColumn(
        "trimester", F.expr(f"try_element_at({concepts}, trimester_concept_id)")
    ).selectExpr(
        "*",
        f"{known_true(period)} AS born_in_period",
        f"{known_true(f'country_concept_id = {settings.resident_concept()}')} AS resident",
        f"{care_known()} AS care_known",
        "coalesce(age IS NOT NULL AND education_concept_id <> 0 AND state IS NOT NULL, false) "
        "AS covariates_known",
    )


def criteria(
    records: DataFrame, years: Sequence[int] | None = None, settings: Settings = SETTINGS
) -> DataFrame:
    """Every record with its criteria, straight from the typed records: no shuffle.

    ``loaded`` stays a column, so one aggregation counts steps 0 and 1 with the others.
    """
    values = records.selectExpr(
        "person_id AS subject_id",
        "source_year",
        "loaded",
        "delivery_date",
        "weeks",
        "plurality",
        "visits",
        "trimester_concept_id",
        "age",
        "education_concept_id",
        "state",
        "country_concept_id",
        "afiliacion AS insurance_code",
    )
    return _with_criteria(values, years, settings)


def event_values(
    events: DataFrame, concept_column: str, wanted: Mapping[str, tuple[int, str]]
) -> DataFrame:
    """Event rows to one row per person: each named value is that of its concept.

    One filtered pass and one shuffle on the person replace one join per value. The load checks
    that a person has one event of each concept.
    """
    listed = ", ".join(str(c) for c in sorted({c for c, _ in wanted.values()}))
    return (
        events.filter(f"{concept_column} IN ({listed})")
        .groupBy("person_id")
        .agg(
            *[
                F.expr(f"max(CASE WHEN {concept_column} = {c} THEN {value} END) AS {name}")
                for name, (c, value) in wanted.items()
            ]
        )
    )


def criteria_from_cdm(
    cdm: Cdm,
    source_years: Sequence[int] | None = None,
    years: Sequence[int] | None = None,
    settings: Settings = SETTINGS,
    concepts: Mapping[str, int] = CONCEPT_IDS,
) -> DataFrame:
    """Every subject with its criteria, read back from the person and event tables.

    Subjects are the persons that are the mother of another. All large joins are on person_id,
    which every side is already grouped by.
    """
    mothers = cdm.fact_relationship.filter(
        f"domain_concept_id_1 = {concepts['person_table']} "
        f"AND relationship_concept_id = {concepts['mother']}"
    ).selectExpr("fact_id_1 AS person_id")
    subjects = cdm.person.selectExpr(
        "person_id",
        "location_id",
        "try_cast(split_part(person_source_value, ':', 1) AS int) AS source_year",
    )
    if source_years is not None:
        subjects = subjects.filter(f"source_year IN ({', '.join(str(y) for y in source_years)})")
    subjects = subjects.join(shuffled_side(mothers), "person_id", "left_semi")
    weeks = concepts["gestational_age_at_birth"]
    measured = event_values(
        cdm.measurement,
        "measurement_concept_id",
        {
            "delivery_date": (weeks, "measurement_date"),
            "weeks": (weeks, "value_as_number"),
            "plurality": (concepts["birth_plurality"], "value_as_number"),
            "age": (concepts["mother_age_at_delivery"], "value_as_number"),
        },
    )
    observed = event_values(
        cdm.observation,
        "observation_concept_id",
        {
            "visits": (concepts["prenatal_visits_count"], "value_as_number"),
            "trimester_concept_id": (
                concepts["first_prenatal_visit_trimester"],
                "value_as_concept_id",
            ),
            "education_concept_id": (concepts["mother_education"], "value_as_concept_id"),
            "insurance_code": (concepts["mother_insurance"], "value_source_value"),
        },
    )
    places = cdm.location.select("location_id", "state", "country_concept_id")
    values = (
        subjects.join(shuffled_side(measured), "person_id", "left")
        .join(shuffled_side(observed), "person_id", "left")
        .join(places, "location_id", "left")
        .withColumnRenamed("person_id", "subject_id")
        .withColumn("loaded", F.lit(True))
    )
    return _with_criteria(values, years, settings)


def first_failed(steps: Sequence[Step], first: int = FIRST_STEP) -> str:
    """The number of the first step a subject fails; NULL when it fails none."""
    return cases(
        *[
            (f"NOT {known_true(step.condition)}", str(number))
            for number, step in enumerate(steps, start=first)
        ]
    )


def exits(
    subjects: DataFrame, defined: Mapping[int, Sequence[Step]] = DEFINITIONS
) -> DataFrame:
    """The subjects with one ``exit_<definition>`` column per definition."""
    return subjects.selectExpr("*", *[f"{first_failed(s)} AS exit_{d}" for d, s in defined.items()])


def exit_rows(
    with_exits: DataFrame, defined: Mapping[int, Sequence[Step]] = DEFINITIONS
) -> DataFrame:
    """One row per loaded subject and definition with its exit step."""
    rows = array(struct(cohort_definition_id=str(d), exit_step=f"exit_{d}") for d in defined)
    return with_exits.filter("loaded").selectExpr("subject_id", "source_year", f"inline({rows})")


def memberships(defined=DEFINITIONS) -> str:
    """Each definition a subject belongs to, and NULL for each other one, as an array."""
    return array(cases((f"exit_{d} IS NULL", str(d))) for d in defined)


def cohort(
    with_exits: DataFrame, defined: Mapping[int, Sequence[Step]] = DEFINITIONS
) -> DataFrame:
    """One row per definition and subject that fails no step, on its delivery day."""
    return (
        with_exits.filter("loaded")
        .selectExpr(
            f"explode({memberships(defined)}) AS cohort_definition_id",
            "subject_id",
            "delivery_date AS cohort_start_date",
            "delivery_date AS cohort_end_date",
        )
        .filter("cohort_definition_id IS NOT NULL")
    )


def exit_summary(
    with_exits: DataFrame,
    defined: Mapping[int, Sequence[Step]] = DEFINITIONS,
    viable_weeks: int = VIABLE_WEEKS,
    preterm_weeks: int = PRETERM_WEEKS,
) -> DataFrame:
    """Records per year, exit steps, outcome and trimester: the only shuffle of the funnel.

    Its rows are bounded by the steps, years and categories, whatever the number of records, and
    attrition and profile of every definition follow from it.
    """
    preterm = f"CASE WHEN weeks >= {viable_weeks} THEN weeks < {preterm_weeks} END"
    keys = ["source_year", "loaded", *[f"exit_{d}" for d in defined], "preterm", "trimester"]
    return (
        with_exits.withColumn("preterm", F.expr(preterm)).groupBy(*keys).agg(F.expr("count(*) AS n"))
    )


def attrition(
    summary: DataFrame,
    defined: Mapping[int, Sequence[Step]] = DEFINITIONS,
    years: DataFrame | None = None,
) -> DataFrame:
    """Remaining and excluded per definition, year and step, steps that remove nobody included.

    Each summary row counts toward every step of every definition, so no step can go missing and
    no join with the list of steps is needed. ``years`` adds years whose files hold no record.
    """
    entries = []

    def entry(definition, step, kind, description, remaining, excluded):
        entries.append(
            struct(
                cohort_definition_id=str(definition),
                step=str(step),
                kind=f"CAST({quoted(kind)} AS string)",
                description=quoted(description),
                remaining=f"if({remaining}, n, 0L)",
                excluded="CAST(NULL AS bigint)" if excluded is None else f"if({excluded}, n, 0L)",
            )
        )

    for definition, steps in defined.items():
        left = f"exit_{definition}"
        entry(definition, 0, None, "Records in the files of the study period", "true", None)
        entry(
            definition, 1, "data model", "Mother's year of birth known", "loaded", "NOT loaded"
        )
        for number, step in enumerate(steps, start=FIRST_STEP):
            entry(
                definition,
                number,
                step.kind,
                step.description,
                f"loaded AND ({left} IS NULL OR {left} > {number})",
                f"loaded AND {left} = {number}",
            )
    if years is not None:
        empty = years.selectExpr("source_year", "false AS loaded", "0L AS n")
        summary = summary.unionByName(empty, allowMissingColumns=True)
    return (
        summary.selectExpr("source_year", f"inline({array(entries)})")
        .groupBy("cohort_definition_id", "source_year", "step", "kind", "description")
        .agg(F.expr("sum(remaining) AS remaining"), F.expr("sum(excluded) AS excluded"))
    )


def excluded_profile(
    summary: DataFrame,
    defined: Mapping[int, Sequence[Step]] = DEFINITIONS,
    kind: str = "validity",
) -> DataFrame:
    """Births and three shares of the records each validity step removes and of those it keeps."""
    groups = []
    for definition, steps in defined.items():
        left = f"exit_{definition}"
        for number, step in enumerate(steps, start=FIRST_STEP):
            if step.kind != kind:
                continue
            for name, test in (
                ("excluded", f"{left} = {number}"),
                ("retained", f"{left} IS NULL OR {left} > {number}"),
            ):
                groups.append(
                    struct(
                        cohort_definition_id=str(definition),
                        step=str(number),
                        subject_group=quoted(name),
                        births=f"if({test}, n, 0L)",
                    )
                )

    def percent(top: str, bottom: str) -> str:
        share = f"CAST(100 AS decimal(3,0)) * {top} / nullif({bottom}, 0)"
        return f"CAST(round({share}, 2) AS decimal(5,2)) AS {top}_percent"

    def part(test: str, name: str):
        return F.expr(f"sum(if({test}, births, 0L)) AS {name}")

    return (
        summary.filter("loaded")
        .selectExpr("preterm", "trimester", f"inline({array(groups)})")
        .groupBy("cohort_definition_id", "step", "subject_group")
        .agg(
            F.expr("sum(births) AS births"),
            part("preterm IS NOT NULL", "with_outcome"),
            part("preterm", "preterm"),
            part("trimester IS NOT NULL", "with_trimester"),
            part("trimester = 1", "first_trimester_start"),
            part("trimester = 0", "no_prenatal_care"),
        )
        .selectExpr(
            "cohort_definition_id",
            "step",
            "subject_group",
            "births",
            percent("preterm", "with_outcome"),
            percent("first_trimester_start", "with_trimester"),
            percent("no_prenatal_care", "with_trimester"),
        )
    )
