"""Person and event tables from typed records (the CDM v5.4 columns the load fills)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.catalogue import CONCEPT_IDS
from cohortspark.functions.text import array, quoted, struct
from cohortspark.operators.ids import rank_by_id, rank_distinct
from cohortspark.session import small_side

RESIDENCE = ["resideextranjero", "entidadresidencia"]


@dataclass
class Cdm:
    """The tables of one load."""

    person: DataFrame
    observation_period: DataFrame
    measurement: DataFrame
    observation: DataFrame
    fact_relationship: DataFrame
    location: DataFrame

    def map(self, change) -> "Cdm":
        return Cdm(**{name: change(name, table) for name, table in vars(self).items()})


def concept_pivot(pairs: DataFrame, key: str, value: str, keys: list[str]) -> DataFrame:
    """Key/value rows to one row of named values; a missing key is NULL."""
    return pairs.agg(
        *[F.expr(f"max(CASE WHEN {key} = {quoted(k)} THEN {value} END) AS `{k}`") for k in keys]
    )


def locations(records: DataFrame) -> DataFrame:
    """One location per distinct residence pair of the loaded records, numbered in code order.

    The typed state and country follow from the pair, so they are part of the same distinct row.
    """
    columns = [*RESIDENCE, "state", "country_concept_id"]
    ranked = rank_distinct(records.filter("loaded").select(*columns), columns, "location_id")
    country, state = RESIDENCE
    return ranked.selectExpr(
        "location_id",
        "state",
        f"CASE WHEN {country} IS NOT NULL OR {state} IS NOT NULL "
        f"THEN concat(coalesce({country}, ''), '|', coalesce({state}, '')) END "
        "AS location_source_value",
        "country_concept_id",
        f"{country} AS country_source_value",
        f"{state} AS _state_source",
    )


def persons(
    records: DataFrame, location: DataFrame, concepts: Mapping[str, int] = CONCEPT_IDS
) -> DataFrame:
    """Two persons per loaded record: the mother, with her residence, and the newborn.

    The location is found by its raw pair, NULLs included. One pair may hold most records: the
    locations are broadcast once counted as few, and beyond that the adaptive join splits the pair.
    """
    found = small_side(
        location.selectExpr("country_source_value AS _country", "_state_source", "location_id")
    )
    loaded = records.filter("loaded").join(
        found,
        F.expr(f"{RESIDENCE[0]} <=> _country AND {RESIDENCE[1]} <=> _state_source"),
        "left",
    )
    mother = _person(
        person_id="person_id",
        gender_concept_id=str(concepts["female"]),
        year_of_birth="year_of_birth",
        month_of_birth="month_of_birth",
        day_of_birth="day_of_birth",
        location_id="location_id",
        gender_source_value="CAST(NULL AS string)",
        gender_source_concept_id="CAST(NULL AS int)",
    )
    newborn = _person(
        person_id="newborn_person_id",
        gender_concept_id="newborn_gender_concept_id",
        year_of_birth="year(delivery_date)",
        month_of_birth="month(delivery_date)",
        day_of_birth="day(delivery_date)",
        location_id="CAST(NULL AS bigint)",
        gender_source_value="sexo",
        gender_source_concept_id="0",
    )
    return loaded.selectExpr(
        "concat(source_year, ':', source_row) AS person_source_value",
        f"inline({array([mother, newborn])})",
    )


def _person(**parts: str) -> str:
    return struct(**parts, race_concept_id="0", ethnicity_concept_id="0")


def observation_periods(
    records: DataFrame, concepts: Mapping[str, int] = CONCEPT_IDS
) -> DataFrame:
    """One period per person, one day long: the delivery."""
    return (
        records.filter("loaded")
        .selectExpr("explode(array(person_id, newborn_person_id)) AS person_id", "delivery_date")
        .selectExpr(
            "person_id AS observation_period_id",
            "person_id",
            "delivery_date AS observation_period_start_date",
            "delivery_date AS observation_period_end_date",
            f"{concepts['registry']} AS period_type_concept_id",
        )
    )


#: What the two event tables read from a record.
EVENT_INPUTS = [
    "person_id",
    "newborn_person_id",
    "delivery_date",
    "weeks",
    "plurality",
    "plurality_at_least",
    "age",
    "weight",
    "visits",
    "trimester_concept_id",
    "education_concept_id",
    "insurance_concept_id",
    "edadgestacional",
    "productoembarazo",
    "edad",
    "peso",
    "totalconsultas",
    "trimestreprimerconsulta",
    "escolaridad",
    "afiliacion",
]


#: What the tables of a load read from a record.
LOAD_INPUTS = [
    "source_year",
    "source_row",
    "loaded",
    "year_of_birth",
    "month_of_birth",
    "day_of_birth",
    "newborn_gender_concept_id",
    "sexo",
    *RESIDENCE,
    "state",
    "country_concept_id",
    *EVENT_INPUTS,
]


def ranked_records(records: DataFrame, bucket_rows: int = 1 << 20) -> DataFrame:
    """The loaded records with their position in person order, which the event ids build on."""
    return rank_by_id(
        records.filter("loaded").select(*EVENT_INPUTS), "person_id", "_rank", bucket_rows
    )


def measurements(
    ranked: DataFrame, mothers: Column, concepts: Mapping[str, int] = CONCEPT_IDS
) -> DataFrame:
    """Three events per mother and one per newborn, in one pass over the records.

    Every mother id is below every newborn id and the events per person are constant, so the dense
    id in (person, position) order is arithmetic on the rank of the record; ``mothers`` counts them.
    """

    def event(event_id, person, concept, number, unit, source, operator="CAST(NULL AS int)"):
        return struct(
            measurement_id=event_id,
            person_id=person,
            measurement_concept_id=str(concepts[concept]),
            operator_concept_id=operator,
            value_as_number=number,
            unit_concept_id=str(concepts[unit]) if unit else "CAST(NULL AS int)",
            measurement_source_value=quoted(source.upper()),
            value_source_value=source,
        )

    at_least = f"CASE WHEN plurality_at_least THEN {concepts['at_least']} END"
    weeks, plurality = "gestational_age_at_birth", "birth_plurality"
    events = [
        event("3 * _rank - 2", "person_id", weeks, "weeks", "week", "edadgestacional"),
        event(
            "3 * _rank - 1", "person_id", plurality, "plurality", None, "productoembarazo", at_least
        ),
        event("3 * _rank", "person_id", "mother_age_at_delivery", "age", "year", "edad"),
        event(
            "3 * _mothers + _rank", "newborn_person_id", "birth_weight", "weight", "gram", "peso"
        ),
    ]
    return ranked.withColumn("_mothers", mothers).selectExpr(
        "delivery_date AS measurement_date",
        f"{concepts['registry']} AS measurement_type_concept_id",
        "0 AS measurement_source_concept_id",
        f"inline({array(events)})",
    )


def observations(ranked: DataFrame, concepts: Mapping[str, int] = CONCEPT_IDS) -> DataFrame:
    """Four events per mother: visits, trimester, education, insurance."""

    def event(position, concept, source, number="NULL", value="NULL"):
        return struct(
            observation_id=f"4 * _rank - {4 - position}",
            observation_concept_id=str(concepts[concept]),
            value_as_number=f"CAST({number} AS decimal(38,0))",
            value_as_concept_id=f"CAST({value} AS int)",
            observation_source_value=quoted(source.upper()),
            value_source_value=source,
        )

    events = [
        event(1, "prenatal_visits_count", "totalconsultas", number="visits"),
        event(
            2,
            "first_prenatal_visit_trimester",
            "trimestreprimerconsulta",
            value="trimester_concept_id",
        ),
        event(3, "mother_education", "escolaridad", value="education_concept_id"),
        event(4, "mother_insurance", "afiliacion", value="insurance_concept_id"),
    ]
    return ranked.selectExpr(
        "person_id",
        "delivery_date AS observation_date",
        f"{concepts['registry']} AS observation_type_concept_id",
        "0 AS observation_source_concept_id",
        f"inline({array(events)})",
    )


def links(
    records: DataFrame, concepts: Mapping[str, int] = CONCEPT_IDS, kept: Sequence[str] = ()
) -> DataFrame:
    """The mother and the newborn of each record, linked in both directions; ``kept``: more columns of the record."""

    def link(one, other, relationship):
        return struct(
            domain_concept_id_1=str(concepts["person_table"]),
            fact_id_1=one,
            domain_concept_id_2=str(concepts["person_table"]),
            fact_id_2=other,
            relationship_concept_id=str(concepts[relationship]),
        )

    both = [
        link("person_id", "newborn_person_id", "mother"),
        link("newborn_person_id", "person_id", "child"),
    ]
    return records.filter("loaded").selectExpr(*kept, f"inline({array(both)})")


def build(
    records: DataFrame,
    concepts: Mapping[str, int] = CONCEPT_IDS,
    bucket_rows: int = 1 << 20,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> Cdm:
    """All person and event tables of a load.

    ``keep`` is applied to the two intermediate tables that feed others, the locations and the
    ranked records: a load writes them, so the ranks are computed once for both event tables.
    """
    location = keep(locations(records), "location_keys")
    ranked = keep(ranked_records(records, bucket_rows), "ranked")
    return Cdm(
        person=persons(records, location, concepts),
        observation_period=observation_periods(records, concepts),
        measurement=measurements(ranked, loaded_total(records), concepts),
        observation=observations(ranked, concepts),
        fact_relationship=links(records, concepts),
        location=location.drop("_state_source"),
    )


def loaded_total(records: DataFrame) -> Column:
    """How many records are loaded, as a scalar for another query over the same records."""
    return records.filter("loaded").agg(F.count(F.lit(1))).scalar()


def cdm_source(
    files: DataFrame, version: str, concepts: Mapping[str, int] = CONCEPT_IDS
) -> DataFrame:
    """One row describing a load from its files (source_year, name, version, sha256, retrieved).

    The described files are one per year, so the collected list is as short as the years.
    """
    described = "concat(source_year, ': ', name, '?V=', version, ', sha256 ', sha256)"
    return files.agg(
        F.expr(
            "concat('Record files loaded: ', "
            f"array_join(array_sort(collect_list({described})), '; ')) AS source_description"
        ),
        F.expr("max(retrieved) AS source_release_date"),
    ).selectExpr(
        "source_description",
        "source_release_date",
        "'v5.4.3' AS cdm_version",
        f"{concepts['cdm_version']} AS cdm_version_concept_id",
        f"{quoted(version)} AS vocabulary_version",
    )


def register_vocabularies(vocabulary: DataFrame, local: DataFrame) -> DataFrame:
    """The vocabulary table with the local rows replaced by the current ones, others untouched."""
    kept = vocabulary.join(local.select("vocabulary_id"), "vocabulary_id", "left_anti")
    return kept.unionByName(local)


def code_map_table(spark: SparkSession, code_map, targets) -> DataFrame:
    """The declared code map as rows of (source_vocabulary_id, source_code, target, ...)."""
    rows = [
        (code, 0, vocabulary, target, (targets[vocabulary][0] if target else "None"), None)
        for vocabulary, codes in code_map.items()
        for code, target in codes.items()
    ]
    return spark.createDataFrame(
        rows,
        "source_code string, source_concept_id int, source_vocabulary_id string, "
        "target_concept_id int, target_vocabulary_id string, invalid_reason string",
    )
