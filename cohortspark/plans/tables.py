"""The shared inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.catalogue import CODE_MAP, CONCEPTS, VOCABULARY_TARGETS
from cohortspark.operators import cdm, counts, funnel
from cohortspark.operators.typed import typed_records
from cohortspark.session import smaller_tasks, together, tuned, written
from cohortspark.sources.proxy import PROXY_SETTINGS, PROXY_YEARS, damaged_registry, registry

PERIOD = "all"
AXIS_YEARS = (2000, 2001)
GRID = counts.analyses(PERIOD, PROXY_YEARS, AXIS_YEARS)
MAIN = [a for a in GRID if not a.stratum]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(tuned(spark), sf_dir)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_records(staged(spark, sf_dir), PROXY_SETTINGS)


def damaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_records(damaged_registry(tuned(spark), sf_dir), PROXY_SETTINGS)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its criteria and the step it leaves each definition at."""
    return funnel.exits(
        funnel.criteria(records(spark, sf_dir), PROXY_YEARS, PROXY_SETTINGS)
    )


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.exit_summary(subjects(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.aggregated_counts(subjects(spark, sf_dir))


def analysis_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.combinations(subjects(spark, sf_dir), (2,)).drop("definition")


def written_load(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = tuple(cdm.LOAD_INPUTS)
) -> tuple[DataFrame, cdm.Cdm]:
    """Some columns of the typed records, and the event tables of a load, each computed once and written.

    The event tables are independent of one another once the records are ranked, so they are written at the same time.
    """
    with smaller_tasks(tuned(spark)):
        typed = written(records(spark, sf_dir).select(*columns), "records")
        return typed, written_together(cdm.build(typed, keep=written))


def written_together(built: cdm.Cdm) -> cdm.Cdm:
    """Every table of a load written, by jobs that run side by side: one's last tasks leave no core idle."""
    jobs = {name: partial(written, df, name) for name, df in vars(built).items()}
    return cdm.Cdm(**together(built.person.sparkSession, jobs))


def concepts(spark: SparkSession) -> DataFrame:
    """The vocabulary rows of the declared concepts and the targets of the code map."""
    rows = {0: ("Metadata", "None", "No matching concept", None)}
    for vocabulary, codes in CODE_MAP.items():
        target_vocabulary, domain = VOCABULARY_TARGETS[vocabulary]
        for target in codes.values():
            if target:
                rows[target] = (domain, target_vocabulary, str(target), "S")
    for concept_id, domain, vocabulary, code in CONCEPTS.values():
        rows[concept_id] = (domain, vocabulary, code, "S")
    return spark.createDataFrame(
        [(k, *v, None) for k, v in sorted(rows.items())],
        "concept_id int, domain_id string, vocabulary_id string, concept_code string, "
        "standard_concept string, invalid_reason string",
    )


def code_map(spark: SparkSession) -> DataFrame:
    return cdm.code_map_table(spark, CODE_MAP, VOCABULARY_TARGETS)


def part_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code map with one row per part, some of them breaking a rule each."""
    return table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 41 = 0 THEN '' ELSE string(p_partkey - p_partkey % 37 % 2) END "
        "AS source_code",
        "CASE WHEN p_partkey % 43 = 0 THEN '7' ELSE '0' END AS source_concept_id",
        "p_brand AS source_vocabulary_id",
        "CASE WHEN p_partkey % 47 = 0 THEN repeat('x', 256) ELSE p_name END "
        "AS source_code_description",
        "CASE WHEN p_partkey % 53 = 0 THEN '-1' WHEN p_partkey % 3 = 0 THEN '0' "
        "ELSE string(p_partkey) END AS target_concept_id",
        "CASE WHEN p_partkey % 6 = 0 OR p_partkey % 59 = 0 THEN 'None' ELSE p_type END "
        "AS target_vocabulary_id",
        "CASE WHEN p_partkey % 61 = 0 THEN '2020-13-01' ELSE '2020-01-01' END "
        "AS valid_start_date",
        "CASE WHEN p_partkey % 67 = 0 THEN '2019-12-31' ELSE '2023-12-31' END AS valid_end_date",
        "CASE WHEN p_partkey % 71 = 0 THEN 'X' WHEN p_partkey % 73 = 0 THEN 'D' END "
        "AS invalid_reason",
    )


def part_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared vocabularies of that map: most brands, and two that have no rows."""
    brands = (
        table(spark, sf_dir, "part")
        .filter("p_brand NOT LIKE '%5'")
        .selectExpr("p_brand AS vocabulary_id")
        .distinct()
        .selectExpr(
            "vocabulary_id",
            "CASE WHEN vocabulary_id LIKE '%1' THEN NULL ELSE 'Part' END AS target_domain_id",
        )
    )
    regions = table(spark, sf_dir, "region").filter("r_regionkey < 2").selectExpr(
        "r_name AS vocabulary_id", "'Part' AS target_domain_id"
    )
    return brands.unionByName(regions)


def part_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary with one concept per part."""
    return table(spark, sf_dir, "part").filter("p_partkey % 19 <> 4").selectExpr(
        "CAST(p_partkey AS int) AS concept_id",
        "element_at(array('Measurement', 'Unit', 'Observation', 'Type Concept'), "
        "CAST(p_partkey % 4 + 1 AS int)) AS domain_id",
        "p_brand AS vocabulary_id",
        "string(p_size) AS concept_code",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'S' END AS standard_concept",
        "CASE WHEN p_partkey % 13 = 0 THEN 'D' END AS invalid_reason",
    )


def item_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct uses of parts as concepts in fields, from the line items."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "CAST(l_partkey AS int) AS concept_id",
            "element_at(array('measurement.measurement_concept_id', "
            "'measurement.unit_concept_id', 'observation.observation_concept_id', "
            "'measurement.measurement_type_concept_id', 'person.person_id'), "
            "CAST(l_linenumber % 5 + 1 AS int)) AS field",
        )
        .distinct()
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(staged(spark, sf_dir))


def files_of(staged: DataFrame) -> DataFrame:
    """One row per record file: a name, a version and a digest that follow from its records."""
    return (
        staged.groupBy("source_year")
        .agg(F.expr("count(*) AS n"), F.expr("max(source_row) AS last"))
        .selectExpr(
            "source_year",
            "concat('births_', source_year, '.csv') AS name",
            "string(n) AS version",
            "sha2(concat(source_year, ':', last), 256) AS sha256",
            "make_date(source_year + 1, 1, 31) AS retrieved",
        )
    )
