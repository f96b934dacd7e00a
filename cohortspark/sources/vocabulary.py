"""Vocabulary files (tab-separated, no quoting) and digests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The seven vocabulary tables, as DDL schemas.
SCHEMAS = {
    "concept": "concept_id int, concept_name string, domain_id string, vocabulary_id string, "
    "concept_class_id string, standard_concept string, concept_code string, "
    "valid_start_date date, valid_end_date date, invalid_reason string",
    "vocabulary": "vocabulary_id string, vocabulary_name string, vocabulary_reference string, "
    "vocabulary_version string, vocabulary_concept_id int",
    "domain": "domain_id string, domain_name string, domain_concept_id int",
    "concept_class": "concept_class_id string, concept_class_name string, "
    "concept_class_concept_id int",
    "relationship": "relationship_id string, relationship_name string, is_hierarchical string, "
    "defines_ancestry string, reverse_relationship_id string, relationship_concept_id int",
    "concept_relationship": "concept_id_1 int, concept_id_2 int, relationship_id string, "
    "valid_start_date date, valid_end_date date, invalid_reason string",
    "concept_ancestor": "ancestor_concept_id int, descendant_concept_id int, "
    "min_levels_of_separation int, max_levels_of_separation int",
}

TSV_OPTIONS = {
    "sep": "\t",
    "quote": "",
    "header": "true",
    "dateFormat": "yyyyMMdd",
    "mode": "FAILFAST",
    "enforceSchema": "false",
    "encoding": "UTF-8",
}


def read_vocabulary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A vocabulary table: the header must match, a quote is a plain character, empty is NULL."""
    return spark.read.schema(schema).options(**TSV_OPTIONS).csv(path)


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """A code map file with every column as text, as its rules are checked on the text."""
    from cohortspark.sources.records import read_records

    columns = (
        "source_code",
        "source_concept_id",
        "source_vocabulary_id",
        "source_code_description",
        "target_concept_id",
        "target_vocabulary_id",
        "valid_start_date",
        "valid_end_date",
        "invalid_reason",
    )
    return read_records(spark, path, columns)


def file_digests(
    spark: SparkSession, path: str, depth: int = 1, whole_bytes: int = 256 << 20
) -> DataFrame:
    """Name, bytes and sha256 of every file under a path; one task reads one file at a time.

    The name is the last ``depth`` parts of the path, so that files of several folders differ. A
    file up to ``whole_bytes`` is read whole by the scan; a larger one is read in pieces.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    small = files.filter(F.col("length") <= whole_bytes).selectExpr(
        "path", "length", "sha2(content, 256) AS sha256"
    )

    def in_pieces(batches):
        import hashlib

        from pyarrow import fs

        for batch in batches:
            found = []
            for uri in batch["path"]:
                system, name = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while piece := stream.read(8 << 20):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield batch.assign(sha256=found)

    large = (
        files.filter(F.col("length") > whole_bytes)
        .select("path", "length")
        .repartition("path")
        .mapInPandas(in_pieces, "path string, length bigint, sha256 string")
    )
    return small.unionByName(large).selectExpr(
        f"array_join(slice(split(path, '/'), -{depth}, {depth}), '/') AS name",
        "length AS bytes",
        "sha256",
    )


def digest_problems(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Recorded files (name, bytes, sha256) that are missing, or whose content is another."""
    problem = (
        "CASE WHEN f_sha IS NULL THEN 'missing' WHEN f_bytes <> bytes THEN 'size differs' "
        "WHEN f_sha <> sha256 THEN 'digest differs' END AS problem"
    )
    read = found.selectExpr("name", "bytes AS f_bytes", "sha256 AS f_sha")
    return (
        expected.join(read, "name", "left")
        .selectExpr("name", problem)
        .filter(F.col("problem").isNotNull())
    )
