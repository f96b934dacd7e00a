"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import (
    centroids,
    decontaminate,
    licenses,
    mixture,
    personal_data,
    quality_classifier,
    quality_rules,
    simhash,
    spelling,
    substring_dedup,
    token_files,
    url_filter,
    warc,
)
from cohortspark.session import tuned

#: Fixed values of the query on urls: its rules, and the host labels that put a host on the list.
URL_RULES = (
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
)
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as flat files, and read back from them."""
    docs = table(spark, sf_dir, "documents")
    return token_files.read_tokens(spark, token_files.write_tokens(docs, tokenizer_file()))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and benchmark items."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.scanned(docs, benchmark, keep=["doc_id"]))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence sentences and licences."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, from labels of the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.filter(~quality_classifier.held_out(F.col("doc_id")))
    scored = quality_classifier.scores(docs, quality_classifier.fit(docs, learned))
    return scored.select(
        "doc_id",
        quality_classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, URL_RULES, url_filter.hosts_with_labels(pages, LISTED_LABELS))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component it belongs to."""
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix."""
    return mixture.taken_words(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, what goes of them, and a digest of what stays."""
    return substring_dedup.removed_spans(table(spark, sf_dir, "documents")).drop("removed")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to archives and read back."""
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    archives = spark.read.parquet(f"{folder}/archives")
    return warc.records(warc.read_archives(spark, archives))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality_rows(docs, quality_rules.fit(docs, labels))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster after three rounds."""
    found = centroids.clusters(table(spark, sf_dir, "embeddings"))
    return found.select("row.vec_id", *[c for c in found.columns if c != "row"])


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: the patterns' counts and digest, and all spans."""
    return personal_data.digest(personal_data.found_in(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_source_mix": op7_source_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_centroids": op11_centroids,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_personal_data": op13_personal_data,
}
