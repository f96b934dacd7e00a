"""Publishing: validated tables, sorted CSV, read-back, manifest and promotion of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.text import array, cases, quoted
from cohortspark.operators import commits
from cohortspark.operators.checks import LoadRefused, bag_difference
from cohortspark.session import run_path, together, written
from cohortspark.sources.records import CSV_WRITE


@dataclass(frozen=True)
class OutputTable:
    """A published table: its columns with types, the nullable ones, and its key."""

    name: str
    schema: str
    key: tuple[str, ...]
    nullable: tuple[str, ...] = ()

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromDDL(self.schema)


_COUNTED = (
    "source string, cohort_definition_id int, period string, outcome_cutoff int, measure string, "
    "variant string, level string, "
)
_ESTIMATE_KEY = (
    "source", "cohort_definition_id", "period", "outcome_cutoff", "measure", "variant", "level",
)

OUTPUT_TABLES: Mapping[str, OutputTable] = {
    table.name: table
    for table in (
        OutputTable(
            "attrition",
            "cohort_definition_id int, source_year int, step int, kind string, "
            "description string, remaining bigint, excluded bigint",
            ("cohort_definition_id", "source_year", "step"),
            ("kind", "excluded"),
        ),
        OutputTable(
            "exposure_distribution",
            _COUNTED + "outcome string, stratum_variable string, stratum_value string, births bigint",
            (*_ESTIMATE_KEY, "outcome", "stratum_variable", "stratum_value"),
        ),
        OutputTable(
            "estimates",
            _COUNTED + "reference string, model string, stratum_variable string, "
            "stratum_value string, births bigint, preterm_births bigint, odds_ratio double, "
            "lower_limit double, upper_limit double",
            (*_ESTIMATE_KEY, "model", "stratum_variable", "stratum_value"),
            ("odds_ratio", "lower_limit", "upper_limit"),
        ),
        OutputTable(
            "truncation_share",
            "cohort_definition_id int, measure string, variant string, level string, "
            "scenario string, reference string, observed_odds_ratio double, "
            "observed_lower double, observed_upper double, simulated_odds_ratio double, "
            "observed_risk_difference double, simulated_risk_difference double, share double",
            ("cohort_definition_id", "measure", "variant", "level", "scenario"),
            (
                "observed_odds_ratio", "observed_lower", "observed_upper", "simulated_odds_ratio",
                "observed_risk_difference", "simulated_risk_difference", "share",
            ),
        ),
        OutputTable(
            "excluded_profile",
            "cohort_definition_id int, step int, subject_group string, births bigint, "
            "preterm_percent decimal(5,2), first_trimester_start_percent decimal(5,2), "
            "no_prenatal_care_percent decimal(5,2)",
            ("cohort_definition_id", "step", "subject_group"),
            (
                "preterm_percent", "first_trimester_start_percent", "no_prenatal_care_percent",
            ),
        ),
    )
}


def violations(df: DataFrame, table: OutputTable) -> DataFrame:
    """Cells a published file cannot hold: (column, problem, rows)."""
    rules = []
    for f in table.struct:
        name = f.name
        problem = []
        if name not in table.nullable:
            problem.append((f"{name} IS NULL", "'NULL where none is allowed'"))
        elif isinstance(f.dataType, T.StringType):
            problem.append((f"{name} = ''", "'empty text would read back as NULL'"))
        if isinstance(f.dataType, T.DoubleType):
            problem.append(
                (f"isnan({name}) OR abs({name}) = double('Infinity')", "'not a finite number'")
            )
        for test, message in problem:
            rules.append(
                cases((test, f"named_struct('column', {quoted(name)}, 'problem', {message})"))
            )
    found = df.selectExpr(f"inline({array(rules)})").filter("problem IS NOT NULL")
    return found.groupBy("column", "problem").agg(F.expr("count(*) AS rows"))


#: Names of published columns that the operators call otherwise.
PUBLISHED = {"definition": "cohort_definition_id", "cutoff": "outcome_cutoff"}


def as_published(df: DataFrame, **constants) -> DataFrame:
    """The rows under their published names, with constants for columns they lack."""
    return df.withColumnsRenamed(PUBLISHED).withColumns({k: F.lit(v) for k, v in constants.items()})


def scenario_rows(df: DataFrame, period: str, cutoff: int) -> DataFrame:
    """Rows of the null model as rows of the observed tables: their source names the scenario.

    Their births are expectations; a published count is the nearest whole number.
    """
    named = as_published(
        df, period=period, outcome_cutoff=cutoff, stratum_variable="", stratum_value=""
    )
    whole = {c: F.round(c).cast("bigint") for c in ("births", "preterm_births") if c in df.columns}
    return named.withColumns(whole).withColumn("source", F.concat(F.lit("sim_"), "scenario"))


def conform(df: DataFrame, table: OutputTable) -> DataFrame:
    """The columns of the published table, in order, in its types."""
    return df.selectExpr(
        *[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in table.struct]
    )


def publish(df: DataFrame, table: OutputTable, path: str, files: int | None = None) -> DataFrame:
    """Write a table as CSV sorted by its key, and give back what reads from it.

    The rows are computed once, to a written copy; a copy with a cell that would not read back is refused
    before any CSV is written. By default the rows are sorted across as many files as their size calls for, one for
    a summary; ``files`` sets a number. Files in the order of their names are in the order of the key.
    """
    rows = written(conform(df, table), table.name)
    found = violations(rows, table).collect()
    if found:
        raise LoadRefused("; ".join(f"{r.column}: {r.problem} ({r.rows})" for r in found))
    ordered = (
        rows.orderBy(*table.key)
        if files is None
        else rows.repartitionByRange(files, *table.key).sortWithinPartitions(*table.key)
    )
    ordered.write.mode("overwrite").options(**CSV_WRITE, nullValue="", emptyValue="").csv(path)
    return read_published(df.sparkSession, table, path)


def read_published(spark: SparkSession, table: OutputTable, path: str) -> DataFrame:
    """A published CSV with its declared types; a file that does not read as them is refused.

    An empty field is NULL in a nullable column and empty text elsewhere.
    """
    read = (
        spark.read.schema(table.struct)
        .options(header="true", quote='"', escape='"', mode="FAILFAST", enforceSchema="false")
        .csv(path)
    )
    texts = {
        f.name: F.coalesce(F.col(f.name), F.lit(""))
        for f in table.struct
        if isinstance(f.dataType, T.StringType) and f.name not in table.nullable
    }
    return read.withColumns(texts) if texts else read


def order_breaks(spark: SparkSession, table: OutputTable, path: str) -> DataFrame:
    """``file`` and ``breaks`` of published files: rows whose key is less than that of the row before.

    The row before the first of a file is the last of the file before, by name. Each task compares the rows it reads
    and sends the first and last key of each block of a file; the blocks, a row each, are then compared in order.
    """
    read = spark.read.schema(table.struct).options(header="true", quote='"', escape='"', mode="FAILFAST").csv(path)
    rows = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.struct(*table.key).alias("key"),
    )
    kind = rows.schema["key"].dataType.simpleString()

    def block_ends(batches):
        """For each run of rows of one block of a file: its first and last key, and the steps down between."""
        import pyarrow as pa

        done, current, schema = [], None, None

        def rank(key: dict) -> tuple:
            return tuple((value is not None, value) for value in key.values())

        for batch in batches:
            schema = batch.schema
            for file, block, key in zip(*(column.to_pylist() for column in batch.columns)):
                if current is None or current[:2] != [file, block]:
                    current = [file, block, key, key, 0]
                    done.append(current)
                    continue
                current[4] += rank(key) < rank(current[3])
                current[3] = key
        if done:
            kind = schema.field("key").type
            kinds = (pa.string(), pa.int64(), kind, kind, pa.int64())
            names = ("file", "block", "first", "last", "breaks")
            columns = [pa.array(column, t) for column, t in zip(zip(*done), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    blocks = rows.mapInArrow(block_ends, f"file string, block long, first {kind}, last {kind}, breaks long")
    before = Window.orderBy("file", "block")  # a row for each block
    return (
        blocks.withColumn("_step", (F.lag("last").over(before) > F.col("first")).cast("long"))
        .withColumn("breaks", F.expr("breaks + coalesce(_step, 0)"))
        .groupBy("file")
        .agg(F.sum("breaks").alias("breaks"))
    )


#: Parts of a bag that are compared by fingerprint first.
RANGES = 4096


def differing_ranges(first: DataFrame, second: DataFrame, columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """``range``: the parts, by hash of the row, in which two bags of rows differ.

    A part is compared by its number of rows and the sums and exclusive ors of two 64-bit hashes of them, so only some
    numbers for each part leave a task. Nulls have a hash of their own.
    """
    values = ", ".join([*columns, *[f"isnull({c})" for c in columns]])
    sides = None
    for df, sign in ((first, 1), (second, -1)):
        hashed = df.selectExpr(f"xxhash64({values}) AS h", f"xxhash64(7, {values}) AS g", f"{sign}L AS sign")
        sides = hashed if sides is None else sides.unionByName(hashed)
    total = "sum(sign * CAST({0} AS decimal(20,0)))"
    return (
        sides.groupBy(F.expr(f"int(pmod(h, {ranges})) AS range"))
        .agg(
            F.expr("sum(sign) AS n"), F.expr("bit_xor(h) AS x"), F.expr("bit_xor(g) AS y"),
            F.expr(f"{total.format('h')} AS s"), F.expr(f"{total.format('g')} AS t"),
        )
        .filter("n <> 0 OR x <> 0 OR y <> 0 OR s <> 0 OR t <> 0")
        .select("range")
    )


def ranged_difference(first: DataFrame, second: DataFrame, columns: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """Rows of each bag that are not in the other, counted exactly in the parts that differ and nowhere else."""
    found = written(differing_ranges(first, second, columns, ranges), "differing_ranges")
    if found.isEmpty():
        return bag_difference(first.limit(0), second.limit(0), list(columns))
    values = ", ".join([*columns, *[f"isnull({c})" for c in columns]])
    held = F.broadcast(found)  # at most ``ranges`` numbers
    parts = [
        df.withColumn("_range", F.expr(f"int(pmod(xxhash64({values}), {ranges}))"))
        .join(held, F.col("_range") == held["range"], "left_semi")
        .drop("_range")
        for df in (first, second)
    ]
    return bag_difference(*parts, list(columns))


def roundtrip_differences(df: DataFrame, table: OutputTable, read: DataFrame) -> DataFrame:
    """Rows of the table and of its file that are not in the other, as bags."""
    return ranged_difference(conform(df, table), read, [f.name for f in table.struct])


def run_manifest(
    years: DataFrame, sources: DataFrame, vocabulary: Mapping[str, str], files: DataFrame
) -> DataFrame:
    """One row: the period, each source with its digest, the vocabulary and each written file.

    ``years`` (year), ``sources`` (id, version, sha256) and ``files`` (name, sha256) are a row per
    year or file.
    """
    period = years.agg(F.expr("array_sort(collect_set(year)) AS period"))
    source = sources.agg(
        F.expr("array_sort(collect_list(named_struct('id', id, 'version', version, 'sha256', sha256)))")
        .alias("sources")
    )
    listed = files.agg(
        F.expr("array_sort(collect_list(named_struct('name', name, 'sha256', sha256))) AS files")
    )
    return period.select(
        "period",
        source.scalar().alias("sources"),
        F.expr(
            f"named_struct('version', {quoted(vocabulary['version'])}, "
            f"'sha256', {quoted(vocabulary['sha256'])})"
        ).alias("vocabulary"),
        listed.scalar().alias("files"),
    )


def write_manifest(manifest: DataFrame, path: str) -> DataFrame:
    """The manifest as one JSON line in a file, and what reads back from it."""
    manifest.select(F.to_json(F.struct(*manifest.columns)).alias("value")).coalesce(1).write.text(path)
    return manifest.sparkSession.read.schema(manifest.schema).json(path)


def load_and_promote(
    tables: Mapping[str, DataFrame],
    check,
    target: str,
    spark: SparkSession,
    base: commits.Snapshot | None = None,
    path: str | None = None,
    held: Sequence[str] = (),
) -> str:
    """Write tables to a path of this run, check what was written, and then make it the current one.

    ``check`` gets the written tables and raises to refuse them; the previous run then stays the current one. Several
    loads may promote to one target: each starts from a snapshot (``base``, by default the newest at the start), and
    one that finds its tables promoted by another since then is refused with ``commits.Conflict``. ``held`` names
    tables that the run has written to its ``path`` before, as others are made of them; they are checked and promoted
    like those written here.
    """
    base = commits.snapshot(spark, target) if base is None else base
    path = run_path(spark, "load") if path is None else path
    together(spark, {name: partial(df.write.mode("error").parquet, f"{path}/{name}") for name, df in tables.items()})
    names = [*held, *tables]
    check({name: spark.read.parquet(f"{path}/{name}") for name in names})
    commits.commit(spark, target, base, {name: f"{path}/{name}" for name in names})
    return path


def current(spark: SparkSession, target: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of the run promoted last."""
    held = commits.snapshot(spark, target)
    return {name: spark.read.parquet(held.entries[name]) for name in names}
