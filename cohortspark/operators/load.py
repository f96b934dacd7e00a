"""The gated load: a staged registry becomes the current one only when every check of it passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.catalogue import SETTINGS, SOURCE_COLUMNS, Settings
from cohortspark.operators import cdm, checks, commits, publish, typed
from cohortspark.operators.checks import LoadRefused
from cohortspark.session import run_path, together, written
from cohortspark.sources.records import SOURCE_ROW

#: The columns by which the tables of a load are unique.
KEYS: Mapping[str, Sequence[str]] = {
    "records": ("source_year", "source_row"),
    "person": ("person_id",),
    "observation_period": ("observation_period_id",),
    "measurement": ("measurement_id",),
    "observation": ("observation_id",),
    "location": ("location_id",),
}


def refuse_other_columns(staged: DataFrame, wanted: Sequence[str] = SOURCE_COLUMNS) -> None:
    """A staged table must have the source columns, all text, behind its year and row."""
    found = checks.header_problems(staged.columns, ["source_year", SOURCE_ROW, *wanted])
    kinds = dict(staged.dtypes)
    found += [f"column {c} is no text" for c in wanted if kinds.get(c, "string") != "string"]
    if found:
        raise LoadRefused("columns: " + "; ".join(found))


def refuse_unloadable(records: DataFrame, settings: Settings, shown: int = 10) -> None:
    """One pass over the columns the problems read; the first problems are looked for only if there are any."""
    problems = typed.unloadable(records, settings)
    total = problems.agg(F.count(F.lit(1))).first()[0]
    if total:
        found = problems.orderBy("source_year", SOURCE_ROW, "problem").limit(shown).collect()
        first = "; ".join(f"{r.source_year}/{r.source_row}: {r.problem}" for r in found)
        raise LoadRefused(f"unloadable: {total} problems, first {first}")


def refuse_repeated_keys(tables: Mapping[str, DataFrame]) -> None:
    """Every key once; copies are summed before they move, and only a number comes back for each table."""

    def repeated(name: str) -> int:
        return checks.duplicate_keys(tables[name], KEYS[name]).agg(F.count(F.lit(1))).first()[0]

    keyed = [name for name in KEYS if name in tables]
    counted = together(tables[keyed[0]].sparkSession, {name: partial(repeated, name) for name in keyed})
    found = {name: n for name, n in counted.items() if n}
    if found:
        raise LoadRefused(f"keys: {found}")


def gated_load(
    staged: DataFrame,
    target: str,
    concepts: DataFrame,
    code_map: DataFrame,
    vocabularies: DataFrame,
    stage_counts: DataFrame,
    sources: DataFrame,
    version: str,
    settings: Settings = SETTINGS,
) -> str:
    """Load a staged registry and make it the current one; the path of its run.

    In order: the columns, the records that can't be loaded, the keys of the records, the checks that need no
    other table, and, of what was then written, the keys of all tables and the 28 checks. The first that fails raises
    ``LoadRefused`` and the load before stays current; nothing is written before the records have passed.

    ``staged`` is read several times: pass a written table, not a plan. Records are judged again as they were written.
    """
    spark = staged.sparkSession
    base = commits.snapshot(spark, target)
    refuse_other_columns(staged)
    records = typed.typed_records(staged, settings)
    refuse_unloadable(records, settings)
    refuse_repeated_keys({"records": staged})
    source = cdm.cdm_source(sources, version)
    inputs = (code_map, vocabularies, stage_counts, source)
    checks.require_clean(checks.staged_checks(staged, *inputs))

    path = run_path(spark, "load")
    records.write.mode("error").parquet(f"{path}/records")
    records = spark.read.schema(records.schema).parquet(f"{path}/records")
    refuse_unloadable(records, settings)
    built = cdm.build(records, keep=written)

    def check(stored: Mapping[str, DataFrame]) -> None:
        loaded = built.map(lambda name, df: stored[name])
        unlike = checks.unlike_records(loaded, stored["records"]).agg(F.count(F.lit(1))).first()[0]
        known = () if unlike else ("person", "observation_period")
        refuse_repeated_keys({name: df for name, df in stored.items() if name not in known})
        checks.require_clean(
            checks.post_load_checks(loaded, stored["records"], concepts, *inputs, as_called_for=not unlike)
        )

    return publish.load_and_promote(vars(built), check, target, spark, base, path, ["records"])
