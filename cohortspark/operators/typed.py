"""Typed records: one row per staged record with value, rule and raw text of every field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.catalogue import (
    COUNTED_FIELDS,
    MOTHER_DATE_VOCABULARY,
    RULES,
    SETTINGS,
    Field,
    Ids,
    Settings,
)
from cohortspark.functions.casting import (
    field_rule,
    field_value,
    is_code,
    safe_date,
    safe_number,
)
from cohortspark.functions.text import array, cases, known_true, quoted, struct


def person_id(ids: Ids, year: str = "source_year", row: str = "source_row") -> str:
    """The mother's id: years since the first one, times the rows a year can hold, plus the row."""
    return f"CAST({year} - {ids.first_year} AS bigint) * {ids.rows_per_year} + {row}"


def _value_name(field: Field) -> str:
    if field.name == "sex":
        return "newborn_gender_concept_id"
    return f"{field.name}_concept_id" if field.kind == "concept" else field.name


def typed_records(staged: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Cast every field of the staged text; narrow projections, no join and no shuffle.

    ``staged`` holds ``source_year``, ``source_row`` and the source columns as text.
    """
    codes = settings.code_map
    age = settings.by_name("age")
    plurality = settings.by_name("plurality")
    mother = "fechanacimientomadre"
    not_a_code = f"NOT {is_code(mother, codes.get(MOTHER_DATE_VOCABULARY, {}))}"
    sources = [f.source for f in settings.fields]
    rules = [f"{f.name}_rule" for f in settings.fields]
    parsed = staged.selectExpr(
        "source_year",
        "source_row",
        f"{person_id(settings.ids)} AS person_id",
        "fechanacimiento",
        f"{safe_date('fechanacimiento')} AS delivery_date",
        f"CASE WHEN {not_a_code} THEN {safe_date(mother)} END AS mother_birth_date",
        f"CASE WHEN NOT {is_code(age.source, codes.get(age.vocabulary, {}))} "
        f"THEN {safe_number(age.source, 'int')} END AS declared_age",
        *sources,
        *[f"{field_rule(f, codes.get(f.vocabulary, {}))} AS {f.name}_rule" for f in settings.fields],
    )
    by_date = "year_of_birth_case = 'mother_date'"
    values = {
        _value_name(f): field_value(f, f"{f.name}_rule", codes.get(f.vocabulary, {}))
        for f in settings.fields
    }
    values["newborn_gender_concept_id"] = f"coalesce({values['newborn_gender_concept_id']}, 0)"
    case = cases(
        ("mother_birth_date < delivery_date", "'mother_date'"),
        ("declared_age IS NOT NULL AND delivery_date IS NOT NULL", "'age'"),
    )
    at_least = f"plurality_rule = 'value' AND {plurality.source} = {quoted(plurality.listed[-1])}"
    return parsed.withColumn("year_of_birth_case", F.expr(case)).selectExpr(
        "source_year",
        "source_row",
        "person_id",
        f"person_id + {settings.ids.newborn_offset} AS newborn_person_id",
        "fechanacimiento",
        "delivery_date",
        "year_of_birth_case IS NOT NULL AS loaded",
        "year_of_birth_case",
        f"CASE WHEN {by_date} THEN year(mother_birth_date) WHEN year_of_birth_case = 'age' "
        "THEN year(delivery_date) - declared_age END AS year_of_birth",
        f"CASE WHEN {by_date} THEN month(mother_birth_date) END AS month_of_birth",
        f"CASE WHEN {by_date} THEN day(mother_birth_date) END AS day_of_birth",
        *sources,
        *rules,
        *[f"{text} AS {name}" for name, text in values.items()],
        f"{known_true(at_least)} AS plurality_at_least",
    )


def joined_codes(staged: DataFrame, code_map: DataFrame, fields) -> DataFrame:
    """The target of each field from the code map as a table: one left join per field.

    ``code_map`` holds (source_vocabulary_id, source_code, target_concept_id, invalid_reason). Its
    size is not known here, so no side is hinted; a small map is broadcast by its measured size.
    The literal-map form in ``typed_records`` needs no join; this one serves maps too large for a
    literal.
    """
    valid = code_map.filter("invalid_reason IS NULL")
    result = staged
    for f in fields:
        lookup = valid.filter(f"source_vocabulary_id = {quoted(f.vocabulary)}").selectExpr(
            f"source_code AS {f.source}", f"target_concept_id AS {f.name}_target"
        )
        result = result.join(lookup, f.source, "left")
    return result


def rule_counts(records: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Records per year and rule, zero included: one aggregation, then wide to long."""
    entries: list[tuple[str, str, str]] = [
        ("staging", "rows", "true"),
        ("person", "not_loaded:no_year_of_birth", "NOT loaded"),
        ("person", "year_of_birth:mother_date", "year_of_birth_case = 'mother_date'"),
        ("person", "year_of_birth:age", "year_of_birth_case = 'age'"),
    ]
    for name, table, label in COUNTED_FIELDS:
        for rule in RULES[settings.by_name(name).kind]:
            entries.append((table, f"{label}:{rule}", f"loaded AND {name}_rule = {quoted(rule)}"))
        if name == "plurality":
            entries.append((table, f"{label}:at_least", "loaded AND plurality_at_least"))
    wide = records.groupBy("source_year").agg(
        *[F.expr(f"count_if({test}) AS n{i}") for i, (_, _, test) in enumerate(entries)]
    )
    rows = array(
        struct(cdm_table=quoted(table), rule=quoted(rule), row_count=f"n{i}")
        for i, (table, rule, _) in enumerate(entries)
    )
    return wide.selectExpr("source_year", f"inline({rows})")


def unloadable(records: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row per problem that stops a load: bad delivery date, row out of range, long text.

    A source year outside the range of the id scheme is a problem as well.
    """
    ids = settings.ids
    pair = (
        "coalesce(length(resideextranjero), 0) + 1 + coalesce(length(entidadresidencia), 0) > 50"
    )
    shown = "concat(\"'\", replace(fechanacimiento, \"'\", \"''\"), \"'\")"
    problems = [
        (
            "delivery_date IS NULL",
            f"concat('FECHANACIMIENTO ', coalesce({shown}, 'blank'), "
            "' is not a valid dd/mm/yyyy date')",
        ),
        (
            f"source_row NOT BETWEEN 1 AND {ids.rows_per_year - 1}",
            "'source_row does not fit person_id'",
        ),
        (
            f"source_year NOT BETWEEN {ids.first_year} AND {ids.last_year}",
            "'source_year does not fit person_id'",
        ),
        (pair, "'RESIDEEXTRANJERO|ENTIDADRESIDENCIA is longer than 50 characters'"),
    ]
    for f in settings.fields:
        if f.kind != "two_digits":
            message = f"{f.source.upper()} is longer than {f.max_length} characters"
            problems.append((f"length({f.source}) > {f.max_length}", quoted(message)))
    found = array(cases((test, message)) for test, message in problems)
    return records.selectExpr(
        "source_year", "source_row", f"explode({found}) AS problem"
    ).filter("problem IS NOT NULL")


def first_with_total(rows: DataFrame, order: list[str], first: int = 10) -> DataFrame:
    """The first rows by an order, each with the count of all of them."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.orderBy(*order).limit(first).withColumn("total", total)


def uncountable(records: DataFrame, fields: tuple[str, ...] = ("weeks", "visits")) -> DataFrame:
    """Numbers too large for the int columns of the counts, which would be dropped without a word."""
    found = array(
        cases(
            (
                f"{name} IS NOT NULL AND try_cast({name} AS int) IS NULL",
                struct(field=quoted(name), value=f"CAST({name} AS string)"),
            )
        )
        for name in fields
    )
    return records.selectExpr("source_year", "source_row", f"inline({found})").filter(
        "field IS NOT NULL"
    )
