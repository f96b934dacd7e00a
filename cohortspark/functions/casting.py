"""Expressions that turn text into values without ever failing a row.

Each takes column names and gives expression text of built-in functions, so a whole typed load is
one projection. ``\\z`` ends every pattern, because ``$`` accepts a trailing line break.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from cohortspark.catalogue import Field
from cohortspark.functions.text import cases, map_literal, quoted

NUMBER = "decimal(38,0)"


def _matches(text: str, pattern: str) -> str:
    return f"{text} RLIKE {quoted(pattern)}"


def digits(text: str) -> str:
    return _matches(text, r"^[0-9]+\z")


def safe_date(text: str) -> str:
    """dd/mm/yyyy that names a calendar day, else NULL; there is no year 0."""
    test = _matches(text, r"^[0-9]{2}/[0-9]{2}/(?!0000)[0-9]{4}\z")
    iso = f"concat(substr({text}, 7, 4), '-', substr({text}, 4, 2), '-', substr({text}, 1, 2))"
    return f"CASE WHEN {test} THEN try_cast({iso} AS date) END"


def safe_number(text: str, type_: str = NUMBER) -> str:
    """Digits only that fit the type, else NULL: no blanks, no sign."""
    return f"CASE WHEN {digits(text)} THEN try_cast({text} AS {type_}) END"


def is_code(text: str, codes: Mapping[str, int]) -> str:
    """Whether the text is one of the codes; false, never NULL, for a blank."""
    if not codes:
        return "false"
    return f"coalesce({text} IN ({', '.join(quoted(c) for c in codes)}), false)"


def code_target(text: str, codes: Mapping[str, int]) -> str:
    """The target concept of a code, NULL for a text the map does not hold."""
    return f"try_element_at({map_literal(codes)}, {text})" if codes else "CAST(NULL AS int)"


def field_rule(field: Field, codes: Mapping[str, int]) -> str:
    """The name of the rule a source value meets; exactly one for every row."""
    text = field.source
    blank = (f"{text} IS NULL", "'blank'")
    if field.kind == "concept":
        target = code_target(text, codes)
        return cases(
            blank,
            (f"{target} = 0", "'code_to_0'"),
            (f"{target} IS NOT NULL", "'code_to_concept'"),
            otherwise="'not_in_catalogue'",
        )
    coded = (is_code(text, codes), "'code_to_null'")
    if field.kind == "listed":
        listed = ", ".join(quoted(v) for v in field.listed)
        return cases(
            blank, coded, (f"{text} IN ({listed})", "'value'"), otherwise="'not_in_catalogue'"
        )
    if field.kind == "two_digits":
        two = _matches(text, r"^[0-9]{2}\z")
        return cases(blank, coded, (two, "'value'"), otherwise="'not_two_digits'")
    if field.kind == "number":
        return cases(
            blank,
            coded,
            (f"NOT {digits(text)}", "'not_integer'"),
            (f"length({text}) > 38 AND try_cast({text} AS {NUMBER}) IS NULL", "'too_long'"),
            otherwise="'value'",
        )
    raise ValueError(f"unknown field kind {field.kind!r}")


def field_value(field: Field, rule: str, codes: Mapping[str, int]) -> str:
    """The typed value under its rule: a number, a concept id, or a two-digit text."""
    text = field.source
    if field.kind == "concept":
        return cases(
            (f"{rule} = 'code_to_concept'", code_target(text, codes)),
            (f"{rule} IN ('code_to_0', 'not_in_catalogue')", "0"),
        )
    if field.kind == "two_digits":
        return cases((f"{rule} = 'value'", text))
    return cases((f"{rule} = 'value'", f"try_cast({text} AS {NUMBER})"))


def banded(value: str, bands: Sequence[tuple[int | None, str]]) -> str:
    """The label of the first band whose upper bound the value is below; NULL stays NULL."""
    return cases(
        *[
            (f"{value} IS NOT NULL" if upper is None else f"{value} < {upper}", quoted(name))
            for upper, name in bands
        ]
    )


def grouped_code(text: str, groups: Mapping[str, str], otherwise: str) -> str:
    """The group of a code, and ``otherwise`` for a text no group lists."""
    return f"coalesce(try_element_at({map_literal(groups)}, {text}), {quoted(otherwise)})"
