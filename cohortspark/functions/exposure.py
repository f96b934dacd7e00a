"""Exposure measures of a birth, as expression text over weeks, trimester and visits.

Rate combinations, not records: aggregate first, then these expressions run once per combination.
"""

from __future__ import annotations

from collections.abc import Mapping

from cohortspark.catalogue import (
    ANALYSIS,
    CALENDAR,
    LANDMARKS,
    MULTIPLES,
    THIRD_TRIMESTER_WEEK,
    Calendar,
    Variant,
    index_variants,
)
from cohortspark.functions.text import array, cases, quoted, struct

# Fixed values of the adequacy index: expected visits by week, visits missed by start month, levels.
#: (first week of the band, visits); from 35 weeks on, one more visit a week.
EXPECTED_BANDS = ((34, 9), (32, 8), (30, 7), (26, 6), (22, 5), (18, 4))
WEEKLY_FROM, WEEKLY_OFFSET = 35, 26
MISSED_BY_MONTH = (0, 0, 1, 2, 3, 5, 6, 7, 9, 13)
LEVELS = ("Inadequate", "Intermediate", "Adequate", "Adequate Plus")
FIRST_TRIMESTER, LATER_OR_NONE = "trimester 1", "trimester 0, 2 or 3"
VISIT_RANGE, WEEK_RANGE = (0, 90), (18, 50)
WEEKS_PER_MONTH = 4


def visit_cuts(calendar: Calendar = CALENDAR) -> list[tuple[str, int]]:
    """The labels of the visit measure in order, each with its first count."""
    low, full = calendar.minimum, calendar.full
    return [("0", 0), (f"1-{low - 1}", 1), (f"{low}-{full - 1}", low), (f"{full}+", full)]


def visits_level(visits: str = "visits", calendar: Calendar = CALENDAR) -> str:
    """No care, below the minimum, below the full calendar, or the full calendar."""
    first = visit_cuts(calendar)
    return cases(
        *[(f"{visits} >= {start}", quoted(label)) for label, start in reversed(first)]
    )


def first_trimester_level(trimester: str = "trimester") -> str:
    return cases(
        (f"{trimester} = 1", quoted(FIRST_TRIMESTER)),
        (f"{trimester} IS NOT NULL", quoted(LATER_OR_NONE)),
    )


def check_variant(variant: Variant) -> None:
    """Refuse a month rule that leaves its trimester and a calendar that does not rise."""
    for index, month in enumerate(variant.months):
        if not 3 * index < month <= 3 * index + 3:
            raise ValueError(f"{variant.name}: month {month} is not in trimester {index + 1}")
    weeks = variant.calendar
    if weeks is not None and (not weeks or list(weeks) != sorted(set(weeks))):
        raise ValueError(f"{variant.name}: the calendar must hold visits in rising weeks")


def index_refusal() -> str:
    """Why a combination has no index; NULL when it has one."""
    low_visits, high_visits = VISIT_RANGE
    low_weeks, high_weeks = WEEK_RANGE
    return cases(
        ("visits IS NULL OR trimester IS NULL OR weeks IS NULL", "'value missing'"),
        (f"visits NOT BETWEEN {low_visits} AND {high_visits}", "'visits out of range'"),
        (f"weeks NOT BETWEEN {low_weeks} AND {high_weeks}", "'weeks out of range'"),
        ("trimester NOT BETWEEN 0 AND 3", "'trimester unknown'"),
        ("(trimester = 0) <> (visits = 0)", "'trimester and visits disagree'"),
        (
            f"trimester = 3 AND weeks < {THIRD_TRIMESTER_WEEK}",
            "'third trimester not reached'",
        ),
    )


def _reached(calendar: tuple[int, ...], test: str) -> str:
    """How many visits of a calendar meet a test on their first week."""
    return " + ".join(f"if({week} {test}, 1, 0)" for week in calendar)


def index_parts(variant: Variant) -> dict[str, str]:
    """Each step of the index, as expressions over the columns before it.

    The caller projects the steps in turn: start_month, then recommended and missed, then expected,
    then ratio_percent and initiation, then services, then level.
    """
    check_variant(variant)
    first, second, third = variant.months
    start = f"CASE trimester WHEN 0 THEN 0 WHEN 1 THEN {first} WHEN 2 THEN {second} ELSE {third} END"
    if variant.calendar is None:
        recommended = cases(
            (f"weeks >= {WEEKLY_FROM}", f"weeks - {WEEKLY_OFFSET}"),
            *[(f"weeks >= {week}", str(visits)) for week, visits in EXPECTED_BANDS],
        )
        missed = f"element_at(array({', '.join(map(str, MISSED_BY_MONTH))}), ({start}) + 1)"
    else:
        recommended = _reached(variant.calendar, "<= weeks")
        before = _reached(variant.calendar, f"< {WEEKS_PER_MONTH} * (({start}) - 1)")
        missed = f"if(({start}) = 0, 0, {before})"
    return {"start_month": start, "recommended": recommended, "missed": missed}


RATIO = "CAST(visits AS double) / expected * 100"
INITIATION = cases(
    ("start_month BETWEEN 1 AND 2", quoted(LEVELS[3])),
    ("start_month BETWEEN 3 AND 4", quoted(LEVELS[2])),
    ("start_month BETWEEN 5 AND 6", quoted(LEVELS[1])),
    otherwise=quoted(LEVELS[0]),
)
SERVICES = cases(
    ("ratio_percent > 109.99D", quoted(LEVELS[3])),
    ("ratio_percent > 79.99D", quoted(LEVELS[2])),
    ("ratio_percent > 49.99D", quoted(LEVELS[1])),
    otherwise=quoted(LEVELS[0]),
)
SUMMARY = cases(
    (f"initiation IN ({quoted(LEVELS[1])}, {quoted(LEVELS[0])})", quoted(LEVELS[0])),
    otherwise="services",
)


def index_rows(combinations, variants: tuple[Variant, ...] | None = None):
    """Every combination times variant with the index and each step to it.

    A combination the index refuses keeps its row, with the reason and no values.
    """
    variants = index_variants() if variants is None else variants
    rows = array(struct(variant=quoted(v.name), **index_parts(v)) for v in variants)
    checked = combinations.selectExpr("*", f"{index_refusal()} AS refusal")
    accepted = "refusal IS NULL"
    names = ["start_month", "recommended", "missed"]
    return (
        checked.selectExpr("*", f"inline({rows})")
        .selectExpr(
            *[c for c in checked.columns],
            "variant",
            *[f"CASE WHEN {accepted} THEN {name} END AS {name}" for name in names],
        )
        .selectExpr("*", "greatest(recommended - missed, 1) AS expected_raw")
        .selectExpr("*", f"CASE WHEN {accepted} THEN expected_raw END AS expected")
        .drop("expected_raw")
        .selectExpr("*", f"{RATIO} AS ratio_percent")
        .selectExpr(
            "*",
            f"CASE WHEN {accepted} THEN {INITIATION} END AS initiation",
            f"CASE WHEN {accepted} THEN {SERVICES} END AS services",
        )
        .selectExpr("*", f"CASE WHEN {accepted} THEN {SUMMARY} END AS level")
    )


def index_level(variant: Variant, strict: bool = False) -> str:
    """The summary level of one variant as one expression.

    A refused combination has no level; ``strict`` stops the job there, with the reason.
    """
    parts = index_parts(variant)
    ratio = (
        f"(CAST(visits AS double) / greatest(({parts['recommended']}) - ({parts['missed']}), 1)"
        " * 100)"
    )
    services = SERVICES.replace("ratio_percent", ratio)
    late = f"({parts['start_month']}) NOT BETWEEN 1 AND 4"
    level = cases((late, quoted(LEVELS[0])), otherwise=services)
    refused = f"raise_error(concat('index refused: ', {index_refusal()}))"
    otherwise = f"CAST({refused} AS string)" if strict else "NULL"
    return cases((f"({index_refusal()}) IS NULL", level), otherwise=otherwise)


def reference_level(measure: str, calendar: Calendar = CALENDAR) -> str:
    """The level each measure is compared with: care that meets the norm."""
    return {
        "a": f"{calendar.full}+",
        "d": f"{calendar.full}+",
        "a_count": str(calendar.full),
        "b": LEVELS[2],
        "c": FIRST_TRIMESTER,
    }[measure]


def reference_of(measure: str = "measure", calendar: Calendar = CALENDAR) -> str:
    return cases(
        *[
            (f"{measure} = {quoted(name)}", quoted(reference_level(name, calendar)))
            for name in ("a", "a_count", "b", "c", "d")
        ]
    )


def level_order(
    measure: str = "measure", level: str = "level", calendar: Calendar = CALENDAR
) -> str:
    """The display position of a level: by cut point, by index order, or by count."""
    position = lambda labels: cases(
        *[(f"{level} = {quoted(name)}", str(i)) for i, name in enumerate(labels)]
    )
    cuts = [label for label, _ in visit_cuts(calendar)]
    return cases(
        (f"{measure} IN ('a', 'd')", position(cuts)),
        (f"{measure} = 'b'", position(LEVELS)),
        (f"{measure} = 'c'", position((FIRST_TRIMESTER, LATER_OR_NONE))),
        otherwise=f"try_cast({level} AS int)",
    )


def measure_structs(
    names: tuple[str, ...],
    calendar: Calendar = CALENDAR,
    variants: tuple[Variant, ...] | None = None,
    strict: bool = False,
) -> list[str]:
    """(measure, variant, level) of each named measure; (b) once per variant."""
    variants = index_variants(calendar) if variants is None else variants
    simple = {
        "a": visits_level("visits", calendar),
        "d": visits_level("visits", calendar),
        "a_count": "CAST(visits AS string)",
        "c": first_trimester_level(),
    }
    out = []
    for name in names:
        if name == "b":
            out += [
                struct(measure="'b'", variant=quoted(v.name), level=index_level(v, strict))
                for v in variants
            ]
        else:
            out.append(struct(measure=quoted(name), variant="''", level=simple[name]))
    return out


def definition_measures(
    analysis: int = ANALYSIS,
    landmarks: Mapping[int, int] = LANDMARKS,
    multiples: int = MULTIPLES,
) -> dict[int, tuple[str, ...]]:
    """The measures rated on each definition."""
    return {
        analysis: ("a", "a_count", "b", "c"),
        **{definition: ("d",) for definition in landmarks},
        multiples: ("a", "c"),
    }


def exposure_rows(subjects):
    """Visits, trimester and the two row-level measures of every subject; unknown stays NULL."""
    return (
        subjects.filter("loaded")
        .selectExpr("subject_id", "try_cast(visits AS int) AS visits", "trimester")
        .selectExpr(
            "subject_id",
            "visits",
            "trimester AS first_visit_trimester",
            f"{visits_level()} AS visits_level",
            "trimester = 1 AS first_trimester_start",
        )
    )
