"""Small registries made for these tests: each record says which step it leaves each definition at."""

from __future__ import annotations

from cohortspark.catalogue import SOURCE_COLUMNS

SHORT = (
    "born mother age abroad state weeks plural visits start school sex weight cover".split()
)
TYPICAL = {
    "born": "09/11/2019",
    "mother": "17/06/1992",
    "age": "27",
    "abroad": "2",
    "state": "17",
    "weeks": "38",
    "plural": "1",
    "visits": "9",
    "start": "1",
    "school": "71",
    "sex": "2",
    "weight": "2950",
    "cover": "03",
}
YEAR = 2019
DEFINITIONS = (1, 2, 3, 4, 5, 6)


def typical(**changes):
    return {**TYPICAL, **changes}


def leaves(step, **changes):
    """A record that leaves all definitions at one of the first five steps."""
    return typical(**changes), dict.fromkeys(DEFINITIONS, step)


def short_of(weeks, **changes):
    """A complete record born in some week: it leaves the landmark definitions it did not reach."""
    steps = {1: None, 2: None, 6: None}
    steps |= {d: None if int(weeks) >= least else 10 for d, least in ((3, 28), (4, 32), (5, 34))}
    return typical(weeks=weeks, **changes), steps


def care(**changes):
    """A record without usable care data: only the base definition keeps it."""
    return typical(**changes), {1: None, 2: 8, 3: 8, 4: 8, 5: 8, 6: 7}


def covariate(**changes):
    return typical(**changes), {1: None, 2: 9, 3: 9, 4: 9, 5: 9, 6: 8}


def several(**changes):
    """Several children: the definition without the step of one child alone keeps them."""
    return typical(**changes), {1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: None}


RECORDS = [
    leaves(1, mother="99/99/9999", age="888"),
    short_of("40"),
    leaves(1, mother="30/02/1990", age="2x"),
    short_of("40"),
    leaves(2, born="05/01/2018"),
    short_of("34"),
    leaves(3, abroad="1"),
    leaves(3, abroad=None),
    leaves(3, abroad="88"),
    short_of("33"),
    leaves(4, weeks="99"),
    leaves(4, weeks=None),
    leaves(4, weeks="39 "),
    leaves(4, weeks="99", plural="0"),
    short_of("31", mother="09/09/9999"),
    leaves(5, plural="0"),
    leaves(5, plural="4"),
    several(plural="2"),
    several(plural="3", weeks="30"),
    (typical(plural="2", visits="99"), {1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: 7}),
    (typical(plural="2", school="99"), {1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: 8}),
    (typical(plural="2", weeks="20"), {1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: 6}),
    (typical(weeks="19"), {1: 7, 2: 7, 3: 7, 4: 7, 5: 7, 6: 6}),
    short_of("22"),
    care(visits="99"),
    care(visits=None),
    care(start="9"),
    care(start="8"),
    care(start=None),
    care(visits="0", start="2"),
    care(visits="6", start="0"),
    care(weeks="25", start="3"),
    short_of("39", visits="0", start="0"),
    short_of("28", start="3", visits="2"),
    covariate(school="99"),
    covariate(school=None),
    covariate(state="00"),
    covariate(mother="09/09/9999", age="13", state="88"),
]
#: The values and rules of a few texts that are easily read wrong.
ODD_VALUES = {
    "weeks": [("38\n", None), (" 38", None), ("+38", None), ("-2", None), ("４０", None), ("0041", 41), ("41", 41)],
    "visits": [("7.0", None), ("", None), ("07", 7), ("99", None), ("98", 98)],
    "weight": [("9999", None), ("9998", 9998), ("3 100", None)],
}


def records():
    return [record for record, _ in RECORDS]


def remaining(definition, steps):
    """(remaining, excluded) after each step, counted from what the records say."""
    left, rows = len(RECORDS), [(len(RECORDS), None)]
    for step in range(1, steps):
        gone = sum(exits[definition] == step for _, exits in RECORDS)
        left -= gone
        rows.append((left, gone))
    return rows


def staged(spark, *years):
    """A staged table from (year, records) pairs."""
    rows = [
        (year, row, *[record[s] for s in SHORT])
        for year, records in years
        for row, record in enumerate(records, start=1)
    ]
    schema = "source_year int, source_row bigint, " + ", ".join(f"{c} string" for c in SOURCE_COLUMNS)
    return spark.createDataFrame(rows, schema)
