"""The declared inputs: source columns, code map, concepts, calendars and id scheme.

All of it is passed to the operators as parameters; these are the defaults of a birth registry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Source columns


@dataclass(frozen=True)
class Field:
    """A source column and how its text becomes a value.

    kind: ``number`` (digits, some of them codes), ``listed`` (a number its catalogue lists),
    ``concept`` (a code with a target concept) or ``two_digits``.
    """

    name: str
    source: str
    vocabulary: str
    kind: str
    listed: tuple[str, ...] = ()
    max_length: int = 50


FIELDS: tuple[Field, ...] = (
    Field("weeks", "edadgestacional", "REG_EDADGEST", "number"),
    Field("plurality", "productoembarazo", "REG_PRODEMB", "listed", ("1", "2", "3")),
    Field("visits", "totalconsultas", "REG_TOTCONS", "number"),
    Field("trimester", "trimestreprimerconsulta", "REG_TRIMCONS", "concept"),
    Field("age", "edad", "REG_EDAD", "number"),
    Field("education", "escolaridad", "REG_ESCOL", "concept"),
    Field("insurance", "afiliacion", "REG_AFIL", "concept"),
    Field("country", "resideextranjero", "REG_RESEXT", "concept", max_length=80),
    Field("state", "entidadresidencia", "REG_ENTRES", "two_digits"),
    Field("sex", "sexo", "REG_SEXO", "concept"),
    Field("weight", "peso", "REG_PESO", "number"),
)
MOTHER_DATE_VOCABULARY = "REG_FECHANACMAD"

#: The text columns the pipeline reads, in file order; a source may hold any others.
SOURCE_COLUMNS: tuple[str, ...] = (
    "fechanacimiento",
    "fechanacimientomadre",
    "edad",
    "resideextranjero",
    "entidadresidencia",
    "edadgestacional",
    "productoembarazo",
    "totalconsultas",
    "trimestreprimerconsulta",
    "escolaridad",
    "sexo",
    "peso",
    "afiliacion",
)

# ---------------------------------------------------------------------------------------------
# Code map: vocabulary -> code -> target concept. Fixed values (published catalogues).

CODE_MAP: Mapping[str, Mapping[str, int]] = {
    "REG_EDADGEST": {"99": 0},
    "REG_PRODEMB": {"0": 0},
    "REG_TOTCONS": {"99": 0},
    "REG_TRIMCONS": {
        "0": 45880561,
        "1": 45880554,
        "2": 45879078,
        "3": 45885074,
        "8": 0,
        "9": 0,
    },
    "REG_RESEXT": {"0": 0, "1": 0, "2": 4075636, "8": 0, "9": 0, "88": 0},
    "REG_ENTRES": {"00": 0, "88": 0, "99": 0},
    "REG_ESCOL": {
        "0": 0,
        "1": 4074913,
        "31": 44800023,
        "32": 44800023,
        "51": 43020414,
        "52": 43020414,
        "71": 43020395,
        "72": 43020395,
        "81": 4076230,
        "82": 4076230,
        "88": 0,
        "99": 0,
        "101": 4076230,
        "102": 4076230,
        "111": 43020414,
        "112": 43020414,
        "131": 43020395,
        "132": 43020395,
    },
    "REG_EDAD": {"888": 0, "999": 0},
    "REG_FECHANACMAD": {"09/09/9999": 0},
    "REG_SEXO": {"0": 0, "1": 8507, "2": 8532, "9": 0},
    "REG_PESO": {"9999": 0},
    "REG_AFIL": {
        "00": 0,
        "01": 0,
        "02": 0,
        "03": 0,
        "04": 0,
        "05": 0,
        "06": 0,
        "07": 0,
        "08": 0,
        "10": 0,
        "11": 0,
        "88": 0,
        "99": 0,
    },
}

#: The vocabulary each vocabulary's non-zero targets belong to, and their domain (None: no targets).
VOCABULARY_TARGETS: Mapping[str, tuple[str | None, str | None]] = {
    "REG_EDADGEST": (None, None),
    "REG_PRODEMB": (None, None),
    "REG_TOTCONS": (None, None),
    "REG_TRIMCONS": ("LOINC", "Meas Value"),
    "REG_RESEXT": ("SNOMED", "Geography"),
    "REG_ENTRES": (None, None),
    "REG_ESCOL": ("SNOMED", "Observation"),
    "REG_EDAD": (None, None),
    "REG_FECHANACMAD": (None, None),
    "REG_SEXO": ("Gender", "Gender"),
    "REG_PESO": (None, None),
    "REG_AFIL": (None, None),
}

# Concepts by key: id, domain, vocabulary, code. Fixed values (public standard vocabularies).
CONCEPTS: Mapping[str, tuple[int, str, str, str]] = {
    "female": (8532, "Gender", "Gender", "F"),
    "registry": (32879, "Type Concept", "Type Concept", "OMOP4976952"),
    "gestational_age_at_birth": (4260747, "Measurement", "SNOMED", "412726003"),
    "week": (8511, "Unit", "UCUM", "wk"),
    "birth_plurality": (40760833, "Measurement", "LOINC", "57722-1"),
    "at_least": (4171755, "Meas Value Operator", "SNOMED", "276138003"),
    "mother_age_at_delivery": (36203531, "Measurement", "LOINC", "85724-3"),
    "year": (9448, "Unit", "UCUM", "a"),
    "birth_weight": (3011043, "Measurement", "LOINC", "8339-4"),
    "gram": (8504, "Unit", "UCUM", "g"),
    "prenatal_visits_count": (40771079, "Observation", "LOINC", "68493-6"),
    "first_prenatal_visit_trimester": (44817052, "Observation", "LOINC", "75163-6"),
    "mother_education": (40760823, "Observation", "LOINC", "57712-2"),
    "mother_insurance": (46235654, "Observation", "LOINC", "76437-3"),
    "mother": (4248584, "Relationship", "SNOMED", "72705000"),
    "child": (4285883, "Relationship", "SNOMED", "67822003"),
    "person_table": (1147314, "Metadata", "CDM", "CDM370"),
    "cdm_version": (902983, "Metadata", "CDM", "CDM v5.4.3"),
}
CONCEPT_IDS: Mapping[str, int] = {key: row[0] for key, row in CONCEPTS.items()}

#: The name the rule counts give each field, with its table, and the rules counted for its kind.
COUNTED_FIELDS: tuple[tuple[str, str, str], ...] = (
    ("weeks", "measurement", "gestational_age_at_birth"),
    ("plurality", "measurement", "birth_plurality"),
    ("age", "measurement", "mother_age_at_delivery"),
    ("visits", "observation", "prenatal_visits_count"),
    ("trimester", "observation", "first_prenatal_visit_trimester"),
    ("education", "observation", "mother_education"),
    ("insurance", "observation", "mother_insurance"),
    ("country", "location", "country_concept_id"),
    ("state", "location", "state"),
    ("sex", "person", "gender"),
    ("weight", "measurement", "birth_weight"),
)
RULES: Mapping[str, tuple[str, ...]] = {
    "number": ("value", "code_to_null", "not_integer", "too_long", "blank"),
    "listed": ("value", "code_to_null", "not_in_catalogue", "blank"),
    "concept": ("code_to_concept", "code_to_0", "not_in_catalogue", "blank"),
    "two_digits": ("value", "code_to_null", "not_two_digits", "blank"),
}

#: The answer of the country field whose target is the country of the cohort.
RESIDENT_CODE = ("REG_RESEXT", "2")
TRIMESTER_CODES = ("0", "1", "2", "3")

#: Domains required of the concept fields written, and the domains with an event table of their own.
FIELD_DOMAINS: Mapping[str, str] = {
    "person.gender_concept_id": "Gender",
    "person.race_concept_id": "Race",
    "person.ethnicity_concept_id": "Ethnicity",
    "measurement.measurement_concept_id": "Measurement",
    "measurement.unit_concept_id": "Unit",
}
OWN_TABLE_DOMAINS: tuple[str, ...] = (
    "Condition",
    "Procedure",
    "Drug",
    "Specimen",
    "Measurement",
    "Device",
)

#: Insurance codes by group; any other text, and none, is "Unknown".
INSURANCE_GROUPS: Mapping[str, str] = {
    "02": "IMSS",
    "03": "ISSSTE",
    "04": "Other social security",
    "05": "Other social security",
    "06": "Other social security",
    "11": "Other social security",
    "01": "No social security",
    "07": "No social security",
    "10": "No social security",
    "08": "Other",
}
UNKNOWN_GROUP = "Unknown"

#: Age bands: the first age above each band, with its label; the last one is open.
AGE_BANDS: tuple[tuple[int | None, str], ...] = (
    (15, "under 15"),
    (20, "15-19"),
    (25, "20-24"),
    (30, "25-29"),
    (35, "30-34"),
    (40, "35-39"),
    (None, "40 and over"),
)

# ---------------------------------------------------------------------------------------------
# Calendars and analysis parameters


@dataclass(frozen=True)
class Calendar:
    """A calendar of visits by the first week of each, and the first week of each trimester."""

    first_weeks: tuple[int, ...] = (6, 10, 16, 22, 28, 32, 36, 38)
    minimum: int = 5
    trimester_first_weeks: tuple[int, int, int] = (0, 14, 28)

    @property
    def full(self) -> int:
        return len(self.first_weeks)


CALENDAR = Calendar()


@dataclass(frozen=True)
class Variant:
    """A variant of the adequacy index: a schedule (None: the tabulated one) and a month rule."""

    name: str
    calendar: tuple[int, ...] | None
    months: tuple[int, int, int]


def index_variants(calendar: Calendar = CALENDAR) -> tuple[Variant, ...]:
    return (
        Variant("acog_midpoint", None, (2, 5, 8)),
        Variant("acog_first", None, (1, 4, 7)),
        Variant("acog_last", None, (3, 6, 9)),
        Variant("nom007_midpoint", calendar.first_weeks, (2, 5, 8)),
    )


PRETERM_WEEKS = 37
SENSITIVITY_CUTOFFS = (34, 32)
VIABLE_WEEKS = 22
THIRD_TRIMESTER_WEEK = 28
BASE, ANALYSIS, MULTIPLES = 1, 2, 6
LANDMARKS: Mapping[int, int] = {3: 28, 4: 32, 5: 34}
SCENARIOS: tuple[str, ...] = ("e1", "e2")


@dataclass(frozen=True)
class Ids:
    """Person ids from (year, source row); the newborn's is the mother's plus an offset."""

    first_year: int = 2000
    last_year: int = 2099
    rows_per_year: int = 10_000_000
    newborn_offset: int = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """What a typed load needs to know; every operator takes it as a parameter."""

    fields: Sequence[Field] = FIELDS
    code_map: Mapping[str, Mapping[str, int]] = field(default_factory=lambda: CODE_MAP)
    ids: Ids = Ids()

    def by_name(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def resident_concept(self) -> int:
        vocabulary, code = RESIDENT_CODE
        return self.code_map[vocabulary][code]

    def trimester_concepts(self) -> dict[int, int]:
        """Target concept of each trimester answer."""
        vocabulary = self.by_name("trimester").vocabulary
        return {self.code_map[vocabulary][code]: int(code) for code in TRIMESTER_CODES}


SETTINGS = Settings()
