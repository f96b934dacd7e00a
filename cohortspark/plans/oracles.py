"""The same results in ANSI SQL over the same tables, one statement per registered query."""

from __future__ import annotations

from cohortspark.catalogue import CODE_MAP, COUNTED_FIELDS, FIELDS, RULES
from cohortspark.plans import sql_layers as s

ORACLES: dict[str, str] = {}

RECORDS = (s.REGISTRY, s.records_cte())
DAMAGED = (s.REGISTRY, s.DAMAGED_REGISTRY, s.records_cte("damaged"))
COHORTS = (*RECORDS, s.CRITERIA)
CELLS = (*COHORTS, s.CELLS)
Z = 1.959963984540054
FIT = "definition, period, cutoff, measure, variant, stratum_variable, stratum_value"


def oracle(name: str, layers: tuple[str, ...], select: str) -> None:
    ORACLES[name] = (s.with_layers(*layers) if layers else "") + select.strip()


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


# ---------------------------------------------------------------------------------------------
# Records

oracle("proxy_registry", (s.REGISTRY,), "SELECT * FROM registry")

_values = "weeks, plurality, visits, age, weight"
oracle(
    "typed_records",
    RECORDS,
    f"""
SELECT source_year, source_row, person_id, newborn_person_id,
  CAST(delivery_date AS VARCHAR) AS delivery_date, CAST(loaded AS INTEGER) AS loaded,
  year_of_birth_case, year_of_birth, month_of_birth, day_of_birth,
  {", ".join(f"{f.name}_rule" for f in FIELDS)}, {_values},
  trimester_concept_id, education_concept_id, insurance_concept_id, country_concept_id, state,
  newborn_gender_concept_id, CAST(plurality_at_least AS INTEGER) AS plurality_at_least
FROM records""",
)

oracle(
    "code_join_targets",
    (s.REGISTRY, s.code_map_cte()),
    " UNION ALL ".join(
        f"SELECT '{f.name}' AS field, m.target AS target, count(*) AS record_count "
        f"FROM registry AS r LEFT JOIN code_map AS m ON m.vocabulary = '{f.vocabulary}' "
        f"AND m.code = r.{f.source} GROUP BY m.target"
        for f in FIELDS
    ),
)


def _rule_entries() -> list[tuple[str, str, str]]:
    kinds = {f.name: f.kind for f in FIELDS}
    entries = [
        ("staging", "rows", "TRUE"),
        ("person", "not_loaded:no_year_of_birth", "NOT loaded"),
        ("person", "year_of_birth:mother_date", "year_of_birth_case = 'mother_date'"),
        ("person", "year_of_birth:age", "year_of_birth_case = 'age'"),
    ]
    for name, table, label in COUNTED_FIELDS:
        for rule in RULES[kinds[name]]:
            entries.append((table, f"{label}:{rule}", f"loaded AND {name}_rule = '{rule}'"))
    entries.append(("measurement", "birth_plurality:at_least", "loaded AND plurality_at_least"))
    return entries


RULE_COUNTS = " UNION ALL ".join(
    f"SELECT source_year, '{table}' AS cdm_table, '{rule}' AS rule, "
    f"count(*) FILTER (WHERE {test}) AS row_count FROM records GROUP BY source_year"
    for table, rule, test in _rule_entries()
)
oracle("rule_counts", RECORDS, RULE_COUNTS)

_lengths = " UNION ALL ".join(
    f"SELECT source_year, source_row, '{f.source.upper()} is longer than {f.max_length} "
    f"characters' FROM records WHERE length({f.source}) > {f.max_length}"
    for f in FIELDS
    if f.kind != "two_digits"
)
PROBLEMS = f"""
problems AS (
  SELECT source_year, source_row, 'FECHANACIMIENTO ' || coalesce('''' ||
    replace(fechanacimiento, '''', '''''') || '''', 'blank')
    || ' is not a valid dd/mm/yyyy date' AS problem
  FROM records WHERE delivery_date IS NULL
  UNION ALL
  SELECT source_year, source_row, 'source_row does not fit person_id' FROM records
    WHERE source_row NOT BETWEEN 1 AND 9999999
  UNION ALL
  SELECT source_year, source_row, 'source_year does not fit person_id' FROM records
    WHERE source_year NOT BETWEEN 1990 AND 2089
  UNION ALL
  SELECT source_year, source_row,
    'RESIDEEXTRANJERO|ENTIDADRESIDENCIA is longer than 50 characters' FROM records
    WHERE coalesce(length(resideextranjero), 0) + 1 + coalesce(length(entidadresidencia), 0) > 50
  UNION ALL {_lengths}
)"""
oracle("unloadable_rows", (*DAMAGED, PROBLEMS), "SELECT * FROM problems")
oracle(
    "unloadable_top10",
    (*DAMAGED, PROBLEMS),
    "SELECT *, count(*) OVER () AS total FROM problems "
    "ORDER BY source_year, source_row, problem LIMIT 10",
)

oracle(
    "uncountable_numbers",
    (s.REGISTRY,),
    """SELECT source_year, source_row, 'visits' AS field, '99999' || source_row AS "number"
FROM registry WHERE source_row % 127 = 9
  AND try_cast('99999' || source_row AS INTEGER) IS NULL""",
)

# ---------------------------------------------------------------------------------------------
# Person and event tables

CDM = """
located AS (
  SELECT *, dense_rank() OVER (ORDER BY resideextranjero NULLS LAST,
    entidadresidencia NULLS LAST) AS location_id
  FROM records WHERE loaded
),
location AS (
  SELECT DISTINCT location_id, state,
    CASE WHEN resideextranjero IS NOT NULL OR entidadresidencia IS NOT NULL
      THEN coalesce(resideextranjero, '') || '|' || coalesce(entidadresidencia, '') END
      AS location_source_value, country_concept_id, resideextranjero AS country_source_value
  FROM located
),
person AS (
  SELECT person_id, 8532 AS gender_concept_id, year_of_birth, month_of_birth, day_of_birth,
    0 AS race_concept_id, 0 AS ethnicity_concept_id, location_id,
    CAST(source_year AS VARCHAR) || ':' || CAST(source_row AS VARCHAR) AS person_source_value,
    CAST(NULL AS VARCHAR) AS gender_source_value, CAST(NULL AS INTEGER) AS gender_source_concept_id
  FROM located
  UNION ALL
  SELECT newborn_person_id, newborn_gender_concept_id, CAST(year(delivery_date) AS INTEGER),
    CAST(month(delivery_date) AS INTEGER), CAST(day(delivery_date) AS INTEGER), 0, 0, NULL,
    CAST(source_year AS VARCHAR) || ':' || CAST(source_row AS VARCHAR), sexo, 0
  FROM located
),
observation_period AS (
  SELECT p.person_id AS observation_period_id, p.person_id,
    delivery_date AS observation_period_start_date, delivery_date AS observation_period_end_date,
    32879 AS period_type_concept_id
  FROM (SELECT person_id, delivery_date FROM located
    UNION ALL SELECT newborn_person_id, delivery_date FROM located) AS p
),
measurement AS (
  SELECT row_number() OVER (ORDER BY person_id, position) AS measurement_id, person_id,
    measurement_concept_id, measurement_date, 32879 AS measurement_type_concept_id,
    operator_concept_id, value_as_number, unit_concept_id, measurement_source_value,
    0 AS measurement_source_concept_id, value_source_value
  FROM (
    SELECT person_id, 1 AS position, 4260747 AS measurement_concept_id,
      delivery_date AS measurement_date, CAST(NULL AS INTEGER) AS operator_concept_id,
      weeks AS value_as_number, 8511 AS unit_concept_id,
      'EDADGESTACIONAL' AS measurement_source_value, edadgestacional AS value_source_value
    FROM located
    UNION ALL SELECT person_id, 2, 40760833, delivery_date,
      CASE WHEN plurality_at_least THEN 4171755 END, plurality, NULL, 'PRODUCTOEMBARAZO',
      productoembarazo FROM located
    UNION ALL SELECT person_id, 3, 36203531, delivery_date, NULL, age, 9448, 'EDAD', edad
      FROM located
    UNION ALL SELECT newborn_person_id, 1, 3011043, delivery_date, NULL, weight, 8504, 'PESO', peso
      FROM located
  ) AS events
),
observation AS (
  SELECT row_number() OVER (ORDER BY person_id, position) AS observation_id, person_id,
    observation_concept_id, observation_date, 32879 AS observation_type_concept_id,
    value_as_number, value_as_concept_id, observation_source_value,
    0 AS observation_source_concept_id, value_source_value
  FROM (
    SELECT person_id, 1 AS position, 40771079 AS observation_concept_id,
      delivery_date AS observation_date, visits AS value_as_number,
      CAST(NULL AS INTEGER) AS value_as_concept_id, 'TOTALCONSULTAS' AS observation_source_value,
      totalconsultas AS value_source_value FROM located
    UNION ALL SELECT person_id, 2, 44817052, delivery_date, NULL, trimester_concept_id,
      'TRIMESTREPRIMERCONSULTA', trimestreprimerconsulta FROM located
    UNION ALL SELECT person_id, 3, 40760823, delivery_date, NULL, education_concept_id,
      'ESCOLARIDAD', escolaridad FROM located
    UNION ALL SELECT person_id, 4, 46235654, delivery_date, NULL, insurance_concept_id,
      'AFILIACION', afiliacion FROM located
  ) AS events
),
fact_relationship AS (
  SELECT 1147314 AS domain_concept_id_1, person_id AS fact_id_1, 1147314 AS domain_concept_id_2,
    newborn_person_id AS fact_id_2, 4248584 AS relationship_concept_id FROM located
  UNION ALL
  SELECT 1147314, newborn_person_id, 1147314, person_id, 4285883 FROM located
),
source_files AS (
  SELECT source_year, 'births_' || source_year || '.csv' AS name, CAST(count(*) AS VARCHAR)
    AS version, sha256(source_year || ':' || max(source_row)) AS sha256,
    make_date(source_year + 1, 1, 31) AS retrieved
  FROM registry GROUP BY source_year
)"""
BUILT = (*RECORDS, CDM)
oracle("location_rows", BUILT, "SELECT * FROM location")
oracle("person_rows", BUILT, "SELECT * FROM person")
oracle(
    "observation_period_rows",
    BUILT,
    """SELECT observation_period_id, person_id,
  CAST(observation_period_start_date AS VARCHAR) AS observation_period_start_date,
  CAST(observation_period_end_date AS VARCHAR) AS observation_period_end_date,
  period_type_concept_id FROM observation_period""",
)
oracle(
    "measurement_rows",
    BUILT,
    "SELECT * REPLACE (CAST(measurement_date AS VARCHAR) AS measurement_date) FROM measurement",
)
oracle(
    "observation_rows",
    BUILT,
    "SELECT * REPLACE (CAST(observation_date AS VARCHAR) AS observation_date) FROM observation",
)
oracle("link_rows", BUILT, "SELECT * FROM fact_relationship")
oracle(
    "cdm_source_row",
    BUILT,
    """SELECT 'Record files loaded: ' || string_agg(source_year || ': ' || name || '?V=' || version
    || ', sha256 ' || sha256, '; ' ORDER BY source_year) AS source_description,
  CAST(max(retrieved) AS VARCHAR) AS source_release_date, 'v5.4.3' AS cdm_version,
  902983 AS cdm_version_concept_id, 'v1' AS vocabulary_version FROM source_files""",
)
oracle(
    "registered_vocabularies",
    (
        "held AS (SELECT p_brand AS vocabulary_id, CAST(count(*) AS VARCHAR) AS vocabulary_version "
        "FROM part GROUP BY p_brand)",
        "local_rows AS (SELECT vocabulary_id, 'local ' || vocabulary_version AS vocabulary_version "
        "FROM held WHERE vocabulary_id LIKE '%3' UNION ALL SELECT 'local ' || p_type, "
        "'local ' || CAST(max(p_size) AS VARCHAR) FROM part GROUP BY p_type)",
    ),
    "SELECT * FROM held WHERE vocabulary_id NOT IN (SELECT vocabulary_id FROM local_rows) "
    "UNION ALL SELECT * FROM local_rows",
)
oracle(
    "key_pivot",
    (),
    "SELECT "
    + ", ".join(
        f"max(c_custkey) FILTER (WHERE c_mktsegment = '{k}') AS \"{k}\""
        for k in ("AUTOMOBILE", "MACHINERY", "NONE")
    )
    + " FROM customer",
)
oracle(
    "etl_counts",
    (
        *BUILT,
        """
ids AS (
  SELECT source_year, person_id, 'mother' AS role FROM records
  UNION ALL SELECT source_year, newborn_person_id, 'newborn' FROM records
),
keyed AS (
  SELECT 'person' AS cdm_table, person_id FROM person
  UNION ALL SELECT 'observation_period', person_id FROM observation_period
  UNION ALL SELECT 'measurement', person_id FROM measurement
  UNION ALL SELECT 'observation', person_id FROM observation
  UNION ALL SELECT 'fact_relationship', fact_id_1 FROM fact_relationship
),
table_rows AS (
  SELECT source_year, cdm_table, count(*) AS n FROM keyed JOIN ids USING (person_id)
  GROUP BY source_year, cdm_table
)""",
    ),
    f"""{RULE_COUNTS}
UNION ALL SELECT y.source_year, k.cdm_table, 'rows', coalesce(n, 0)
  FROM (SELECT DISTINCT source_year FROM records) AS y
  CROSS JOIN (SELECT DISTINCT cdm_table FROM keyed) AS k
  LEFT JOIN table_rows AS r ON r.source_year = y.source_year AND r.cdm_table = k.cdm_table
UNION ALL SELECT source_year, 'person', 'rows:' || role, count(*) FROM person
  JOIN ids USING (person_id) GROUP BY source_year, role
UNION ALL SELECT NULL, 'location', 'rows', count(*) FROM location""",
)

# ---------------------------------------------------------------------------------------------
# Checks of a load

_concept_ids = sorted(
    {0, *s.C.values(), *(target for codes in CODE_MAP.values() for target in codes.values())}
)
CONCEPTS = f"concept(concept_id) AS (VALUES {', '.join(f'({c})' for c in _concept_ids)})"

_WRITTEN = {
    "person": (
        "gender_concept_id", "race_concept_id", "ethnicity_concept_id", "gender_source_concept_id",
    ),
    "observation_period": ("period_type_concept_id",),
    "measurement": (
        "measurement_concept_id", "measurement_type_concept_id", "operator_concept_id",
        "unit_concept_id", "measurement_source_concept_id",
    ),
    "observation": (
        "observation_concept_id", "observation_type_concept_id", "value_as_concept_id",
        "observation_source_concept_id",
    ),
    "fact_relationship": ("domain_concept_id_1", "domain_concept_id_2", "relationship_concept_id"),
    "location": ("country_concept_id",),
}


def _checks(prefix: str, registered: str, counts: str, sources: int, visits: str) -> str:
    """The 28 checks as scalar subqueries over the tables named with a prefix."""
    p = prefix
    table = {name: f"{p}{name}" for name in _WRITTEN}
    out = []

    def check(rule: str, select: str) -> None:
        out.append(f"SELECT '{rule}' AS rule, CAST(({select}) AS BIGINT) AS violations")

    for name, columns in _WRITTEN.items():
        written = " UNION ".join(f"SELECT {c} AS c FROM {table[name]}" for c in columns)
        check(
            f"concept_not_in_vocabulary:{name}",
            f"SELECT count(*) FROM ({written}) AS w WHERE c IS NOT NULL "
            "AND c NOT IN (SELECT concept_id FROM concept)",
        )
    check("concept_not_in_vocabulary:cdm_source", "SELECT 0")
    check("concept_not_in_vocabulary:source_to_concept_map", "SELECT 0")
    for name in ("observation_period", "measurement", "observation"):
        check(
            f"orphan_person:{name}",
            f"SELECT count(*) FROM {table[name]} WHERE person_id NOT IN "
            f"(SELECT person_id FROM {table['person']})",
        )
    check(
        "orphan_person:fact_relationship",
        f"SELECT count(*) FROM {table['fact_relationship']} WHERE fact_id_1 NOT IN "
        f"(SELECT person_id FROM {table['person']}) OR fact_id_2 NOT IN "
        f"(SELECT person_id FROM {table['person']})",
    )
    check(
        "orphan_location:person",
        f"SELECT count(*) FROM {table['person']} WHERE location_id IS NOT NULL AND location_id "
        f"NOT IN (SELECT location_id FROM {table['location']})",
    )
    check(
        "person_without_one_observation_period",
        f"SELECT count(*) FROM {p}per_person WHERE periods <> 1",
    )
    for rule, role, column, wanted in (
        ("mother_without_three_measurements", "mother", "measurements", 3),
        ("mother_without_four_observations", "mother", "observations", 4),
        ("newborn_without_one_measurement", "newborn", "measurements", 1),
        ("newborn_with_an_observation", "newborn", "observations", 0),
    ):
        check(
            rule,
            f"SELECT count(*) FROM {p}per_person WHERE role = '{role}' AND {column} <> {wanted}",
        )
    check(
        "observation_period_not_the_delivery_day",
        f"SELECT count(*) FROM {table['observation_period']} AS o LEFT JOIN roles AS r "
        "USING (person_id) WHERE o.observation_period_start_date <> o.observation_period_end_date "
        "OR o.observation_period_start_date IS DISTINCT FROM r.delivery_date",
    )
    check(
        "newborn_birth_not_the_delivery_day",
        f"SELECT count(*) FROM {table['person']} AS p JOIN roles AS r USING (person_id) "
        "WHERE r.role = 'newborn' AND try_cast(p.year_of_birth || '-' || p.month_of_birth || '-' "
        "|| p.day_of_birth AS DATE) IS DISTINCT FROM r.delivery_date",
    )
    check(
        "fact_relationship_not_the_record_pair",
        f"SELECT count(*) FROM ((SELECT * FROM fact_relationship EXCEPT ALL SELECT * FROM "
        f"{table['fact_relationship']}) UNION ALL (SELECT * FROM {table['fact_relationship']} "
        "EXCEPT ALL SELECT * FROM fact_relationship)) AS d",
    )
    for name in ("measurement", "observation"):
        check(
            f"event_outside_observation_period:{name}",
            f"SELECT count(*) FROM {table[name]} AS m JOIN {table['observation_period']} AS o "
            f"USING (person_id) WHERE m.{name}_date NOT BETWEEN o.observation_period_start_date "
            "AND o.observation_period_end_date",
        )
    check("visit_occurrence_rows", visits)
    check("vocabulary_not_registered", registered)
    check(
        "person_not_matched_to_staging",
        "(SELECT count(*) FROM roles WHERE person_id NOT IN (SELECT person_id FROM "
        f"{table['person']})) + (SELECT count(*) FROM {p}per_person WHERE role IS NULL)".join(
            ("SELECT ", "")
        ),
    )
    check("staging_rows_not_load_counts", counts)
    check("cdm_source_rows_not_one", f"SELECT {abs(sources - 1)}")
    return "\nUNION ALL ".join(out)


def _per_person(prefix: str) -> str:
    p = prefix
    count = "SELECT person_id, count(*) AS n FROM {} GROUP BY person_id"
    return f"""
{p}per_person AS (
  SELECT p.person_id, r.role, coalesce(o.n, 0) AS periods, coalesce(m.n, 0) AS measurements,
    coalesce(e.n, 0) AS observations
  FROM {p}person AS p
  LEFT JOIN ({count.format(p + "observation_period")}) AS o ON p.person_id = o.person_id
  LEFT JOIN ({count.format(p + "measurement")}) AS m ON p.person_id = m.person_id
  LEFT JOIN ({count.format(p + "observation")}) AS e ON p.person_id = e.person_id
  LEFT JOIN roles AS r ON p.person_id = r.person_id
)"""


ROLES = """
roles AS (
  SELECT person_id, 'mother' AS role, delivery_date FROM records WHERE loaded
  UNION ALL SELECT newborn_person_id, 'newborn', delivery_date FROM records WHERE loaded
)"""
BROKEN = """
d_person AS (
  SELECT * REPLACE (
    CASE WHEN location_id IS NOT NULL AND person_id % 223 = 5 THEN 999999 ELSE location_id END
      AS location_id,
    CASE WHEN person_id > 10000000000000000 AND person_id % 281 = 12 THEN 31 ELSE day_of_birth END
      AS day_of_birth)
  FROM person WHERE person_id % 211 <> 3
),
d_periods AS (
  SELECT * REPLACE (CASE WHEN person_id % 227 = 7 THEN CAST(observation_period_start_date
    + INTERVAL 1 DAY AS DATE) ELSE observation_period_start_date END
    AS observation_period_start_date)
  FROM observation_period WHERE person_id % 229 <> 9
),
d_observation_period AS (
  SELECT * FROM d_periods UNION ALL SELECT * FROM d_periods WHERE person_id % 233 = 11
),
d_measurement AS (
  SELECT * REPLACE (
    CASE WHEN measurement_id % 241 = 2 THEN CAST(measurement_date + INTERVAL 5 DAY AS DATE)
      ELSE measurement_date END AS measurement_date,
    CASE WHEN measurement_id % 251 = 3 THEN 999 ELSE unit_concept_id END AS unit_concept_id)
  FROM measurement WHERE measurement_id % 239 <> 1
),
d_observation AS (
  SELECT * REPLACE (CASE WHEN observation_id % 263 = 5 THEN person_id + 7 ELSE person_id END
    AS person_id)
  FROM (SELECT * FROM observation UNION ALL SELECT * FROM observation
    WHERE observation_id % 257 = 4) AS o
),
d_fact_relationship AS (
  SELECT * REPLACE (
    CASE WHEN fact_id_1 % 269 = 6 THEN 999 ELSE relationship_concept_id END
      AS relationship_concept_id,
    CASE WHEN fact_id_1 % 277 = 10 THEN -1 ELSE fact_id_2 END AS fact_id_2)
  FROM (SELECT * FROM fact_relationship UNION ALL SELECT * FROM fact_relationship
    WHERE fact_id_1 % 271 = 8) AS f
),
d_location AS (SELECT * FROM location WHERE location_id % 7 <> 3)"""

oracle(
    "written_concepts",
    BUILT,
    "SELECT DISTINCT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS cdm_table, {column} AS concept_id FROM {name}"
        for name, columns in _WRITTEN.items()
        for column in columns
    )
    + ") AS w WHERE concept_id IS NOT NULL",
)
oracle(
    "postload_checks",
    (*BUILT, CONCEPTS, ROLES, _per_person("")),
    _checks("", "SELECT 0", "SELECT 0", 1, "SELECT 0"),
)
_damaged = _checks(
    "d_",
    "SELECT 2",
    "SELECT count(*) FROM (SELECT DISTINCT source_year FROM records) AS y WHERE source_year % 2 = 1",
    2,
    "SELECT count(*) FROM d_observation WHERE observation_id % 1000 = 1",
)
oracle(
    "postload_checks_damaged", (*BUILT, CONCEPTS, ROLES, BROKEN, _per_person("d_")), _damaged
)
oracle(
    "failed_checks",
    (*BUILT, CONCEPTS, ROLES, BROKEN, _per_person("d_")),
    f"SELECT * FROM ({_damaged}) AS c WHERE violations <> 0",
)
oracle(
    "link_differences",
    (
        *BUILT,
        """
broken AS (
  SELECT * REPLACE (CASE WHEN fact_id_1 % 277 = 10 THEN -1 ELSE fact_id_2 END AS fact_id_2)
  FROM (SELECT * FROM fact_relationship UNION ALL SELECT * FROM fact_relationship
    WHERE fact_id_1 % 271 = 8) AS f
)""",
    ),
    """SELECT *, 'first' AS side, count(*) AS copies FROM (SELECT * FROM fact_relationship
  EXCEPT ALL SELECT * FROM broken) AS a GROUP BY ALL
UNION ALL SELECT *, 'second', count(*) FROM (SELECT * FROM broken
  EXCEPT ALL SELECT * FROM fact_relationship) AS b GROUP BY ALL""",
)

# ---------------------------------------------------------------------------------------------
# Cohorts

oracle(
    "exit_steps",
    COHORTS,
    "SELECT definition AS cohort_definition_id, subject_id, source_year, exit_step FROM exits",
)
oracle(
    "cohort_rows",
    COHORTS,
    "SELECT definition AS cohort_definition_id, subject_id, CAST(delivery_date AS VARCHAR) "
    "AS cohort_start_date, CAST(delivery_date AS VARCHAR) AS cohort_end_date FROM exits "
    "WHERE exit_step IS NULL",
)
_attrition = (
    "SELECT cohort_definition_id, source_year, step, kind, description, "
    "CAST(remaining AS BIGINT) AS remaining, CAST(excluded AS BIGINT) AS excluded FROM attrition"
)
for _name in ("attrition", "attrition_from_cdm", "published_attrition"):
    oracle(_name, (*COHORTS, s.ATTRITION), _attrition)

oracle(
    "attrition_problems",
    (
        *COHORTS,
        s.ATTRITION,
        """
cohort_counts AS (
  SELECT definition AS cohort_definition_id, source_year, count(*) AS n FROM exits
  WHERE exit_step IS NULL GROUP BY definition, source_year
),
broken AS (
  SELECT cohort_definition_id, source_year, step,
    CASE WHEN step = 6 AND source_year % 3 = 0 THEN remaining + 5000
      WHEN step = 4 AND source_year % 5 = 0 THEN -remaining ELSE remaining END AS remaining,
    CASE WHEN step = 0 AND source_year % 4 = 0 THEN 1 WHEN step = 7 AND source_year % 4 = 1
      THEN NULL WHEN step = 3 AND source_year % 4 = 2 THEN -excluded ELSE excluded END AS excluded
  FROM attrition
  WHERE NOT (cohort_definition_id = 3 AND step = 5 AND source_year % 2 = 0)
    AND NOT (cohort_definition_id = 5 AND source_year % 2 = 1)
),
shape AS (
  SELECT cohort_definition_id, source_year, max(step) AS last,
    max(step) + 1 <> count(*) OR min(step) <> 0 AS gap
  FROM broken GROUP BY cohort_definition_id, source_year
),
beside AS (
  SELECT b.*, p.step AS previous_step, p.remaining AS before, h.last, h.gap, coalesce(c.n, 0) AS n
  FROM broken AS b JOIN shape AS h USING (cohort_definition_id, source_year)
  LEFT JOIN broken AS p ON p.cohort_definition_id = b.cohort_definition_id
    AND p.source_year = b.source_year AND p.step = b.step - 1
  LEFT JOIN cohort_counts AS c ON c.cohort_definition_id = b.cohort_definition_id
    AND c.source_year = b.source_year
)""",
    ),
    """
SELECT cohort_definition_id, source_year, step,
  'the steps do not run from 0 without a gap' AS problem FROM beside WHERE gap AND step = last
UNION ALL SELECT cohort_definition_id, source_year, step, 'remaining is negative' FROM beside
  WHERE NOT gap AND remaining < 0
UNION ALL SELECT cohort_definition_id, source_year, step, 'step 0 excludes nobody' FROM beside
  WHERE NOT gap AND step = 0 AND excluded IS NOT NULL
UNION ALL SELECT cohort_definition_id, source_year, step, 'excluded is missing' FROM beside
  WHERE NOT gap AND step > 0 AND excluded IS NULL
UNION ALL SELECT cohort_definition_id, source_year, step, 'excluded is negative' FROM beside
  WHERE NOT gap AND step > 0 AND excluded < 0
UNION ALL SELECT cohort_definition_id, source_year, step, 'more remain than before the step'
  FROM beside WHERE NOT gap AND step > 0 AND excluded IS NOT NULL AND remaining > before
UNION ALL SELECT cohort_definition_id, source_year, step, 'excluded is not the difference'
  FROM beside WHERE NOT gap AND step > 0 AND excluded <> before - remaining
UNION ALL SELECT cohort_definition_id, source_year, step, 'the cohort holds other rows'
  FROM beside WHERE NOT gap AND step = last AND remaining <> n
UNION ALL SELECT cohort_definition_id, source_year, NULL, 'the cohort has no attrition'
  FROM cohort_counts WHERE (cohort_definition_id, source_year) NOT IN
    (SELECT (cohort_definition_id, source_year) FROM broken)""",
)
_percent = ("preterm_percent", "first_trimester_start_percent", "no_prenatal_care_percent")
oracle(
    "excluded_profile",
    (*COHORTS, s.PROFILE),
    "SELECT cohort_definition_id, step, subject_group, births, "
    + ", ".join(f"CAST(round({c}, 2) AS DOUBLE) AS {c}" for c in _percent)
    + " FROM profile",
)
oracle(
    "profile_problems",
    (
        *COHORTS,
        s.ATTRITION,
        s.PROFILE,
        """
edited AS (
  SELECT cohort_definition_id,
    CASE WHEN cohort_definition_id = 1 AND step = 4 THEN 6 ELSE step END AS step, subject_group,
    CASE WHEN cohort_definition_id = 2 AND step = 5 THEN births + 1 ELSE births END AS births
  FROM profile WHERE NOT (cohort_definition_id = 4 AND step = 8)
),
wanted AS (
  SELECT cohort_definition_id, step, 'excluded' AS subject_group, sum(excluded) AS n FROM attrition
    WHERE kind = 'validity' GROUP BY 1, 2
  UNION ALL SELECT cohort_definition_id, step, 'retained', sum(remaining) FROM attrition
    WHERE kind = 'validity' GROUP BY 1, 2
)""",
    ),
    """SELECT * FROM (SELECT cohort_definition_id, step, subject_group,
  CASE WHEN births IS NULL THEN 'the profile has no row' WHEN n IS NULL
    THEN 'the step is not one of validity' WHEN births <> n THEN 'the births differ' END AS problem
FROM edited FULL JOIN wanted USING (cohort_definition_id, step, subject_group)) AS p
WHERE problem IS NOT NULL""",
)

# ---------------------------------------------------------------------------------------------
# Exposure, counts, comparisons

oracle(
    "exposure_levels",
    COHORTS,
    """SELECT subject_id, CAST(visits AS INTEGER) AS visits, trimester AS first_visit_trimester,
  CASE WHEN visits = 0 THEN '0' WHEN visits < 5 THEN '1-4' WHEN visits < 8 THEN '5-7'
    WHEN visits >= 8 THEN '8+' END AS visits_level,
  CAST(trimester = 1 AS INTEGER) AS first_trimester_start FROM flagged""",
)
_analysis = "analysis AS (SELECT * FROM cells WHERE definition = 2)"
INDEX = s.INDEX.replace("{source}", "analysis")
oracle(
    "index_variants",
    (*CELLS, _analysis, INDEX),
    f"""SELECT i.weeks, i.trimester, i.visits, c.births, variant, start_month, recommended, missed,
  expected, {_rounded("ratio_percent")}, initiation, services, level
FROM index_levels AS i JOIN (SELECT weeks, trimester, visits, CAST(sum(births) AS BIGINT) AS births
  FROM analysis GROUP BY ALL) AS c USING (weeks, trimester, visits)""",
)
oracle(
    "index_refusals",
    COHORTS,
    """SELECT * FROM (
  SELECT CAST(weeks AS INTEGER) AS weeks, trimester, CAST(visits AS INTEGER) AS visits,
    count(*) AS births,
    CASE WHEN visits IS NULL OR trimester IS NULL OR weeks IS NULL THEN 'value missing'
      WHEN visits NOT BETWEEN 0 AND 90 THEN 'visits out of range'
      WHEN weeks NOT BETWEEN 18 AND 50 THEN 'weeks out of range'
      WHEN trimester NOT BETWEEN 0 AND 3 THEN 'trimester unknown'
      WHEN (trimester = 0) <> (visits = 0) THEN 'trimester and visits disagree'
      WHEN trimester = 3 AND weeks < 28 THEN 'third trimester not reached' END AS refusal
  FROM flagged GROUP BY weeks, trimester, visits) AS k WHERE refusal IS NOT NULL""",
)
_sum = "CAST(sum(births) AS BIGINT) AS births"
oracle(
    "combinations",
    CELLS,
    f"SELECT definition, weeks, trimester, visits, {_sum} FROM cells "
    "WHERE definition BETWEEN 2 AND 5 GROUP BY definition, weeks, trimester, visits",
)
for _name in ("aggregated_counts", "aggregated_from_cdm"):
    oracle(_name, CELLS, "SELECT * FROM cells")
oracle(
    "summed_cells",
    CELLS,
    f"SELECT definition, weeks, trimester, visits, {_sum} FROM cells "
    "GROUP BY definition, weeks, trimester, visits",
)
oracle(
    "landmark_counts",
    CELLS,
    f"SELECT landmark, weeks, visits, {_sum} FROM cells JOIN (VALUES (28), (32), (34)) "
    "AS w(landmark) ON weeks >= landmark WHERE definition = 2 GROUP BY landmark, weeks, visits",
)
oracle(
    "births_per_year",
    CELLS,
    f"SELECT year, {_sum} FROM cells WHERE definition = 2 GROUP BY year",
)
_last = (
    "last_steps AS (SELECT source_year, CAST(remaining AS BIGINT) AS remaining FROM attrition "
    "WHERE cohort_definition_id = 2 QUALIFY row_number() OVER (PARTITION BY source_year "
    "ORDER BY step DESC) = 1)"
)
oracle("last_steps", (*COHORTS, s.ATTRITION, _last), "SELECT * FROM last_steps")
oracle(
    "births_against_attrition",
    (*CELLS, s.ATTRITION, _last),
    """SELECT b.year, b.births, l.remaining FROM (SELECT year,
  CAST(sum(births) + year % 2 AS BIGINT) AS births FROM cells WHERE definition = 2 GROUP BY year)
  AS b FULL JOIN last_steps AS l ON l.source_year = b.year
WHERE b.births IS DISTINCT FROM l.remaining""",
)
oracle(
    "births_against_cohort",
    CELLS,
    """SELECT definition, b.births, c.cohort_rows
FROM (SELECT definition, CAST(sum(births) AS BIGINT) AS births FROM cells
  WHERE NOT (definition = 4 AND weeks = 40) GROUP BY definition) AS b
FULL JOIN (SELECT definition, count(*) AS cohort_rows FROM exits WHERE exit_step IS NULL
  GROUP BY definition) AS c USING (definition)
WHERE b.births IS DISTINCT FROM c.cohort_rows""",
)
_label = """
  SELECT CASE WHEN count(DISTINCT source_year) > 1 AND max(source_year) - min(source_year) + 1
    = count(DISTINCT source_year) THEN min(source_year) || '-' || max(source_year)
    ELSE string_agg(DISTINCT CAST(source_year AS VARCHAR), ',' ORDER BY CAST(source_year AS VARCHAR))
    END AS period, '{}' AS part FROM registry {}"""
oracle(
    "period_labels",
    (s.REGISTRY,),
    _label.format("all", "")
    + " UNION ALL "
    + _label.format("odd", "WHERE source_year % 2 = 1"),
)

#: The analysis grid: which levels take part in which model.
GRID_RATED = """
rated AS (
  SELECT *, 'all' AS period, 37 AS cutoff, '' AS stratum_variable, '' AS stratum_value FROM levels
  UNION ALL
  SELECT l.*, 'all', w.cutoff, '', '' FROM levels AS l, (VALUES (34), (32)) AS w(cutoff)
    WHERE definition = 2 AND measure IN ('a', 'c')
  UNION ALL
  SELECT *, '2000-2001', 37, '', '' FROM levels
    WHERE definition = 2 AND measure IN ('a', 'c') AND year IN (2000, 2001)
  UNION ALL
  SELECT *, 'all', 37, 'state', state FROM levels WHERE definition = 2 AND measure IN ('a', 'c')
  UNION ALL
  SELECT *, 'all', 37, 'insurance', insurance FROM levels
    WHERE definition = 2 AND measure IN ('a', 'c')
),
rated_counts AS (
  SELECT definition, period, cutoff, measure, variant, stratum_variable, stratum_value, level,
    CAST(sum(births) AS BIGINT) AS births,
    CAST(coalesce(sum(births) FILTER (WHERE weeks < cutoff), 0) AS BIGINT) AS preterm
  FROM rated GROUP BY ALL
),
models AS (
  SELECT definition, period, cutoff, measure, variant, stratum_variable, stratum_value, level,
    age_group, education, state, year, CAST(sum(births) AS BIGINT) AS births,
    CAST(coalesce(sum(births) FILTER (WHERE weeks < cutoff), 0) AS BIGINT) AS preterm
  FROM rated GROUP BY ALL
)"""
LEVELS = s.levels_cte("cells", "age_group, education, state, year, insurance")
GRID = (*CELLS, _analysis, INDEX, LEVELS, GRID_RATED)
ORDER = """CASE WHEN measure IN ('a', 'd') THEN CASE level WHEN '0' THEN 0 WHEN '1-4' THEN 1
    WHEN '5-7' THEN 2 WHEN '8+' THEN 3 END
  WHEN measure = 'b' THEN CASE level WHEN 'Inadequate' THEN 0 WHEN 'Intermediate' THEN 1
    WHEN 'Adequate' THEN 2 WHEN 'Adequate Plus' THEN 3 END
  WHEN measure = 'c' THEN CASE level WHEN 'trimester 1' THEN 0 ELSE 1 END
  ELSE CAST(level AS INTEGER) END AS level_order"""
oracle("level_counts", GRID, f"SELECT *, {ORDER} FROM rated_counts")
_unstratified = "plain AS (SELECT * FROM rated_counts WHERE stratum_variable = '')"
CRUDE = s.crude_cte("plain", FIT)
oracle(
    "crude_odds",
    (*GRID, _unstratified, CRUDE),
    f"""SELECT {FIT}, level, reference, births, preterm,
  {_rounded("odds_ratio", "lower_limit", "upper_limit", "risk_difference")},
  CAST(coalesce(lower_limit > 1 OR upper_limit < 1, FALSE) AS INTEGER) AS excludes_one
FROM crude""",
)
oracle(
    "exposure_distribution",
    GRID,
    f"SELECT {FIT}, level, 'preterm' AS outcome, preterm AS births FROM rated_counts UNION ALL "
    f"SELECT {FIT}, level, 'term', births - preterm FROM rated_counts",
)
oracle(
    "stratum_counts",
    GRID,
    "SELECT stratum_variable, stratum_value, CAST(sum(births) AS BIGINT) AS births, "
    "CAST(sum(preterm) AS BIGINT) AS preterm FROM rated_counts WHERE stratum_variable <> '' "
    "AND measure = 'c' GROUP BY stratum_variable, stratum_value",
)

# ---------------------------------------------------------------------------------------------
# Null model

NULL_MODEL = """
combos AS (
  SELECT weeks, trimester, visits, CAST(sum(births) AS BIGINT) AS births FROM cells
  WHERE definition = 2 GROUP BY weeks, trimester, visits
),
calibration AS (
  SELECT 38 AS from_week, CAST(sum(births) AS BIGINT) AS births,
    CAST(coalesce(sum(births) FILTER (WHERE visits >= 8), 0) AS DOUBLE)
      / nullif(CAST(sum(births) AS DOUBLE), 0) AS full_calendar_share
  FROM combos WHERE trimester = 1 AND weeks >= 38
),
p AS (SELECT *, power(full_calendar_share, 1.0 / 7) AS visit_probability FROM calibration),
pregnancies AS (
  SELECT w.weeks, t.trimester, CAST(w.births AS DOUBLE) * t.births / a.births AS mass,
    greatest(CASE t.trimester WHEN 0 THEN 0 ELSE
      (SELECT count(*) FROM (VALUES (6), (10), (16), (22), (28), (32), (36), (38)) AS v(week)
        WHERE v.week <= w.weeks) - CASE t.trimester WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 4 END END, 0)
      AS possible
  FROM (SELECT weeks, sum(births) AS births FROM combos GROUP BY weeks) AS w,
    (SELECT trimester, sum(births) AS births FROM combos GROUP BY trimester) AS t,
    (SELECT sum(births) AS births FROM combos) AS a
),
expectation AS (
  SELECT scenario, weeks, trimester, visits, sum(mass) AS births FROM (
    SELECT 'e1' AS scenario, weeks, CASE WHEN possible = 0 THEN 0 ELSE trimester END AS trimester,
      possible AS visits, mass FROM pregnancies
    UNION ALL
    SELECT 'e2', weeks, 0, 0, mass FROM pregnancies WHERE possible = 0
    UNION ALL
    SELECT 'e2', weeks, trimester, 1 + kept, mass * factorial(CAST(possible - 1 AS INTEGER))
      / (factorial(CAST(kept AS INTEGER)) * factorial(CAST(possible - 1 - kept AS INTEGER)))
      * power(p.visit_probability, kept)
      * power(1 - p.visit_probability, possible - 1 - kept)
    FROM pregnancies, p, range(0, 12) AS k(kept) WHERE possible > 0 AND kept <= possible - 1
  ) AS m GROUP BY scenario, weeks, trimester, visits HAVING sum(mass) > 0
)"""
NULL = (*CELLS, NULL_MODEL)
oracle(
    "calibration",
    NULL,
    f"SELECT from_week, births, "
    f"{_rounded('full_calendar_share', 'visit_probability', digits=9)} FROM p",
)
oracle(
    "null_expectation",
    NULL,
    f"SELECT scenario, weeks, CAST(trimester AS INTEGER) AS trimester, CAST(visits AS INTEGER) "
    f"AS visits, {_rounded('births')} FROM expectation",
)
NULL_LEVELS = """
null_source AS (
  SELECT 2 AS definition, weeks, CAST(trimester AS INTEGER) AS trimester,
    CAST(visits AS INTEGER) AS visits, births, scenario FROM expectation
  UNION ALL
  SELECT w.definition, weeks, CAST(trimester AS INTEGER), CAST(visits AS INTEGER), births, scenario
  FROM expectation JOIN (VALUES (3, 28), (4, 32), (5, 34)) AS w(definition, week) ON weeks >= week
)"""
NULL_RATED = """
null_counts AS (
  SELECT scenario, definition, measure, variant, level, sum(births) AS births,
    coalesce(sum(births) FILTER (WHERE weeks < 37), 0) AS preterm
  FROM null_levels WHERE definition < 6 GROUP BY scenario, definition, measure, variant, level
)"""
SCENARIO = "scenario, definition, measure, variant"
NULL_CRUDE = (
    *NULL,
    NULL_LEVELS,
    s.INDEX.replace("{source}", "null_source"),
    s.levels_cte("null_source", "scenario", "null_levels"),
    NULL_RATED,
    s.crude_cte("null_counts", SCENARIO, "null_crude"),
)
oracle(
    "null_estimates",
    NULL_CRUDE,
    f"""SELECT {SCENARIO}, level, reference, {_rounded("births", "preterm", "odds_ratio",
    "lower_limit", "upper_limit", "risk_difference")} FROM null_crude""",
)
oracle(
    "null_distribution",
    NULL_CRUDE,
    f"SELECT {SCENARIO}, level, 'preterm' AS outcome, round(preterm, 6) AS births FROM null_counts "
    f"UNION ALL SELECT {SCENARIO}, level, 'term', round(births - preterm, 6) FROM null_counts",
)
oracle(
    "null_without_effect",
    NULL_CRUDE,
    "SELECT scenario, level, CAST(coalesce(lower_limit > 1 OR upper_limit < 1, FALSE) AS INTEGER) "
    "AS excludes_one FROM null_crude WHERE measure = 'c'",
)
_main = (
    "plain AS (SELECT * FROM rated_counts WHERE stratum_variable = '' AND cutoff = 37 "
    "AND period = 'all' AND definition < 6)"
)
SHARES = """
seen AS (
  SELECT c.*, w.scenario FROM crude AS c, (VALUES ('e1'), ('e2')) AS w(scenario)
),
shares AS (
  SELECT coalesce(o.definition, n.definition) AS definition,
    coalesce(o.measure, n.measure) AS measure, coalesce(o.variant, n.variant) AS variant,
    coalesce(o.scenario, n.scenario) AS scenario, coalesce(o.level, n.level) AS level,
    coalesce(o.reference, n.reference) AS reference, o.odds_ratio AS observed_odds_ratio,
    o.lower_limit AS observed_lower, o.upper_limit AS observed_upper,
    n.odds_ratio AS simulated_odds_ratio, o.risk_difference AS observed_risk_difference,
    n.risk_difference AS simulated_risk_difference,
    CASE WHEN (o.lower_limit > 1 OR o.upper_limit < 1) AND o.risk_difference <> 0
      THEN n.risk_difference / o.risk_difference END AS share
  FROM seen AS o FULL JOIN null_crude AS n ON o.definition = n.definition
    AND o.measure = n.measure AND o.variant = n.variant AND o.level = n.level
    AND o.scenario = n.scenario
)"""
oracle(
    "null_long_calendar",
    NULL,
    "SELECT scenario, round(CAST(sum(births) AS DOUBLE), 3) AS births FROM combos, "
    "(VALUES ('e1'), ('e2')) AS w(scenario) GROUP BY scenario",
)
oracle(
    "gated_loads",
    (s.REGISTRY,),
    """SELECT run, outcome, (SELECT count(*) FROM registry) AS records FROM (VALUES
  ('clean', 'promoted'), ('a column less', 'columns'), ('unloadable records', 'unloadable'),
  ('repeated records', 'keys'), ('counts that differ', 'staging_rows_not_load_counts')) AS w(run, outcome)""",
)
# The index of the observed combinations and that of the null model have tables of their own.
_observed_index = s.INDEX.replace("{source}", "analysis").replace("index_", "observed_index_")
SHARE_LAYERS = (
    *NULL_CRUDE,
    _analysis,
    _observed_index,
    LEVELS.replace("index_levels", "observed_index_levels"),
    GRID_RATED,
    _main,
    CRUDE,
    SHARES,
)
oracle(
    "truncation_share",
    SHARE_LAYERS,
    f"""SELECT definition, measure, variant, scenario, level, reference,
  {_rounded("observed_odds_ratio", "observed_lower", "observed_upper", "simulated_odds_ratio",
    "observed_risk_difference", "simulated_risk_difference", "share")} FROM shares""",
)
oracle(
    "share_difference",
    SHARE_LAYERS,
    "SELECT scenario, round(max(CASE WHEN share <> 0 THEN abs(round(share, 2) - share) "
    "/ abs(share) END), 6) AS largest FROM shares GROUP BY scenario",
)

# ---------------------------------------------------------------------------------------------
# Adjusted models

oracle("model_tables", GRID, "SELECT * FROM models")


def _reference(term: str) -> str:
    rank = "year DESC" if term == "year" else f"births DESC, CAST({term} AS VARCHAR)"
    return (
        f"SELECT {FIT}, CAST({term} AS VARCHAR) AS reference, '{term}' AS term FROM (SELECT {FIT}, "
        f"{term}, sum(births) AS births FROM round_8 GROUP BY {FIT}, {term}) AS m QUALIFY "
        f"row_number() OVER (PARTITION BY {FIT} ORDER BY {rank}) = 1"
    )


_TERMS = ("age_group", "education", "state", "year")
def _rounds(n: int, source: str = "models", terms: tuple[str, ...] = ("level", *_TERMS)) -> str:
    """The model rows left after n rounds of dropping the values of one outcome."""
    parts = []
    for i in range(1, n + 1):
        tests = " AND ".join(
            f"sum(preterm) OVER (PARTITION BY {FIT}, {term}) > 0 AND sum(preterm) OVER "
            f"(PARTITION BY {FIT}, {term}) < sum(births) OVER (PARTITION BY {FIT}, {term})"
            for term in terms
        )
        parts.append(f"round_{i} AS (SELECT * FROM {source} QUALIFY {tests})")
        source = f"round_{i}"
    return ",\n".join(parts)


oracle(
    "covariate_references",
    (*GRID, _rounds(8)),
    " UNION ALL ".join(f"({_reference(t)})" for t in _TERMS),
)
_MODEL = f"concat_ws('|', {', '.join(f'coalesce(CAST({k} AS VARCHAR), chr(1))' for k in FIT.split(', '))})"


def _design(source: str, terms: tuple[str, ...]) -> str:
    """Numbered categories of the models of ``source``, and its rows in long form: a row for each number it has."""
    values = " UNION ALL ".join(
        f"SELECT model, r, measure, {i} AS place, '{t}' AS term, CAST({t} AS VARCHAR) AS value, births FROM placed"
        for i, t in enumerate(terms)
    )
    first = f"CASE term WHEN '{terms[0]}' THEN CASE WHEN value = {s.REFERENCE} THEN 0 ELSE 1 END"
    return f"""
placed AS MATERIALIZED (SELECT *, {_MODEL} AS model, row_number() OVER () AS r FROM {source}),
valued AS MATERIALIZED ({values}),
category_sums AS (
  SELECT model, measure, place, term, value, CAST(sum(births) AS BIGINT) AS births
  FROM valued GROUP BY model, measure, place, term, value
),
based AS (
  SELECT model, place, term, value, row_number() OVER (PARTITION BY model, term ORDER BY
    {first} WHEN 'year' THEN -try_cast(value AS INTEGER) ELSE -births END, value) = 1 AS base,
    max(CASE WHEN place = 0 AND value = {s.REFERENCE} THEN 1 ELSE 0 END) OVER (PARTITION BY model) AS whole
  FROM category_sums
),
categories AS MATERIALIZED (
  SELECT model, term, value, row_number() OVER (PARTITION BY model ORDER BY place, value) AS number
  FROM based WHERE whole = 1 AND NOT base
),
whole_models AS (SELECT DISTINCT model FROM based WHERE whole = 1),
sizes AS MATERIALIZED (
  SELECT model, 1 + count(number) AS p FROM whole_models LEFT JOIN categories USING (model) GROUP BY model
),
long AS MATERIALIZED (
  SELECT model, r, number FROM valued JOIN categories USING (model, term, value)
  UNION ALL SELECT model, r, 0 FROM placed JOIN sizes USING (model)
),
pairs AS MATERIALIZED (
  SELECT l.model, l.r, l.number AS a, m.number AS b FROM long AS l JOIN long AS m ON l.r = m.r
),
grid AS MATERIALIZED (
  SELECT model, p, i.i AS a, j.j AS b FROM sizes, unnest(range(p)) AS i(i), unnest(range(p)) AS j(j)
)"""


def _eliminated(name: str, entries: str, right: str) -> str:
    """``name``: rows of each model's matrix ``entries`` and right side once all its columns are eliminated.

    A column of which nothing is left stays as it is.
    """
    return f"""
{name}_rows AS MATERIALIZED (
  SELECT g.model, g.p, g.a AS i, list(coalesce(e.v, 0.0) ORDER BY g.b) || any_value({right}) AS row,
    max(CASE WHEN g.a = g.b THEN e.v END) AS scale
  FROM grid AS g LEFT JOIN {entries} AS e USING (model, a, b) LEFT JOIN {name}_right AS y USING (model, a)
  GROUP BY g.model, g.p, g.a
),
{name}_steps AS (
  SELECT model, p, 0 AS step, i, row, scale FROM {name}_rows
  UNION ALL
  SELECT t.model, t.p, t.step + 1, t.i, CASE
    WHEN q.row[t.step + 1] <= 1e-9 * q.scale THEN t.row
    WHEN t.i = t.step THEN list_transform(t.row, lambda x: x / q.row[t.step + 1])
    ELSE list_transform(list_zip(t.row, q.row), lambda z: z[1] - z[2] * t.row[t.step + 1] / q.row[t.step + 1]) END,
    t.scale
  FROM {name}_steps AS t JOIN {name}_steps AS q ON q.model = t.model AND q.step = t.step AND q.i = t.step
  WHERE t.step < t.p
),
{name} AS MATERIALIZED (
  SELECT model, p, i, row, abs(row[i + 1] - 1) < 1e-6 AS independent FROM {name}_steps WHERE step = p
)"""


def _newton(terms: tuple[str, ...], steps: int = 10) -> str:
    """Newton's method, unrolled; ``estimates`` has beta, variance and whether it is loose for every category."""
    parts = [
        """
at_0 AS MATERIALIZED (
  SELECT model, a AS number, CASE WHEN a = 0 THEN ln(sum(preterm) / (sum(births) - sum(preterm))) ELSE 0.0 END AS beta
  FROM placed JOIN grid USING (model) WHERE b = 0 GROUP BY model, a
)"""
    ]
    for k in range(steps + 1):
        parts.append(
            f"""
rated_{k} AS MATERIALIZED (
  SELECT r, births * m * (1 - m) AS w, preterm - births * m AS e FROM (
    SELECT r, births, preterm, 1 / (1 + exp(-eta)) AS m FROM placed JOIN (
      SELECT r, sum(beta) AS eta FROM long JOIN at_{k} USING (model, number) GROUP BY r) USING (r))
),
sums_{k} AS MATERIALIZED (SELECT model, a, b, sum(w) AS v FROM pairs JOIN rated_{k} USING (r) GROUP BY model, a, b),
solved_{k}_right AS MATERIALIZED (
  SELECT model, number AS a, sum(e) AS y FROM long JOIN rated_{k} USING (r) GROUP BY model, number
)"""
        )
        unit = "list_transform(range(g.p), lambda x: CASE WHEN x = g.a THEN 1.0 ELSE 0.0 END)" if k == steps else "[]"
        parts.append(_eliminated(f"solved_{k}", f"sums_{k}", f"[coalesce(y.y, 0.0)] || {unit}"))
        if k < steps:
            parts.append(
                f"""
stepped_{k} AS (
  SELECT model, i AS number, CASE WHEN independent THEN row[p + 1] ELSE 0.0 END AS d FROM solved_{k}
),
at_{k + 1} AS MATERIALIZED (
  SELECT model, number, beta + d * least(1.0, 4.0 / greatest(1e-300, max(abs(d)) OVER (PARTITION BY model))) AS beta
  FROM at_{k} JOIN stepped_{k} USING (model, number)
)"""
            )
    parts.append(
        f"""
dependent AS (SELECT model, i AS j FROM solved_{steps} WHERE NOT independent),
estimates AS MATERIALIZED (
  SELECT o.model, c.term, c.value, t.beta, o.row[o.p + 2 + o.i] AS variance, NOT o.independent OR EXISTS (
    SELECT 1 FROM dependent AS d WHERE d.model = o.model AND abs(o.row[d.j + 1]) > 1e-6) AS loose
  FROM solved_{steps} AS o JOIN categories AS c ON c.model = o.model AND c.number = o.i
  JOIN at_{steps} AS t ON t.model = o.model AND t.number = o.i
)"""
    )
    return ",".join(parts)


def recursive_oracle(name: str, layers: tuple[str, ...], select: str) -> None:
    oracle(name, layers, select)
    ORACLES[name] = ORACLES[name].replace("WITH", "WITH RECURSIVE", 1)


FITTED = (*GRID, _rounds(8), _design("round_8", ("level", *_TERMS)), _newton(("level", *_TERMS)))
_aside = f"""asides AS (
  SELECT {FIT}, model, CAST(sum(m.births) - coalesce(max(k.births), 0) AS BIGINT) AS set_aside
  FROM (SELECT *, {_MODEL} AS model FROM models) AS m
  LEFT JOIN (SELECT model, sum(births) AS births FROM placed GROUP BY model) AS k USING (model) GROUP BY {FIT}, model
)"""
_with_limits = f"""SELECT a.definition, a.period, a.cutoff, a.measure, a.variant, a.stratum_variable, a.stratum_value,
  l.level, CASE WHEN NOT e.loose THEN exp(e.beta) END AS odds_ratio,
  CASE WHEN NOT e.loose THEN exp(e.beta - {Z} * sqrt(e.variance)) END AS lower_limit,
  CASE WHEN NOT e.loose THEN exp(e.beta + {Z} * sqrt(e.variance)) END AS upper_limit, a.set_aside
FROM asides AS a
JOIN (SELECT DISTINCT {_MODEL} AS model, level FROM models WHERE level <> {s.REFERENCE}) AS l USING (model)
LEFT JOIN estimates AS e ON e.model = a.model AND e.term = 'level' AND e.value = l.level"""
recursive_oracle(
    "adjusted_odds",
    (*FITTED, _aside),
    f"SELECT {FIT}, level, {_rounded('odds_ratio', 'lower_limit', 'upper_limit')}, set_aside FROM ({_with_limits})",
)
oracle(
    "score_equations",
    (*GRID, _rounds(8), _design("round_8", ("level", *_TERMS))),
    f"""SELECT {", ".join(f"k.{k}" for k in FIT.split(", "))}, term, value, CAST(sum(v.births) AS BIGINT) AS births,
  round(CAST(sum(p.preterm) AS DOUBLE), 3) AS fitted
FROM valued AS v JOIN placed AS p USING (model, r) JOIN sizes USING (model)
JOIN (SELECT DISTINCT model, {FIT} FROM placed) AS k USING (model)
GROUP BY {", ".join(f"k.{k}" for k in FIT.split(", "))}, term, value""",
)
oracle(
    "births_set_aside",
    (*GRID, _rounds(8), _design("round_8", ("level", *_TERMS)), _aside),
    f"SELECT {FIT}, set_aside, CAST(0 AS BIGINT) AS exact FROM asides",
)
_MORE_TERMS = ("level", *_TERMS, "era", "state_and_school")
_more = f"""more AS (
  SELECT *, CASE WHEN year < 2001 THEN 'early' ELSE 'late' END AS era,
    CASE WHEN state = '09' THEN '09:' || education ELSE 'elsewhere' END AS state_and_school
  FROM models WHERE stratum_variable = ''
)"""
recursive_oracle(
    "aliased_categories",
    (
        *GRID,
        _more,
        _rounds(8, "more", _MORE_TERMS),
        _design("round_8", _MORE_TERMS),
        "counted AS (SELECT model, a, b, CAST(count(*) AS DOUBLE) AS v FROM pairs GROUP BY model, a, b)",
        "crossed_right AS (SELECT model, a, CAST(0 AS DOUBLE) AS y FROM grid WHERE b = 0)",
        _eliminated("crossed", "counted", "[y.y]"),
    ),
    f"""SELECT {", ".join(f"k.{k}" for k in FIT.split(", "))}, c.term, c.value FROM crossed AS o
JOIN categories AS c ON c.model = o.model AND c.number = o.i
JOIN (SELECT DISTINCT model, {FIT} FROM placed) AS k ON k.model = o.model
WHERE NOT o.independent OR EXISTS (
  SELECT 1 FROM crossed AS d WHERE d.model = o.model AND NOT d.independent AND abs(o.row[d.i + 1]) > 1e-6)""",
)
_kept = (
    f"SELECT {FIT}, level, CAST(sum(births) AS BIGINT) AS births, CAST(sum(preterm) AS BIGINT) "
    f"AS preterm FROM round_{{}} GROUP BY {FIT}, level"
)
oracle("one_outcome_kept", (*GRID, _rounds(8)), _kept.format(8))
_every = s.crude_cte("rated_counts", FIT, "every_crude")
oracle(
    "crude_fits",
    (*GRID, _every),
    f"""SELECT {FIT}, level, {_rounded("odds_ratio", "lower_limit", "upper_limit", digits=5)}
FROM every_crude""",
)
oracle(
    "estimate_keys",
    (*GRID, _every),
    f"""SELECT {FIT}, level, reference, births, preterm AS preterm_births, 'crude' AS model,
  'observed' AS source, {_rounded("odds_ratio").replace(" AS odds_ratio", "")} AS crude_odds_ratio
FROM every_crude WHERE stratum_variable = ''
UNION ALL SELECT {FIT}, level, reference, births, preterm, 'adjusted', 'observed', NULL
FROM every_crude""",
)
recursive_oracle(
    "estimates",
    (*FITTED, _every, _aside, f"limits AS ({_with_limits})"),
    f"""SELECT {FIT}, level, reference, births, preterm AS preterm_births, 'crude' AS model, 'observed' AS source,
  {_rounded("odds_ratio", "lower_limit", "upper_limit")} FROM every_crude WHERE stratum_variable = ''
UNION ALL
SELECT {", ".join(f"c.{k}" for k in FIT.split(", "))}, c.level, c.reference, c.births, c.preterm, 'adjusted',
  'observed', {", ".join(f"round(a.{x}, 6)" for x in ("odds_ratio", "lower_limit", "upper_limit"))}
FROM every_crude AS c LEFT JOIN limits AS a USING ({FIT}, level)""",
)
_ref = s.REFERENCE.replace("measure", "c.measure")
oracle(
    "glm_score_check",
    (*GRID, _rounds(8), f"kept AS ({_kept.format(8)})"),
    f"""SELECT c.definition, c.period, c.cutoff, c.measure, c.variant, c.stratum_variable,
  c.stratum_value, c.level, CASE WHEN r.level IS NOT NULL THEN round(CAST(k.preterm AS DOUBLE), 3)
    END AS fitted
FROM rated_counts AS c
LEFT JOIN kept AS k USING ({FIT}, level)
LEFT JOIN kept AS r ON r.definition = c.definition AND r.period = c.period AND r.cutoff = c.cutoff
  AND r.measure = c.measure AND r.variant = c.variant AND r.stratum_variable = c.stratum_variable
  AND r.stratum_value = c.stratum_value AND r.level = {_ref}
WHERE c.level <> {_ref} AND c.stratum_variable = ''""",
)

# ---------------------------------------------------------------------------------------------
# Code maps, concepts, keys

PART_MAP = """
part_map AS (
  SELECT p_partkey,
    CASE WHEN p_partkey % 41 = 0 THEN '' ELSE CAST(p_partkey - p_partkey % 37 % 2 AS VARCHAR) END
      AS source_code,
    CASE WHEN p_partkey % 43 = 0 THEN '7' ELSE '0' END AS source_concept_id,
    p_brand AS source_vocabulary_id,
    CASE WHEN p_partkey % 47 = 0 THEN repeat('x', 256) ELSE p_name END AS source_code_description,
    CASE WHEN p_partkey % 53 = 0 THEN '-1' WHEN p_partkey % 3 = 0 THEN '0'
      ELSE CAST(p_partkey AS VARCHAR) END AS target_concept_id,
    CASE WHEN p_partkey % 6 = 0 OR p_partkey % 59 = 0 THEN 'None' ELSE p_type END
      AS target_vocabulary_id,
    CASE WHEN p_partkey % 61 = 0 THEN '2020-13-01' ELSE '2020-01-01' END AS valid_start_date,
    CASE WHEN p_partkey % 67 = 0 THEN '2019-12-31' ELSE '2023-12-31' END AS valid_end_date,
    CASE WHEN p_partkey % 71 = 0 THEN 'X' WHEN p_partkey % 73 = 0 THEN 'D' END AS invalid_reason
  FROM part
),
declared AS (
  SELECT DISTINCT p_brand AS vocabulary_id,
    CASE WHEN p_brand LIKE '%1' THEN NULL ELSE 'Part' END AS target_domain_id
  FROM part WHERE p_brand NOT LIKE '%5'
  UNION ALL SELECT r_name, 'Part' FROM region WHERE r_regionkey < 2
),
copies AS (
  SELECT source_vocabulary_id, source_code, count(*) AS copies FROM part_map
  GROUP BY source_vocabulary_id, source_code HAVING count(*) > 1
)"""
_KEY = "source_vocabulary_id, source_code"
_number = "regexp_full_match(target_concept_id, '[0-9]+')"
_zero = "try_cast(target_concept_id AS BIGINT) = 0"
_start, _end = "try_cast(valid_start_date AS DATE)", "try_cast(valid_end_date AS DATE)"
_map_rules = (
    ("d.vocabulary_id IS NULL", "vocabulary not declared"),
    ("length(source_code) NOT BETWEEN 1 AND 50", "code length"),
    ("source_concept_id <> '0'", "source concept is not 0"),
    ("length(source_code_description) > 255", "description too long"),
    (f"NOT {_number}", "target is not a concept id"),
    (
        f"{_number} AND ({_zero}) <> (target_vocabulary_id = 'None')",
        "target vocabulary is None exactly for target 0",
    ),
    (
        f"d.vocabulary_id IS NOT NULL AND d.target_domain_id IS NULL AND {_number} "
        f"AND NOT ({_zero})",
        "vocabulary without targets",
    ),
    (f"{_start} IS NULL OR {_end} IS NULL", "validity dates"),
    (f"{_end} < {_start}", "validity ends before it starts"),
    ("coalesce(invalid_reason, '') NOT IN ('', 'D', 'U')", "invalid reason"),
)
oracle(
    "code_map_problems",
    (PART_MAP,),
    " UNION ALL ".join(
        [
            f"SELECT {_KEY}, 'mapped more than once' AS problem FROM copies",
            *[
                f"SELECT {_KEY}, '{message}' FROM part_map LEFT JOIN declared AS d "
                f"ON d.vocabulary_id = source_vocabulary_id WHERE {test}"
                for test, message in _map_rules
            ],
            "SELECT vocabulary_id, NULL, 'vocabulary has no rows' FROM declared "
            "WHERE vocabulary_id NOT IN (SELECT source_vocabulary_id FROM part_map)",
        ]
    ),
)
oracle("duplicate_codes", (PART_MAP,), "SELECT * FROM copies")
PART_CONCEPTS = """
part_concept AS (
  SELECT CAST(p_partkey AS INTEGER) AS concept_id,
    ['Measurement', 'Unit', 'Observation', 'Type Concept'][p_partkey % 4 + 1] AS domain_id,
    p_brand AS vocabulary_id, CAST(p_size AS VARCHAR) AS concept_code,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'S' END AS standard_concept,
    CASE WHEN p_partkey % 13 = 0 THEN 'D' END AS invalid_reason
  FROM part WHERE p_partkey % 19 <> 4
)"""
oracle(
    "domain_problems",
    (
        PART_CONCEPTS,
        """
uses AS (
  SELECT DISTINCT CAST(l_partkey AS INTEGER) AS concept_id,
    ['measurement.measurement_concept_id', 'measurement.unit_concept_id',
     'observation.observation_concept_id', 'measurement.measurement_type_concept_id',
     'person.person_id'][l_linenumber % 5 + 1] AS field
  FROM lineitem
),
required AS (
  SELECT u.concept_id, u.field, c.domain_id,
    CASE u.field WHEN 'measurement.measurement_concept_id' THEN 'Measurement'
      WHEN 'measurement.unit_concept_id' THEN 'Unit'
      WHEN 'measurement.measurement_type_concept_id' THEN 'Type Concept' END AS required
  FROM uses AS u JOIN part_concept AS c USING (concept_id)
)""",
    ),
    """SELECT * FROM (SELECT concept_id, field, domain_id,
  CASE WHEN domain_id <> required THEN 'takes ' || required
    WHEN field = 'observation.observation_concept_id' AND domain_id IN ('Condition', 'Procedure',
      'Drug', 'Specimen', 'Measurement', 'Device') THEN 'has a table of its own' END AS problem
FROM required) AS r WHERE problem IS NOT NULL""",
)
_uses = """
uses AS (
  SELECT l_orderkey || ':' || l_linenumber AS used_by, CAST(l_partkey AS INTEGER) AS concept_id,
    l_linenumber = 1 AS standard, CASE WHEN l_linenumber = 2 THEN 'Unit' END AS domain_id,
    'Brand#' || (1 + l_partkey % 5) || (1 + l_partkey % 3) AS vocabulary_id,
    CASE WHEN l_linenumber = 3 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS concept_code
  FROM lineitem
),
found AS (
  SELECT u.*, c.concept_id IS NOT NULL AS found, c.domain_id AS c_domain,
    c.vocabulary_id AS c_vocabulary, c.concept_code AS c_code, c.standard_concept, c.invalid_reason
  FROM uses AS u LEFT JOIN part_concept AS c USING (concept_id)
)"""
_concept_rules = (
    ("NOT found", "not in the loaded vocabulary"),
    ("found AND invalid_reason IS NOT NULL", "not valid"),
    ("found AND standard AND standard_concept IS DISTINCT FROM 'S'", "not standard"),
    ("found AND domain_id IS NOT NULL AND c_domain <> domain_id", "domain"),
    ("found AND c_vocabulary <> vocabulary_id", "vocabulary"),
    ("found AND concept_code IS NOT NULL AND c_code <> concept_code", "code"),
)
oracle(
    "concept_problems",
    (PART_CONCEPTS, _uses),
    " UNION ALL ".join(
        f"SELECT used_by, concept_id, '{message}' AS problem FROM found WHERE {test}"
        for test, message in _concept_rules
    ),
)
oracle(
    "lookup_problems",
    (PART_MAP,),
    """SELECT * FROM (SELECT p_brand AS source_vocabulary_id, CAST(p_partkey AS VARCHAR)
    AS source_code, (SELECT count(*) FROM part_map AS m WHERE m.source_vocabulary_id = p.p_brand
    AND m.source_code = CAST(p.p_partkey AS VARCHAR) AND m.invalid_reason IS NULL
    AND try_cast(m.target_concept_id AS BIGINT) <> 0) AS targets FROM part AS p) AS t
WHERE targets <> 1""",
)
oracle(
    "missing_keys",
    (),
    "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
oracle(
    "vocabulary_versions",
    (
        "package AS (SELECT 'v' || p_partkey AS version FROM part WHERE p_partkey <= 2)",
        "counted AS (SELECT count(*) AS n, max(version) AS version, FALSE AS one FROM package "
        "UNION ALL SELECT count(*), max(version), TRUE FROM package WHERE version <> 'v2')",
    ),
    "SELECT n, version, CASE WHEN n <> 1 THEN 'expected one package row, found ' || n "
    "WHEN version IS NULL OR version = '' THEN 'the package row has no version' "
    "WHEN one AND version <> 'v1' THEN 'another version than declared' END AS problem FROM counted",
)

# ---------------------------------------------------------------------------------------------
# Files

oracle(
    "staged_csv",
    (s.REGISTRY,),
    "SELECT * REPLACE (row_number() OVER (PARTITION BY source_year ORDER BY source_row) "
    "AS source_row) FROM registry",
)
oracle(
    "parquet_ordinals",
    (s.REGISTRY,),
    "SELECT * EXCLUDE (source_row), source_row AS record, row_number() OVER (PARTITION BY source_year "
    "ORDER BY source_row) AS source_row FROM registry",
)
_breaks = """broken AS (
  SELECT * REPLACE (CASE WHEN source_year % 3 = 0 AND source_row % 50 = 1 THEN edad || chr(10) || '"' || source_row
    WHEN source_row % 70 = 2 THEN '"' || edad || ',' ELSE edad END AS edad) FROM registry
)"""
oracle(
    "staged_csv_with_breaks",
    (s.REGISTRY, _breaks),
    "SELECT * REPLACE (row_number() OVER (PARTITION BY source_year ORDER BY source_row) "
    "AS source_row) FROM broken",
)
oracle(
    "broken_line_files",
    (s.REGISTRY, _breaks),
    "SELECT source_year, CAST(2 * count(*) FILTER (WHERE edad LIKE '%' || chr(10) || '%') AS BIGINT) AS broken "
    "FROM broken GROUP BY source_year",
)
oracle("yearly_union", (s.REGISTRY,), "SELECT source_year, source_row, edad, peso FROM registry")
oracle(
    "replaced_years",
    (s.REGISTRY,),
    "SELECT source_year, count(*) FILTER (WHERE source_year % 2 = 0 OR source_row % 10 = 0) AS n, "
    "count(*) FILTER (WHERE source_year % 2 = 1 AND source_row % 10 = 0) AS replaced "
    "FROM registry GROUP BY source_year",
)
oracle(
    "vocabulary_scan",
    (),
    """SELECT CAST(p_partkey AS INTEGER) AS concept_id, '"' || p_name AS concept_name,
  p_type AS domain_id, p_brand AS vocabulary_id,
  CASE WHEN p_size % 2 = 0 THEN 'S' END AS standard_concept,
  CAST(CAST(DATE '2020-01-01' + CAST(p_partkey % 365 AS INTEGER) AS DATE) AS VARCHAR)
    AS valid_start_date FROM part""",
)
oracle(
    "digest_audit",
    (),
    "SELECT * FROM (VALUES ('digest differs', CAST(1 AS BIGINT)), ('missing', 1), "
    "('size differs', 1)) AS v(problem, files)",
)
oracle(
    "stage_counts",
    (s.REGISTRY,),
    "SELECT source_year, count(*) AS csv_rows, count(*) FILTER (WHERE source_row % 50 <> 1 "
    "OR source_year % 2 = 0) AS parquet_rows FROM registry GROUP BY source_year "
    "HAVING count(*) <> count(*) FILTER (WHERE source_row % 50 <> 1 OR source_year % 2 = 0)",
)
_columns = [
    "fechanacimiento", "fechanacimientomadre", "edad", "resideextranjero", "entidadresidencia",
    "edadgestacional", "productoembarazo", "totalconsultas", "trimestreprimerconsulta",
    "escolaridad", "sexo", "peso", "afiliacion",
]
oracle(
    "sample_compare",
    (
        s.REGISTRY,
        s.DAMAGED_REGISTRY,
        "sampled AS (SELECT * FROM registry WHERE source_row % 100 = 0 "
        "OR (source_year, source_row) IN (SELECT source_year, max(source_row) FROM registry GROUP BY 1))",
    ),
    " UNION ALL ".join(
        f"SELECT w.source_year, w.source_row, '{c}' AS \"column\", w.{c} AS wanted, g.{c} AS got, "
        "CAST(g.source_row IS NULL AS INTEGER) AS row_missing FROM sampled AS w LEFT JOIN damaged "
        "AS g ON g.source_year = w.source_year AND g.source_row = w.source_row "
        f"WHERE g.source_row IS NULL OR w.{c} IS DISTINCT FROM g.{c}"
        for c in _columns
    ),
)
oracle(
    "published_tables",
    (),
    "SELECT published, 0 AS differences, 0 AS repeated_keys, 1 AS has_rows FROM (VALUES ('attrition'), "
    "('excluded_profile'), ('estimates'), ('exposure_distribution'), ('truncation_share')) AS v(published)",
)
oracle(
    "published_roundtrip",
    (*COHORTS, s.PROFILE),
    "SELECT 'edited' AS file, side, count(*) AS copies FROM profile, (VALUES ('first'), "
    "('second')) AS v(side) WHERE step = 5 GROUP BY side",
)
oracle(
    "publish_violations",
    (),
    """SELECT * FROM (
  SELECT 'flag' AS "column", 'NULL where none is allowed' AS problem,
    count(*) FILTER (WHERE l_linenumber = 7) AS "rows" FROM lineitem
  UNION ALL SELECT 'note', 'empty text would read back as NULL',
    count(*) FILTER (WHERE l_linenumber = 6) FROM lineitem
  UNION ALL SELECT 'ratio', 'not a finite number',
    count(*) FILTER (WHERE l_quantity IN (49, 50)) FROM lineitem
) AS v WHERE "rows" > 0""",
)
oracle(
    "run_manifest",
    BUILT,
    """SELECT string_agg(CAST(source_year AS VARCHAR), ',' ORDER BY source_year) AS period,
  string_agg(name || '|' || version || '|' || sha256, ';' ORDER BY name) AS sources,
  'v1' AS vocabulary_version,
  string_agg('copy_' || name || '|' || sha256, ';' ORDER BY name) AS files FROM source_files""",
)
oracle(
    "promoted_load",
    RECORDS,
    "SELECT source_year, count(*) AS n, count(*) FILTER (WHERE loaded) AS loaded FROM records "
    "GROUP BY source_year",
)
oracle(
    "competing_loads",
    RECORDS,
    """SELECT 'first' AS run, 'promoted' AS outcome, 1 AS number, 1 AS tables, (SELECT count(*) FROM records) AS records
UNION ALL SELECT 'second of the same tables', 'refused', 1, 1, (SELECT count(*) FROM records)
UNION ALL SELECT 'second of other tables', 'promoted', 2, 2, (SELECT count(*) FROM records)
UNION ALL SELECT 'started afterwards', 'promoted', 3, 2, (SELECT count(*) FROM records WHERE source_year % 2 = 0)""",
)
_old = "peso IN ('0', '1', '2', '3', '4')"
oracle(
    "year_snapshots",
    (
        s.REGISTRY,
        """held AS (
  SELECT 1 AS snapshot, source_year, source_row, peso FROM registry
  UNION ALL SELECT v.snapshot, source_year, source_row,
    CASE WHEN v.snapshot > 2 AND source_year = 1996 THEN '2' WHEN v.snapshot > 3 AND source_year = 1997 THEN '3'
      WHEN source_year % 2 = 1 THEN '0' ELSE peso END
  FROM registry, (VALUES (2), (3), (4)) AS v(snapshot)
  WHERE CASE WHEN v.snapshot > 2 AND source_year = 1996 THEN source_row % 5 = 0
    WHEN v.snapshot > 3 AND source_year = 1997 THEN source_row % 7 = 0
    WHEN source_year % 2 = 1 THEN source_row % 10 = 0 ELSE true END
)""",
    ),
    f"""SELECT snapshot, source_year, count(*) AS n, CAST(sum(source_row) AS BIGINT) AS rows,
  count(*) FILTER (WHERE {_old}) AS replaced FROM held GROUP BY snapshot, source_year""",
)
oracle(
    "published_order",
    (s.REGISTRY,),
    "SELECT 'ascending' AS copy, CAST(0 AS BIGINT) AS breaks UNION ALL "
    "SELECT 'descending', count(*) - 1 FROM registry",
)
oracle(
    "registry_readback",
    (
        s.REGISTRY,
        """sides AS (
  SELECT 'first' AS side, source_year FROM registry
  WHERE source_row % 3000 = 5 OR (source_row % 1000 = 1 AND nullif(peso, '') IS DISTINCT FROM '0')
  UNION ALL SELECT 'second', source_year FROM registry
  WHERE source_row % 2500 = 7 OR (source_row % 1000 = 1 AND nullif(peso, '') IS DISTINCT FROM '0')
)""",
    ),
    "SELECT 'edited' AS file, side, source_year, count(*) AS copies FROM sides GROUP BY side, source_year",
)
