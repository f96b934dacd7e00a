"""The layers of ANSI SQL the oracle queries are built from; each is one or more CTEs."""

from __future__ import annotations

from cohortspark.catalogue import CODE_MAP, CONCEPT_IDS, INSURANCE_GROUPS

#: One raw text record per order.
REGISTRY = """
registry AS (
  SELECT
    CAST(year(d) AS INTEGER) AS source_year,
    k + 1 AS source_row,
    lpad(CAST(day(d) AS VARCHAR), 2, '0') || '/' || lpad(CAST(month(d) AS VARCHAR), 2, '0')
      || '/' || CAST(year(d) AS VARCHAR) AS fechanacimiento,
    CASE WHEN k % 41 = 0 THEN '09/09/9999' WHEN k % 41 = 1 THEN '31/02/1970'
      WHEN k % 41 = 2 THEN NULL
      ELSE lpad(CAST(1 + c % 28 AS VARCHAR), 2, '0') || '/'
        || lpad(CAST(1 + c % 12 AS VARCHAR), 2, '0') || '/' || CAST(1955 + c % 30 AS VARCHAR)
    END AS fechanacimientomadre,
    CASE WHEN k % 43 = 0 THEN '888' WHEN k % 43 = 1 THEN ' 26' WHEN k % 43 = 2 THEN NULL
      ELSE CAST(12 + c % 35 AS VARCHAR) END AS edad,
    CASE WHEN k % 211 = 0 THEN '88' WHEN k % 223 = 0 THEN NULL WHEN reg = 4 THEN '1'
      ELSE '2' END AS resideextranjero,
    CASE WHEN k % 67 = 0 THEN '99' WHEN k % 71 = 0 THEN '9'
      ELSE lpad(CAST(1 + nat AS VARCHAR), 2, '0') END AS entidadresidencia,
    CASE WHEN k % 101 = 0 THEN '99' WHEN k % 101 = 1 THEN ' 38' WHEN k % 101 = 2 THEN NULL
      WHEN k % 503 = 3 THEN '21' WHEN (k + 3 * n) % 11 = 0 THEN CAST(22 + c % 15 AS VARCHAR)
      ELSE CAST(37 + c % 6 AS VARCHAR) END AS edadgestacional,
    CASE WHEN k % 199 = 0 THEN '0' WHEN k % 97 = 0 THEN '3' WHEN k % 53 = 0 THEN '2'
      WHEN k % 307 = 0 THEN '7' ELSE '1' END AS productoembarazo,
    CASE WHEN k % 131 = 0 THEN '99' WHEN k % 137 = 0 THEN NULL
      ELSE CAST(n + n % 3 AS VARCHAR) END AS totalconsultas,
    CASE WHEN k % 151 = 0 THEN '9' WHEN n = 0 THEN '0' WHEN pr IN ('1', '2') THEN '1'
      WHEN pr = '3' THEN '2' WHEN pr = '4' AND k % 7 = 0 THEN '8' WHEN pr = '4' THEN '1'
      ELSE '3' END AS trimestreprimerconsulta,
    CASE WHEN k % 61 = 0 THEN '99' WHEN seg = 'AUTOMOBILE' THEN '1' WHEN seg = 'BUILDING' THEN '31'
      WHEN seg = 'FURNITURE' THEN '51' WHEN seg = 'HOUSEHOLD' THEN '71'
      ELSE '81' END AS escolaridad,
    CASE WHEN k % 311 = 0 THEN '9' WHEN k % 2 = 0 THEN '1' ELSE '2' END AS sexo,
    CASE WHEN k % 17 = 0 THEN '9999' ELSE CAST(1500 + c AS VARCHAR) END AS peso,
    CASE WHEN k % 401 = 0 THEN NULL ELSE lpad(CAST(c % 13 AS VARCHAR), 2, '0') END AS afiliacion
  FROM (
    SELECT o.o_orderkey AS k, o.o_custkey AS c, CAST(o.o_orderdate AS DATE) AS d,
      substr(o.o_orderpriority, 1, 1) AS pr, cu.c_mktsegment AS seg, na.n_nationkey AS nat,
      na.n_regionkey AS reg, coalesce(li.n, 0) AS n
    FROM orders AS o
    JOIN customer AS cu ON o.o_custkey = cu.c_custkey
    JOIN nation AS na ON cu.c_nationkey = na.n_nationkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) AS li
      ON o.o_orderkey = li.l_orderkey
  ) AS source
)"""

#: The records with the values that stop a load.
DAMAGED_REGISTRY = """
damaged AS (
  SELECT source_year,
    CASE WHEN source_row % 389 = 0 THEN source_row + 100000000000 ELSE source_row END AS source_row,
    CASE WHEN source_row % 97 = 5 THEN '31/02/1999' WHEN source_row % 97 = 6 THEN NULL
      WHEN source_row % 97 = 7 THEN 'it''s' ELSE fechanacimiento END AS fechanacimiento,
    fechanacimientomadre,
    CASE WHEN source_row % 113 = 3 THEN rpad('7', 51, '7') ELSE edad END AS edad,
    CASE WHEN source_row % 113 = 3 THEN rpad('7', 51, '7') ELSE resideextranjero END
      AS resideextranjero,
    entidadresidencia, edadgestacional, productoembarazo, totalconsultas,
    trimestreprimerconsulta,
    CASE WHEN source_row % 113 = 3 THEN rpad('7', 51, '7') ELSE escolaridad END AS escolaridad,
    sexo, peso, afiliacion
  FROM registry
)"""


def code_map_cte() -> str:
    rows = ", ".join(
        f"('{vocabulary}', '{code}', {target})"
        for vocabulary, codes in CODE_MAP.items()
        for code, target in codes.items()
    )
    return f"code_map(vocabulary, code, target) AS (VALUES {rows})"


def _date(column: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({column}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') "
        f"AND {column} NOT LIKE '%/0000' THEN "
        f"try_cast(substr({column}, 7, 4) || '-' || substr({column}, 4, 2) || '-' "
        f"|| substr({column}, 1, 2) AS DATE) END"
    )


def _number_rule(column: str, alias: str) -> str:
    return (
        f"CASE WHEN r.{column} IS NULL THEN 'blank' WHEN {alias}.code IS NOT NULL "
        f"THEN 'code_to_null' WHEN NOT regexp_full_match(r.{column}, '[0-9]+') THEN 'not_integer' "
        f"WHEN length(r.{column}) > 38 THEN 'too_long' ELSE 'value' END"
    )


def _concept_rule(column: str, alias: str) -> str:
    return (
        f"CASE WHEN r.{column} IS NULL THEN 'blank' WHEN {alias}.target = 0 THEN 'code_to_0' "
        f"WHEN {alias}.target IS NOT NULL THEN 'code_to_concept' ELSE 'not_in_catalogue' END"
    )


_LOOKUPS = (
    ("md", "REG_FECHANACMAD", "fechanacimientomadre"),
    ("ag", "REG_EDAD", "edad"),
    ("wk", "REG_EDADGEST", "edadgestacional"),
    ("pl", "REG_PRODEMB", "productoembarazo"),
    ("vi", "REG_TOTCONS", "totalconsultas"),
    ("tr", "REG_TRIMCONS", "trimestreprimerconsulta"),
    ("ed", "REG_ESCOL", "escolaridad"),
    ("ins", "REG_AFIL", "afiliacion"),
    ("co", "REG_RESEXT", "resideextranjero"),
    ("st", "REG_ENTRES", "entidadresidencia"),
    ("sx", "REG_SEXO", "sexo"),
    ("wt", "REG_PESO", "peso"),
)


def records_cte(source: str = "registry") -> str:
    """The typed records, from the code map as a table joined once per column."""
    joins = "\n    ".join(
        f"LEFT JOIN code_map AS {alias} ON {alias}.vocabulary = '{vocabulary}' "
        f"AND {alias}.code = r.{column}"
        for alias, vocabulary, column in _LOOKUPS
    )
    return f"""
{code_map_cte()},
ruled AS (
  SELECT r.*,
    (r.source_year - 1990) * CAST(100000000000 AS BIGINT) + r.source_row AS person_id,
    {_date("r.fechanacimiento")} AS delivery_date,
    CASE WHEN md.code IS NULL THEN {_date("r.fechanacimientomadre")} END AS mother_birth_date,
    CASE WHEN ag.code IS NULL AND regexp_full_match(r.edad, '[0-9]+')
      THEN try_cast(r.edad AS INTEGER) END AS declared_age,
    {_number_rule("edadgestacional", "wk")} AS weeks_rule,
    CASE WHEN r.productoembarazo IS NULL THEN 'blank' WHEN pl.code IS NOT NULL THEN 'code_to_null'
      WHEN r.productoembarazo IN ('1', '2', '3') THEN 'value'
      ELSE 'not_in_catalogue' END AS plurality_rule,
    {_number_rule("totalconsultas", "vi")} AS visits_rule,
    {_concept_rule("trimestreprimerconsulta", "tr")} AS trimester_rule,
    {_number_rule("edad", "ag")} AS age_rule,
    {_concept_rule("escolaridad", "ed")} AS education_rule,
    {_concept_rule("afiliacion", "ins")} AS insurance_rule,
    {_concept_rule("resideextranjero", "co")} AS country_rule,
    CASE WHEN r.entidadresidencia IS NULL THEN 'blank' WHEN st.code IS NOT NULL
      THEN 'code_to_null' WHEN regexp_full_match(r.entidadresidencia, '[0-9]{{2}}') THEN 'value'
      ELSE 'not_two_digits' END AS state_rule,
    {_concept_rule("sexo", "sx")} AS sex_rule,
    {_number_rule("peso", "wt")} AS weight_rule,
    tr.target AS trimester_target, ed.target AS education_target, ins.target AS insurance_target,
    co.target AS country_target, sx.target AS sex_target
  FROM {source} AS r
    {joins}
),
records AS (
  SELECT *, person_id + 10000000000000000 AS newborn_person_id,
    year_of_birth_case IS NOT NULL AS loaded,
    CASE WHEN year_of_birth_case = 'mother_date' THEN CAST(year(mother_birth_date) AS INTEGER)
      WHEN year_of_birth_case = 'age' THEN CAST(year(delivery_date) - declared_age AS INTEGER)
      END AS year_of_birth,
    CASE WHEN year_of_birth_case = 'mother_date' THEN CAST(month(mother_birth_date) AS INTEGER) END
      AS month_of_birth,
    CASE WHEN year_of_birth_case = 'mother_date' THEN CAST(day(mother_birth_date) AS INTEGER) END
      AS day_of_birth,
    CASE WHEN weeks_rule = 'value' THEN try_cast(edadgestacional AS BIGINT) END AS weeks,
    CASE WHEN plurality_rule = 'value' THEN try_cast(productoembarazo AS BIGINT) END AS plurality,
    plurality_rule = 'value' AND productoembarazo = '3' AS plurality_at_least,
    CASE WHEN visits_rule = 'value' THEN try_cast(totalconsultas AS BIGINT) END AS visits,
    CASE WHEN trimester_rule = 'blank' THEN NULL ELSE coalesce(trimester_target, 0) END
      AS trimester_concept_id,
    CASE WHEN age_rule = 'value' THEN try_cast(edad AS BIGINT) END AS age,
    CASE WHEN education_rule = 'blank' THEN NULL ELSE coalesce(education_target, 0) END
      AS education_concept_id,
    CASE WHEN insurance_rule = 'blank' THEN NULL ELSE coalesce(insurance_target, 0) END
      AS insurance_concept_id,
    CASE WHEN country_rule = 'blank' THEN NULL ELSE coalesce(country_target, 0) END
      AS country_concept_id,
    CASE WHEN state_rule = 'value' THEN entidadresidencia END AS state,
    coalesce(sex_target, 0) AS newborn_gender_concept_id,
    CASE WHEN weight_rule = 'value' THEN try_cast(peso AS BIGINT) END AS weight
  FROM (
    SELECT *, CASE WHEN mother_birth_date < delivery_date THEN 'mother_date'
      WHEN declared_age IS NOT NULL AND delivery_date IS NOT NULL THEN 'age' END
      AS year_of_birth_case
    FROM ruled
  ) AS cased
)"""


RECORDS = f"{REGISTRY},{records_cte()}"
C = CONCEPT_IDS

#: Every subject (loaded record) with the columns the cohort criteria read.
CRITERIA = """
criteria AS (
  SELECT person_id AS subject_id, source_year, delivery_date, weeks, plurality, visits, age,
    education_concept_id, state, afiliacion,
    CASE trimester_concept_id WHEN 45880561 THEN 0 WHEN 45880554 THEN 1 WHEN 45879078 THEN 2
      WHEN 45885074 THEN 3 END AS trimester,
    year(delivery_date) IN (SELECT DISTINCT source_year FROM records) AS born_in_period,
    coalesce(country_concept_id = 4075636, FALSE) AS resident,
    weeks IS NOT NULL AS weeks_specified,
    plurality IS NOT NULL AS multiplicity_specified,
    coalesce(plurality = 1, FALSE) AS singleton,
    coalesce(weeks >= 22, FALSE) AS viable
  FROM records WHERE loaded
),
flagged AS (
  SELECT *,
    coalesce(trimester IS NOT NULL AND visits IS NOT NULL AND (trimester = 0) = (visits = 0)
      AND NOT (trimester = 3 AND weeks < 28), FALSE) AS care_known,
    coalesce(age IS NOT NULL AND education_concept_id <> 0 AND state IS NOT NULL, FALSE)
      AS covariates_known
  FROM criteria
),
exit_1 AS (
  SELECT *, CASE WHEN NOT born_in_period THEN 2 WHEN NOT resident THEN 3
    WHEN NOT weeks_specified THEN 4 WHEN NOT multiplicity_specified THEN 5
    WHEN NOT singleton THEN 6 WHEN NOT viable THEN 7 END AS e1
  FROM flagged
),
exit_2 AS (
  SELECT *, CASE WHEN e1 IS NOT NULL THEN e1 WHEN NOT care_known THEN 8
    WHEN NOT covariates_known THEN 9 END AS e2
  FROM exit_1
),
exits AS (
  SELECT 1 AS definition, subject_id, source_year, delivery_date, weeks, trimester, e1 AS exit_step
    FROM exit_1
  UNION ALL
  SELECT 2, subject_id, source_year, delivery_date, weeks, trimester, e2 FROM exit_2
  UNION ALL
  SELECT w.definition, subject_id, source_year, delivery_date, weeks, trimester,
    CASE WHEN e2 IS NOT NULL THEN e2 WHEN NOT coalesce(weeks >= w.week, FALSE) THEN 10 END
    FROM exit_2, (VALUES (3, 28), (4, 32), (5, 34)) AS w(definition, week)
  UNION ALL
  SELECT 6, subject_id, source_year, delivery_date, weeks, trimester,
    CASE WHEN NOT born_in_period THEN 2 WHEN NOT resident THEN 3 WHEN NOT weeks_specified THEN 4
      WHEN NOT multiplicity_specified THEN 5 WHEN NOT viable THEN 6 WHEN NOT care_known THEN 7
      WHEN NOT covariates_known THEN 8 END
    FROM exit_2
),
steps(definition, step, kind, description) AS (
  SELECT d.definition, s.step, s.kind, s.description
  FROM (VALUES (1), (2), (3), (4), (5)) AS d(definition),
    (VALUES (2, 'coverage', 'Born in the study period'),
      (3, 'coverage', 'Mother resident in Mexico'),
      (4, 'validity', 'Gestational age specified'),
      (5, 'validity', 'Multiplicity specified'),
      (6, 'design', 'Singleton'),
      (7, 'design', '22 completed weeks or more'),
      (8, 'validity', 'Prenatal care data known and coherent'),
      (9, 'validity', 'Covariates known')) AS s(step, kind, description)
  WHERE d.definition > 1 OR s.step <= 7
  UNION ALL
  VALUES (3, 10, 'design', 'Reached week 28'), (4, 10, 'design', 'Reached week 32'),
    (5, 10, 'design', 'Reached week 34'),
    (6, 2, 'coverage', 'Born in the study period'),
    (6, 3, 'coverage', 'Mother resident in Mexico'),
    (6, 4, 'validity', 'Gestational age specified'),
    (6, 5, 'validity', 'Multiplicity specified'),
    (6, 6, 'design', '22 completed weeks or more'),
    (6, 7, 'validity', 'Prenatal care data known and coherent'),
    (6, 8, 'validity', 'Covariates known')
)"""

ATTRITION = """
years AS (
  SELECT source_year, count(*) AS staged, count(*) FILTER (WHERE NOT loaded) AS not_loaded
  FROM records GROUP BY source_year
),
exit_counts AS (
  SELECT definition, source_year, exit_step, count(*) AS n FROM exits
  GROUP BY definition, source_year, exit_step
),
attrition AS (
  SELECT d.definition AS cohort_definition_id, y.source_year, 0 AS step,
    CAST(NULL AS VARCHAR) AS kind, 'Records in the files of the study period' AS description,
    y.staged AS remaining, CAST(NULL AS BIGINT) AS excluded
  FROM (SELECT DISTINCT definition FROM steps) AS d, years AS y
  UNION ALL
  SELECT d.definition, y.source_year, 1, 'data model', 'Mother''s year of birth known',
    coalesce((SELECT sum(n) FROM exit_counts AS x WHERE x.definition = d.definition
      AND x.source_year = y.source_year), 0), y.not_loaded
  FROM (SELECT DISTINCT definition FROM steps) AS d, years AS y
  UNION ALL
  SELECT s.definition, y.source_year, s.step, s.kind, s.description,
    coalesce(sum(x.n) FILTER (WHERE x.exit_step IS NULL OR x.exit_step > s.step), 0),
    coalesce(sum(x.n) FILTER (WHERE x.exit_step = s.step), 0)
  FROM steps AS s CROSS JOIN years AS y
  LEFT JOIN exit_counts AS x ON s.definition = x.definition AND y.source_year = x.source_year
  GROUP BY s.definition, y.source_year, s.step, s.kind, s.description
)"""

PROFILE = """
profile AS (
  SELECT s.definition AS cohort_definition_id, s.step, g.subject_group, count(x.subject_id) AS births,
    100.0 * count(*) FILTER (WHERE x.weeks >= 22 AND x.weeks < 37)
      / nullif(count(*) FILTER (WHERE x.weeks >= 22), 0) AS preterm_percent,
    100.0 * count(*) FILTER (WHERE x.trimester = 1) / nullif(count(x.trimester), 0)
      AS first_trimester_start_percent,
    100.0 * count(*) FILTER (WHERE x.trimester = 0) / nullif(count(x.trimester), 0)
      AS no_prenatal_care_percent
  FROM steps AS s CROSS JOIN (VALUES ('excluded'), ('retained')) AS g(subject_group)
  LEFT JOIN exits AS x ON x.definition = s.definition
    AND CASE WHEN g.subject_group = 'excluded' THEN x.exit_step = s.step
      ELSE x.exit_step IS NULL OR x.exit_step > s.step END
  WHERE s.kind = 'validity'
  GROUP BY s.definition, s.step, g.subject_group
)"""


def _insurance() -> str:
    branches = " ".join(f"WHEN '{code}' THEN '{group}'" for code, group in INSURANCE_GROUPS.items())
    return f"CASE afiliacion {branches} ELSE 'Unknown' END"


#: Births per definition (2 to 6) and the keys of the models.
CELLS = f"""
members AS (
  SELECT x.definition, CAST(f.weeks AS INTEGER) AS weeks, f.trimester,
    CAST(f.visits AS INTEGER) AS visits,
    CASE WHEN f.age < 15 THEN 'under 15' WHEN f.age < 20 THEN '15-19' WHEN f.age < 25 THEN '20-24'
      WHEN f.age < 30 THEN '25-29' WHEN f.age < 35 THEN '30-34' WHEN f.age < 40 THEN '35-39'
      WHEN f.age >= 40 THEN '40 and over' END AS age_group,
    f.education_concept_id AS education, f.state, CAST(year(f.delivery_date) AS INTEGER) AS year,
    {_insurance()} AS insurance
  FROM exits AS x JOIN flagged AS f USING (subject_id)
  WHERE x.exit_step IS NULL AND x.definition >= 2
),
cells AS (
  SELECT definition, weeks, trimester, visits, age_group, education, state, year, insurance,
    count(*) AS births
  FROM members GROUP BY ALL
)"""

_INDEX_LEVEL = """
  CASE WHEN initiation IN ('Intermediate', 'Inadequate') OR services = 'Inadequate'
    THEN 'Inadequate' ELSE services END"""

#: The adequacy index of every (weeks, trimester, visits) of table {source}, one row per variant.
INDEX = f"""
index_keys AS (
  SELECT DISTINCT weeks, trimester, visits FROM {{source}}
),
index_start AS (
  SELECT k.*, v.variant, v.acog,
    CASE k.trimester WHEN 0 THEN 0 WHEN 1 THEN v.m1 WHEN 2 THEN v.m2 WHEN 3 THEN v.m3 END
      AS start_month
  FROM index_keys AS k, (VALUES ('acog_midpoint', TRUE, 2, 5, 8), ('acog_first', TRUE, 1, 4, 7),
    ('acog_last', TRUE, 3, 6, 9), ('nom007_midpoint', FALSE, 2, 5, 8))
    AS v(variant, acog, m1, m2, m3)
),
index_expected AS (
  SELECT *,
    CASE WHEN acog THEN CASE WHEN weeks >= 35 THEN weeks - 26 WHEN weeks = 34 THEN 9
        WHEN weeks >= 32 THEN 8 WHEN weeks >= 30 THEN 7 WHEN weeks >= 26 THEN 6
        WHEN weeks >= 22 THEN 5 ELSE 4 END
      ELSE CAST(len(list_filter([6, 10, 16, 22, 28, 32, 36, 38], lambda w: w <= weeks)) AS INTEGER)
      END AS recommended,
    CASE WHEN acog THEN [0, 0, 1, 2, 3, 5, 6, 7, 9, 13][start_month + 1]
      WHEN start_month = 0 THEN 0
      ELSE CAST(len(list_filter([6, 10, 16, 22, 28, 32, 36, 38],
        lambda w: w < 4 * (start_month - 1))) AS INTEGER) END AS missed
  FROM index_start
),
index_rated AS (
  SELECT *, greatest(recommended - missed, 1) AS expected,
    CAST(visits AS DOUBLE) / greatest(recommended - missed, 1) * 100 AS ratio_percent,
    CASE WHEN start_month BETWEEN 1 AND 2 THEN 'Adequate Plus'
      WHEN start_month BETWEEN 3 AND 4 THEN 'Adequate'
      WHEN start_month BETWEEN 5 AND 6 THEN 'Intermediate' ELSE 'Inadequate' END AS initiation
  FROM index_expected
),
index_levels AS (
  SELECT *, {_INDEX_LEVEL} AS level
  FROM (
    SELECT *, CASE WHEN ratio_percent > 109.99 THEN 'Adequate Plus' WHEN ratio_percent > 79.99
      THEN 'Adequate' WHEN ratio_percent > 49.99 THEN 'Intermediate' ELSE 'Inadequate' END
      AS services
    FROM index_rated
  ) AS s
)"""


def levels_cte(source: str, keys: str, name: str = "levels") -> str:
    """Every row of a table of combinations with the level of each measure it is rated on.

    ``keys`` are the columns kept besides definition, weeks, trimester, visits and births.
    """
    visits = (
        "CASE WHEN visits = 0 THEN '0' WHEN visits < 5 THEN '1-4' WHEN visits < 8 THEN '5-7' "
        "ELSE '8+' END"
    )
    kept = f"definition, weeks, trimester, visits, births{', ' + keys if keys else ''}"
    qualified = ", ".join(f"c.{k.strip()}" for k in kept.split(","))
    return f"""
{name} AS (
  SELECT {kept}, 'a' AS measure, '' AS variant, {visits} AS level FROM {source}
    WHERE definition IN (2, 6)
  UNION ALL
  SELECT {kept}, 'a_count', '', CAST(visits AS VARCHAR) FROM {source} WHERE definition = 2
  UNION ALL
  SELECT {qualified}, 'b', i.variant, i.level FROM {source} AS c
    JOIN index_levels AS i USING (weeks, trimester, visits) WHERE c.definition = 2
  UNION ALL
  SELECT {kept}, 'c', '', CASE WHEN trimester = 1 THEN 'trimester 1'
    ELSE 'trimester 0, 2 or 3' END FROM {source} WHERE definition IN (2, 6)
  UNION ALL
  SELECT {kept}, 'd', '', {visits} FROM {source} WHERE definition IN (3, 4, 5)
)"""


REFERENCE = (
    "CASE measure WHEN 'a' THEN '8+' WHEN 'd' THEN '8+' WHEN 'a_count' THEN '8' "
    "WHEN 'b' THEN 'Adequate' ELSE 'trimester 1' END"
)


def crude_cte(source: str, keys: str, name: str = "crude") -> str:
    """Odds ratio, limits and risk difference of every non-reference level of ``source``."""
    match = " AND ".join(f"l.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_pairs AS (
  SELECT l.*, {REFERENCE.replace("measure", "l.measure")} AS reference,
    CAST(l.preterm AS DOUBLE) AS a, CAST(l.births - l.preterm AS DOUBLE) AS b,
    CAST(r.preterm AS DOUBLE) AS c, CAST(r.births - r.preterm AS DOUBLE) AS d
  FROM {source} AS l LEFT JOIN {source} AS r
    ON {match} AND r.level = {REFERENCE.replace("measure", "l.measure")}
  WHERE l.level <> {REFERENCE.replace("measure", "l.measure")}
),
{name} AS (
  SELECT *,
    CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN exp(ln(a / b) - ln(c / d)) END AS odds_ratio,
    CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0
      THEN exp(ln(a / b) - ln(c / d) - 1.959963984540054 * sqrt(1/a + 1/b + 1/c + 1/d)) END
      AS lower_limit,
    CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0
      THEN exp(ln(a / b) - ln(c / d) + 1.959963984540054 * sqrt(1/a + 1/b + 1/c + 1/d)) END
      AS upper_limit,
    CASE WHEN a + b > 0 AND c + d > 0 THEN
      CASE WHEN abs(a / (a + b) - c / (c + d)) <= 1e-12 * greatest(a / (a + b), c / (c + d)) THEN 0.0
        ELSE a / (a + b) - c / (c + d) END END AS risk_difference
  FROM {name}_pairs
)"""


def with_layers(*layers: str) -> str:
    return "WITH " + ",\n".join(layer.strip() for layer in layers) + "\n"
