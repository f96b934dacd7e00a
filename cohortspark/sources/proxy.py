"""A stand-in birth registry: one raw text record per order of a star schema.

It gives every operator the kinds of values a registry file holds (codes, blanks, impossible dates,
out-of-catalogue answers), derived from the given tables by fixed formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.catalogue import SOURCE_COLUMNS, Ids, Settings

#: The order years start before 2000, so the stand-in registry counts its years from 1990. Its ids have room
#: for 100 billion records a year: the tables grow with no bound of their own.
PROXY_SETTINGS = Settings(
    ids=Ids(first_year=1990, last_year=2089, rows_per_year=10**11, newborn_offset=10**16)
)

#: The years a run over the stand-in registry asks for.
PROXY_YEARS = tuple(range(1990, 2011))

#: k order key, c customer key, n line items, d order date, pr priority, reg region, nat nation.
_FORMULAS = {
    "fechanacimiento": "date_format(d, 'dd/MM/yyyy')",
    "fechanacimientomadre": """CASE k % 41 WHEN 0 THEN '09/09/9999' WHEN 1 THEN '31/02/1970'
        WHEN 2 THEN NULL ELSE concat_ws('/', lpad(1 + c % 28, 2, '0'), lpad(1 + c % 12, 2, '0'),
        1955 + c % 30) END""",
    "edad": """CASE k % 43 WHEN 0 THEN '888' WHEN 1 THEN ' 26' WHEN 2 THEN NULL
        ELSE string(12 + c % 35) END""",
    "resideextranjero": """CASE WHEN k % 211 = 0 THEN '88' WHEN k % 223 = 0 THEN NULL
        WHEN reg = 4 THEN '1' ELSE '2' END""",
    "entidadresidencia": """CASE WHEN k % 67 = 0 THEN '99' WHEN k % 71 = 0 THEN '9'
        ELSE lpad(1 + nat, 2, '0') END""",
    "edadgestacional": """CASE WHEN k % 101 = 0 THEN '99' WHEN k % 101 = 1 THEN ' 38'
        WHEN k % 101 = 2 THEN NULL WHEN k % 503 = 3 THEN '21'
        WHEN (k + 3 * n) % 11 = 0 THEN string(22 + c % 15) ELSE string(37 + c % 6) END""",
    "productoembarazo": """CASE WHEN k % 199 = 0 THEN '0' WHEN k % 97 = 0 THEN '3'
        WHEN k % 53 = 0 THEN '2' WHEN k % 307 = 0 THEN '7' ELSE '1' END""",
    "totalconsultas": """CASE WHEN k % 131 = 0 THEN '99' WHEN k % 137 = 0 THEN NULL
        ELSE string(n + n % 3) END""",
    "trimestreprimerconsulta": """CASE WHEN k % 151 = 0 THEN '9' WHEN n = 0 THEN '0'
        WHEN pr IN ('1', '2') THEN '1' WHEN pr = '3' THEN '2'
        WHEN pr = '4' AND k % 7 = 0 THEN '8' WHEN pr = '4' THEN '1' ELSE '3' END""",
    "escolaridad": """CASE WHEN k % 61 = 0 THEN '99' ELSE CASE seg WHEN 'AUTOMOBILE' THEN '1'
        WHEN 'BUILDING' THEN '31' WHEN 'FURNITURE' THEN '51' WHEN 'HOUSEHOLD' THEN '71'
        ELSE '81' END END""",
    "sexo": "CASE WHEN k % 311 = 0 THEN '9' WHEN k % 2 = 0 THEN '1' ELSE '2' END",
    "peso": "CASE WHEN k % 17 = 0 THEN '9999' ELSE string(1500 + c) END",
    "afiliacion": "CASE WHEN k % 401 = 0 THEN NULL ELSE lpad(c % 13, 2, '0') END",
}


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records: ``source_year``, ``source_row`` and the text columns.

    Line items are counted per order before the join, so the order join moves one row per order.
    No side is hinted: each join takes the strategy its measured sizes call for.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    items = read("lineitem").groupBy(F.expr("l_orderkey AS k")).agg(F.expr("count(*) AS items"))
    nation = read("nation").selectExpr("n_nationkey AS nat", "n_regionkey AS reg")
    places = (
        read("customer")
        .selectExpr("c_custkey AS c", "c_mktsegment AS seg", "c_nationkey AS nat")
        .join(nation, "nat")
    )
    base = (
        read("orders")
        .selectExpr(
            "o_orderkey AS k",
            "o_custkey AS c",
            "CAST(o_orderdate AS date) AS d",
            "substr(o_orderpriority, 1, 1) AS pr",
        )
        .join(items, "k", "left")
        .join(places, "c")
        .selectExpr("k", "c", "d", "pr", "seg", "nat", "reg", "coalesce(items, 0) AS n")
    )
    return base.selectExpr(
        "year(d) AS source_year",
        "k + 1 AS source_row",
        *[f"{_FORMULAS[name]} AS {name}" for name in SOURCE_COLUMNS],
    )


def damaged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged(registry(spark, sf_dir))


def damaged(staged: DataFrame) -> DataFrame:
    """The same records with the values that stop a load: bad dates, long texts, high rows."""
    changes = {
        "source_row": "CASE WHEN source_row % 389 = 0 THEN source_row + 100000000000 "
        "ELSE source_row END",
        "fechanacimiento": "CASE source_row % 97 WHEN 5 THEN '31/02/1999' WHEN 6 THEN NULL "
        "WHEN 7 THEN \"it's\" ELSE fechanacimiento END",
    }
    for name in ("edad", "escolaridad", "resideextranjero"):
        changes[name] = f"CASE WHEN source_row % 113 = 3 THEN repeat('7', 51) ELSE {name} END"
    columns = ["source_year", "source_row", *SOURCE_COLUMNS]
    return staged.selectExpr(*[f"{changes.get(name, name)} AS {name}" for name in columns])
