"""The place table that the registered queries read, derived from the customer and nation tables, in Spark and in SQL.

Three customers in a row are one place in three spellings, 40 to 90 m apart. Among them are places whose lines differ
in more than spelling, places of many customers at one point, rows without a country, brands in lower case, brands with
numbers, and street lines among the brands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"

_COLUMNS = {
    "handle": "concat('c', lpad(cast(k as {string}), 9, '0'))",
    "name": "case v when 0 then concat('Maison Nr', cast(g as {string}), ' Watches') when 1 then concat('Maison Nr', cast(g as {string}), ' Watches Inc') else concat('MAISON NR', cast(g as {string}), ' WATCHES') end",
    "line1": "concat(cast(100 + g % 900 as {string}), ' ', case g % 4 when 0 then 'Whitaker' when 1 then 'Jean Jaures' when 2 then 'North Milwaukee' else 'Roma' end, case when g % 7 = 3 and v = 1 then ' Mall' when g % 7 = 3 and v = 2 then ' Center' when v = 0 or (v = 1 and g % 10 = 0) then ' Street' when v = 1 then ' St' else concat(' St, Suite ', cast(g % 7 + 1 as {string})) end)",
    "city": "concat('City ', cast(g % 40 as {string}))",
    "country": "case when g % 50 <> 49 then n_name end",
    "country_raw": "case g % 8 when 0 then 'US' when 1 then 'france' when 2 then ' usa ' when 3 then 'DE' when 4 then 'Hong Kong SAR' when 5 then 'Atlantis' when 6 then 'UNITED KINGDOM' else '' end",
    "lat": "case when g % 25 = 7 then 10.0D else ((g * 7919) % 16000) / 100.0D - 80 + v * 0.0004D end",
    "lon": "case when g % 25 = 7 then 20.0D else ((g * 104729) % 35000) / 100.0D - 175 end",
    "is_premium": "c_acctbal > 5000",
    "status": "k % 10 <> 0",
    "status_text": "case k % 6 when 0 then 'Active' when 1 then 'TRUE' when 2 then '1' when 3 then 'closed' when 4 then '' end",
    "brands": "concat('brand_', cast(g % 13 as {string}), '_stores, Brand ', cast(k % 7 as {string}), ',brand ', cast(g % 13 as {string}), case when k % 17 = 0 then ', 88 Wayne Watches' when k % 17 = 1 then ', 12 Rue du Lac' else '' end)",
    "custom_brands": "case when k % 5 = 0 then concat('<a href=\"#\">Custom ', cast(k % 11 as {string}), '</a>') end",
    "phone": "case when k % 4 <> 0 then concat('+41 22 ', lpad(cast(k % 10000000 as {string}), 7, '0')) end",
    "email": "case k % 3 when 0 then concat(' Info', cast(k as {string}), '@Shop.example.com') when 1 then 'not an address' end",
    "website": "case k % 4 when 0 then concat('HTTP://shop', cast(g as {string}), '.example.com/store/', cast(k as {string})) when 1 then concat('www.shop', cast(g as {string}), '.example.org') when 2 then concat('https:\\\\\\\\shop', cast(g as {string}), '.example.net') end",
    "updated_at": "{date}",
}


def _columns(dialect: dict[str, str]) -> list[str]:
    return [f"{text.format(**dialect)} AS {name}" for name, text in _COLUMNS.items()]


#: Rows of a task in which texts are made and parsed.
TASK_ROWS = 1 << 14


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table, spread by rows: its files are so small that a reader would leave millions of rows to one task."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tasks = -(-rows.count() // TASK_ROWS)
    return rows.repartition(tasks) if tasks > 1 else rows


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    keyed = customers(spark, sf_dir).withColumns({"k": F.col("c_custkey"), "g": F.expr("c_custkey div 3"), "v": F.expr("c_custkey % 3")})
    return keyed.join(nations, F.expr("n_nationkey = g % 25")).selectExpr(*_columns({"string": "string", "date": "date_add(date'2024-01-01', cast(k % 30 as int))"}))


def sql() -> str:
    """The same as a common table expression ``places`` (with ``p0`` before it)."""
    columns = ", ".join(_columns({"string": "varchar", "date": "date '2024-01-01' + cast(k % 30 as integer)"})).replace("v * 0.0004D", "v * cast(0.0004 as double)").replace("/ 100.0D ", "/ cast(100 as double) ").replace("then 10.0D", "then cast(10 as double)").replace("then 20.0D", "then cast(20 as double)").replace("\\\\\\\\", "\\\\")
    return f"p0 AS (SELECT *, c_custkey AS k, c_custkey // 3 AS g, c_custkey % 3 AS v FROM customer), places AS (SELECT {columns} FROM p0 JOIN nation ON n_nationkey = g % 25)"
