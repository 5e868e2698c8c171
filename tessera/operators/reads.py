"""Filtered, searched, paged and ranked reads of the place table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import brands as B
from ..functions import geo
from ..functions.country import normalized_country


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def contains(column: Column, text: str) -> Column:
    """Case-insensitive, literal."""
    return F.coalesce(F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))


def where(df: DataFrame, *, city: str | None = None, country: str | None = None, name: str | None = None, brand: str | None = None, premium: bool | None = None, active: bool | None = None) -> DataFrame:
    """Optional filters, all of which must hold; those left out don't count."""
    tests = []
    if city is not None:
        tests.append(F.col("city") == city)
    if country is not None:
        tests.append(F.col("country") == normalized_country(F.lit(country)))
    if name:
        tests.append(contains(F.col("name"), name))
    if brand:
        shown = B.display_name(F.lit(brand))
        tests.append(F.coalesce(F.contains(F.upper("brands"), shown), F.lit(False)) | contains(F.col("brands"), brand))
    if premium is not None:
        tests.append(F.col("is_premium") == premium)
    if active is not None:
        tests.append(F.col("status") == active)
    return df.where(all_of(tests))


def search(df: DataFrame, text: str, columns: tuple[str, ...] = ("name", "line1", "city"), limit: int = 50) -> DataFrame:
    """Rows with the text in one of the columns, by name."""
    return df.where(reduce(lambda a, b: a | b, [contains(F.col(c), text) for c in columns])).orderBy("name", "handle").limit(limit)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """A page in order of name, with the number of all rows and pages. Deep pages cost more and more; see :func:`after`."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy("name", "handle").offset((number - 1) * size).limit(size)
    counts = total.select(F.col("total").cast("long").alias("total"), F.ceil(F.col("total") / size).cast("long").alias("pages"), (F.col("total") > number * size).alias("has_more"))
    return rows.join(F.broadcast(counts))


def after(df: DataFrame, key: str | None, size: int = 100) -> DataFrame:
    """The next rows by handle: a page that costs no more the deeper it lies (the key is pushed to the scan)."""
    return (df.where(F.col("handle") > key) if key is not None else df).orderBy("handle").limit(size)


def batches(df: DataFrame, size: int = 100) -> Iterator[DataFrame]:
    """All rows in order of handle, a batch at a time; only the last handle of each comes to the driver."""
    last = None
    while True:
        batch = after(df, last, size)
        last = batch.agg(F.max("handle")).first()[0]
        if last is None:
            return
        yield batch


def export_filter(parameters: dict[str, str | list[str]], with_country: bool = True) -> dict[str, Any]:
    """Arguments for :func:`where` out of request parameters: the first value of each; blank ones don't count."""
    first = {k: (v[0] if isinstance(v, list) and v else "" if isinstance(v, list) else v) for k, v in parameters.items()}
    out: dict[str, Any] = {k: first[k].strip() for k in ("brand", "country") if first.get(k, "").strip() and (k == "brand" or with_country)}
    return out | ({"premium": True} if first.get("premium", "").lower() in ("1", "true", "yes") else {})


def nearby(df: DataFrame, lat: float, lon: float, radius_miles: float) -> DataFrame:
    """Rows within the radius by rounded distance, nearest first; a bounding box comes before (pushed to the scan)."""
    south, north, west, east = geo.bounding_box(F.lit(lat), F.lit(lon), (radius_miles + 0.1) * 1609.344)
    box = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return df.where(box).withColumn("distance", geo.miles(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("distance") <= radius_miles).orderBy("distance", "handle")


def in_box(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def nearest(df: DataFrame, lat: float, lon: float, within_meters: float) -> DataFrame:
    """The nearest row within the radius; ties go by handle."""
    d = geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return df.withColumn("meters", d).where(F.col("meters") <= within_meters).orderBy("meters", "handle").limit(1)


def numbered(df: DataFrame, by: list[str], order: list[Any]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def counts(df: DataFrame) -> DataFrame:
    """Totals: rows, active, inactive, countries, cities, brands."""
    return df.agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.count_if(F.col("status")).cast("long").alias("active"),
        (F.count(F.lit(1)) - F.count_if(F.col("status"))).cast("long").alias("inactive"),
        F.countDistinct("country").cast("long").alias("countries"),
        F.countDistinct("city").cast("long").alias("cities"),
        F.countDistinct("brands").cast("long").alias("brand_lists"),
    )


def top(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).cast("long").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def distinct_brands(df: DataFrame) -> DataFrame:
    """Display names over both brand columns, sorted."""
    names = F.explode(F.array_union(B.display_names(F.col("brands")), B.display_names(F.array_join(B.custom_names(F.col("custom_brands")), ","))))
    return df.select(names.alias("brand")).distinct().orderBy("brand")


def distinct_countries(df: DataFrame) -> DataFrame:
    return df.select("country").distinct().select(normalized_country(F.col("country")).alias("country")).where("country <> ''").distinct().orderBy("country")


def autocomplete(df: DataFrame, text: str, n: int = 8) -> DataFrame:
    return search(df, text, ("name", "line1"), n)


def missing_data(df: DataFrame) -> DataFrame:
    """Places without a phone or an address, with the number of them and of all."""
    lacks = (F.coalesce(F.trim("phone"), F.lit("")) == "") | (F.coalesce(F.trim("line1"), F.lit("")) == "")
    return df.agg(F.count(F.lit(1)).cast("long").alias("total"), F.count_if(lacks).cast("long").alias("incomplete"))


def logs(df: DataFrame, upload: str, kind: str | None = None) -> DataFrame:
    """Log rows of an upload by row number (rows without one last), then time."""
    out = df.where(F.col("upload_id") == upload)
    return (out.where(F.col("log_type") == kind) if kind else out).orderBy(F.asc_nulls_last("row_number"), "created_at")


def run_stats(df: DataFrame, status: str, states: tuple[str, ...], rows: str) -> DataFrame:
    """Runs by state and all their rows."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("total"), *[F.count_if(F.col(status) == s).cast("long").alias(s) for s in states], F.coalesce(F.sum(rows), F.lit(0)).cast("long").alias("rows"))


def by_locale(df: DataFrame, column: str) -> DataFrame:
    """Sorted by the language-neutral, case-insensitive collation."""
    return df.orderBy(F.collate(F.col(column), "UNICODE_CI"), column)


def suggestions(df: DataFrame, text: str, chosen: list[str], n: int = 10) -> DataFrame:
    """Brands that hold the text and aren't chosen yet, in order; case doesn't count."""
    known = [c.strip().upper() for c in chosen]
    names = distinct_brands(df)
    return names.where(contains(F.col("brand"), text) & ~F.col("brand").isin(*known)).orderBy("brand").limit(n)
