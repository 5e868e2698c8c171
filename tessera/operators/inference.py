"""What do landed records hold? Paths, how often they are filled, what their values look like, and a mapping to known fields."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records
from ..functions.contact import email_like, phone_like
from ..functions.records import flattened

#: Words in the last part of a path that name a field, best first; required fields count double.
ALIASES = {
    "Name": ("name", "storename", "title", "label"), "Latitude": ("latitude", "lat"), "Longitude": ("longitude", "lng", "lon"),
    "Address Line 1": ("address1", "addressline1", "streetaddress", "street", "address"), "City": ("city", "town", "locality"), "Country": ("country", "countrycode"),
    "Postal/ZIP Code": ("postalcode", "zip", "postcode"), "Phone": ("phone", "telephone", "tel"), "Email": ("email", "mail"), "Website": ("website", "url", "link"),
}
REQUIRED = ("Name", "Latitude", "Longitude")


def paths(rows: DataFrame, column: str = "record") -> DataFrame:
    """(path, n, share, numeric, phones, emails): of each path, in how many records it is filled, and what its values look like.

    Records are counted in the same pass: they are costly to make, and a count apart would make all of them once more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            found: list[tuple[str, str]] = []
            for text in batch.column(0).to_pylist():
                try:
                    data: Any = json.loads(text or "null")
                except ValueError:
                    continue
                found += [(k, str(v)) for k, v in flattened(data).items() if k and v not in (None, "", [], {})]
            paths, values = [None, *[k for k, _ in found]], [str(batch.num_rows), *[v for _, v in found]]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], ["path", "value"])

    cells = rows.select(column).mapInArrow(run, "path string, value string")  # without a path: the records of a batch
    number = F.col("value").try_cast("double")
    g = cells.groupBy("path").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.count_if(number.isNotNull()).alias("numbers"), F.min(number).alias("least"), F.max(number).alias("most"),
        F.count_if(phone_like(F.col("value"))).alias("phones"), F.count_if(email_like(F.col("value"))).alias("emails"), F.sum(F.when(F.col("path").isNull(), F.col("value").try_cast("long"))).alias("_records"),
    )
    total = F.max("_records").over(Window.partitionBy(F.lit(0)))  # one row a path, of which there are few
    found = g.withColumn("_total", total).where("path IS NOT NULL")
    return found.withColumn("share", F.round(F.col("n") / F.greatest(F.lit(1), F.col("_total")), 3)).drop("_total", "_records")


#: Keys under which an answer keeps its records; keys of opening hours.
DATA_KEYS = ("data", "results", "items", "stores", "locations", "retailers", "dealers", "shops", "establishments", "places", "markers")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
HOUR_LISTS = ("hours", "hoursDetails", "hoursTranslatedDetails", "openingHours", "businessHours")
HOUR_TEXTS = ("hours", "opening_hours", "business_hours", "hours_of_operation")


def name_similarity(field: Column, key: Column) -> Column:
    """1 for equal letters and digits, 0.9 where all words of one are words of the other, else the share of common words,
    else 0.7 where one holds the other."""
    a, b = F.regexp_replace(F.lower(field), "[ /-]", ""), F.regexp_replace(F.lower(key), "[_.-]", "")
    x, y = (F.array_distinct(F.regexp_extract_all(t, F.lit("([a-z]+)"), 1)) for t in (a, b))
    both = F.size(F.array_intersect(x, y))
    return (
        F.when(a == b, 1.0)
        .when((both == F.size(x)) | (both == F.size(y)), 0.9)
        .when(both > 0, both / F.size(F.array_union(x, y)))
        .when(F.contains(a, b) | F.contains(b, a), 0.7)
        .otherwise(0.0)
    )


def _is_list(value: Column) -> Column:
    return F.coalesce(F.ltrim(value).startswith("["), F.lit(False))


def structure(doc: Column) -> Column:
    """flat_array, geojson, nested_array (a list under a usual key, here or one level down) or unknown."""
    one = lambda at: F.exists(F.array(*[_is_list(records.of_key(at, F.lit(k))) for k in DATA_KEYS]), lambda x: x)
    deeper = F.exists(F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>")), lambda k: one(records.of_key(doc, k)))
    known = F.try_parse_json(doc).isNotNull()
    geo = (records.value(doc, "type") == "FeatureCollection") & records.value(doc, "features").isNotNull()
    return F.when(known & _is_list(doc), "flat_array").when(geo, "geojson").when(known & (one(doc) | deeper), "nested_array").otherwise("unknown")


def _sample(doc: Column) -> Column:
    return F.when(_is_list(doc), F.get_json_object(doc, "$[0]")).otherwise(doc)


def coordinate_format(doc: Column) -> Column:
    """How a record, or the first of a list, holds its coordinates."""
    keys = F.coalesce(F.json_object_keys(_sample(doc)), F.array().cast("array<string>"))
    has = lambda *names: F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == len(names)
    nested = F.coalesce(F.ltrim(F.get_json_object(_sample(doc), "$.location")).startswith("{"), F.lit(False))
    return F.when(has("lat", "lng"), "lat_lng").when(has("latitude", "longitude"), "latitude_longitude").when(has("geoLat", "geoLng"), "geo_lat_lng").when(has("coordinates"), "coordinates_array").when(nested, "nested_location").otherwise("unknown")


def hours_format(doc: Column) -> Column:
    """day_keys (five days or more), hours_array, hours_string or unknown."""
    keys = F.transform(F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>")), lambda k: F.lower(k))
    days = F.size(F.array_intersect(keys, F.array(*map(F.lit, DAYS))))
    listed = F.exists(F.array(*[_is_list(records.of_key(doc, F.lit(k))) for k in HOUR_LISTS]), lambda x: x)
    text = F.exists(F.array(*[F.coalesce(~records.of_key(doc, F.lit(k)).rlike(r"^\s*[\[{]"), F.lit(False)) for k in HOUR_TEXTS]), lambda x: x)
    return F.when(days >= 5, "day_keys").when(listed, "hours_array").when(text, "hours_string").otherwise("unknown")


def _score(field: str) -> Column:
    leaf = F.lower(F.regexp_replace(F.element_at(F.split("path", "\\."), -1), "[^A-Za-z0-9]", ""))
    score = F.lit(0.0)
    for k, word in enumerate(ALIASES[field]):
        exact = 10.0 - 0.1 * k
        score = F.greatest(score, F.when(leaf == word, exact).when(F.contains(leaf, F.lit(word)), 5.0 - 0.1 * k).otherwise(0.0))
    if field in ("Latitude", "Longitude"):
        limit = 90.0 if field == "Latitude" else 180.0
        score = F.when((F.col("numbers") == F.col("n")) & (F.col("least") >= -limit) & (F.col("most") <= limit), score).otherwise(0.0)
    return F.when(F.col("share") >= (1.0 if field in REQUIRED else 0.3), score).otherwise(0.0)


def mapping(found: DataFrame) -> DataFrame:
    """(field, path, score): the best path of each field; shorter paths win ties."""
    scored = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _score(f).alias("score")) for f in ALIASES]))
    best = found.select("path", scored.alias("s")).select("path", "s.field", "s.score").where("score > 0")
    return best.groupBy("field").agg(F.max_by(F.struct("path", "score"), F.struct("score", -F.length("path"), "path")).alias("b")).select("field", "b.path", "b.score")


def confidence(chosen: DataFrame) -> DataFrame:
    """Percentage of fields found (required ones count double) and its level."""
    weight = F.when(F.col("field").isin(*REQUIRED), 2.0).otherwise(1.0)
    top = float(2 * len(REQUIRED) + len(ALIASES) - len(REQUIRED))
    percent = F.round(100 * F.coalesce(F.sum(weight), F.lit(0.0)) / top, 1)
    return chosen.agg(percent.alias("percent")).withColumn("level", F.when(F.col("percent") >= 80, "high").when(F.col("percent") >= 60, "medium").otherwise("low"))
