"""Places that are entered by hand, one a request: JSON bodies judged, and turned into canonical rows.

Bodies are read as VARIANT in the engine, all of them in one pass without a shuffle. Defined results: a null body, or one that is
no JSON object, is refused as such; of several faults the first counts; texts of other types are empty, except for the
phone, which is taken as written; coordinates may be texts that begin with a number; a row without a handle gets one that
follows from its body, so the same body always gives the same row; other keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Canonical columns and the keys of their texts.
TEXTS = {
    "Name": "name", "Address Line 1": "addressLine1", "Address Line 2": "addressLine2", "City": "city", "State/Province/Region": "stateProvinceRegion", "Postal/ZIP Code": "postalCode",
    "Country": "country", "Email": "email", "Website": "website", "Tags": "tags", "Page Title": "pageTitle", "Page Description": "pageDescription",
}
#: The answers to refused bodies.
NO_OBJECT, NO_NUMBERS, NO_LINE = "Request body must be a JSON object", "latitude and longitude must be valid numbers", "At least one of addressLine1 or addressLine2 is required"
PENDING = "manual_pending_"


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _kind(doc: Column, key: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant")), F.lit("VOID"))


def _shown(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$.{key}", "string")


def _text(doc: Column, key: str) -> Column:
    return F.when(_kind(doc, key) == "STRING", _trim(_shown(doc, key))).otherwise("")


def _brands(doc: Column) -> Column:
    listed = F.transform(F.try_variant_get(doc, "$.brands", "array<variant>"), lambda b: _trim(F.try_variant_get(b, "$", "string")))
    return F.coalesce(F.array_join(F.filter(listed, lambda b: b != ""), ", "), _text(doc, "brands"))


def _active(doc: Column) -> Column:
    kind, shown = _kind(doc, "status"), _shown(doc, "status")
    none = kind.isin("BOOLEAN", "STRING") & (shown == "false")
    return ~F.coalesce(none | (~kind.isin("BOOLEAN", "STRING") & (shown.try_cast("double") == 0)), F.lit(False))


def judged(requests: DataFrame) -> DataFrame:
    """(request_id, body) as (request_id, problem, canonical columns as texts); the problem of a good row is null."""
    doc = F.col("doc")
    text = {column: _text(doc, key) for column, key in TEXTS.items()}
    number = {c: geo.parse_number(_shown(doc, c.lower())) for c in ("Latitude", "Longitude")}
    wanted = F.when(~F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), NO_OBJECT)
    for column in ("Name", "City", "Country"):
        wanted = wanted.when(text[column] == "", f"{column.lower()} is required")
    lost = lambda n: F.coalesce(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(True))
    wanted = wanted.when(lost(number["Latitude"]) | lost(number["Longitude"]), NO_NUMBERS)
    wanted = wanted.when((text["Address Line 1"] == "") & (text["Address Line 2"] == ""), NO_LINE)
    given = _text(doc, "handle")
    handle = F.when(given != "", given).otherwise(F.concat(F.lit(PENDING), F.substring(F.sha2("body", 256), 1, 16)))
    return requests.select("request_id", "body", F.try_parse_json("body").alias("doc")).select(
        "request_id", wanted.alias("problem"), handle.alias("Handle"), F.when(_active(doc), "true").otherwise("false").alias("Status"),
        *[c.alias(n) for n, c in text.items()], _trim(_shown(doc, "phone")).alias("Phone"), *[c.cast("string").alias(n) for n, c in number.items()], _brands(doc).alias("Brands"),
    )


def canonical(requests: DataFrame) -> DataFrame:
    """The rows of good bodies."""
    return judged(requests).where("problem IS NULL").drop("request_id", "problem")
