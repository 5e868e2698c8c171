"""Rule-based checks of canonical rows: one array of issues for each row, exploded on demand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..functions.contact import normalized_url
from ..functions.country import normalized_country

REQUIRED = ("Handle", "Name", "Status", "Address Line 1", "City", "Country", "Latitude", "Longitude")


@dataclass(frozen=True)
class Policy:
    """``import_parity``: address line 1 isn't required, but one of the lines is. ``fail_duplicates``: these are errors."""

    import_parity: bool = False
    fail_duplicates: bool = False
    large_file: int = 10_000

    def required(self) -> tuple[str, ...]:
        return tuple(c for c in REQUIRED if c != "Address Line 1") if self.import_parity else REQUIRED


def header_issues(columns: list[str], known: tuple[str, ...]) -> list[tuple[str, str]]:
    """(severity, issue) of a header: repeated and missing names are errors, unknown ones warnings."""
    names = [c.strip() for c in columns]
    out = [("error", f"duplicate:{c}") for c in sorted({c for c in names if names.count(c) > 1})]
    out += [("error", f"missing:{c}") for c in REQUIRED if c not in names]
    return out + [("warning", f"unknown:{c}") for c in names if c not in known and c not in REQUIRED]


def _issue(test: Column, severity: str, field: str, code: str | Column) -> Column:
    kind = F.lit(code) if isinstance(code, str) else code
    return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), kind.alias("issue")))


def issues(df: DataFrame, policy: Policy = Policy()) -> Column:
    """Array of (severity, field, issue). A blank coordinate gives ``empty`` twice, as a required field and as a number."""
    has = lambda c: c in df.columns
    out = [_issue(X.blank(F.col(f"`{c}`")), "error", c, "empty") for c in policy.required() if has(c)]
    if policy.import_parity:
        out.append(_issue(X.blank(F.col("`Address Line 1`")) & (X.blank(F.col("`Address Line 2`")) if has("Address Line 2") else F.lit(True)), "error", "Address Line 1", "need_address_line_1_or_2"))
    for c, limit in (("Latitude", 90.0), ("Longitude", 180.0)):
        code = geo.coordinate_error(F.col(c), limit)
        out += [_issue(code.isNotNull(), "error", c, code), _issue(code.isNull() & (geo.decimals(F.col(c)) > 7), "warning", c, "precision")]
    for c in ("Website", "Image URL"):
        if has(c):
            url = normalized_url(F.col(f"`{c}`"))
            out += [_issue(~X.blank(F.col(f"`{c}`")) & url.isNull(), "error", c, "invalid_url"), _issue(url.isNotNull() & (url != F.trim(F.col(f"`{c}`"))), "warning", c, "normalized_url")]
    out.append(_issue(~X.blank(F.col("Country")) & (normalized_country(F.col("Country")) != F.trim("Country")), "warning", "Country", "country_not_canonical"))
    for c in ("Name", "Address Line 1", "City"):
        if has(c):
            v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
            slashes = F.length(v) - F.length(F.replace(v, F.lit("\\"), F.lit("")))
            out += [_issue(slashes > 0, "warning", c, "backslash"), _issue(v.endswith("\\"), "warning", c, "trailing_backslash"), _issue(slashes > 0.3 * F.length(v), "warning", c, "many_backslashes"), _issue(v.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "warning", c, "control_characters")]
    out.append(_issue(F.trim("Name").rlike(r"^\d{4,}$"), "warning", "Name", "numeric_name"))
    return F.array_compact(F.array(*out))


def exploded(df: DataFrame, row: str, policy: Policy = Policy()) -> DataFrame:
    """(row, severity, field, issue) of every issue."""
    return df.select(F.col(row).alias("row"), F.explode(issues(df, policy)).alias("i")).select("row", "i.severity", "i.field", "i.issue")


def passes(df: DataFrame) -> DataFrame:
    """The simple check: required fields and coordinates; one row (rows, bad, valid)."""
    bad = F.exists(issues(df), lambda i: i["severity"] == "error")
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.count_if(bad).cast("long").alias("n_bad")).withColumn("valid", F.col("n_bad") == 0)


def outcome(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row: rows, errors, warnings, status (valid or invalid), and whether the file is empty or large."""
    found = issues(df, policy)
    counted = lambda kind: F.coalesce(F.sum(F.size(F.filter(found, lambda i: i["severity"] == kind))), F.lit(0)).cast("long").alias(f"n_{kind}s")
    one = df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), counted("error"), counted("warning"))
    size = F.when(F.col("n_rows") == 0, "empty_file").when(F.col("n_rows") > policy.large_file, "large_file")
    return one.withColumns({"status": F.when(F.col("n_errors") == 0, "valid").otherwise("invalid"), "file_warning": size})


def log_rows(df: DataFrame, row: str, upload: str, policy: Policy = Policy()) -> DataFrame:
    """A log row for each issue: errors with their row and field, warnings without (their row is in the message)."""
    found, error = exploded(df, row, policy), F.col("severity") == "error"
    message = F.concat_ws(": ", "field", "issue")
    return found.select(F.lit(upload).alias("upload_id"), F.when(error, F.col("row")).alias("row_number"), F.col("severity").alias("log_type"), F.when(error, F.col("field")).alias("field_name"), F.col("issue").alias("issue_type"), message.alias("message"))


def fixed(df: DataFrame) -> DataFrame:
    """Every cell cleaned, countries canonical, URLs normalised where they can be."""
    out = {}
    for c in df.columns:
        v = X.fix_cell(F.col(f"`{c}`"), address=c.startswith("Address"))
        if c == "Country":
            v = normalized_country(v)
        elif c in ("Website", "Image URL"):
            v = F.coalesce(normalized_url(v), v)
        out[c] = v
    return df.select(*[v.alias(c) for c, v in out.items()])


def split_by_coordinates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with coordinates, and the others with a reason."""
    bad = F.coalesce(geo.coordinate_error(F.col("Latitude"), 90.0), geo.coordinate_error(F.col("Longitude"), 180.0))
    return df.where(bad.isNull()), df.where(bad.isNotNull()).withColumn("reason", bad)
