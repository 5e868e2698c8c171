"""Reports of repeated values, countries, completeness and value changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.country import normalized_country, recognized
from .joins import first_of


def repeated(df: DataFrame, keys: dict[str, Column], where: Column | None = None, limit: int | None = 40, samples: Column | None = None, shown: int = 80) -> DataFrame:
    """Groups of more than one row, largest first: keys, number, the first ``shown`` handles in order (and samples).

    Numbers come first, by partial aggregates; handles (and the first ``shown`` distinct samples) are listed only for the
    groups in the report. :func:`memberships` gives all rows of all groups, one for each.
    """
    rows = df.select("handle", *[c.alias(n) for n, c in keys.items()], *([samples.alias("_s")] if samples is not None else []))
    rows = rows.where(where) if where is not None else rows
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n")).where("n > 1")
    found = found.orderBy(F.desc("n"), *keys).limit(limit) if limit else found

    def listed(column: str, sep: str, name: str) -> DataFrame:
        each = rows.alias("l").join(found.alias("r"), _same(keys, "l", "r"), "left_semi")
        first = each.select(*keys, column).distinct() if column == "_s" else each.select(*keys, column)
        return first_of(first, list(keys), [column], shown).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(column)), sep).alias(name))

    out = found.alias("l").join(listed("handle", ",", "handles").alias("r"), _same(keys, "l", "r")).select("l.*", "r.handles")
    if samples is not None:
        out = out.alias("l").join(listed("_s", " | ", "samples").alias("r"), _same(keys, "l", "r")).select("l.*", "r.samples")
    return out.orderBy(F.desc("n"), *keys) if limit else out


def _same(keys: dict[str, Column], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def memberships(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(keys, n, first, handle): every row of every group of more than one row, with the group's number and least handle."""
    rows = df.select("handle", *[c.alias(n) for n, c in keys.items()])
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"), F.min("handle").alias("first")).where("n > 1")
    return rows.alias("l").join(found.alias("r"), _same(keys, "l", "r")).select(*[F.col(f"l.{k}") for k in keys], "r.n", "r.first", "l.handle")


def country_audit(df: DataFrame) -> DataFrame:
    """Countries by verdict: canonical, needs_normalizing, blank, unrecognized."""
    grouped = df.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    norm = normalized_country(F.col("country"))
    verdict = F.when(X.blank(F.col("country")), "blank").when(~recognized(F.col("country")), "unrecognized").when(norm != F.col("country"), "needs_normalizing").otherwise("canonical")
    return grouped.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).cast("long").alias("n_values"), F.sum("n").cast("long").alias("n_rows"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each field: filled rows and their percentage to one place (half even)."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~X.blank(F.col(f).cast("string"))).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields]))
    return one.select("total", pairs.alias("p")).select("p.field", F.col("p.filled").cast("long").alias("filled"), F.bround(100.0 * F.col("p.filled") / F.greatest(F.lit(1), F.col("total")), 1).alias("percent"))


def quality_counts(df: DataFrame) -> DataFrame:
    """Rows without a name, coordinates, address or phone; only what occurs."""
    tests = {"no_name": X.blank(F.col("name")), "no_coordinates": F.col("lat").isNull() | F.col("lon").isNull(), "no_address": X.blank(F.col("line1")), "no_phone": X.blank(F.col("phone"))}
    one = df.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).cast("long").alias("n")) for n in tests]))
    return one.select(pairs.alias("p")).select("p.issue", "p.n").where("n > 0")


def grouped_issues(issues: DataFrame, keep: int = 20) -> DataFrame:
    """Issues by type: number, the first ``keep`` in order of row, and how many more there are."""
    totals = issues.groupBy("issue").agg(F.count(F.lit(1)).cast("long").alias("n"))
    shown = first_of(issues, ["issue"], ["row", "field"], keep).groupBy("issue").agg(F.sort_array(F.collect_list(F.struct("row", "field"))).alias("first"))
    out = totals.join(shown, "issue")
    return out.select("issue", "n", F.array_join(F.transform("first", lambda x: F.concat_ws(":", x["row"].cast("string"), x["field"])), ",").alias("examples"), F.greatest(F.lit(0).cast("long"), F.col("n") - keep).alias("more"))


def value_changes(before: Column, after: Column, df: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent changes of a value."""
    pairs = df.select(before.alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    return pairs.groupBy("before", "after").agg(F.count(F.lit(1)).cast("long").alias("n")).orderBy(F.desc("n"), "before", "after").limit(top)


def by_file_with_total(df: DataFrame, file_col: str, counts: dict[str, Column]) -> DataFrame:
    """Counts for each file and for all of them (``file`` is null)."""
    return df.rollup(F.col(file_col).alias("file")).agg(*[F.count_if(c).cast("long").alias(n) for n, c in counts.items()])
