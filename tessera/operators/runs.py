"""Uploads, jobs and brand configurations: what is listed, where a job's rows come from, which brands a run leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the upload that isn't listed.
MASTER = "master_stores.csv"
#: Parts of URLs that are templates or viewports, and settings that make a run a long one.
TEMPLATES = ("yourbrand.com", "myshopify.com", "yourwebsite.com", "api.yourbrand", "yourstore.")
EXPANSIONS = ("worldwide_country_pagination", "geohash_prefix_expansion", "stores_by_api_countries", "pagination_fetch_urls", "force_radius_multi_point")
VIEWPORTS = ("northEastLat", "southWestLat")
#: Why a job has no rows to show.
UNFINISHED, UNLINKED, LOST = "Only completed jobs have viewable records", "No upload linked to this job", "Job CSV file not found"


def listed(uploads: DataFrame, hidden: str = MASTER) -> DataFrame:
    """Uploads but for those with the hidden file name, in any case; an upload without a name isn't listed either."""
    return uploads.where(F.lower("filename") != hidden.lower())


def of_upload(places: DataFrame, upload: str) -> DataFrame:
    """The places of one upload by name, equal names by handle."""
    return places.where(F.col("upload_id") == upload).orderBy("name", "handle")


def _set(config: Column, key: str) -> Column:
    """Has the configuration (JSON text) a value under the key that isn't false, zero or empty?"""
    value = F.get_json_object(config, f"$.{key}")
    return value.isNotNull() & ~value.isin("", "false", "0", "0.0", "[]", "{}")


def skip_reason(brand: Column, config: Column, heavy: bool = False) -> Column:
    """Why a run leaves a brand out; null if it doesn't. With ``heavy``, only what can't be run at all is left out."""
    url = F.coalesce(F.get_json_object(config, "$.url"), F.lit(""))
    holds = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(url, m))
    reason = F.when(brand.startswith("_"), "meta").when(F.get_json_object(config, "$.enabled") == "false", "enabled false").when(holds(TEMPLATES), "template url")
    if heavy:
        return reason
    reason = reason.when(F.coalesce(F.get_json_object(config, "$.type"), F.lit("")) != "json", "non-json (use --include-heavy)")
    for key in EXPANSIONS:
        reason = reason.when(_set(config, key), f"expansion {key}")
    return reason.when(holds(VIEWPORTS), "viewport url")


def job_sources(jobs: DataFrame, uploads: DataFrame, stored: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, upload_id, filename, source, problem): where each job's rows are to be read.

    A run's own file comes first, then the stored places of the upload, then any other file; ``files`` has the names of
    those that are there. ``uploads`` and ``files`` have one row for each; only keys of ``stored`` move.
    """
    has_rows = stored.select("upload_id").where("upload_id IS NOT NULL").distinct().withColumn("rows", F.lit(True))
    there = files.select("filename").distinct().withColumn("there", F.lit(True))
    known = uploads.select("upload_id", "filename", "uploaded_by", F.lit(True).alias("linked"))
    j = jobs.join(known, "upload_id", "left").join(there, "filename", "left").join(has_rows, "upload_id", "left")
    own = F.coalesce(F.col("there") & (F.col("uploaded_by") == "scraper"), F.lit(False))
    source = F.when(own, "csv").when(F.col("rows"), "db").when(F.col("there"), "csv")
    problem = F.when(~F.coalesce(F.col("status") == "completed", F.lit(False)), UNFINISHED).when(F.col("linked").isNull(), UNLINKED).when(source.isNull(), LOST)
    return j.select("job_id", "upload_id", "filename", F.when(problem.isNull(), source).alias("source"), problem.alias("problem"))


def job_rows(sources: DataFrame, stored: DataFrame, landed: DataFrame) -> DataFrame:
    """The rows of each job from its source: job_id, source and the columns that the stored and the landed rows share.

    ``stored`` has an upload_id, ``landed`` (the files' rows) a filename.
    """
    shared = [c for c in stored.columns if c in landed.columns and c not in ("upload_id", "filename")]
    of = lambda name: sources.where(F.col("source") == name).select("job_id", "source", "upload_id", "filename")
    from_table = of("db").join(stored.select("upload_id", *shared), "upload_id").select("job_id", "source", *shared)
    return from_table.unionByName(of("csv").join(landed.select("filename", *shared), "filename").select("job_id", "source", *shared))
