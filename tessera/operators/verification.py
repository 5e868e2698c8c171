"""Coordinates verified by geocodes, once for each row and address: a ledger says what is done, and a stopped run goes on.

The ledger is a folder of Parquet files with one row for each verified place: handle, stamp (the address as it was when it
was verified), decision, coordinates and the number of the run. A place is due if the ledger has no row for its handle and
stamp, so a changed address is verified again and an unchanged one never. Places are taken in parts, by a hash of the
handle; each part is one append that Spark commits as a whole, so what a stopped run has finished isn't asked for again.
An address without a geocode isn't stamped and stays due.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..plans.work import WorkTables, written
from . import dedupe

#: Takes (stamp, query) of different addresses; gives (stamp, new_lat, new_lon) of those that it finds.
Geocode = Callable[[DataFrame], DataFrame]
LEDGER = "handle string, stamp string, decision string, lat double, lon double, run int"


def stamp() -> Column:
    return X.joined_key(F.col("line1"), F.col("city"), F.col("country"))


def read_ledger(places: DataFrame, path: str) -> DataFrame:
    """The ledger's rows; none if nothing has been written yet."""
    spark = places.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)


def due(places: DataFrame, ledger: DataFrame) -> DataFrame:
    """The places (with their stamp) that the ledger doesn't have as they are now."""
    return places.withColumn("stamp", stamp()).join(ledger.select("handle", "stamp"), ["handle", "stamp"], "left_anti")


def verify(places: DataFrame, geocode: Geocode, path: str, parts: int = 4) -> int:
    """Verify what is due, part by part, and append it to the ledger at ``path``; the run's number.

    Each address is asked for once in a part, however many places share it.
    """
    last = read_ledger(places, path).agg(F.max("run")).first()[0]
    run = (last or 0) + 1
    for part in range(parts):
        own = places.where(F.pmod(F.xxhash64("handle"), F.lit(parts)) == part)
        work = WorkTables(places.sparkSession)
        rows = work.written(due(own, read_ledger(places, path)).select("handle", "stamp", "line1", "city", "country", "lat", "lon"), "due")
        if not rows.isEmpty():
            query = X.joined_present(", ", F.col("line1"), F.col("city"), F.col("country"))
            asked = rows.groupBy("stamp").agg(F.min(query).alias("query"))
            found = rows.join(geocode(asked), "stamp", "left")
            decision = geo.correction(F.col("lat"), F.col("lon"), F.col("new_lat"), F.col("new_lon"))
            moved = {c: F.when(F.col("decision") == "replace", F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon")}
            settled = found.withColumn("decision", decision).where("decision <> 'no_geocode'")
            settled.select("handle", "stamp", "decision", *moved.values(), F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/run={run}-part={part}")
        work.drop()
    return run


def applied(places: DataFrame, ledger: DataFrame) -> DataFrame:
    """The places with the ledger's coordinates, ``decision`` and ``run`` (no_geocode and null where it has none)."""
    known = ledger.select("handle", "stamp", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "decision", "run")
    joined = places.withColumn("stamp", stamp()).join(known, ["handle", "stamp"], "left")
    return joined.withColumns({"lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon"), "decision": F.coalesce("decision", F.lit("no_geocode"))}).drop("_lat", "_lon", "stamp")


def verify_and_merge(places: DataFrame, chosen: Column, geocode: Geocode, path: str) -> tuple[DataFrame, DataFrame]:
    """The whole flow for the places that ``chosen`` says: verify, then merge them among themselves.

    Gives the table afterwards (all places) and one row of counts: updated, confirmed, without geocode, merged away, remaining.
    """
    mine = F.coalesce(chosen, F.lit(False))
    scope = places.where(mine)
    verify(scope, geocode, path)
    fresh = written(applied(scope, read_ledger(places, path)), "verified")
    plans = dedupe.merge_plans(fresh)
    after = written(dedupe.merged(fresh.select(*places.columns), plans), "merged")
    said = lambda what, name: F.count_if(F.col("decision") == what).cast("long").alias(name)
    counts = fresh.agg(said("replace", "n_updated"), said("keep", "n_confirmed"), said("no_geocode", "n_failed"), F.count(F.lit(1)).cast("long").alias("_n"))
    left = after.agg(F.count(F.lit(1)).cast("long").alias("n_remaining"))
    tally = counts.crossJoin(F.broadcast(left)).select("n_updated", "n_confirmed", "n_failed", (F.col("_n") - F.col("n_remaining")).alias("n_merged"), "n_remaining")
    return places.where(~mine).unionByName(after), tally
