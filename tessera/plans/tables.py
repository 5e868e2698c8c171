"""Registered queries over the place table: reads, audits, validation, imports, fills, files, pages, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, html, records
from ..functions import text as X
from ..functions.country import normalized_country
from ..functions.generate import focused_grid, prefixes, viewport_url
from ..operators import audits, dedupe, inference, joins, reads, runs, upsert, validation
from ..sources import fanout, files, manual, sinks
from .places import places
from .queries import COUNTRY, KEYED, MERGES, _meters, query, table
from .work import new_path, written



def _k() -> Column:
    """The number in a place's handle."""
    return F.expr("cast(substring(handle, 2) as int)")


PK = "pk0 AS (SELECT *, substr(handle, 2) :: INT AS k FROM places)"


# Reads


@query("SELECT handle, name FROM places WHERE contains(lower(name), 'nr1 ')")
def loc_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.where(places(spark, sf_dir), name="NR1 ").select("handle", "name")


@query("SELECT handle FROM places WHERE country = 'FRANCE'")
def loc_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = places(spark, sf_dir).withColumn("country", normalized_country(F.col("country")))
    return reads.where(upper, country="fr").select("handle")


@query("SELECT handle, name FROM places WHERE contains(lower(name), 'nr2') OR contains(lower(line1), 'nr2') ORDER BY name, handle LIMIT 8")
def loc_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.autocomplete(places(spark, sf_dir), "Nr2").select("handle", "name")


@query("SELECT count(*) :: BIGINT AS total, count(*) FILTER (coalesce(trim(phone), '') = '' OR coalesce(trim(line1), '') = '') :: BIGINT AS incomplete FROM places")
def loc_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.missing_data(places(spark, sf_dir))


@query("SELECT DISTINCT name FROM places WHERE is_premium AND trim(name) <> ''")
def loc_premium_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.where(places(spark, sf_dir), premium=True).where(~X.blank(F.col("name"))).select("name").distinct()


@query("SELECT handle, name FROM places WHERE handle > 'c000000050' ORDER BY handle LIMIT 40")
def loc_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.after(places(spark, sf_dir), "c000000050", 40).select("handle", "name")


@query("SELECT handle FROM places WHERE is_premium AND (contains(upper(brands), 'BRAND 3') OR contains(lower(brands), 'brand_3_stores'))")
def loc_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.where(places(spark, sf_dir), **reads.export_filter({"brand": ["brand_3_stores", "x"], "premium": "Yes", "country": " "})).select("handle")


@query("SELECT name, handle FROM (SELECT name, handle, row_number() OVER (ORDER BY lower(name), name, handle) AS n FROM places)")
def loc_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.by_locale(places(spark, sf_dir).select("name", "handle"), "name")


@query("SELECT brands AS value, count(*) :: BIGINT AS n FROM places WHERE trim(brands) <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 15")
def loc_repeated_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.top(places(spark, sf_dir).where(~X.blank(F.col("brands"))), "brands", 15).where("n > 1")


@query("SELECT count(*) :: BIGINT AS total, count(*) FILTER (o_orderstatus = 'F') :: BIGINT AS \"F\", count(*) FILTER (o_orderstatus = 'O') :: BIGINT AS \"O\", count(*) FILTER (o_orderstatus = 'P') :: BIGINT AS \"P\", sum(o_custkey) :: BIGINT AS rows FROM orders", False)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.run_stats(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "P"), "o_custkey")


@query(f", {PK} SELECT k AS row_number, 'e' || k AS message FROM pk0 WHERE k % 3 = 1 AND k % 2 = 0 ORDER BY row_number")
def log_rows_of_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = places(spark, sf_dir).select(F.concat(F.lit("u"), (_k() % 3).cast("string")).alias("upload_id"), F.when(_k() % 2 == 0, "error").otherwise("warning").alias("log_type"), _k().alias("row_number"), F.concat(F.lit("e"), _k().cast("string")).alias("message"), F.lit(0).alias("created_at"))
    return reads.logs(rows, "u1", "error").select("row_number", "message")


# Audits


@query(f", {KEYED} SELECT k_line AS addr, city, coalesce(country, '') AS land, count(*) :: BIGINT AS n, array_to_string(list_slice(list_sort(list(handle)), 1, 80), ',') AS handles FROM pk WHERE length(k_line) > 3 GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"addr": X.alnum(F.col("line1")), "city": F.col("city"), "land": F.coalesce("country", F.lit(""))}
    return audits.repeated(places(spark, sf_dir), keys, F.length("addr") > 3, None)


def _issues(p: DataFrame) -> DataFrame:
    kind = F.when(_k() % 3 == 0, "empty").when(_k() % 3 == 1, "out_of_range").otherwise("precision")
    return p.select(_k().alias("row"), F.concat(F.lit("f"), (_k() % 2).cast("string")).alias("field"), kind.alias("issue"))


@query(f", {PK}, i AS (SELECT k AS row, 'f' || k % 2 AS field, CASE k % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'out_of_range' ELSE 'precision' END AS issue FROM pk0) SELECT issue, count(*) :: BIGINT AS n, string_agg(row || ':' || field, ',' ORDER BY row, field) FILTER (r <= 20) AS examples, greatest(0, count(*) - 20) :: BIGINT AS more FROM (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY row, field) AS r FROM i) GROUP BY issue")
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.grouped_issues(_issues(places(spark, sf_dir)))


@query(f", {PK}, i AS (SELECT 'file' || k % 4 AS file, k % 3 = 0 AS empty FROM pk0) SELECT file, count(*) FILTER (empty) :: BIGINT AS n_empty, count(*) FILTER (NOT empty) :: BIGINT AS n_other FROM i GROUP BY ROLLUP (file)")
def totals_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _issues(places(spark, sf_dir)).withColumn("file", F.concat(F.lit("file"), (F.col("row") % 4).cast("string")))
    return audits.by_file_with_total(i, "file", {"n_empty": F.col("issue") == "empty", "n_other": F.col("issue") != "empty"})


@query("SELECT k0, n, first FROM (SELECT trim(city) AS k0, count(*) :: BIGINT AS n, min(handle) AS first FROM places GROUP BY 1 HAVING count(*) > 1)")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicates(places(spark, sf_dir), [F.col("city")], F.col("handle")).select("k0", "n", F.col("rows")[0].alias("first"))


@query("SELECT arg_min(handle, (lat, handle)) AS handle FROM places GROUP BY round(lat, 5), round(lon, 5), coalesce(lower(country), '')")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    key = dedupe.record_key(F.col("lat"), F.col("lon"), F.col("country"), F.col("line1"), F.col("city"), F.col("handle"))
    rows = p.select("handle", "lat", key.alias("key"))  # a first row is taken whole, so with these columns alone
    return dedupe.keep_first(rows, [F.col("key")], [F.col("lat"), F.col("handle")]).select("handle")


@query(f", {KEYED}, seeds AS (SELECT * FROM pk WHERE is_premium AND k % 10 = 0), near AS (SELECT q.* FROM seeds p JOIN pk q ON p.city = q.city AND p.k_country = q.k_country WHERE abs(p.lat - q.lat) <= 500 / 111320.0 :: DOUBLE AND abs(p.lon - q.lon) <= 500 / (111320.0 :: DOUBLE * greatest(0.01, cos(radians(p.lat))))), found AS (SELECT * FROM seeds UNION SELECT * FROM near) SELECT DISTINCT handle FROM (SELECT handle FROM found UNION ALL SELECT q.handle FROM found p JOIN pk q ON p.k_addr = q.k_addr AND p.city = q.city AND p.k_country = q.k_country)")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return dedupe.expanded(p, p.where(F.col("is_premium") & (_k() % 10 == 0)))


@query(f", {MERGES} SELECT handle, plan, pass FROM plans")
def scoped_merge_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    return dedupe.scoped_merge_plans(p, p.select("handle"))


# Validation and imports


def _canonical(p: DataFrame) -> DataFrame:
    """Canonical rows of which some lack a name or coordinates, some say so in another way."""
    out = upsert.to_canonical(p.withColumn("country", F.col("country_raw")))
    k = F.expr("cast(substring(Handle, 2) as int)")
    return out.withColumns({"Name": F.when(k % 11 == 0, "").otherwise(F.col("Name")), "Latitude": F.when(k % 13 == 0, "x").when(k % 13 == 1, F.concat(F.lit("12."), k.cast("string"), F.lit("abc"))).otherwise(F.lit("10.5")), "Longitude": F.lit("20.25"), "State/Province/Region": F.when(k % 2 == 0, F.upper("City")).otherwise("North"), "Priority": F.concat((k % 9).cast("string"), F.lit(" high")), " Tags": F.lit("vip, hublot_stores")})


@query(f", {PK} SELECT handle, trim(name) AS name, status, city, CASE WHEN k % 2 = 1 THEN 'North' END AS state, {COUNTRY} AS country, CASE WHEN k % 13 = 1 THEN ('12.' || k) :: DOUBLE ELSE 10.5 :: DOUBLE END AS lat, 20.25 :: DOUBLE AS lon, k % 9 AS priority, 'vip, HUBLOT' AS tags, false AS is_premium FROM pk0 WHERE k % 11 <> 0 AND k % 13 <> 0")
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.from_canonical(_canonical(places(spark, sf_dir))).select("handle", "name", "status", "city", "state", "country", "lat", "lon", "priority", "tags", "is_premium")


@query(f", {PK} SELECT change, count(*) :: BIGINT AS n FROM (SELECT CASE WHEN k % 4 = 0 THEN 'created' ELSE 'updated' END AS change FROM pk0 WHERE k % 11 <> 0 AND k % 13 <> 0) GROUP BY 1")
def import_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows are parsed, matched with three quarters of the table, classified and counted (their countries differ)."""
    p = places(spark, sf_dir)
    incoming = upsert.from_canonical(_canonical(p)).withColumn("city", F.concat("city", F.lit(" New")))
    return upsert.batch_summary(upsert.classified(p.where(_k() % 4 != 0), incoming))


@query(f", {PK} SELECT count(*) :: BIGINT AS n_rows, sum((k % 11 = 0) :: INT + (k % 13 < 2) :: INT + (trim(country_raw) = '') :: INT) :: BIGINT AS n_errors, CASE WHEN count(*) > 10000 THEN 'large_file' END AS file_warning, 'invalid' AS status FROM pk0")
def validation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.outcome(_plain(places(spark, sf_dir))).select("n_rows", "n_errors", "file_warning", "status")


def _plain(p: DataFrame) -> DataFrame:
    return _canonical(p).drop("Website", "Phone", "Email", "Brands")


@query(f", {PK}, i AS (SELECT k AS row, 'Name' AS field, 'empty' AS issue FROM pk0 WHERE k % 11 = 0 UNION ALL SELECT k, 'Latitude', 'not_a_number' FROM pk0 WHERE k % 13 < 2 UNION ALL SELECT k, 'Country', 'empty' FROM pk0 WHERE trim(country_raw) = '') SELECT 'u1' AS upload_id, 'c' || lpad(row :: VARCHAR, 9, '0') AS row_number, 'error' AS log_type, field AS field_name, issue AS issue_type, field || ': ' || issue AS message FROM i")
def validation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.log_rows(_plain(places(spark, sf_dir)), "Handle", "u1").where("log_type = 'error'")


@query(f", {PK} SELECT count(*) :: BIGINT AS n_rows, count(*) FILTER (k % 11 = 0 OR k % 13 < 2 OR trim(country_raw) = '') :: BIGINT AS n_bad, false AS valid FROM pk0")
def validation_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.passes(_plain(places(spark, sf_dir)))


@query(f", {PK} SELECT handle AS \"Handle\", CASE WHEN k % 11 = 0 THEN '' ELSE trim(name) END AS \"Name\", {COUNTRY} AS \"Country\" FROM pk0")
def validation_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.fixed(_plain(places(spark, sf_dir))).select("Handle", "Name", "Country")


@query(f", {PK} SELECT reason, count(*) :: BIGINT AS n FROM (SELECT CASE WHEN k % 13 = 0 THEN 'not_a_number' WHEN k % 13 = 1 THEN 'not_a_number' END AS reason FROM pk0) WHERE reason IS NOT NULL GROUP BY 1")
def validation_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.split_by_coordinates(_canonical(places(spark, sf_dir)))[1].groupBy("reason").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query(f", {PK} SELECT count(*) FILTER (k % 5 = 0) :: BIGINT AS n FROM pk0")
def validation_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plain(places(spark, sf_dir)).withColumns({"Address Line 1": F.when(F.expr("cast(substring(Handle, 2) as int) % 5 = 0"), "").otherwise(F.col("`Address Line 1`")), "Address Line 2": F.lit(" ")})
    found = validation.exploded(rows, "Handle", validation.Policy(import_parity=True))
    return found.where("issue = 'need_address_line_1_or_2'").agg(F.count(F.lit(1)).cast("long").alias("n"))


# Mutations


@query(f", {PK}, u AS (SELECT CASE WHEN k % 2 = 0 THEN handle ELSE 'z' || handle END AS handle, CASE WHEN k % 2 = 0 THEN 0 ELSE lat + 0.0003 :: DOUBLE END AS lat, lon FROM pk0), near AS (SELECT u.handle, p.handle AS match, {_meters('u', 'p')} AS m FROM u JOIN places p ON abs(p.lat - u.lat) <= 0.00045 AND abs(p.lon - u.lon) <= 0.00045 / cos(radians(u.lat)) WHERE u.handle LIKE 'z%') SELECT handle, handle AS match FROM u WHERE handle NOT LIKE 'z%' UNION ALL SELECT handle, arg_min(match, (m, match)) FROM near GROUP BY handle")
def patch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    u = p.select(F.when(_k() % 2 == 0, F.col("handle")).otherwise(F.concat(F.lit("z"), "handle")).alias("handle"), F.when(_k() % 2 == 0, 0.0).otherwise(F.col("lat") + 0.0003).alias("lat"), "lon")
    return upsert.matched(u, p)


@query(f", {PK} SELECT handle, CASE WHEN k % 3 = 0 THEN 'New ' || k ELSE name END AS name, city FROM pk0")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    patches = p.where(_k() % 3 == 0).select("handle", F.concat(F.lit("New "), _k().cast("string")).alias("name"), F.lit("no").alias("city"))
    return upsert.patched(p.select("handle", "name", "city"), patches, ("name", "phone"))


@query(f", {PK} SELECT handle, CASE WHEN k % 7 = 0 THEN '+41 99' ELSE phone END AS phone FROM pk0 UNION ALL SELECT 'n' || handle, '+41 99' FROM pk0 WHERE k % 7 = 1")
def upsert_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    rows = p.where((_k() % 7 == 0) | (_k() % 7 == 1)).select(F.when(_k() % 7 == 1, F.concat(F.lit("n"), "handle")).otherwise(F.col("handle")).alias("handle"), "name", "brands", F.lit("+41 99").alias("phone"))
    return upsert.upserted(p, rows, manual=True).select("handle", "phone")


@query(f", {PK} SELECT handle FROM pk0 UNION ALL SELECT 'i' || handle FROM pk0 WHERE k % 9 = 0")
def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).select("handle", "name")
    rows = p.select(F.when(_k() % 9 == 0, F.concat(F.lit("i"), "handle")).otherwise(F.col("handle")).alias("handle"), "name")
    return upsert.inserted(p, rows.unionByName(rows), F.col("name")).select("handle")


@query(f", {PK}, d AS (SELECT handle, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN lat + 0.0001 ELSE lat + 1 END AS new_lat, lon FROM pk0) SELECT p.handle, CASE WHEN new_lat IS NULL OR new_lat NOT BETWEEN -90 AND 90 THEN 'no_geocode' WHEN k % 4 = 1 THEN 'keep' ELSE 'replace' END AS decision, round(CASE WHEN k % 4 > 1 AND new_lat BETWEEN -90 AND 90 THEN new_lat ELSE lat END, 6) AS lat FROM pk0 p JOIN d USING (handle)")
def coordinates_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    codes = p.select("handle", F.when(_k() % 4 == 0, None).when(_k() % 4 == 1, F.col("lat") + 0.0001).otherwise(F.col("lat") + 1).alias("new_lat"), F.col("lon").alias("new_lon"))
    return upsert.verified(p, codes).select("handle", "decision", F.round("lat", 6).alias("lat"))


@query(f", {PK} SELECT handle, CASE WHEN coalesce(trim(phone), '') = '' AND k % 3 = 0 THEN '+00' ELSE trim(phone) END AS phone FROM pk0")
def details_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).select("handle", "phone")
    return joins.filled(p, p.where(_k() % 3 == 0).select("handle", F.lit("+00").alias("phone")), ("phone",))


@query(f", {PK} SELECT handle FROM pk0 WHERE k % 5 <> 0")
def deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).select("handle")
    return upsert.deleted(p, p.where(_k() % 5 == 0))


@query("SELECT arg_min(handle, (NOT is_premium, -epoch(updated_at), handle)) AS handle FROM places GROUP BY trim(regexp_replace(lower(line1), '[^\\p{L}\\p{N}]+', ' ', 'g')), lower(city), coalesce(lower(country), ''), printf('%.5f', lat), printf('%.5f', lon)")
def cleaned_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.cleaned(places(spark, sf_dir)).select("handle")


@query("SELECT round((lat + 0.005) * 100) :: BIGINT AS row, count(*) :: BIGINT AS n FROM places WHERE lat BETWEEN 9 AND 11 GROUP BY 1")
def rounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    south, north, _, _ = geo.bounding_box(F.lit(10.0), F.lit(20.0), geo.METERS_PER_DEGREE)
    return places(spark, sf_dir).where(F.col("lat").between(south, north)).groupBy(F.round((F.col("lat") + 0.005) * 100).cast("long").alias("row")).agg(F.count(F.lit(1)).cast("long").alias("n"))


# Files, pages, inference


@query("SELECT handle, name, line1, n_rows FROM places, (SELECT count(*) :: BIGINT AS n_rows FROM places)")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as canonical CSV, its lines counted, read again by header."""
    path = new_path(spark, "csv")
    sinks.write_csv(places(spark, sf_dir).select("handle", "name", "line1"), path)
    total = files.line_count(spark, path).agg(F.sum("n_rows").cast("long").alias("n_rows"))
    return files.csv_rows(spark, path).join(F.broadcast(total))


def _mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of CSV files with three headers: columns in another order, missing, additional and repeated."""
    p, path = places(spark, sf_dir), new_path(spark, "mixed")
    heads = ([("Handle", "handle"), ("Name", "name"), ("City", "city")], [("Name", "name"), (" Handle ", "handle"), ("Extra", "line1")], [("City", "country"), ("Handle", "handle"), ("City", "city")])
    for k, head in enumerate(heads):
        rows = p.where(_k() % 3 == k)
        line = F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit("")), F.lit('"')) for _, c in head])
        with_head = rows.select(F.lit(1).alias("n"), line.alias("value")).unionByName(spark.createDataFrame([(0, ",".join(n for n, _ in head))], "n int, value string"))
        with_head.repartition(1).sortWithinPartitions("n").select("value").write.option("lineSep", "\n").text(f"{path}/part{k}")
    folder = new_path(spark, "folder")
    for k in range(len(heads)):
        spark.read.text(f"{path}/part{k}").coalesce(1).write.mode("append").option("lineSep", "\n").text(folder)
    return folder


@query(f", {PK} SELECT handle, CASE WHEN k % 3 < 2 THEN name END AS name, CASE WHEN k % 3 <> 1 THEN city END AS city, CASE WHEN k % 3 = 1 THEN line1 END AS extra FROM pk0")
def csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one folder, each read by its own header."""
    return files.csv_directory(spark, _mixed_files(spark, sf_dir), "*.txt").select("Handle", "Name", "City", "Extra").toDF("handle", "name", "city", "extra")


@query(f", {PK}, f AS (SELECT k % 3 AS part, count(*) :: BIGINT AS n FROM pk0 GROUP BY 1), i AS (SELECT * FROM (VALUES (0, 'error', 'missing:Status'), (0, 'error', 'missing:Country'), (1, 'error', 'missing:Status'), (1, 'error', 'missing:City'), (1, 'error', 'missing:Country'), (1, 'warning', 'unknown:Extra'), (2, 'error', 'duplicate:City'), (2, 'error', 'missing:Name'), (2, 'error', 'missing:Status'), (2, 'error', 'missing:Country')) t(part, severity, issue)) SELECT severity, issue, sum(n) :: BIGINT AS n_rows FROM i JOIN f USING (part) GROUP BY ALL")
def csv_header_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of headers, with how many rows stand in files that have them."""
    folder = _mixed_files(spark, sf_dir)
    rows = files.csv_directory(spark, folder, "*.txt").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    found = files.header_faults(spark, folder, ("Handle", "Name", "City"), "*.txt").where("issue NOT LIKE '%Address%' AND issue NOT LIKE '%itude'")
    return found.join(rows, "file").groupBy("severity", "issue").agg(F.sum("n").cast("long").alias("n_rows"))


@query("SELECT row_number() OVER (ORDER BY handle) + 1 AS row, handle FROM places")
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.numbered_rows(written(places(spark, sf_dir).select("handle").orderBy("handle"), "rows").orderBy("handle")).select(F.col("row").cast("long").alias("row"), "handle")


def _records(p: DataFrame) -> DataFrame:
    """Answers in JSONP, each with a list of two records, one of which all answers of a city share."""
    one = F.struct(F.col("handle").alias("id"), F.col("name").alias("storeName"), F.col("city").alias("town"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("geo"))
    shared = F.struct(F.col("city").alias("id"), F.lit("Head Office").alias("storeName"), F.col("city").alias("town"), F.struct(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude")).alias("geo"))
    return p.select(F.concat(F.lit("cb("), F.to_json(F.struct(F.struct(F.array(one, shared).alias("stores")).alias("data"))), F.lit(");")).alias("raw"))


@query("SELECT handle AS id, name FROM places UNION ALL SELECT DISTINCT city, 'Head Office' FROM places")
def answers_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _records(places(spark, sf_dir)).select(records.jsonp_body(F.col("raw")).alias("body"))
    found = files.distinct_records(files.answer_records(bodies))
    return found.select(records.value(F.col("record"), "id").alias("id"), records.value(F.col("record"), "storeName").alias("name"))


@query("SELECT * FROM (VALUES ('Name', 'storeName'), ('Latitude', 'geo.latitude'), ('Longitude', 'geo.longitude'), ('City', 'town')) AS t(field, path)")
def inferred_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _records(places(spark, sf_dir)).select(records.jsonp_body(F.col("raw")).alias("body"))
    return inference.mapping(inference.paths(files.answer_records(bodies))).select("field", "path")


@query("SELECT path, count(*) :: BIGINT * 2 AS n, 1.0 :: DOUBLE AS share FROM places, (VALUES ('id'), ('storeName'), ('town'), ('geo.latitude'), ('geo.longitude')) AS t(path) GROUP BY path")
def inferred_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _records(places(spark, sf_dir)).select(records.jsonp_body(F.col("raw")).alias("body"))
    return inference.paths(files.answer_records(bodies)).select("path", "n", "share")


def _landed(p: DataFrame, size: int = 5) -> DataFrame:
    """Answers of a city's API, ``size`` places a page, by page number and by token; each city's last page comes once more."""
    at = F.row_number().over(Window.partitionBy("city").orderBy("handle")) - 1
    rows = p.select("city", "handle", F.floor(at / size).cast("int").alias("page"))
    record = F.struct(F.col("handle").alias("id"), F.col("city").alias("town"))
    made = rows.groupBy("city", "page").agg(F.sort_array(F.collect_list(record)).alias("items"))
    last = made.groupBy("city").agg(F.max("page").alias("last"), F.sum(F.size("items")).alias("total"))
    paged = made.join(last, "city")
    city = F.replace(F.col("city"), F.lit(" "), F.lit("-"))
    body = lambda following: F.to_json(F.struct(F.col("items"), F.col("total"), following.alias("next")))
    token = F.when(F.col("page") < F.col("last"), F.concat(F.lit("t"), (F.col("page") + 1).cast("string")))
    by_page = paged.select(F.concat(F.lit("https://x/"), city, F.lit("?page="), (F.col("page") + 1).cast("string")).alias("url"), body(F.lit(None).cast("string")).alias("body"))
    again = paged.where("page = last").select(F.concat(F.lit("https://x/"), city, F.lit("?page="), (F.col("page") + 2).cast("string")).alias("url"), body(F.lit(None).cast("string")).alias("body"))
    by_token = paged.select(F.concat(F.lit("https://x/"), city, F.lit("?token="), F.when(F.col("page") > 0, F.concat(F.lit("t"), F.col("page").cast("string"))).otherwise("")).alias("url"), body(token).alias("body"))
    return by_page.unionByName(again).unionByName(by_token)


def _requests(p: DataFrame, query: str) -> DataFrame:
    return p.select(F.col("city").alias("request")).distinct().withColumn("url", F.concat(F.lit("https://x/"), F.replace(F.col("request"), F.lit(" "), F.lit("-")), F.lit(query)))


_PAGED = "SELECT city AS request, ((row_number() OVER (PARTITION BY city ORDER BY handle) - 1) // 5) :: INT AS page, handle AS id FROM places"


def _ids(found: DataFrame) -> DataFrame:
    return found.select("request", "page", F.explode(records.record_array(F.col("body"), "items")).alias("r")).select("request", "page", records.value(F.col("r"), "id").alias("id"))


@query(_PAGED)
def fanout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each city, page after page by the token that each answer gives."""
    p = places(spark, sf_dir)
    return _ids(fanout.followed(_requests(p, "?token={token}"), written(_landed(p), "landed"), fanout.Paging(items_key="items", token_key="next")))


@query(_PAGED)
def fanout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page numbers, until a page repeats the ids of an earlier one."""
    p = places(spark, sf_dir)
    return _ids(fanout.followed(_requests(p, "?page={page}"), written(_landed(p), "landed"), fanout.Paging(items_key="items")))


@query(_PAGED)
def fanout_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By page numbers, until as many records have come as the answers say there are."""
    p = places(spark, sf_dir)
    return _ids(fanout.followed(_requests(p, "?page={page}"), written(_landed(p), "landed"), fanout.Paging(items_key="items", total_key="total")))


@query("SELECT city AS request, count(*) :: BIGINT AS n FROM places GROUP BY 1")
def fanout_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities are listed by one answer for each country; what they list is asked for in turn."""
    p = places(spark, sf_dir)
    lists = p.groupBy("country").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_set("city")), lambda c: F.struct(F.replace(c, F.lit(" "), F.lit("-")).alias("id"))).alias("items"))).alias("body"))
    found = fanout.dependent(lists, written(_landed(p), "landed"), "https://x/{id}?token={token}", items_key="items", paging=fanout.Paging(items_key="items", token_key="next"))
    return found.groupBy(F.replace("request", F.lit("-"), F.lit(" ")).alias("request")).agg(F.sum("n").cast("long").alias("n"))


@query("SELECT prefix, count(*) :: BIGINT AS n, (SELECT count(*) FROM places) :: BIGINT AS total, false AS missing FROM (SELECT left(sha256(handle), 1) AS prefix FROM places) GROUP BY 1")
def fanout_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each prefix; the root's count is held against the sum of all prefixes."""
    p = places(spark, sf_dir).select("handle", F.left(F.sha2(F.col("handle").cast("binary"), 256), F.lit(1)).alias("prefix"))
    answer = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("handle").alias("id")))).alias("items")))
    landed = written(p.groupBy("prefix").agg(answer.alias("body")).select(F.concat(F.lit("https://x/"), "prefix").alias("url"), "body"), "landed")
    asked = prefixes(spark, 1, "0123456789abcdef").select(F.col("prefix").alias("request"), F.concat(F.lit("https://x/"), "prefix").alias("url"))
    found = fanout.followed(asked, landed, fanout.Paging(items_key="items"))
    sums = found.agg(F.sum("n").alias("sum"))
    root = p.agg(F.count(F.lit(1)).cast("long").alias("total"))
    return found.crossJoin(F.broadcast(root)).crossJoin(F.broadcast(sums)).select(F.col("request").alias("prefix"), "n", "total", (F.col("sum") < F.col("total")).alias("missing"))


def place_pages(p: DataFrame) -> DataFrame:
    """A page of each place, in one of seven forms by its number."""
    name, lat, lon, line = F.concat(F.lit("Shop "), _k().cast("string")), F.concat((_k() % 90).cast("string"), F.lit(".5")), F.concat((_k() % 180).cast("string"), F.lit(".25")), F.concat(_k().cast("string"), F.lit(" Main St"))
    forms = [
        F.concat(F.lit("<div data-locations='[{&quot;handle&quot;:&quot;a&quot;,&quot;name&quot;:&quot;"), name, F.lit("&quot;,&quot;latitude&quot;:"), lat, F.lit(",&quot;longitude&quot;:"), lon, F.lit("}]'></div>")),
        F.concat(F.lit('<div class="row sm-block" id="store_1" data-latlng="'), lat, F.lit(", "), lon, F.lit('"><h4 class="stitle">'), name, F.lit('</h4><div class="saddress"><p>'), line, F.lit("</p><label><span>Tel.</span> +41 22</label></div></div>")),
        F.concat(F.lit('<script type="application/json">{"x":{"stores":[{"name":"'), name, F.lit('","city":"Paris","coordinates":['), lon, F.lit(","), lat, F.lit("]}]}}</script>")),
        F.concat(F.lit('<div data-lat="'), lat, F.lit('" data-lng="'), lon, F.lit('" data-name="'), name, F.lit('"></div><h3>'), name, F.lit("</h3><p>"), line, F.lit("</p>")),
        F.concat(F.lit("<h2>"), name, F.lit("</h2><p>"), line, F.lit("</p><p>a</p><p>b</p><p>c</p><h2>Other</h2><p>1 Side St</p>")),
        F.concat(F.lit('<script>x({"name":"'), name, F.lit('","city":"Rome","latitude":'), lat, F.lit(',"longitude":'), lon, F.lit("})</script>")),
        F.lit("<p>nothing here</p>"),
    ]
    page = forms[-1]
    for n, form in enumerate(forms[:-1]):
        page = F.when(_k() % 7 == n, form).otherwise(page)
    return p.select(_k().alias("page_id"), page.alias("html"))


@query(f", {PK}, f AS (SELECT k AS page_id, 'Shop ' || k AS name, k % 90 || '.5' AS lat, k % 180 || '.25' AS lon, k || ' Main St' AS line FROM pk0) SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'json_attributes' WHEN 1 THEN 'block_pins' WHEN 2 THEN 'json_scripts' WHEN 3 THEN 'coordinate_elements' WHEN 4 THEN 'cards' ELSE 'inline_pairs' END AS technique, name, CASE page_id % 7 WHEN 1 THEN line WHEN 3 THEN line WHEN 4 THEN line || ', a, b, c' END AS address, CASE page_id % 7 WHEN 2 THEN 'Paris' WHEN 5 THEN 'Rome' END AS city, CASE WHEN page_id % 7 = 1 THEN '+41 22' END AS phone, CASE WHEN page_id % 7 <> 4 THEN lat END AS lat, CASE WHEN page_id % 7 <> 4 THEN lon END AS lon FROM f WHERE page_id % 7 < 6 UNION ALL SELECT page_id, 'cards', 'Other', '1 Side St', NULL, NULL, NULL, NULL FROM f WHERE page_id % 7 = 4")
def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_records(place_pages(places(spark, sf_dir))).drop("postal", "country")


@query("SELECT page_id, 0 :: BIGINT AS n FROM pages", False)
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places out of the raw pages, by whichever technique finds any (the given tables' pages hold none)."""
    found = html.page_records(table(spark, sf_dir, "pages"))
    return table(spark, sf_dir, "pages").select("page_id").join(found.groupBy("page_id").agg(F.count(F.lit(1)).cast("long").alias("n")), "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, 'href=\"tel:([^\"]+)\"', 1), ''), '-') AS phone, coalesce(nullif(regexp_extract(html, 'href=\"mailto:([^\"?]+)', 1), ''), '-') AS email FROM pages", False)
def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone, email, _ = html.contacts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(phone, F.lit("-")).alias("phone"), F.coalesce(email, F.lit("-")).alias("email"))


@query("SELECT left(sha256(handle), 1) AS prefix, count(*) :: BIGINT AS n FROM places GROUP BY 1")
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by the first digit of a hash, beside all prefixes of the alphabet."""
    keyed = places(spark, sf_dir).select(F.left(F.sha2(F.col("handle").cast("binary"), 256), F.lit(1)).alias("prefix"))
    return prefixes(spark, 1, "0123456789abcdef").join(keyed, "prefix").groupBy("prefix").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("SELECT 'https://x/?south=' || s || '&north=' || (s + 1) || '&west=' || w || '&east=' || (w + 1) AS url, count(*) :: BIGINT AS n FROM (SELECT cast(floor(lat) as double) AS s, cast(floor(lon) as double) AS w FROM places WHERE lat >= 5 AND lat < 15 AND lon >= 15 AND lon < 25) GROUP BY 1")
def focused_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = focused_grid(spark, 10, 20, 5, 1).withColumn("url", viewport_url("https://x/"))
    p = places(spark, sf_dir).select(F.floor("lat").cast("double").alias("south"), F.floor("lon").cast("double").alias("west"))
    return p.join(boxes, ["south", "west"]).groupBy("url").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("SELECT user_id, count(*) :: BIGINT AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1", False)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import events as S
    from .queries import EVENT_SCHEMA

    source = S.stream(spark, f"{sf_dir}/events.parquet*", EVENT_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.latest(spark, S.distinct_sessions(source, "3650 days").select("user_id", F.lit(1).cast("long").alias("n")), "user_id", new_path(spark, "sessions"), "append")
    return out


# Uploads, jobs, entries by hand


@query(f", {PK} SELECT handle, 'Stores_' || (k % 3) || '.csv' AS filename FROM pk0 WHERE k % 4 IN (1, 2)")
def listed_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(_k() % 4 == 0, "MASTER_Stores.csv").when(_k() % 4 != 3, F.concat(F.lit("Stores_"), (_k() % 3).cast("string"), F.lit(".csv")))
    return runs.listed(places(spark, sf_dir).select("handle", name.alias("filename")))


@query(f", {PK} SELECT handle, name, city FROM pk0 WHERE k % 9 = 3 ORDER BY name, handle")
def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploaded = places(spark, sf_dir).withColumn("upload_id", F.concat(F.lit("u"), (_k() % 9).cast("string")))
    return runs.of_upload(uploaded, "u3").select("handle", "name", "city")


@query(f""", {PK} SELECT reason, count(*) :: BIGINT AS n, min(handle) AS first FROM (SELECT handle, CASE WHEN k % 11 = 0 THEN 'meta' WHEN k % 7 = 0 THEN 'enabled false' WHEN k % 5 = 0 THEN 'template url' WHEN k % 3 = 0 THEN 'non-json (use --include-heavy)'
WHEN k % 13 = 0 AND k % 2 = 1 THEN 'expansion geohash_prefix_expansion' WHEN coalesce(website, '') LIKE '%shop%.example.com%' THEN 'viewport url' END AS reason FROM pk0) GROUP BY 1""")
def skipped_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    shop = F.coalesce(F.col("website"), F.lit(""))
    url = F.concat(F.when(k % 5 == 0, "https://api.yourbrand/").otherwise("https://"), shop, F.when(F.contains(shop, F.lit(".example.com")), "?northEastLat=1").otherwise(""))
    config = F.to_json(F.struct(url.alias("url"), (k % 7 != 0).alias("enabled"), F.when(k % 3 == 0, "html").otherwise("json").alias("type"), F.when(k % 13 == 0, F.array_repeat(F.lit("d"), (k % 2).cast("int"))).alias("geohash_prefix_expansion")))
    brand = F.concat(F.when(k % 11 == 0, "_").otherwise(""), F.col("handle"))
    found = places(spark, sf_dir).select("handle", runs.skip_reason(brand, config).alias("reason"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).cast("long").alias("n"), F.min("handle").alias("first"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS u FROM orders),
d AS (SELECT j.*, CASE WHEN o_orderstatus <> 'F' THEN 'Only completed jobs have viewable records' WHEN u IS NULL THEN 'No upload linked to this job' WHEN u % 3 <> 0 AND u % 5 >= 2 THEN 'Job CSV file not found' END AS problem FROM j),
e AS (SELECT *, CASE WHEN problem IS NULL THEN CASE WHEN u % 3 = 0 AND u % 2 = 0 THEN 'csv' WHEN u % 5 < 2 THEN 'db' ELSE 'csv' END END AS source FROM d)
SELECT source, problem, count(*) :: BIGINT AS n_jobs, coalesce(sum(CASE source WHEN 'csv' THEN 2 WHEN 'db' THEN 1 END), 0) :: BIGINT AS n_rows FROM e GROUP BY 1, 2""", False)
def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    jobs = orders.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("upload_id"))
    uploads = c.select(key.alias("upload_id"), F.concat(F.lit("f"), key.cast("string")).alias("filename"), F.when(key % 2 == 0, "scraper").otherwise("admin").alias("uploaded_by"))
    stored = c.where(key % 5 < 2).select(key.alias("upload_id"), F.col("c_name").alias("name"))
    landed = c.where(key % 3 == 0).select(F.concat(F.lit("f"), key.cast("string")).alias("filename"), F.explode(F.array("c_name", "c_mktsegment")).alias("name"))
    sources = runs.job_sources(jobs, uploads, stored, landed.select("filename"))
    shown = runs.job_rows(sources, stored, landed).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    by = sources.join(shown, "job_id", "left").groupBy("source", "problem")
    return by.agg(F.count(F.lit(1)).cast("long").alias("n_jobs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"))


@query(f""", {PK}, m AS (SELECT *, CASE WHEN k % 11 = 5 THEN 'Request body must be a JSON object' WHEN k % 11 = 0 THEN 'name is required' WHEN k % 11 = 1 THEN 'city is required' WHEN country IS NULL THEN 'country is required'
WHEN k % 11 = 3 THEN 'latitude and longitude must be valid numbers' WHEN k % 11 = 4 THEN 'At least one of addressLine1 or addressLine2 is required' END AS problem FROM pk0)
SELECT handle AS request_id, problem, CASE WHEN problem IS NULL THEN handle END AS handle, CASE WHEN problem IS NULL THEN name END AS name, CASE WHEN problem IS NULL THEN lat END AS lat, CASE WHEN problem IS NULL THEN coalesce(phone, '') END AS phone, CASE WHEN problem IS NULL THEN status END AS status, CASE WHEN problem IS NULL THEN CASE WHEN k % 3 = 0 THEN 'A ' || k || ', B' ELSE brands END END AS brands FROM m""")
def manual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place entered by hand, some of them badly."""
    k, p = _k(), places(spark, sf_dir)
    texts = [
        F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "name", F.lit("\n"))).alias("name"), F.when(k % 11 != 1, F.col("city")).alias("city"), F.col("country"), F.col("lon").alias("longitude"),
        F.when(k % 11 == 4, "").otherwise(F.col("line1")).alias("addressLine1"), F.col("phone"), F.col("status"), F.col("handle"),
    ]
    lat = F.when(k % 11 == 3, '"north"').when(k % 2 == 0, F.concat(F.lit('"'), F.col("lat").cast("string"), F.lit(' deg"'))).otherwise(F.col("lat").cast("string"))
    brands = F.when(k % 3 == 0, F.concat(F.lit('[" A '), k.cast("string"), F.lit('", "", "B"]'))).otherwise(F.to_json(F.struct("brands")).substr(F.lit(11), F.length(F.to_json(F.struct("brands"))) - 11))
    whole = F.concat(F.regexp_replace(F.to_json(F.struct(*texts)), r"\}$", ""), F.lit(', "latitude": '), lat, F.lit(', "brands": '), brands, F.lit("}"))
    requests = p.select(F.col("handle").alias("request_id"), F.when(k % 11 == 5, "[1]").otherwise(whole).alias("body"))
    good = F.col("problem").isNull()
    shown = {"handle": F.col("Handle"), "name": F.col("Name"), "lat": F.col("Latitude").cast("double"), "phone": F.col("Phone"), "status": F.col("Status") == "true", "brands": F.col("Brands")}
    return manual.judged(requests).select("request_id", "problem", *[F.when(good, c).alias(n) for n, c in shown.items()])


# Others


@query("SELECT count(DISTINCT o_custkey) :: BIGINT AS n FROM orders", False)
def located_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").cast("long").alias("n"))


@query(f", {PK}, b AS (SELECT DISTINCT 'BRAND ' || k % 13 AS brand FROM pk0) SELECT brand FROM (SELECT 'BRAND ' || i AS brand FROM range(13) t(i)) WHERE contains(brand, '1') AND brand <> 'BRAND 11' AND (SELECT count(*) FROM b) > 0")
def brand_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.suggestions(places(spark, sf_dir), "d 1", ["brand 11"])


@query(f", {PK} SELECT change, count(*) :: BIGINT AS n FROM (SELECT CASE WHEN k % 7 = 0 THEN 'created' WHEN k % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM pk0) GROUP BY 1")
def batch_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    first = p.select("handle", F.when(_k() % 7 == 0, "created").otherwise("unchanged").alias("change"))
    return upsert.tally(first.unionByName(p.select("handle", F.when(_k() % 3 == 0, "updated").otherwise("unchanged").alias("change"))))


@query("SELECT handle, CASE city WHEN 'City 7' THEN 'Town 7' WHEN 'City 8' THEN 'Town 8' ELSE city END AS city FROM places")
def renamed_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    names = p.where("city IN ('City 7', 'City 8')").select(F.col("city").alias("old"), F.replace(F.col("city"), F.lit("City"), F.lit("Town")).alias("new")).distinct()
    return upsert.renamed(p.select("handle", "city"), names, "city")
