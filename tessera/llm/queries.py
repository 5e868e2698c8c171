"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_middle, jaccard_join, language_id, license_scan, media, nearest, packing, quality_rules, spelling, substring_dedup, token_files, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), word_vocabulary())


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.stored_media(table(spark, sf_dir, "documents"))).drop("width", "height")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()), "text", "lang")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(F.pmod(crc, F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, url_filter.listed_urls(pages))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.sized(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(nearest.built(vectors, k=5), vectors.where(F.col("vec_id") % 50 == 0))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    rows = fill_middle.restored(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_jaccard_join, op4_token_files, op5_media, op6_language_id, op7_url_filter, op8_bpe, op9_packing, op10_substring_dedup, op11_nearest, op12_fill_middle, op13_spelling)}

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def _repeat_sql(size: int) -> str:
    """Words of each document that lie in a window of ``size`` words found twice or more in it."""
    return f"""SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + {size})) AS p FROM (
SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS c FROM (SELECT doc_id, s, array_to_string(list_slice(w, s, s + {size - 1}), ' ') AS win FROM (
SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS s FROM words))) WHERE c > 1) GROUP BY doc_id"""


def _quality_sql(limits: quality_rules.Limits = quality_rules.Limits()) -> str:
    x = limits
    return rf"""WITH words AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS ({_repeat_sql(x.window)}), short AS ({_repeat_sql(x.min_repeat)}), long AS ({_repeat_sql(x.max_longest + 1)}),
j AS (SELECT words.doc_id, len(w) :: BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) :: BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) :: BIGINT AS n_symbols,
coalesce(lines.n, 0) :: BIGINT AS n_dup_lines, coalesce(base.n, 0) :: BIGINT AS n_repeat_words, coalesce(short.n, 0) :: BIGINT AS covered_words, long.n IS NOT NULL AS too_long
FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN short USING (doc_id) LEFT JOIN long USING (doc_id)),
f AS (SELECT *, n_words < {x.min_words} OR 100 * n_repeat_words > {x.max_repeated_percent} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * covered_words <= {x.max_covered_percent} * n_words AND NOT too_long AS kept, covered_words FROM f"""


JACCARD_SQL = rf"""WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.node)
SELECT d.doc_id, coalesce(sizes.n, 0) :: BIGINT AS n_shingles, r.c AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node, min(root) AS c FROM reach GROUP BY node) r ON r.node = d.doc_id"""

SUBSTRING_SQL = rf"""WITH words AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM every e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
SELECT words.doc_id, len(w) :: BIGINT AS n_words, (len(w) - coalesce(n, 0)) :: BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _quality_sql(), "op2_license_scan": license_scan.sql(), "op3_jaccard_join": JACCARD_SQL, "op7_url_filter": url_filter.sql(), "op10_substring_dedup": SUBSTRING_SQL, "op12_fill_middle": fill_middle.sql()}
