"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter. SQL functions only.

The list's URLs set bits in a blocked Bloom filter: a hash picks a block of 512 bits (eight longs), a second hash one bit
in each long. The filter is a DataFrame of at most ``n_blocks`` rows (about 90 bytes each), a number that follows the
list's size. Up to a bound (25 MB) it is broadcast; beyond it equal rows are counted and meet the filter by block in a shuffle of both. URLs that
miss a bit are certainly not listed; only possible hits go to an exact hash join with the list. Equal hits are counted
first. A URL with more than HEAVY different ones is salted, in the list as well, and so is a block of the filter with
more rows. Hits that the join doesn't confirm are false positives of the filter. URLs are parsed once, and so is the list:
both are written to the shared folder.

Defined results: a null or empty URL or one without ``://`` has an empty host and path, no rule, and isn't listed (allow);
a very long URL is judged whole; repeated rows (also with null ids) keep their number; of rules that fit the longest wins;
repeated and null entries of the list count once and not at all; an empty list blocks nothing; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import repeated, written

WORDS = 8
#: Different rows with one URL that a task takes in the join.
HEAVY = 1 << 20
#: The rules (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Labels of hosts whose pages are in the list of the registered query; digests by which other pages are.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DIGEST = "00"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bloom:
    """``n_blocks``: rows of the filter at most (2**15 rows are 3 MB). With 0 blocks every row is a possible hit.

    A filter that isn't ``small`` isn't broadcast; its rows are joined by a shuffle.
    """

    n_blocks: int = 1 << 15
    small: bool = True

    @classmethod
    def of(cls, n_keys: int, most: int = 1 << 18) -> Bloom:
        """A filter for any number of keys, which is broadcast up to ``most`` blocks; for narrow rows, which may move."""
        blocks = max(64, 1 << (n_keys // 32).bit_length())
        return cls(blocks, blocks <= most)

    @classmethod
    def sized(cls, n_keys: int, most: int = 1 << 18) -> Bloom:
        """A filter for so many keys: a block of 512 bits for 32 of them, at least 64 blocks.

        Beyond ``most`` blocks (25 MB; 8 million keys) a filter is too large to be broadcast: there is none, and all rows
        go to the exact join.
        """
        blocks = max(64, 1 << (n_keys // 32).bit_length())
        return cls(blocks if blocks <= most else 0)

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(max(1, self.n_blocks)))

    def _mask(self, key: Column, k: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * k).bitwiseAND(F.lit(63)).cast("int"))

    def build(self, keys: DataFrame, key: str) -> DataFrame:
        """(block, w0..w7) of the keys; partial sums in each task come before the shuffle."""
        if not self.n_blocks:
            keys = keys.limit(0)
        masks = keys.where(F.col(key).isNotNull()).select(self._block(F.col(key)).alias("block"), *[self._mask(F.col(key), k).alias(f"m{k}") for k in range(WORDS)])
        return masks.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])

    def flagged(self, rows: DataFrame, bloom: DataFrame, key: str, flag: str, heavy: int = HEAVY) -> DataFrame:
        """``rows`` with a boolean: might the key be one of the filter's? (False for null.) Blocks with more than ``heavy``
        rows are salted where rows move."""
        if not self.n_blocks:
            return rows.withColumn(flag, F.col(key).isNotNull())
        hit = F.col("_bloom_0").isNotNull() & F.col(key).isNotNull()
        for k in range(WORDS):
            mask = self._mask(F.col(key), k)
            hit = hit & (F.col(f"_bloom_{k}").bitwiseAND(mask) == mask)
        words = bloom.select(F.col("block").alias("_bloom_block"), *[F.col(f"w{k}").alias(f"_bloom_{k}") for k in range(WORDS)])
        if self.small:
            joined = rows.join(F.broadcast(words), self._block(F.col(key)) == F.col("_bloom_block"), "left")
        else:
            joined = salted_join(rows.withColumn("_bloom_block", self._block(F.col(key))), words, "_bloom_block", rows.columns, heavy)
        return joined.select(*[F.col(c) for c in rows.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def salted_join(rows: DataFrame, side: DataFrame, key: str, spread: list[str], heavy: int) -> DataFrame:
    """A left join in which a key with more than ``heavy`` rows is spread over salts by the columns ``spread``."""
    hot = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / heavy).cast("int").alias("_salts")).where(f"_salts > 1 AND {key} IS NOT NULL")
    salts = F.coalesce("_salts", F.lit(1))
    copies = side.join(hot, key, "left").select(*side.columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    placed = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    return placed.join(copies.hint("shuffle_hash"), [key, "_salt"], "left").drop("_salt")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, ``www.``, query, fragment, ``.html`` and closing slash; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "(\\.html)?/?$", "")))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    return split.withColumn("canonical", canonical(F.col("host"), F.col("path")))


def url_filter(pages: DataFrame, listed: DataFrame, bloom: Bloom | None = None, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", heavy: int = HEAVY) -> DataFrame:
    """page_id, host, path, rule, verdict. ``listed`` has a column ``canonical``; without ``bloom`` its size gives the filter's.

    URLs with a rule or without a host need no filter.
    """
    columns = ["page_id", "host", "path", "rule"]
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = written(parsed(pages, id_col, url_col).withColumns({"rule": rule, "said": verdict}), "urls")
    keys = written(listed.select("canonical").where(F.col("canonical").isNotNull()).distinct(), "listed")
    bloom = bloom or Bloom.of(keys.count())
    is_open = F.col("said").isNull() & F.col("canonical").isNotNull()
    counted = lambda df: df.groupBy(*columns, "canonical").agg(F.sum("n").alias("n"))
    undecided = rows.where(is_open).select(*columns, "canonical", F.lit(1).cast("long").alias("n"))
    flagged = bloom.flagged(undecided if bloom.small else counted(undecided), bloom.build(keys, "canonical"), "canonical", "maybe", heavy)
    ruled = rows.where(~is_open).select(*columns, F.coalesce("said", F.lit("allow")).alias("verdict"))
    passed = flagged.where("NOT maybe").select(*columns, F.lit("allow").alias("verdict"), "n")
    settled = ruled.unionByName(passed.drop("n") if bloom.small else repeated(passed, "n"))
    hits = counted(flagged.where("maybe")) if bloom.small else flagged.where("maybe")
    joined = salted_join(hits, keys.withColumn("in_list", F.lit(True)), "canonical", columns[:3], heavy)
    found = joined.select(*columns, F.when(F.col("in_list"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), "n")
    return settled.unionByName(repeated(found, "n"))


def listed_urls(pages: DataFrame, labels: tuple[str, ...] = LISTED_LABELS, digest: str = LISTED_DIGEST) -> DataFrame:
    """Canonical URLs of pages on hosts with one of these labels, and those, of any host, whose MD5 begins with ``digest``.

    The second kind shares its hosts with pages that aren't listed, so only the whole URL tells them apart.
    """
    known = F.arrays_overlap(F.split("host", "\\."), F.array(*[F.lit(x) for x in labels]))
    return parsed(pages).where(known | F.md5(F.col("canonical").cast("binary")).startswith(digest)).select("canonical")


def sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in cases) + " END"
    return f"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html)?/?$', '') END AS canonical FROM s),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND (list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}]) OR starts_with(md5(canonical), '{LISTED_DIGEST}')))
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM c"""
