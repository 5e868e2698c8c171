"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A bin carries two bitmaps: the sources and the duplicate clusters of what it holds. Documents are placed in falling order
of length: bins are kept in order of what is left in them, the search begins at the first bin with room and goes on to
its successors until a compatible one is found (none of the document's source or cluster): the tightest compatible bin.
If there is none, a new bin is opened. A document longer than a bin is cut: its full pieces fill bins of their own, the
rest is packed like a document.

Spark deals documents out, by a hash, to shards of about ``shard_rows`` rows, and each shard packs its own bins, so a hot
source or cluster spreads over all shards. Repeated rows are counted before the shuffle, numbered, and spread by their
number, so a shard's size doesn't depend on what repeats. The successor search is linear in the open bins with room, of
which a shard has at most as many as documents. No row is dropped: an incompatible document always gets a new bin.

The duplicate cluster of :func:`sized` is a text's digest, so it holds exact copies; any other cluster, such as the
component ids of :mod:`.jaccard_join`, may be given to :func:`packed`. The registered query keeps to exact copies, as the
join alone takes more than its budget; in the pipeline one of each near-duplicate group is left, so there are no others.

Defined results: a document without words (or without a length, or with a null text) gets one row of length 0 with a null
bin; a null source or cluster conflicts with nothing; ties in length go by ascending doc_id (null first); repeated rows
are packed as many times; a very long text is counted whole and cut into full bins; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import repeated

CAPACITY = 2048
SCHEMA = "doc_id long, piece long, n_words long, bin long, start long"
WORD = "[^\\x20\\x09-\\x0D]+"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each of the items (length, source bit, cluster bit); items come in order of placing."""
    free: list[tuple[int, int]] = []  # (words left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for size, source, cluster in items:
        at = bisect_left(free, (size, -1))
        while at < len(free):
            left, k = free[at]
            if not (sources[k] & source or clusters[k] & cluster):
                del free[at]
                break
            at += 1
        else:
            left, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[k] |= source
        clusters[k] |= cluster
        if left > size:
            insort(free, (left - size, k))
        placed.append((k, capacity - left))
    return placed


def pack_shard(rows: list[tuple[int | None, int, str | None, str | None]], capacity: int) -> list[tuple[int | None, int, int, int | None, int]]:
    """(doc_id, piece, words, bin, start) of rows (doc_id, words, source, cluster), bins numbered from 0."""
    rows = sorted(rows, key=lambda r: (-(r[1] % capacity), r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or ""))
    source_bits: dict[str, int] = {}
    cluster_bits: dict[str, int] = {}
    seen = Counter(r[3] for r in rows)
    items, owners, out = [], [], []
    for doc, size, source, cluster in rows:
        if size % capacity:
            s = 0 if source is None else 1 << source_bits.setdefault(source, len(source_bits))
            c = 0 if cluster is None or seen[cluster] < 2 else 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
            items.append((size % capacity, s, c))
            owners.append((doc, size // capacity))
        elif not size:
            out.append((doc, 0, 0, None, 0))
    placed = best_fit(items, capacity)
    out += [(doc, piece, item[0], k, start) for (doc, piece), item, (k, start) in zip(owners, items, placed)]
    bins = max((k for k, _ in placed), default=-1) + 1
    for doc, size, _, _ in rows:
        for piece in range(size // capacity):
            out.append((doc, piece, capacity, bins, 0))
            bins += 1
    return out


def packed(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = 4096) -> DataFrame:
    """Rows (doc_id, piece, n_words, bin, start) for ``items`` (doc_id, n_words, source, cluster)."""
    shards = max(1, -(-items.count() // shard_rows))

    def pack(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        rows = list(zip(*[table[c].to_pylist() for c in ("doc_id", "n_words", "source", "cluster")]))
        out = [(d, p, n, None if k is None else shard << 32 | k, s) for d, p, n, k, s in pack_shard(rows, capacity)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "piece", "n_words", "bin", "start"])

    typed = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_words").cast("long"), F.lit(0)).alias("n_words"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    columns, step = typed.columns, 256  # of equal rows each 256 go to a shard of their own choice
    counted = typed.groupBy(*columns).agg(F.count(F.lit(1)).alias("k"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / step) - 1)))
    dealt = parts.withColumns({"shard": F.pmod(F.xxhash64(*columns, "part"), F.lit(shards)), "k": F.least(F.lit(step).cast("long"), F.col("k") - F.col("part") * step)})
    return repeated(dealt.drop("part"), "k").groupBy("shard").applyInArrow(pack, SCHEMA)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Items for :func:`packed`: words of whole texts; documents with the same text are a duplicate cluster."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(WORD)).alias("n_words"), F.col(source_col).alias("source"), F.md5(text.cast("binary")).alias("cluster"))
