"""Removal of repeated passages: Rabin-Karp hashes of every window of a fixed number of words, counted in Spark.

A word goes if a window that covers it has the same words as a window that starts earlier (smaller doc_id, or the same
document and an earlier start). Windows are judged on the input. Steps:

1. Tasks hash each window: words are digits of two numbers modulo the prime 2**61 - 1. Of equal windows within a piece of
   about ``piece_words`` words only the earliest goes on; the others are marked right there. So a passage or a copy
   that holds a third of all rows reaches its bucket at most once for each piece.
2. The windows that go on are dealt out by hash bucket, packed (96 bits of the hashes, document and place as differences).
   Each bucket finds windows that occur more than once and marks all but the earliest.
3. Marks, packed and dealt out by group of documents, become one row for each marked document, and meet the texts in a
   join. Texts that a Bloom filter of the marked documents doesn't pass have no marks and are not shuffled. Overlapping
   marks merge into maximal removal intervals.

Buckets and document groups follow the input's bytes (``bucket_bytes`` and ``group_bytes`` of text for each), so a task
stays small at any size; a document that many rows hold is one key of an ordinary join, which Spark may split. Nothing
passes through the driver but counts. Windows count as equal when 96 bits of their hashes are equal: two given windows
collide with a chance of 2**-87 at most (20 words), n windows give about n**2 / 2**97 false pairs (0.0014 for 1.5e13).

Defined results: a null text has no words, an empty or short one no windows; rows that share a doc_id count as versions
of one document: what is marked in one goes in all (equal rows get equal results and don't remove each other); a null
doc_id sorts first, and counts as the same document as the id -2**63; a very long text is one block, whole; an empty table
gives no rows; other columns of the input stay as they are, and where one is called like an output column, that output
column gets an underscore before its name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, numbered, partitions, written
from .textblocks import MIX3, U, Block, blocks, mix, ranges
from .url_filter import Bloom

WINDOW = 20
NULL_ID = -(2**63)
PRIME = U(2**61 - 1)
#: Bases of the two polynomials (any would do; all tasks need the same).
BASES = (0x0F3A5C79B1D24E68, 0x16B89D4E2C70F135)
LOW31, LOW30 = U(2**31 - 1), U(2**30 - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> U(61))
    return np.minimum(x, x - PRIME)  # the difference wraps around where x is smaller


def times(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo 2**61 - 1, by halves of 31 and 30 bits."""
    high, low = U(factor >> 31), U(factor & (2**31 - 1))
    x1, x0 = x >> U(31), x & LOW31
    middle = x1 * low + x0 * high
    return reduced((x1 * high << U(1)) + (middle >> U(30)) + ((middle & LOW30) << U(31)) + x0 * low)


def rolled(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """The Rabin-Karp number of words[i:i+window] for each i: windows of growing length, each from two of half the length."""
    out, size, prime = words, 1, int(PRIME)
    for bit in bin(window)[3:]:
        out = reduced(times(out[:-size], pow(base, size, prime)) + out[size:])
        size *= 2
        if bit == "1":
            out = reduced(times(out[:-1], base) + words[size:])
            size += 1
    return out


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and 32 more of the hashes of words[i:i+window] for each i."""
    if len(words) < window:
        return np.zeros(0, U), np.zeros(0, np.uint32)
    step, found = 1 << 14, []  # small enough for a core's own cache
    for k in range(0, len(words) - window + 1, step):
        part = words[k : k + step + window - 1]
        one, two = rolled(reduced(part), window, BASES[0]), rolled(reduced(mix(part ^ MIX3)), window, BASES[1])
        found.append((mix(one | two << U(61)), (two >> U(3)).astype(np.uint32)))
    h, check = zip(*found)
    return np.concatenate(h), np.concatenate(check)


def _squeeze(x: np.ndarray) -> bytes:
    """Non-negative numbers by byte planes, compressed."""
    x = x.astype("<u8")
    used = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([used]) + zlib.compress(x.view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    used, planes = data[0], np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    out = np.zeros((len(planes) // used, 8), np.uint8)
    out[:, :used] = planes.reshape(used, -1).T
    return out.view("<u8")[:, 0].astype(np.int64)


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack_places(ids: np.ndarray, places: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs in ascending order of (id, place), as differences; ``more`` are numbers along with them."""
    first = int(ids[0]) if len(ids) else 0
    step = np.diff(ids.astype(U), prepend=U(first % 2**64)).astype(np.int64)
    fresh = np.append(True, step[1:] != 0)[: len(ids)]
    gaps = np.where(fresh, places, places - np.append(0, places[:-1]))
    return _join(first.to_bytes(8, "little", signed=True), _squeeze(step.view(U)), _squeeze(gaps), *map(_squeeze, more))


def unpack_places(data: bytes) -> list[np.ndarray]:
    head, step, gaps, *more = _split(data)
    step, gaps = _spread(step), _spread(gaps)
    ids = (np.cumsum(step.astype(U)) + U(int.from_bytes(head, "little"))).astype(np.int64)
    fresh = np.append(True, step[1:] != 0)[: len(step)]
    total = np.cumsum(gaps)
    base = (total - gaps)[np.maximum.accumulate(np.where(fresh, np.arange(len(step)), 0))] if len(step) else total
    return [ids, total - base, *map(_spread, more)]


def pack_marks(ids: np.ndarray, places: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Marked windows by document group: (group, packed (id, first place, places in turn))."""
    order = np.lexsort((places, ids, ids % groups))
    ids, places = ids[order], places[order]
    other = np.append(True, (ids[1:] != ids[:-1]) | (places[1:] != places[:-1]))[: len(ids)]
    ids, places = ids[other], places[other]
    new = np.append(True, (ids[1:] != ids[:-1]) | (places[1:] != places[:-1] + 1))[: len(ids)]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(ids)))
    ids, places = ids[at], places[at]
    group = ids % groups
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(ids)] if len(ids) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(ids)).tolist()):
        yield int(group[a]), pack_places(ids[a:b], places[a:b], count[a:b])


def prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def same_as_before(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Of hashes in order: is each the same as the one before it?"""
    return np.append(False, (h[1:] == h[:-1]) & (check[1:] == check[:-1]))[: len(h)]


def later_ones(by: np.ndarray, first: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the windows ``by`` (equal ones in turn, ``first`` of each marked) start later than the first of them."""
    head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))] if len(by) else by
    return ~first & ((doc[by] != doc[head]) | (place[by] != place[head]))


def _marks(docs: DataFrame, window: int, groups: int, bits: int, piece_words: int) -> DataFrame:
    """(group, data): packed marks of windows that also start earlier. ``docs`` has doc_id and text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            ids, sizes, h, check = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids, kind="stable")
            turn = ranges((np.cumsum(sizes) - sizes)[order], sizes[order])
            h, check, sizes = h[turn], check[turn], sizes[order]
            doc, place = np.repeat(ids[order], sizes), ranges(np.zeros(len(sizes), np.int64), sizes)
            by = np.argsort(h, kind="stable")  # equal windows stay in order of (document, place), copies of a row aside
            if ((h[by][1:] == h[by][:-1]) & (check[by][1:] != check[by][:-1])).any():
                by = np.lexsort((check, h))
            first = ~same_as_before(h[by], check[by])
            if not first.all():
                size = np.diff(np.append(np.flatnonzero(first), len(by)))
                group = np.repeat(np.arange(len(size)), size)
                several = np.flatnonzero((size > 1)[group])
                sub = by[several]
                by[several] = sub[np.lexsort((place[sub], doc[sub], group[several]))]
            later = later_ones(by, first, doc, place)
            rows: list[tuple[int, int, int, bytes]] = []
            for group, data in pack_marks(doc[by[later]], place[by[later]], groups):
                rows.append((int(group) % (1 << bits), 1, group, data))
            kept = np.sort(by[first])
            o = np.lexsort((place[kept], doc[kept])) if len(set(ids.tolist())) < len(ids) else slice(None)
            kept = kept[o]
            bucket = (h[kept] >> U(64 - bits)).astype(np.int64)
            kept = kept[np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")]
            bucket = (h[kept] >> U(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(kept)]
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(kept)).tolist()):
                mine = kept[a:b]
                low = np.ascontiguousarray(h[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()
                rows.append((int(bucket[a]), 0, -1, _join(pack_places(doc[mine], place[mine]), low, check[mine].astype("<u4").tobytes())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "kind", "group", "data"])

        n = 0
        for batch in batches:
            for block in blocks(batch.column(1)):
                count = np.maximum(np.diff(block.word_bounds) - window + 1, 0)
                if not count.sum():
                    continue
                h, check = window_hashes(block.hashes(), window)
                names = batch.column(0)[block.first : block.first + len(block)].fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                inside = ranges(block.word_bounds[:-1], count)
                held.append((names, count, h[inside], check[inside]))
                n += int(count.sum())
                if n >= piece_words:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def repeated(table: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        parts = []
        for kind, group, data in zip(table["kind"].to_pylist(), table["group"].to_pylist(), table["data"]):
            if kind:
                out.append((group, data.as_py()))
            else:
                where, low, check = _split(data.as_py())
                h = np.zeros((len(low) // 7, 8), np.uint8)
                h[:, :7] = np.frombuffer(low, np.uint8).reshape(-1, 7)
                parts.append((h.view("<u8")[:, 0], np.frombuffer(check, "<u4"), *unpack_places(where)))
        if len(parts) > 1:
            h, check, doc, place = (np.concatenate(x) for x in zip(*parts))
            s = np.sort(h)
            several = np.unique(s[1:][s[1:] == s[:-1]])
            if len(several):
                at = np.minimum(np.searchsorted(several, h), len(several) - 1)
                sub = np.flatnonzero(several[at] == h)
                by = sub[np.lexsort((place[sub], doc[sub], check[sub], h[sub]))]
                later = later_ones(by, ~same_as_before(h[by], check[by]), doc, place)
                out += pack_marks(doc[by[later]], place[by[later]], groups)
        return pa.table({"group": pa.array([g for g, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    hashed = docs.mapInArrow(hashes, "bucket int, kind int, group long, data binary")
    return hashed.groupBy("bucket").applyInArrow(repeated, "group long, data binary")


def _by_document(marks: DataFrame) -> DataFrame:
    """(key, places, sizes): of each marked document the stretches of marked windows, disjoint and in order."""

    def merge(table: pa.Table) -> pa.Table:
        ids, places, sizes = (np.concatenate(x) for x in zip(*[unpack_places(d.as_py()) for d in table["data"]]))
        order = np.lexsort((places, ids))
        ids, places, ends = ids[order], places[order], (places + sizes)[order]
        doc = np.cumsum(np.append(True, ids[1:] != ids[:-1])[: len(ids)]) - 1
        reach = np.maximum.accumulate(ends + doc * (int(ends.max()) + 1)) - doc * (int(ends.max()) + 1)  # furthest end so far
        new = np.append(True, (doc[1:] != doc[:-1]) | (places[1:] > reach[:-1]))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(ids)) - 1
        bounds = np.append(np.flatnonzero(np.append(True, doc[at][1:] != doc[at][:-1])), len(at)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (places[at], reach[last] - places[at])]
        return pa.table({"key": pa.array(ids[at][bounds[:-1]]), "places": lists[0], "sizes": lists[1]})

    return marks.groupBy("group").applyInArrow(merge, "key long, places array<long>, sizes array<long>")


def removed_words(block: Block, n: np.ndarray, places: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which words of a block's texts lie in the marked windows: ``n`` stretches of each text, from ``places`` on, ``counts`` windows each."""
    change = np.zeros(len(block.starts) + 1, np.int64)
    begin, end = np.repeat(block.word_bounds[:-1], n), np.repeat(block.word_bounds[1:], n)
    lo, hi = np.minimum(begin + places, end), np.minimum(begin + places + counts - 1 + window, end)
    change += np.bincount(lo, minlength=len(change)) - np.bincount(hi, minlength=len(change))
    return np.cumsum(change)[:-1] > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece_words: int = 1_000_000, bucket_bytes: int = 16 << 20, group_bytes: int = 64 << 20) -> DataFrame:
    """The input's rows and columns with n_words, n_removed and kept_text (kept words joined by one blank)."""
    parts = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = prime_from(max(2 * parts, total // group_bytes))
    bits = max(8, (parts - 1).bit_length(), (total // bucket_bytes).bit_length())
    key, columns, rows = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), docs.columns, numbered(docs)
    by_document = written(_by_document(_marks(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), window, groups, bits, piece_words)), "marked")
    bloom = Bloom.sized(by_document.count())
    key = F.coalesce(F.col(f"c{columns.index(id_col)}").cast("long"), F.lit(NULL_ID))
    flagged = bloom.flagged(rows.withColumn("key", key), bloom.build(by_document.select("key"), "key"), "key", "maybe")
    found = flagged.where("maybe").join(by_document.hint("shuffle_merge"), "key", "left").drop("key", "maybe")
    rest = flagged.where("NOT maybe").drop("key", "maybe").withColumns({c: F.lit(None).cast("array<long>") for c in ("places", "sizes")})
    at, n_columns = columns.index(text_col), len(columns)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = batch.column(n_columns), batch.column(n_columns + 1)
            sizes = np.array([0 if n is None else n for n in places.value_lengths().to_pylist()], np.int64)
            flat, bounds = [x.flatten().to_numpy() for x in (places, counts)], np.append(0, np.cumsum(sizes))
            for block in blocks(batch.column(at)):
                a, b = block.first, block.first + len(block)
                mine = slice(bounds[a], bounds[b])
                gone = removed_words(block, sizes[a:b], flat[0][mine], flat[1][mine], window)
                cut = block.word_bounds
                so_far = np.append(0, np.cumsum(gone))
                stay = ~gone
                length = (block.ends - block.starts)[stay]
                text = np.full(int(length.sum()) + len(length), 32, np.uint8)
                text[ranges(np.cumsum(length + 1) - length - 1, length)] = block.data[ranges(block.starts[stay], length)]
                ends = np.append(0, np.cumsum(length + 1))[np.append(0, np.cumsum(stay))[cut]].tolist()
                whole = memoryview(text)
                kept = [str(whole[x : max(x, y - 1)], "utf-8") for x, y in zip(ends, ends[1:])]
                out = [*[batch.column(k)[a:b] for k in range(n_columns)], pa.array(np.diff(cut)), pa.array(so_far[cut[1:]] - so_far[cut[:-1]]), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    schema = T.StructType(list(rows.schema.fields))
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    return found.unionByName(rest).mapInArrow(remove, schema).toDF(*columns, *fresh(columns, "n_words", "n_removed", "kept_text"))
