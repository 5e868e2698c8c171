"""Spelling variant grouping: words one edit apart, found by bit-sliced position indexes over blocks of the vocabulary.

Words are counted by Spark. Two words are near if one code point is inserted, deleted or replaced. A word of L letters and
one of L or L + 1 that are near have their difference in the first or in the second half of the shorter one, so they agree
in the letters before, or after, that segment: words meet by (L, segment, the letters around it), a shuffle of four rows a
word. A group of more than ``block_words`` words is cut further, segment by segment, down to single positions, where a
group can't be larger than the alphabet allows; so no group grows with the vocabulary, and no pair is lost.

Groups are put together into blocks of about ``block_words``. For a block, each position has a bitset over the block's
words for each letter. All words of L letters ask at once: with Z, the set of words that agree so far, S, of those with
one letter replaced, and I, of those with one letter more, a step over the query's next letter is
``I = (I | Z) & B[i + 1]``, ``S = S & B[i] | Z & ~B[i]``, ``Z = Z & B[i]``, with 64 words to a machine word. The sets are
exact, so that whatever a block finds is near; pairs found twice count once.

A word's form is its near word of largest count (ties: the least in code-point order), if that count is at least
``ratio`` times its own. Counts grow along forms, so the last of them is found in a few rounds of joins that double.

Defined results: a null or empty text has no words; a null id hashes as an empty string; repeated rows count each; a very
long text is read whole, and a word may be of any length; words without near words have null form and themselves as root;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, written

#: Letters of words, and the divisor of hashes whose words lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
TYPO = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """``block_words``, ``block_letters``: of a group that isn't cut further, and so of a block."""

    least_letters: int = 7
    least_count: int = 2
    ratio: int = 10
    block_words: int = 4096
    block_letters: int = 1 << 20


def words(docs: DataFrame, least_letters: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of so many letters at least and how often they occur, after the loss of letters by hash."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    each = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text")).select("id", F.explode(runs).alias("run"))
    each = each.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    each = each.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    lost = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO == 0, lost).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _segment(low: Column, high: Column, longer: Column, length: Column, last: Column) -> Column:
    return F.struct(length.alias("length"), low.cast("int").alias("low"), high.cast("int").alias("high"), longer.alias("longer"), last.alias("last"))


def _keyed(rows: DataFrame, segments: Column) -> DataFrame:
    """A row for each of a word's segments, under a hash of the letters around it."""
    each = rows.select("word", "n", F.explode(segments).alias("s")).select("word", "n", "s.*")
    around = [F.expr("left(word, low)"), F.expr("right(word, length - high)")]
    return each.withColumn("key", F.xxhash64("length", "low", "high", *around))


def halves(vocabulary: DataFrame, least_letters: int) -> DataFrame:
    n, no = F.length("word"), F.lit(False)
    found = []
    for length, longer in ((n, F.lit(False)), (n - 1, F.lit(True))):
        mid = F.floor(length / 2)
        found += [_segment(F.lit(0), mid, longer, length, no), _segment(mid, length, longer, length, no)]
    return _keyed(vocabulary, F.filter(F.array(*found), lambda s: s["length"] >= least_letters))


def quarters(rows: DataFrame) -> DataFrame:
    """The rows with their segments cut in two, and single positions by kind: replaced there, or added before or after it."""
    length, low, high, longer = (F.col(c) for c in ("length", "low", "high", "longer"))
    mid, yes, no = F.floor((low + high) / 2), F.lit(True), F.lit(False)
    cut = F.array(_segment(low, mid, longer, length, no), _segment(mid, high, longer, length, no))
    one = F.array(_segment(low, low, longer, length, yes), _segment(high, high, longer, length, yes), _segment(low, high, longer, length, yes))
    same_only = F.filter(one, lambda s: ~longer | (s["low"] == s["high"]))
    return _keyed(rows, F.when(high - low > 1, cut).otherwise(same_only))


def grouped(vocabulary: DataFrame, work: WorkTables, s: Settings) -> DataFrame:
    """Rows of words by key, no key with more than a block of words (but for single positions, which the alphabet bounds)."""
    rows, settled = halves(vocabulary, s.least_letters), None
    while True:
        size = rows.where(~F.col("last")).groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("word")).alias("letters"))
        heavy = work.written(size.where((F.col("size") > s.block_words) | (F.col("letters") > s.block_letters)).where("size > 1").select("key"), "heavy")
        if heavy.isEmpty():
            return rows if settled is None else settled.unionByName(rows)
        mark = rows.join(heavy.withColumn("heavy", F.lit(True)), "key", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)) & ~F.col("last"))
        mark = work.written(mark, "grouped")
        light = mark.where(~F.col("heavy")).drop("heavy")
        settled = light if settled is None else settled.unionByName(light)
        rows = quarters(mark.where("heavy").drop("heavy", "key", "last"))


def codes(values: pa.Array, sizes: np.ndarray, wide: int) -> np.ndarray:
    """A row of ``wide`` letters for each word, numbered from 1 (0: none)."""
    flat = np.frombuffer("".join(values.to_pylist()).encode("utf-32-le"), "<u4")
    _, number = np.unique(flat, return_inverse=True)
    out = np.zeros((len(sizes), wide), np.int32)
    out[np.arange(wide) < sizes[:, None]] = number + 1
    return out


def bitsets(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slices, place): a bitset over the words for each letter at one position, and which of them is each word's own.

    The first slice is empty: for letters that no word has here.
    """
    known, place = np.unique(letters, return_inverse=True)
    bits = np.zeros((len(known) + 1, -(-len(letters) // 64) * 64), bool)
    bits[1:, : len(letters)] = (known[:, None] == letters) & (known[:, None] > 0)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), known


def members(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of the bits that are set."""
    row, lane = np.nonzero(sets)
    which, bit = np.nonzero((sets[row, lane][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    return row[which], lane[which] * 64 + bit


def near_in_block(letters: np.ndarray, longer: np.ndarray, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of words of a block that are one edit apart, a being a word of the shorter length.

    ``letters`` has a row for each word, of L + 1 columns (the last 0 for words of L letters); ``longer``: those of L + 1.
    """
    length, asking = letters.shape[1] - 1, np.flatnonzero(~longer)
    lanes = -(-len(letters) // 64)
    as_set = lambda x: np.packbits(np.pad(x, (0, lanes * 64 - len(x))), bitorder="little").view("<u8")
    long_set, short_set, found = as_set(longer), as_set(~longer), []
    step = max(1, room // (8 * lanes))
    for first in range(0, len(asking), step):
        who = asking[first : first + step]
        same = np.repeat((long_set | short_set)[None], len(who), axis=0)
        replaced, added = np.zeros_like(same), np.zeros_like(same)
        slices, known = bitsets(letters[:, 0])
        for i in range(length):
            after, known_after = bitsets(letters[:, i + 1])
            own = letters[who, i]
            here = slices[np.searchsorted(known, own) + 1]
            at = np.minimum(np.searchsorted(known_after, own), len(known_after) - 1)
            there = after[np.where(known_after[at] == own, at + 1, 0)]
            added = (added | same) & there
            replaced = (replaced & here) | (same & ~here)
            same = same & here
            slices, known = after, known_after
        for sets in (replaced & short_set, (added | same) & long_set):
            row, word = members(sets)
            found.append((who[row], word))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.Table]:
    """Whole groups (rows sorted by length and key), so many that a block has no more than a group may."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, ended: bool) -> Iterator[pa.Table]:
        length, key = table["length"].to_numpy(), table["key"].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((np.diff(length) != 0) | (np.diff(key) != 0)) + 1, [table.num_rows]])
        if not ended:
            held.append(table.slice(starts[-2]).combine_chunks().to_batches()[0])
            starts = starts[:-1]
        first = 0
        while first < len(starts) - 1:
            last = first + 1
            while last < len(starts) - 1 and length[starts[last]] == length[starts[first]] and starts[last + 1] - starts[first] <= s.block_words and (starts[last + 1] - starts[first]) * (length[starts[first]] + 1) <= s.block_letters:
                last += 1
            yield table.slice(starts[first], starts[last] - starts[first])
            first = last

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * s.block_words:
                table = pa.Table.from_batches(held)
                held.clear()
                yield from cut(table, False)
    if held:
        yield from cut(pa.Table.from_batches(held), True)


def near_words(vocabulary: DataFrame, work: WorkTables, s: Settings = Settings()) -> DataFrame:
    """(word, near, near_n) of all words (word, n) that are one edit apart, both ways; pairs may come repeatedly."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, s):
            longer = block["longer"].to_numpy()
            if block.num_rows < 2 or longer.all():
                continue
            length, values = block["length"][0].as_py(), block["word"].combine_chunks()
            a, b = near_in_block(codes(values, length + longer.astype(np.int64), length + 1), longer)
            back = longer[b]  # words of one length find each other
            a, b = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
            n = block["n"].combine_chunks()
            for k in range(0, len(a), 1 << 16):
                x, y = pa.array(a[k : k + (1 << 16)]), pa.array(b[k : k + (1 << 16)])
                yield pa.RecordBatch.from_pydict({"word": values.take(x), "near": values.take(y), "near_n": n.take(y)})

    rows = grouped(vocabulary, work, s).select("length", "key", "longer", "word", "n")
    return rows.repartition("key").sortWithinPartitions("length", "key").mapInArrow(match, "word string, near string, near_n long")


def last_forms(forms: DataFrame, work: WorkTables) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles how far."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        following = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = work.written(roots.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    work = WorkTables(docs.sparkSession)
    vocabulary = written(words(docs, s.least_letters, id_col, text_col).where(F.col("n") >= s.least_count), "words")
    once = near_words(vocabulary, work, s).repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = once.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = work.written(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "near")
    joined = vocabulary.join(near, "word", "left")
    is_form = F.coalesce(F.col("near_n") >= s.ratio * F.col("n"), F.lit(False))
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    rows = written(rows, "variants")
    roots = written(last_forms(rows.where(F.col("form").isNotNull()), work), "last-forms")
    work.drop()
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
