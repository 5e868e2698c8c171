"""Quality rules from suffix-array repetition.

Each text's words get a suffix array (prefix doubling over all texts of a block at once; suffixes of different texts
never compare equal). Neighbouring suffixes' longest common prefixes form LCP intervals; the intervals that cannot be
extended to the left are the maximal repeated word sequences. The union of their spans gives the covered fraction, which
is limited together with the longest repeat. Rows are independent of one another: no shuffle, bounded blocks.

Defined results: a null text counts as empty; a text without words has zero counts and fails the base rule (too few
words); repeated rows and equal texts get equal rows; a very long text is a block of its own, whole, and takes memory in
proportion to its words (about 60 bytes for each, and 4 for each doubling of its longest repeat); an empty table gives no
rows; other columns of the input are ignored here, and kept with their values by :func:`good_documents`. Words are told
apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow
from .textblocks import Block, blocks, distinct_spans

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, n_repeats long, longest_repeat long, base_failed boolean, kept boolean"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """min_words, window, max_repeated_percent: the base rule. The others: shortest repeat that counts for the method's
    covered fraction, largest covered percentage, and longest repeat in words."""

    min_words: int = 20
    window: int = 8
    max_repeated_percent: int = 30
    min_repeat: int = 4
    max_covered_percent: int = 40
    max_longest: int = 100


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``ids`` (word numbers that also differ between texts), and each doubling level's ranks.

    ``ends[i]`` is the end of the text that holds word i. At level k two words have the same rank if and only if the
    2**k words from there on are the same, all within a text.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.ones(n, bool)
    first[1:] = ids[order[1:]] != ids[order[:-1]]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = head
    levels, step = [rank], 1
    single = first & np.append(first[1:], True)
    at = np.flatnonzero(~single)  # places in the order that still share a rank
    while len(at):
        i, group = order[at], head[at]
        after = np.where(i + step < ends[i], rank[np.minimum(i + step, n - 1)].astype(np.int64), -1)
        key = group.astype(np.int64) * (n + 1) + after + 1
        o = np.argsort(key, kind="stable")
        key, i = key[o], i[o]
        order[at] = i
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[i] = head[at]
        levels.append(rank)
        step *= 2
        single = new & np.append(new[1:], True)
        at = at[~single]
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray, least: int) -> np.ndarray:
    """lcp[p]: words that suffixes order[p-1] and order[p] have in common, where these are at least ``least`` (else 0)."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    base = min(least.bit_length() - 1, len(levels) - 1)
    p = np.flatnonzero(levels[base][order[1:]] == levels[base][order[:-1]]) + 1
    i, j, size = order[p - 1], order[p], np.zeros(len(p), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + size, j + size
        inside = (a < ends[i]) & (b < ends[j])
        size += ((levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]) & inside).astype(np.int64) << k
    lcp[p] = np.where(size >= least, size, 0)
    return lcp


def lcp_intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first place, last place, length) of each LCP interval of positive length, inner ones first."""
    places = np.flatnonzero(lcp)
    stack: list[tuple[int, int]] = []  # (first place, length), lengths rising
    last = -1
    for p, size in zip(places.tolist(), lcp[places].tolist()):
        if p != last + 1:
            while stack:
                first, length = stack.pop()
                yield first, last, length
        first = p - 1
        while stack and stack[-1][1] > size:
            first, length = stack.pop()
            yield first, p - 1, length
        if not stack or stack[-1][1] < size:
            stack.append((first, size))
        last = p
    while stack:
        first, length = stack.pop()
        yield first, last, length


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in the union of the spans."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1))[:n] > 0


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repetition(block: Block, window: int, min_repeat: int) -> dict[str, np.ndarray]:
    """Of each text of a block: words in repeated windows, words in maximal repeats, number and longest of these."""
    bounds, n, m = block.word_bounds, len(block.starts), len(block)
    if not n:
        zero = np.zeros(m, np.int64)
        return {"n_repeat_words": zero, "covered_words": zero, "n_repeats": zero, "longest_repeat": zero}
    doc = block.doc_of_word()
    ends = bounds[1:][doc]
    words = distinct_spans(block.data, block.starts, block.ends)[1]
    order, levels = suffix_array(doc * np.int64(words.max() + 1) + words, ends)
    lcp = common_prefixes(order, levels, ends, min(window, min_repeat))
    longest = np.maximum(lcp[:-1], lcp[1:])  # of each place, the longest repeat that starts at its word
    out = {}
    for name, least in (("n_repeat_words", window), ("covered_words", min_repeat)):
        here = longest >= least
        out[name] = per_text(covered(order[here], longest[here], n), bounds)
    repeats, top = np.zeros(m, np.int64), np.zeros(m, np.int64)
    lcp[lcp < min_repeat] = 0
    before = np.where(order > bounds[:-1][doc[order]], words[order - 1], -1 - order)  # a text's start differs from any word
    changes = np.zeros(n, np.int64)
    np.cumsum(before[1:] != before[:-1], out=changes[1:])
    changes, owner = changes.tolist(), doc[order].tolist()
    for first, last, size in lcp_intervals(lcp[:n]):
        if changes[last] > changes[first]:
            k = owner[first]
            repeats[k] += 1
            top[k] = max(top[k], size)
    return out | {"n_repeats": repeats, "longest_repeat": top}


def judged(values: pa.Array, limits: Limits) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Of each block of texts: the first one's place, and all counts and verdicts by column."""
    for block in blocks(values):
        b, n_words = block.word_bounds, np.diff(block.word_bounds)
        inside = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum((block.data & 0xC0) != 0x80, out=inside[1:])
        chars = np.zeros(len(block.starts) + 1, np.int64)
        np.cumsum(inside[block.ends] - inside[block.starts], out=chars[1:])
        dup = []
        for k in range(len(block)):
            lines = [x for x in block.text(k).split(b"\n") if x.strip()]
            dup.append(len(lines) - len(set(lines)))
        rep = repetition(block, limits.window, limits.min_repeat)
        failed = (n_words < limits.min_words) | (100 * rep["n_repeat_words"] > limits.max_repeated_percent * n_words)
        kept = ~failed & (100 * rep["covered_words"] <= limits.max_covered_percent * n_words) & (rep["longest_repeat"] <= limits.max_longest)
        yield block.first, {"n_words": n_words, "word_chars": chars[b[1:]] - chars[b[:-1]], "n_symbols": per_text(SYMBOLS[block.data], block.bounds), "n_dup_lines": np.array(dup, np.int64), **rep, "base_failed": failed, "kept": kept}


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept`` (see the module's text for defined results)."""

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, out in judged(batch.column(1), limits):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[first : first + len(out["kept"])], **{k: pa.array(v) for k, v in out.items()}})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(arrow(judge), SCHEMA)


def good_documents(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    at = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(np.concatenate([out["kept"] for _, out in judged(batch.column(at), limits)])))

    return docs.mapInArrow(arrow(keep), docs.schema)
