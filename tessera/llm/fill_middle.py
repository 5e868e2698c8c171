"""Fill-in-middle transformation of whole texts, as a pipeline of pyarrow.compute calls over pieces of Arrow batches.

A text's lines (each with its line end) become a list array, which is flattened with the indices of its parents; ordinals
within the text tell prefix, middle and suffix; each role's units are filtered out, put back into lists by their counts
and joined to one piece a text; pieces are joined with the markers. Rows are independent: no shuffle; a piece of a batch
holds about ``PIECE`` bytes of text (a longer text is a piece of its own and is never cut).

Which units are moved follows four numbers, the first groups of eight hexadecimal digits of the SHA-256 of the seed, a
colon and the document's id, computed by Spark's own functions.

Defined results: a null text counts as empty, an empty text and one that holds a marker are plain (unchanged); a null id
hashes as an empty string; a very long text is moved whole; repeated rows give equal rows; an empty table gives none;
other columns are ignored, whatever their names. Only the line feed ends a line; a last line without one is a unit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow
from .textblocks import column, raw

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARKER = "<[PSM]>"
PIECE = 4 << 20


@dataclass(frozen=True)
class Rates:
    """Percentages: of texts that are moved at all, and of those in suffix-prefix-middle order."""

    moved: int = 100
    spm: int = 50
    seed: int = 7


def numbers(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def remainder(x: pa.Array, by: pa.Array | pa.Scalar) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def int64(x) -> pa.Array:
    return pa.array(np.asarray(x), pa.int64())


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(unit, parent, ordinal) of all lines of all texts."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    size = pc.list_value_length(lists).cast(pa.int64())
    begin = pc.subtract(pc.cumulative_sum(size), size)
    ordinal = pc.subtract(int64(np.arange(len(flat))), begin.take(parent))
    last = pc.equal(ordinal, pc.subtract(size.take(parent), 1))
    real = pc.invert(pc.and_(last, pc.equal(flat, "")))  # after a closing line end there's no unit
    ended = pc.binary_join_element_wise(flat, pc.if_else(last, "", "\n"), "")
    return ended.filter(real), parent.filter(real), ordinal.filter(real)


def joined(values: pa.Array, sizes: pa.Array) -> pa.Array:
    """The values joined to one string for each of the sizes, that many in turn."""
    bounds = np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), values), "")


def moved(texts: pa.Array, h: list[pa.Array], rates: Rates) -> dict[str, pa.Array]:
    """The columns n, form, prefix_chars, middle_chars and output of texts (no nulls)."""
    unit, parent, ordinal = units(texts)
    n = int64(np.bincount(parent.to_numpy(), minlength=len(texts)))
    cuts = [remainder(x, pc.add(n, 1)) for x in h[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before, behind = pc.less(ordinal, low.take(parent)), pc.greater_equal(ordinal, high.take(parent))
    prefix = joined(unit.filter(before), low)
    middle = joined(unit.filter(pc.invert(pc.or_(before, behind))), pc.subtract(high, low))
    suffix = joined(unit.filter(behind), pc.subtract(n, high))
    plain = pc.or_(pc.equal(texts, ""), pc.greater_equal(remainder(h[2], pa.scalar(100, pa.int64())), rates.moved))
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    spm = pc.less(remainder(h[3], pa.scalar(100, pa.int64())), rates.spm)
    one, two = pc.if_else(spm, SUFFIX, PREFIX), pc.if_else(spm, PREFIX, SUFFIX)
    first, second = pc.if_else(spm, suffix, prefix), pc.if_else(spm, prefix, suffix)
    output = pc.if_else(plain, texts, pc.binary_join_element_wise(one, first, two, second, MIDDLE, middle, ""))
    no = pa.scalar(None, pa.int64())
    chars = {name: pc.if_else(plain, no, pc.utf8_length(x).cast(pa.int64())) for name, x in (("prefix_chars", prefix), ("middle_chars", middle))}
    return {"n": n, "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), **chars, "output": output}


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts of which :func:`moved` made these. No text that is moved holds a marker, so the markers cut it rightly."""
    plain = pc.equal(form, "plain")
    parts = pc.split_pattern_regex(pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, output), ANY_MARKER)
    a, b, middle = (pc.list_element(parts, k) for k in (1, 2, 3))
    spm = pc.equal(form, "spm")
    return pc.if_else(plain, output, pc.binary_join_element_wise(pc.if_else(spm, b, a), middle, pc.if_else(spm, a, b), ""))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    off, _ = raw(texts)
    k = 0
    while k < len(texts):
        m = max(k + 1, int(np.searchsorted(off, off[k] + PIECE, "right")) - 1)
        yield k, m - k
        k = m


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output."""

    def move(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = column(batch.column(1))
        for k, size in _pieces(texts):
            found = moved(texts.slice(k, size), [batch.column(j).slice(k, size) for j in range(2, 6)], rates)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(k, size), **found})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(numbers(docs[id_col], rates.seed))])
    return rows.mapInArrow(arrow(move), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle`, each with the text it was made from (``restored``), out of output and form alone."""

    def rebuild(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        output, form = batch.column("output"), batch.column("form")
        for k, size in _pieces(output):
            part = batch.slice(k, size)
            yield pa.RecordBatch.from_arrays([*part.columns, rebuilt(output.slice(k, size), form.slice(k, size))], names=[*part.schema.names, "restored"])

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(arrow(rebuild), f"{fields}, restored string")


def sql(rates: Rates = Rates()) -> str:
    h = ", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    part = lambda a, b: f"coalesce(array_to_string(list_slice(w, {a}, {b}), ''), '')"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{rates.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w, {h} FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi FROM u),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR {marked} OR h3 % 100 >= {rates.moved} THEN 'plain' WHEN h4 % 100 < {rates.spm} THEN 'spm' ELSE 'psm' END AS form, {part(1, "lo")} AS prefix, {part("lo + 1", "hi")} AS middle, {part("hi + 1", "n")} AS suffix FROM c)
SELECT doc_id, n :: BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) :: BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) :: BIGINT END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END) AS output_sha256,
sha256(t) AS restored_sha256 FROM p"""
