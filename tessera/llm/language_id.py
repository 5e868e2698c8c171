"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram (n = 3) is the product of its letters' vectors, each permuted
by its place; a text's vector is the sum (bundle) of its n-grams' vectors, a language's prototype the bundle of all its
training texts. A text gets the language whose prototype has the largest cosine with its vector.

``fit`` reads every labelled row: tasks count n-grams by language, Spark sums the counts, tasks for each language and
share of the n-grams bundle them, and the shares' sums are added. Only the prototypes, 4 kB for each language, reach the
driver, which takes MAX_LANGUAGES at most (more raise ValueError: such labels are no languages). ``predict`` is a map over
rows without a shuffle.

Letters are a-z in either case and other letters in lower case, the latter by code point modulo a prime of about 4000: the
alphabets of Europe and the Near East never collide within one another, a few Chinese characters share a vector.

Defined results: the prediction is ``und`` with score 0 where the text is null, has no letter, or no language was
learnt; ties go to the language that sorts first; repeated rows and equal texts get equal rows; a training row without
text or language is ignored; a text of fewer than three letters still has n-grams, as words are framed by blanks; a very
long text is a piece of its own, whole, and takes memory in proportion to its letters (about 60 bytes for each); an empty
table gives no rows; other columns are ignored by :func:`predict`, and kept with their values by :func:`recognised`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow
from .textblocks import column, raw

#: Letter classes: 0 for no letter, 26 for a-z, and a prime number of others.
OTHERS = 4057
ALPHABET = 27 + OTHERS
MAX_LANGUAGES = 4096
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass(frozen=True)
class Space:
    """dimensions: length of the vectors; seed: of the letters' vectors."""

    dimensions: int = 512
    seed: int = 7


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For each code point: 0 for what is no letter, 1-26 for a-z in either case, else a class of other letters."""
    out = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % OTHERS
    return out


@lru_cache(maxsize=2)
def letter_vectors(space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors, permuted for the first, second and third place of an n-gram."""
    letters = (np.random.default_rng(space.seed).integers(0, 2, (ALPHABET, space.dimensions)) * 2 - 1).astype(np.int8)
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


def gram_vectors(grams: np.ndarray, space: Space) -> np.ndarray:
    """The vectors of n-grams (a * ALPHABET + b) * ALPHABET + c: the product of their letters'."""
    first, second, third = letter_vectors(space)
    return first[grams // ALPHABET**2] * second[grams // ALPHABET % ALPHABET] * third[grams % ALPHABET]


def grams(values: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """In pieces of whole texts: first place, number of texts, and (text, n-gram, count) for what occurs."""
    off, data = raw(column(values))
    codes, k = letter_codes(), 0
    while k < len(off) - 1:
        m = max(k + 1, int(np.searchsorted(off, off[k] + size, "right")) - 1)
        points = np.frombuffer(data[off[k] : off[m]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.zeros(int(off[m] - off[k]) + 1, np.int64)
        np.cumsum((data[off[k] : off[m]] & 0xC0) != 0x80, out=lead[1:])
        doc = np.repeat(np.arange(m - k), np.diff(lead[off[k : m + 1] - off[k]]))
        letter = codes[points]
        keep = letter > 0
        keep[1:] |= keep[:-1] & (doc[1:] == doc[:-1])  # one blank after each word
        letter, doc = letter[keep], doc[keep]
        n = len(letter)
        if n:
            same1 = np.append(False, doc[1:] == doc[:-1])
            b = np.where(same1, np.append(0, letter[:-1]), 0).astype(np.int64)
            same2 = np.append([False] * min(2, n), doc[2:] == doc[:-2])
            a = np.where(same2, np.append([0] * min(2, n), letter[:-2]), 0).astype(np.int64)
            key, count = np.unique(doc * np.int64(ALPHABET**3) + (a * ALPHABET + b) * ALPHABET + letter, return_counts=True)
            yield k, m - k, key // ALPHABET**3, key % ALPHABET**3, count
        else:
            yield k, m - k, *(np.zeros(0, np.int64),) * 3
        k = m


def fit(labelled: DataFrame, text_col: str, lang_col: str, space: Space = Space(), shares: int = 64) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order and their prototypes, of unit length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, owner = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for first, _, doc, gram, n in grams(batch.column(0)):
                key, place = np.unique(owner[first + doc] * ALPHABET**3 + gram, return_inverse=True)
                total = np.bincount(place, n, len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(langs[key // ALPHABET**3], pa.string()), pa.array(key % ALPHABET**3), pa.array(total)], ["lang", "gram", "n"])

    def bundle(table: pa.Table) -> pa.Table:
        at, n, total = table["gram"].to_numpy(), table["n"].to_numpy().astype(np.float64), np.zeros(space.dimensions)
        for k in range(0, len(at), 4096):
            total += n[k : k + 4096] @ gram_vectors(at[k : k + 4096], space).astype(np.float64)
        return pa.table({"lang": table["lang"][:1], "vector": pa.array([total.tolist()], pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([v.as_py() for v in table["vector"]], axis=0)
        return pa.table({"lang": table["lang"][:1], "vector": pa.array([(total / (np.linalg.norm(total) or 1)).tolist()], pa.list_(pa.float64()))})

    used = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    counts = used.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    schema = "lang string, vector array<double>"
    parts = counts.withColumn("share", F.pmod("gram", F.lit(shares))).groupBy("lang", "share").applyInArrow(bundle, schema)
    rows = sorted(parts.groupBy("lang").applyInArrow(add, schema).limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [r["lang"] for r in rows], np.array([r["vector"] for r in rows]).reshape(len(rows), space.dimensions)


def predicted(values: pa.Array, model: tuple[list[str], np.ndarray], space: Space) -> Iterator[tuple[int, list[str], list[float]]]:
    """Of each piece of the texts: the first one's place, languages and scores."""
    langs, prototypes = model
    for first, m, doc, gram, n in grams(values):
        bounds = np.searchsorted(doc, np.arange(m + 1)).tolist()
        weights = n.astype(np.float32)
        pred, score = ["und"] * m, [0.0] * m
        one, place = np.unique(gram, return_inverse=True)
        table = gram_vectors(one, space) if len(one) <= 1 << 16 else None  # 32 MB at most
        for k in range(m):
            a, b = bounds[k], bounds[k + 1]
            if a < b and langs:
                total = np.zeros(space.dimensions)
                for c in range(a, b, 2048):
                    e = min(b, c + 2048)
                    vectors = table[place[c:e]] if table is not None else gram_vectors(gram[c:e], space)
                    total += weights[c:e] @ vectors.astype(np.float32)
                cos = prototypes @ total / (np.linalg.norm(total) or 1)
                best = int(np.argmax(cos))
                pred[k], score[k] = langs[best], float(min(1.0, max(0.0, cos[best])))
        yield first, pred, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", space: Space = Space()) -> DataFrame:
    """doc_id, lang_pred and score of each row."""

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, pred, score in predicted(batch.column(1), model, space):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[first : first + len(pred)], "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(arrow(judge), SCHEMA)


def recognised(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float, text_col: str = "text", space: Space = Space()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is recognised with a score of ``least`` or more."""
    at = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = list(predicted(batch.column(at), model, space))
        yield batch.filter(pa.array([p != "und" and s >= least for _, pred, score in found for p, s in zip(pred, score)]))

    return docs.mapInArrow(arrow(keep), docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are not learnt from: crc32 of the id as text leaves 2 when divided by 4 (false where the id is null)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
