"""Token-id files in patched frame-of-reference blocks.

Ids of all documents, in ascending order of the documents, go to binary files. A file holds BLOCK ids in a block: the
block's minimum is subtracted, the differences are packed at the width that PERCENTILE of them need, and the others
(exceptions) stand whole in a list with their places. An index says where each block starts, so a range of ids can be
read without what precedes it. All numbers are little-endian:

    "PFR1", u32 block length, u64 documents, u64 ids, u64 blocks
    i64 document id (each), u64 ids of each document, u64 start of each block and the end of the last, in bytes
    blocks: u32 minimum, u8 width, u16 exceptions, u16 places, u32 differences, packed bits (least significant first)

Spark deals documents out by ranges of their ids (and of their texts' hashes, so that an id that a third of all rows
share, or null, is split) and sorts within partitions; each task streams its partition into files of about ``file_ids``
ids. The order is total but for equal rows, a file's name follows from partition and place, and it appears by a rename, so
a repeated task writes the same file again. Where a file's first id stands in the whole is summed from counts by file,
never from ids.

The ids come from the tokenizers library. Texts are split into pre-tokens as in :mod:`.bpe` (whose tables hold for the
library's Unicode version; tests compare whole texts and code points of all planes), and each distinct one of a block is
encoded by the library once. A vocabulary of another shape, which doesn't mark the ends of words, raises ValueError.

Files are written with Arrow's file systems (local paths, s3, gs, hdfs where its native library is installed).

Defined results: a null text counts as empty and still gets the end id; a null doc_id sorts first and is kept as null (in
a file it is the id -2**63, which therefore is read back as null); repeated ids of documents keep all rows, in the order of
their texts' hashes; a very long text is encoded whole and makes a file of its own; an empty table gives no files and no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary
from .common import new_path, partitions
from .textblocks import blocks, ranges
from .wordwise import EncodeWords, encoded

MAGIC, HEAD = b"PFR1", struct.Struct("<4sIQQQ")
BLOCK, PERCENTILE, END = 256, 90, 2
NULL_ID = -(2**63)
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, n_bytes long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bit_width(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def pack(ids: np.ndarray, size: int = BLOCK, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` and their starts (with the end of the last)."""
    n = -(-len(ids) // size)
    full = np.zeros(n * size, np.int64)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0  # the last block is filled up with its last id
    full = full.reshape(n, size)
    least = full.min(axis=1)
    over = full - least[:, None]
    rank = max(0, -(-size * percentile // 100) - 1)
    width = bit_width(np.partition(over, rank, axis=1)[:, rank]) if n else np.zeros(0, np.int64)
    odd = over >> width[:, None] > 0
    n_odd = odd.sum(axis=1)
    sizes = 7 + 6 * n_odd + size * width // 8
    starts = np.append(0, np.cumsum(sizes))
    out = np.zeros(int(starts[-1]), np.uint8)
    begin = starts[:-1]
    out[begin[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    out[begin + 4] = width
    out[begin[:, None] + [5, 6]] = n_odd.astype("<u2").view(np.uint8).reshape(n, 2)
    row, place = np.nonzero(odd)
    out[ranges(begin + 7, 2 * n_odd)] = place.astype("<u2").view(np.uint8)
    out[ranges(begin + 7 + 2 * n_odd, 4 * n_odd)] = over[row, place].astype("<u4").view(np.uint8)
    over[odd] = 0
    for w in set(width.tolist()) - {0}:
        mine = np.flatnonzero(width == w)
        for c in range(0, len(mine), 1024):
            part = mine[c : c + 1024]
            bits = (over[part][:, :, None] >> np.arange(w)).astype(np.uint8) & 1
            packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            out[(begin + 7 + 6 * n_odd)[part, None] + np.arange(packed.shape[1])] = packed
    return out.tobytes(), starts


def unpack(data: np.ndarray, starts: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """All ids of the blocks that begin at ``starts`` (the last of which is the end)."""
    begin = starts[:-1].astype(np.int64)
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64)
    least = np.ascontiguousarray(data[begin[:, None] + np.arange(4)]).view("<u4").astype(np.int64)[:, 0]
    width = data[begin + 4].astype(np.int64)
    n_odd = np.ascontiguousarray(data[begin[:, None] + [5, 6]]).view("<u2").astype(np.int64)[:, 0]
    over = np.zeros((n, size), np.int64)
    for w in set(width.tolist()) - {0}:
        mine = np.flatnonzero(width == w)
        for c in range(0, len(mine), 1024):
            part = mine[c : c + 1024]
            packed = data[(begin + 7 + 6 * n_odd)[part, None] + np.arange(size * w // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(part), size, w)
            value = np.zeros((len(part), size), np.int64)
            for k in range(w):
                value |= bits[:, :, k].astype(np.int64) << k
            over[part] = value
    place = data[ranges(begin + 7, 2 * n_odd)].view("<u2").astype(np.int64)
    over[np.repeat(np.arange(n), n_odd), place] = data[ranges(begin + 7 + 2 * n_odd, 4 * n_odd)].view("<u4")
    return (over + least[:, None]).ravel()


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    body, starts = pack(ids)
    at = HEAD.size + 16 * len(doc_ids) + 8 * len(starts)
    return HEAD.pack(MAGIC, BLOCK, len(doc_ids), len(ids), len(starts) - 1) + doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes() + (starts + at).astype("<u8").tobytes() + body


def read_header(data: bytes) -> tuple[int, int, int, int]:
    magic, size, n_docs, n_ids, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    return size, n_docs, n_ids, n_blocks


def read_tables(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each, block starts."""
    _, n, _, n_blocks = read_header(data)
    at = HEAD.size
    return np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64), np.frombuffer(data, "<u8", n_blocks + 1, at + 16 * n).astype(np.int64)


def read_ids(data: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
    """Ids first..end of a file; only the blocks that hold them are decoded."""
    size, _, n_ids, _ = read_header(data)
    end = n_ids if end is None else min(end, n_ids)
    starts = read_tables(data)[2]
    a, b = first // size, -(-end // size)
    return unpack(np.frombuffer(data, np.uint8), starts[a : b + 1], size)[first - a * size : end - a * size]


class LibraryVocabulary(Vocabulary):
    """Words are split as in :mod:`.bpe`; the distinct pre-tokens go to the tokenizers library, many in one string.

    A blank ends a pre-token and is dropped, and just the last id of a pre-token carries the end-of-word suffix, so the
    ids of a string of pre-tokens can be told apart.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread in each task
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.is_last = np.zeros(max(self.names) + 1, bool)
        self.is_last[[i for i, s in self.names.items() if s.endswith(self.suffix)]] = True

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, filled = np.zeros(len(starts), np.int64), ends > starts  # special tokens stand as empty pre-tokens
        starts, sizes = starts[filled], (ends - starts)[filled]
        text = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        to = np.cumsum(sizes + 1) - sizes - 1
        text[ranges(to, sizes)] = data[ranges(starts, sizes)]
        whole, cuts = text.tobytes(), [*to[::1024].tolist(), len(text)]
        out = [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast([whole[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)]
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        last = np.flatnonzero(self.is_last[ids])
        if len(last) != len(sizes):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        counts[filled] = np.diff(np.append(-1, last))
        return ids, counts


@lru_cache(maxsize=1)
def library_encoder(path: str) -> EncodeWords:
    return LibraryVocabulary(path).encode_words


def _put(path: str, data: bytes) -> None:
    files, where = fs.FileSystem.from_uri(path)
    part = f"{where}.{TaskContext.get().taskAttemptId()}.tmp"
    files.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, where)


def write_token_files(docs: DataFrame, path: str, encoder: Callable[[], EncodeWords], id_col: str = "doc_id", text_col: str = "text", end_id: int = END, file_ids: int = 4_000_000) -> DataFrame:
    """Encode, append ``end_id`` to each document and write the files; gives the manifest, a row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            docs_, counts, ids = (np.concatenate(x) for x in zip(*held))
            data, name = file_bytes(docs_, counts, ids), f"{path}/part-{part:06d}-{seq:06d}.pfr"
            _put(name, data)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(docs_), "n_ids": len(ids), "n_bytes": len(data)}], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for block in blocks(batch.column(1), min(8 << 20, 4 * file_ids)):
                ids, bounds = encoded(block, encode)
                whole = np.insert(ids, bounds[1:], end_id)
                names = batch.column(0)[block.first : block.first + len(block)].fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                held.append((names, np.diff(bounds) + 1, whole))
                size += len(whole)
                if size >= file_ids:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    dealt = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read files back: a row for each document, with its place among all ids and a checksum of its own."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            files, where = fs.FileSystem.from_uri(name)
            with files.open_input_stream(where) as f:
                data = f.read()
            doc_ids, counts, _ = read_tables(data)
            ends = np.cumsum(counts)
            starts = ends - counts
            crc, k = [], 0
            while k < len(doc_ids):  # about a million ids at a time
                m = max(k + 1, int(np.searchsorted(ends, starts[k] + 1_000_000, "right")))
                part = memoryview(read_ids(data, int(starts[k]), int(ends[m - 1])).astype("<u4").tobytes())
                crc += [zlib.crc32(part[4 * (a - starts[k]) : 4 * (b - starts[k])]) for a, b in zip(starts[k:m].tolist(), ends[k:m].tolist())]
                k = m
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, mask=doc_ids == NULL_ID), "start": pa.array(first + starts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})

    # Two sums, so that no task sees more rows than there are files in a partition, or partitions.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    order = Window.partitionBy("part").orderBy("seq")
    placed = manifest.withColumn("files_before", F.sum("n_ids").over(order) - F.col("n_ids")).join(before, "part")
    dealt = placed.select("file", (F.col("parts_before") + F.col("files_before")).alias("first")).repartition(partitions(manifest.sparkSession), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from read(batch)

    return dealt.mapInArrow(run, SCHEMA)


def token_files(docs: DataFrame, vocab_path: str, path: str | None = None) -> DataFrame:
    """Write and read back: (doc_id, start, n_tokens, ids_crc32)."""
    return read_token_files(write_token_files(docs, path or new_path(docs.sparkSession, "tokens"), lambda: library_encoder(vocab_path)))
