"""Media columns: texts stored losslessly as baseline JPEG, read back, with thumbnail hashes.

A text's UTF-8 bytes, filled up with 255 to a positive multiple of 576, become the quantised coefficients of grey images
(see :mod:`.jpeg`; the format's unit, not rounded samples). ``stored`` writes them as a binary media column to the shared
folder; ``features`` parses the stored bytes, Huffman-decodes the scans and hashes the DC-only luminance thumbnail.
Rows are independent: no shuffle, work in pieces of about 1 MB (a longer text is a piece of its own).

Defined results: a null or empty text is 576 bytes 255; repeated rows and equal texts give equal values; a very long text
is a piece of its own and becomes several images in one value; an empty table gives no rows; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import arrow, written
from .textblocks import column, raw

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def encode_texts(texts: list[bytes]) -> list[bytes]:
    payload, rows, lengths, images = bytearray(), [], [], []
    for text in texts:
        n = max(1, -(-len(text) // jpeg.ROW))
        payload += text + b"\xff" * (n * jpeg.ROW - len(text))
        cut = [min(jpeg.STRIP, n - k) for k in range(0, n, jpeg.STRIP)]
        rows += cut
        lengths += [len(text)] * len(cut)
        images.append(len(cut))
    made = iter(jpeg.encode(np.frombuffer(bytes(payload), np.uint8), rows, lengths))
    return [b"".join(next(made) for _ in range(n)) for n in images]


def decode_media(media: list[bytes]) -> list[tuple[int, bytes, str, int, int]]:
    """(length without padding, payload, feature, width, height) of each media value of :func:`encode_texts`."""
    owners, groups = [], {}
    for k, value in enumerate(media):
        data = np.frombuffer(value, np.uint8)
        for image in jpeg.markers(value):
            groups.setdefault(image.layout(), []).append((len(owners), data[image.data[0] : image.data[1]], image))
            owners.append(k)
    found: list = [None] * len(owners)
    for group in groups.values():
        for (place, _, image), coefficients in zip(group, jpeg.scans([(d, i) for _, d, i in group])):
            found[place] = (image, jpeg.TO_BYTE[coefficients.astype(np.int64) + 128].tobytes(), jpeg.thumbnail(image, coefficients))
    out, at = [], 0
    for k in range(len(media)):
        mine = []
        while at < len(owners) and owners[at] == k:
            mine.append(found[at])
            at += 1
        pixels = np.concatenate([x[2] for x in mine])
        width, height = mine[0][0].width, sum(x[0].height for x in mine)
        out.append((struct.unpack(">Q", mine[0][0].comment)[0], b"".join(x[1] for x in mine), f"{width}x{height}:{jpeg.difference_hash(pixels):016x}", width, height))
    return out


def _pieces(values: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    off, data = raw(values)
    k = 0
    while k < len(off) - 1:
        m = max(k + 1, int(np.searchsorted(off, off[k] + size, "right")) - 1)
        m = min(m, k + 2000)
        yield k, [data[off[j] : off[j + 1]].tobytes() for j in range(k, m)]
        k = m


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as JPEG bytes."""

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, texts in _pieces(column(batch.column(1)), 1 << 20):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[first : first + len(texts)], "media": pa.array(encode_texts(texts), pa.binary())})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(arrow(encode), "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """One row for each of the media values: what is read back from its bytes."""

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, values in _pieces(batch.column(1), 3 << 19):
            rows = []
            for value, (n, payload, feature, width, height) in zip(values, decode_media(values)):
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(value), hashlib.sha256(value).hexdigest(), feature, width, height))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[first : first + len(rows)], **{k: pa.array(v) for k, v in zip(names, zip(*rows))}})

    return media.select("doc_id", "media").mapInArrow(arrow(decode), SCHEMA)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the media column to the shared folder and give it back, read from there."""
    return written(media_column(docs, id_col, text_col), "media")
