"""BPE encoding and decoding with contiguous rank arrays.

Of each distinct word (pre-token) the part boundaries and the ranks of adjacent pairs are held in contiguous arrays. The
array is scanned for the minimum rank, that boundary is deleted and the neighbouring ranks are looked up anew, until no
pair has a rank. Words of like length are rows of one matrix, so a scan handles all of them at once; a pre-token of more
than LONG bytes uses a heap over the same parts instead of scans (the same order: least rank, then leftmost).

The vocabulary file (tokenizers' JSON: NFC, white space and lower-case normalisers, a splitting pattern, byte-level
symbols, an end-of-word suffix, no decoder) is a parameter. Encoding needs nothing but numpy and regex.

Equal words and pre-tokens of a block are encoded once; they are told apart by their bytes (see :mod:`.textblocks`).

Defined results: a null text counts as empty; texts without tokens decode to the empty string; special tokens' strings
in a text give their ids; repeated rows and equal texts get equal rows; a very long text is encoded whole, in a block of
its own, and so is a very long word; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow
from .textblocks import blocks, distinct_spans, ranges
from .wordwise import encoded

LONG = 96
NONE = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that are letters or numbers only in Unicode versions later than 16, which the pattern means.
LATER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""


#: Lower-case forms that Unicode 16 and 17 have added.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it is a visible Latin-1 character, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """What the JSON file says: ids, merges, the splitting pattern, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.names: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        later = "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split())
        for kind in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{later}]]")
        self.pattern = regex.compile("(?V1)" + pattern.replace(r"\s", WHITE))
        names = [self.names.get(i, "").encode() + b" " for i in range(max(self.names) + 1)]
        self.name_sizes = np.array([len(n) for n in names], np.int64)
        self.name_begin = np.cumsum(self.name_sizes) - self.name_sizes
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols], np.int32)
        self.final = np.array([self.ids[s + self.suffix] for s in symbols], np.int32)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        key = np.array([self.ids[a] << 32 | self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where the vocabulary has no such merge or there is no part (-1)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """Merge each row of ``parts`` (ids, filled up with -1) as far as ranks go."""
        parts = parts.copy()
        n, width = parts.shape
        if width < 2:
            return parts
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.rank(parts[:, :-1], parts[:, 1:])
        rows, columns = np.arange(n), np.arange(width)
        while True:
            at = rank[rows].argmin(axis=1)
            best = rank[rows, at]
            more = best != NONE
            rows, at, best = rows[more], at[more], best[more]
            if not len(rows):
                return parts
            parts[rows, at] = self.merged[best]
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)  # the boundary after `at` goes
            moved, ranks = np.take_along_axis(parts[rows], shift, 1), np.take_along_axis(rank[rows], np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
            moved[:, -1], ranks[:, -1] = -1, NONE
            line = np.arange(len(rows))
            ranks[line, at] = self.rank(moved[line, at], moved[line, np.minimum(at + 1, width - 1)])
            left = np.maximum(at - 1, 0)
            ranks[line, left] = np.where(at > 0, self.rank(moved[line, left], moved[line, at]), ranks[line, left])
            parts[rows], rank[rows] = moved, ranks

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for one long list: a heap of (rank, place) over linked parts."""
        nxt, prv, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
        first = self.rank(np.array(parts[:-1], np.int32), np.array(parts[1:], np.int32))
        heap = [(int(r), k, parts[k], parts[k + 1]) for k, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = nxt[k]
            if not alive[k] or j >= len(parts) or parts[k] != a or parts[j] != b:
                continue
            parts[k], alive[j], nxt[k] = int(self.merged[r]), False, nxt[j]
            if nxt[k] < len(parts):
                prv[nxt[k]] = k
            for x, y in ((prv[k], k), (k, nxt[k])):
                if x >= 0 and y < len(parts):
                    new = int(self.rank(np.array([parts[x]], np.int32), np.array([parts[y]], np.int32))[0])
                    if new != NONE:
                        heapq.heappush(heap, (new, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive) if live]

    def pieces(self, text: str) -> list[str | int]:
        """The pre-tokens of a text in turn; special tokens as ids."""
        out: list[str | int] = []
        found = self.special_pattern and any(s in text for s in self.special)
        for k, part in enumerate(self.special_pattern.split(text) if found else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                if part.isascii():
                    part = part.lower()
                else:  # letter by letter: a final sigma is no special case
                    part = "".join([c.lower() for c in unicodedata.normalize("NFC", part).translate(NEW_LOWER)])
                out += self.pattern.findall(part)
        return out

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of the pre-tokens data[starts[k]:ends[k]]: all ids in turn, and how many each has."""
        sizes = ends - starts
        counts = np.zeros(len(sizes), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (pre-tokens, their ids one after another)
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, 24), (24, 48), (48, LONG)):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for c in range(0, len(chosen), 8192):
                mine = chosen[c : c + 8192]
                n = sizes[mine]
                parts = np.full((len(mine), high), -1, np.int32)
                parts[np.repeat(np.arange(len(mine)), n), ranges(np.zeros(len(mine), np.int64), n)] = self.inner[data[ranges(starts[mine], n)]]
                parts[np.arange(len(mine)), n - 1] = self.final[data[ends[mine] - 1]]
                done = self.merge_rows(parts)
                kept = done >= 0
                counts[mine] = kept.sum(axis=1)
                found.append((mine, done[kept]))
        for k in np.flatnonzero(sizes > LONG).tolist():
            part = data[starts[k] : ends[k]]
            ids = np.array(self.merge_long([*self.inner[part[:-1]].tolist(), int(self.final[part[-1]])]), np.int32)
            counts[k] = len(ids)
            found.append((np.array([k]), ids))
        out, begin = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for mine, ids in found:
            out[ranges(begin[mine], counts[mine])] = ids
        return out, counts

    def encode_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each of the words that follow one another in ``data``: all ids in turn, and how many each has.

        Words of ASCII and Latin-1 letters without apostrophes are split where letters, digits and other characters
        meet; NFC changes nothing in them. The others go through the pattern one by one.
        """
        n, word, original = len(sizes), np.repeat(np.arange(len(sizes)), sizes), data
        first = np.zeros(len(data), bool)
        first[np.cumsum(sizes) - sizes] = True
        lead = data == 0xC3
        after = np.append(False, lead[:-1]) & ~first
        odd = (data >= 0x80) & ~lead & ~(after & (data != 0x97) & (data != 0xB7)) | (data == 0x27)
        for special in self.special:
            head = special.encode()[:2]
            odd |= (data == head[0]) & (np.append(data[1:], 0) == head[-1])
        slow = np.bincount(word[odd], minlength=n) > 0
        data = np.where((data >= 65) & (data <= 90) | after & (data < 0x9F), data + 32, data).astype(np.uint8)
        letter, digit = (data >= 97) & (data <= 122) | (data >= 0x80), (data >= 48) & (data <= 57)
        kind = np.where(letter, 1, np.where(digit, 2, 3))
        begin = first | (kind != np.append(0, kind[:-1])) | digit
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        owner, special = word[starts], np.full(len(starts), -1, np.int64)
        if slow.any():
            keep = ~slow[owner]
            starts, ends, owner, special = starts[keep], ends[keep], owner[keep], special[keep]
            more, at, bounds = [], len(data), np.cumsum(sizes)
            rows: list[tuple[int, int, int, int]] = []
            for k in np.flatnonzero(slow).tolist():
                for p in self.pieces(original[bounds[k] - sizes[k] : bounds[k]].tobytes().decode("utf-8", "replace")):
                    piece = b"" if isinstance(p, int) else p.encode()
                    more.append(piece)
                    rows.append((at, at + len(piece), k, p if isinstance(p, int) else -1))
                    at += len(piece)
            if rows:
                data = np.append(data, np.frombuffer(b"".join(more), np.uint8))
                starts, ends, owner, special = (np.append(x, y) for x, y in zip((starts, ends, owner, special), np.array(rows, np.int64).T))
        one, place = distinct_spans(data, starts, ends)
        ids, counts = self.encode_pieces(data, starts[one], ends[one])
        begin = (np.cumsum(counts) - counts)[place]
        counts = counts[place]
        given = special >= 0  # these have no bytes, and so no ids yet
        if given.any():
            ids = np.append(ids, special[given].astype(np.int32))
            begin[given] = np.arange(len(ids) - int(given.sum()), len(ids))
            counts[given] = 1
        order = np.argsort(owner, kind="stable")
        return ids[ranges(begin[order], counts[order])], np.bincount(owner, counts, n).astype(np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decoded form of each of the lists ids[bounds[k]:bounds[k+1]]: without a decoder in the file, tokens joined by blanks."""
        sizes = self.name_sizes[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        text, cut = memoryview(self.name_bytes[ranges(self.name_begin[ids], sizes)]), total[bounds].tolist()
        return [bytes(text[a : max(a, b - 1)]) for a, b in zip(cut[:-1], cut[1:])]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again: token counts and digests of both."""

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for block in blocks(batch.column(1)):
            ids, bounds = encoded(block, vocab.encode_words)
            data, b = memoryview(ids.astype("<u4").tobytes()), (bounds * 4).tolist()
            sha = [hashlib.sha256(data[b[k] : b[k + 1]]).hexdigest() for k in range(len(block))]
            back = [hashlib.sha256(t).hexdigest() for t in vocab.decode(ids, bounds)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[block.first : block.first + len(block)], "n_tokens": pa.array(np.diff(bounds)), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(arrow(digest), SCHEMA)


def bpe_ids(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts, for further use."""

    def ids_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(batch.column(1)):
            ids, bounds = encoded(block, vocabulary(vocab_path).encode_words)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[block.first : block.first + len(block)], "ids": lists})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(arrow(ids_of), "doc_id long, ids array<int>")


def decoded_texts(encoded_docs: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids); null ids count as none."""

    def back(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = [x or [] for x in batch.column(1).to_pylist()]
        bounds = np.cumsum([0, *map(len, lists)])
        ids = np.array([i for x in lists for i in x], np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array([t.decode() for t in vocabulary(vocab_path).decode(ids, bounds)], pa.string())})

    return encoded_docs.select("doc_id", "ids").mapInArrow(arrow(back), "doc_id long, decoded string")
