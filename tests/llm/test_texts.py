"""Operators on single texts against brute force: quality rules, licences, BPE, token files, media, language."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bpe, jpeg, language_id, license_scan, media, quality_rules, queries, token_files


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def repeated(w, size):
    at = {}
    for k in range(len(w) - size + 1):
        at.setdefault(tuple(w[k : k + size]), []).append(k)
    return len({p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + size)})


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_quality_rules(name, request):
    docs = request.getfixturevalue(name)
    got = Counter(tuple(r) for r in quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "base_failed", "kept").collect())
    want = Counter()
    for doc, text in docs.select("doc_id", "text").collect():
        w, t = words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        rep, cov = repeated(w, 8), repeated(w, 4)
        failed = len(w) < 20 or 100 * rep > 30 * len(w)
        kept = not failed and 100 * cov <= 40 * len(w) and not repeated(w, 101)
        want[(doc, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, cov, failed, kept)] += 1
    assert got == want


def test_lcp_intervals_give_maximal_repeats():
    w = b"a b c d x a b c d y b c d".split()
    ids = np.unique(w, return_inverse=True)[1].astype(np.int64)
    ends = np.full(len(w), len(w))
    order, levels = quality_rules.suffix_array(ids, ends)
    assert [w[k:] for k in order] == sorted(w[k:] for k in range(len(w)))
    lcp = quality_rules.common_prefixes(order, levels, ends, 1)
    found = {tuple(w[order[a] : order[a] + n]) for a, _, n in quality_rules.lcp_intervals(lcp[: len(w)])}
    assert {(b"a", b"b", b"c", b"d"), (b"b", b"c", b"d"), (b"d",)} <= found


def test_quality_keeps_columns(edge, empty):
    kept = quality_rules.good_documents(edge)
    assert kept.schema == edge.schema
    verdict = {r.doc_id for r in quality_rules.quality_rules(edge).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict
    assert quality_rules.good_documents(empty).count() == quality_rules.quality_rules(empty).count() == 0


def test_license_rules(spark, edge, empty):
    mit = [license_scan.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is")]
    texts = ["Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", "# " + ". ".join(mit).replace(" software ", "\n# software ") + ".", "Nothing.", None, "All rights reserved. Licensed under CC BY-NC 4.0.", "licensed under the license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in license_scan.license_scan(rows).collect()}
    assert got == {0: ("MIT", 0), 1: ("Apache-2.0", 0), 2: ("MIT", 0), 3: ("", 0), 4: ("", 0), 5: ("CC-BY-NC-4.0 Proprietary", 0), 6: ("", 0)}
    assert all(any(c in s for c in license_scan.CUES) for s in license_scan.SENTENCES.values())
    assert license_scan.license_scan(edge).count() == edge.count() and license_scan.license_scan(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_vocabulary())


def le32(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_bpe_equals_library(name, request, tokenizer):
    docs = request.getfixturevalue(name)
    got = Counter(tuple(r) for r in bpe.bpe_digests(docs, queries.word_vocabulary()).collect())
    want = Counter()
    for doc, text in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want[(doc, len(ids), hashlib.sha256(le32(ids)).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want


def test_bpe_all_code_points(tokenizer):
    from tessera.llm.textblocks import blocks
    from tessera.llm.wordwise import encoded
    import pyarrow as pa

    vocab = bpe.vocabulary(queries.word_vocabulary())
    points = [chr(i) for i in (*range(0x3400), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 3), *range(0x20000, 0x110000, 997))]
    texts = [f"a{c}B{c}5" for c in points] + ["a" * 300, "ab" * 200, "ΑΣ ΣΑΣ", "é", "<|startoftext|><|endoftext|", "İstanbul"]
    for block in blocks(pa.array(texts)):
        ids, bounds = encoded(block, vocab.encode_words)
        for k in range(len(block)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(texts[block.first + k], add_special_tokens=False).ids, texts[block.first + k]


def test_bpe_arrays_round_trip(edge, empty, tokenizer):
    path = queries.word_vocabulary()
    both = bpe.decoded_texts(bpe.bpe_ids(edge, path), path).collect()
    want = Counter((d, tokenizer.decode(tokenizer.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in edge.select("doc_id", "text").collect())
    assert Counter(map(tuple, both)) == want and bpe.bpe_digests(empty, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 2**31])
def test_frame_of_reference_round_trip(n, top):
    r = np.random.default_rng(n)
    ids = r.integers(0, top, n)
    ids[::17] = r.integers(0, 2**31, len(ids[::17]))
    data = token_files.file_bytes(np.array([7]), np.array([n]), ids)
    assert (token_files.read_ids(data) == ids).all() and (token_files.read_ids(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    if n > 256:
        assert len(data) < 12 * n


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_token_files(name, request, tokenizer):
    docs = request.getfixturevalue(name)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_files.token_files(docs, queries.word_vocabulary()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at, want, have = 0, Counter(), Counter()
    for r in got:
        assert r.start == at
        at += r.n_tokens
        have[(r.doc_id, r.n_tokens, r.ids_crc32)] += 1
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[(doc, len(ids), zlib.crc32(le32(ids)))] += 1
    assert have == want


def test_token_files_small_pieces_and_empty(documents, empty, tokenizer):
    from tessera.llm.common import new_path

    path = queries.word_vocabulary()
    manifest = token_files.write_token_files(documents, new_path(documents.sparkSession, "t"), lambda: token_files.library_encoder(path), file_ids=1000)
    assert manifest.count() > 4 and token_files.read_token_files(manifest).agg({"n_tokens": "sum"}).first()[0] == manifest.agg({"n_ids": "sum"}).first()[0]
    assert token_files.token_files(empty, path).count() == 0


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_media_round_trip(name, request):
    docs = request.getfixturevalue(name)
    stored = media.stored_media(docs)
    forms = {(r.doc_id, hashlib.sha256(r.media).hexdigest()): len(r.media) for r in stored.collect()}
    got = Counter()
    for r in media.media_features(stored).collect():
        assert forms[(r.doc_id, r.media_sha256)] == r.media_bytes
        got[(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)] += 1
    want = Counter()
    for doc, text in docs.select("doc_id", "text").collect():
        data = (text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want[(doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    assert got == want


def test_media_equal_texts_and_long_payloads(empty):
    texts = [b"a" * 10, b"b", b"a" * 10, bytes(range(256)) * 9 * 2500]
    first, _, again, _ = forms = media.encode_texts(texts)
    assert first == again and media.encode_texts([texts[0]]) == [first]
    decoded = media.decode_media(forms)
    assert [d[1][: len(t)] for d, t in zip(decoded, texts)] == texts and len(list(jpeg.markers(forms[3]))) == 3
    assert media.media_features(media.media_column(empty)).count() == 0


def reference_scan(data, image):
    """Coefficients of a scan, one bit at a time."""
    codes = {}
    for t, body in image.tables.items():
        code, k = 0, 16
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                codes[(t, n, code)] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
    bits, out, seq = iter(()), [], image.sequence()
    parts, at = [], 0
    for k in range(len(data) - 1):
        if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
            parts.append(data[at:k])
            at = k + 2
    parts.append(data[at:])
    total = image.mcus()[0] * image.mcus()[1]
    for part in parts:
        raw = bytes(part).replace(b"\xff\x00", b"\xff")
        bits = iter("".join(f"{b:08b}" for b in raw))
        take = lambda n: int("".join(next(bits) for _ in range(n)) or "0", 2)

        def symbol(t):
            code, n = 0, 0
            while True:
                code, n = code << 1 | int(next(bits)), n + 1
                if (t, n, code) in codes:
                    return codes[(t, n, code)]

        def number(n):
            v = take(n)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        before = {}
        for _ in range(min(image.interval or total, total - len(out) // len(seq))):
            for part_, dc, ac in seq:
                block = [0] * 64
                before[part_] = block[0] = before.get(part_, 0) + number(symbol(dc))
                k = 1
                while k < 64:
                    s = symbol(ac)
                    if not s:
                        break
                    k += s >> 4
                    block[k] = number(s & 15)
                    k += 1
                out.append(block)
    return np.array(out)


def write_scan(image, blocks, dc_codes, ac_codes):
    """Bits of a scan with zero runs and end-of-block codes, for tests."""
    seq, out, before = image.sequence(), "", {}
    size = lambda v: abs(v).bit_length()
    extra = lambda v: f"{v if v > 0 else v + (1 << size(v)) - 1:0{size(v)}b}" if v else ""
    data = b""
    for n, block in enumerate(blocks):
        mcu = n // len(seq)
        if image.interval and n % len(seq) == 0 and mcu and mcu % image.interval == 0:
            out += "1" * (-len(out) % 8)
            data += int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\x00") + bytes([0xFF, 0xD0 + (mcu // image.interval - 1) % 8])
            out, before = "", {}
        part = seq[n % len(seq)][0]
        d = int(block[0]) - before.get(part, 0)
        before[part] = int(block[0])
        code, m = dc_codes[size(d)]
        out += f"{code:0{m}b}" + extra(d)
        run, last = 0, max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, last + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                out, run = out + f"{ac_codes[0xF0][0]:0{ac_codes[0xF0][1]}b}", run - 16
            code, m = ac_codes[run << 4 | size(int(block[k]))]
            out, run = out + f"{code:0{m}b}" + extra(int(block[k])), 0
        if last < 63:
            out += f"{ac_codes[0][0]:0{ac_codes[0][1]}b}"
    out += "1" * (-len(out) % 8)
    return data + int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("interval", [0, 2])
def test_jpeg_reader_general(interval):
    """Three components, subsampled colours, zero runs, with and without restart intervals."""
    r = np.random.default_rng(3)
    dc_body, dc = jpeg.canonical({s: 4 for s in range(12)})
    ac_body, ac = jpeg.canonical({s: 8 for s in [0, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 9)]]})
    image = jpeg.Image(width=40, height=24, interval=interval, quant={0: bytes([2] * 64), 1: bytes([3] * 64)}, tables={0: dc_body, 16: ac_body}, parts=[(1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1)], scan=[(1, 0, 0), (2, 0, 0), (3, 0, 0)])
    blocks = r.integers(-90, 90, (3 * 2 * 6, 64))
    blocks[r.random(blocks.shape) < 0.8] = 0
    blocks[3:8, 20:] = 0
    data = write_scan(image, blocks, dc, ac)
    got = jpeg.scans([(np.frombuffer(data, np.uint8), image)] * 2)
    assert (got[0] == blocks).all() and (got[1] == blocks).all() and (reference_scan(data, image) == blocks).all()
    assert jpeg.thumbnail(image, got[0]).shape == (3, 5)


def test_jpeg_reader_on_written_images():
    form = media.encode_texts([b"The quick brown fox. " * 60])[0]
    image = next(jpeg.markers(form))
    data = form[image.data[0] : image.data[1]]
    assert (jpeg.scans([(np.frombuffer(data, np.uint8), image)])[0] == reference_scan(data, image)).all()


def test_language_id(documents, edge, empty):
    model = language_id.fit(documents.where(~language_id.held_out()), "text", "lang")
    assert model[0] == ["de", "en", "es", "fr"]
    shown = language_id.predict(documents, model).join(documents.select("doc_id", "lang", language_id.held_out().alias("h")), "doc_id").where("h").collect()
    assert sum(r.lang == r.lang_pred for r in shown) >= 0.95 * len(shown) and all(0 <= r.score <= 1 for r in shown)
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(edge, model).collect()}
    und = {d for d, p, s in got if p == "und"}
    assert {3, 13, 23} <= und and all(s == 0 for d, p, s in got if p == "und")
    assert language_id.predict(empty, model).count() == 0
    assert language_id.recognised(edge, model, 0.1).schema == edge.schema
    assert {r.lang_pred for r in language_id.predict(edge, language_id.fit(empty, "text", "lang")).collect()} == {"und"}


def plain_grams(text):
    """Counts of letter triples of a text, letter by letter; words are framed by blanks (None)."""
    out, a, b = Counter(), None, None
    letters = [c.lower()[0] if c.isalpha() else None for c in text]
    for k, c in enumerate(letters):
        if c is not None or (k and letters[k - 1] is not None):
            out[(a, b, c)] += 1
            a, b = b, c
    return out


def plain_vector(counts, space):
    """The bundle of the triples' vectors, with plain sums."""
    letters = (np.random.default_rng(space.seed).integers(0, 2, (language_id.ALPHABET, space.dimensions)) * 2 - 1).tolist()
    code = lambda c: 0 if c is None else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % language_id.OTHERS
    d, total = space.dimensions, [0] * space.dimensions
    for (a, b, c), n in counts.items():
        x, y, z = (letters[code(q)] for q in (a, b, c))
        for k in range(d):
            total[k] += n * x[(k - 2) % d] * y[(k - 1) % d] * z[k]
    return total


def cosine(a, b):
    size = lambda v: sum(x * x for x in v) ** 0.5 or 1
    return sum(x * y for x, y in zip(a, b)) / size(a) / size(b)


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_language_id_equals_brute_force(name, request):
    space, docs = language_id.Space(48, 3), request.getfixturevalue(name)
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r.text is None or len(r.text) < 3000]
    small = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            trained[lang] = trained.get(lang, Counter()) + plain_grams(text)
    prototypes = {lang: plain_vector(n, space) for lang, n in sorted(trained.items()) if n}
    langs, vectors = model = language_id.fit(small, "text", "lang", space)
    assert langs == sorted(prototypes) and all(cosine(v, prototypes[lang]) > 1 - 1e-9 for lang, v in zip(langs, vectors))
    got = sorted(map(tuple, language_id.predict(small, model, space=space).collect()), key=str)
    assert len(got) == len(rows)
    want = {}
    for doc, text, _ in rows:
        v = plain_vector(plain_grams(text or ""), space)
        want[(doc, text)] = {lang: cosine(v, p) for lang, p in prototypes.items()} if plain_grams(text or "") else None
    for (doc, lang, score), r in zip(got, sorted(language_id.predict(small, model, space=space).collect(), key=str)):
        options = [w for (d, _), w in want.items() if d == doc]
        assert any((w is None and (lang, score) == ("und", 0)) or (w is not None and abs(max(0, w[lang]) - score) < 1e-6 and w[lang] > max(w.values()) - 1e-6) for w in options if w is None or lang in w), doc


def test_language_id_other_scripts(spark):
    """Alphabets beyond the Latin one keep their letters apart."""
    texts = [("ru", "быстрая лиса прыгает через ленивую собаку и убегает в лес"), ("uk", "швидка лисиця стрибає через лінивого собаку і тікає в ліс"), ("el", "η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"), ("ar", "الثعلب السريع يقفز فوق الكلب الكسول ويهرب إلى الغابة")]
    rows = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(rows, "text", "lang")
    asked = spark.createDataFrame([(0, "лиса убегает"), (1, "лисиця тікає"), (2, "αλεπού"), (3, "الكلب")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predict(asked, model).orderBy("doc_id").collect()] == ["ru", "uk", "el", "ar"]


def test_language_vectors_are_bound_and_bundled():
    space = language_id.Space(64, 1)
    letters = np.random.default_rng(1).integers(0, 2, (language_id.ALPHABET, 64)) * 2 - 1
    a, b, c = 3, 0, 9
    vector = language_id.gram_vectors(np.array([(a * language_id.ALPHABET + b) * language_id.ALPHABET + c]), space)[0]
    assert (vector == np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]).all()


def twins():
    """Two words that a polynomial modulo a power of two can't tell apart, whatever its odd base."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark, tokenizer):
    """Such words stay apart in every operator that compares words."""
    a, b = twins()
    filler = [f"w{k}" for k in range(30)]
    texts = [f"{a} {b}", " ".join([a] + filler), " ".join([b] + filler), " ".join([a, *"pqrstuv", b, *"pqrstuv"] + filler)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for doc, n, sha, _ in bpe.bpe_digests(docs, queries.word_vocabulary()).collect():
        ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids
        assert (n, sha) == (len(ids), hashlib.sha256(le32(ids)).hexdigest())
    for r in token_files.token_files(docs, queries.word_vocabulary()).collect():
        assert r.ids_crc32 == zlib.crc32(le32(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]))
    assert [r.n_repeat_words for r in quality_rules.quality_rules(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0]
    from tessera.llm import jaccard_join, substring_dedup

    twin = spark.createDataFrame([(0, f"one two {a} four five"), (1, f"one two {b} four five")], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in jaccard_join.jaccard_components(twin).collect()} == {0, 1}
    passages = [f"{x} " + " ".join(filler[:19]) for x in (a, b)]
    assert [r.n_removed for r in substring_dedup.without_repeats(spark.createDataFrame(list(enumerate(passages)), "doc_id long, text string").coalesce(1)).collect()] == [0, 0]


def test_distinct_spans_compares_bytes(monkeypatch):
    """Should two words share a hash, they are told apart all the same."""
    import pyarrow as pa

    from tessera.llm import textblocks

    block = next(textblocks.blocks(pa.array(["first-long-word other-long-word first-long-word x y"])))
    monkeypatch.setattr(textblocks, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    first, place = textblocks.distinct_spans(block.data, block.starts[:3], block.ends[:3])
    assert len(first) == 2 and place[0] == place[2] != place[1]


def plain_feature(form):
    """Dimensions and difference hash of one grey image, from a reader that goes bit by bit, pixel by pixel."""
    image = next(jpeg.markers(form))
    dc = [int(b[0]) for b in reference_scan(form[image.data[0] : image.data[1]], image)]
    width = image.width // 8
    pixels = [min(255, max(0, round(v * image.quant[0][0] / 8) + 128)) for v in dc]
    grid = [pixels[k : k + width] for k in range(0, len(pixels), width)]
    bits = ""
    for r in range(8):
        a, b = r * len(grid) // 8, max(r * len(grid) // 8 + 1, (r + 1) * len(grid) // 8)
        means = []
        for c in range(9):
            x, y = c * width // 9, max(c * width // 9 + 1, (c + 1) * width // 9)
            cell = [v for line in grid[a:b] for v in line[x:y]]
            means.append(sum(cell) / len(cell))
        bits += "".join(str(int(q > p)) for p, q in zip(means, means[1:]))
    return f"{image.width}x{image.height}:{int(bits, 2):016x}"


def test_media_features_equal_plain_thumbnails(edge):
    few = edge.where("doc_id IN (13, 33, 63, 103, 163)")
    forms = {r.doc_id: r.media for r in media.stored_media(few).collect()}
    for r in media.media_features(media.stored_media(few)).collect():
        assert len(list(jpeg.markers(forms[r.doc_id]))) == 1 and r.feature == plain_feature(forms[r.doc_id]), r.doc_id
