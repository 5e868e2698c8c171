"""Operators over many documents against brute force: Jaccard join, substring dedup, packing, URL filter, the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard_join, language_id, packing, quality_rules, substring_dedup, url_filter
from tessera.operators.components import components


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shingles(text, size=5):
    w = words((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows):
    """{doc_id: smallest doc_id reached by links}; rows of one id are versions of one document."""
    sets, parent = [(d, shingles(t)) for d, t in rows], {d: d for d, _ in rows}
    key = lambda d: (d is not None, d or 0)

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        both = Counter(j for x in s for j in holders[x])
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(sets[k][0]), root(sets[j][0])), key=key)
                parent[b] = a
        for x in s:
            holders[x].append(k)
    return {d: root(d) for d, _ in rows}


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_jaccard_components(name, request):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == Counter((d, len(shingles(t)), want[d]) for d, t in rows)


def test_jaccard_families(spark):
    """Many near copies with chains at the limit, in small blocks and chunks so that groups are split."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for family in range(4):
        base = [word() for _ in range(100)]
        for k in range(60):
            text = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                text[r.randrange(100)] = word()
            rows.append((1000 * family + k, " ".join(text)))
    for k in range(60):  # a shared passage that links nothing, and some where it nearly does
        rows.append((9000 + k, " ".join([word() for _ in range(r.choice([5, 12, 40]))] + passage)))
    small = jaccard_join.Settings(sketch_bits=12, block_tokens=700, chunk_tokens=900, hot=3, large=5)
    want = brute_components(rows)
    assert len(set(want.values())) > 20
    for settings in (small, jaccard_join.Settings()):
        got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), settings=settings).collect()}
        assert got == want


def test_jaccard_one_of_each(edge, empty):
    kept = jaccard_join.one_of_each(edge)
    want = brute_components([tuple(r) for r in edge.select("doc_id", "text").collect()])
    assert kept.schema == edge.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in edge.select("doc_id").collect() if want[r.doc_id] == r.doc_id)
    assert jaccard_join.one_of_each(empty).count() == jaccard_join.jaccard_components(empty).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (101, 103), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 104)}


def brute_removal(rows, window=20):
    """{(doc_id, text): (words, removed, kept)}; rows of one id are versions of one document."""
    order = lambda d: (d is not None, d or 0)
    first, gone = {}, defaultdict(set)
    listed = sorted(rows, key=lambda x: order(x[0]))
    for d, t in listed:
        w = words(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, (order(d), k)), (order(d), k))
    for d, t in listed:
        w = words(t)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (order(d), k):
                gone[d].update(range(k, k + window))
    return {(d, t): (len(w := words(t)), len([k for k in range(len(w)) if k in gone[d]]), b" ".join(x for k, x in enumerate(w) if k not in gone[d]).decode()) for d, t in rows}


@pytest.mark.parametrize("piece", [1_500_000, 500])
@pytest.mark.parametrize("name", ["edge", "documents"])
def test_substring_dedup(name, piece, request):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute_removal(rows)
    out = substring_dedup.without_repeats(docs, piece_words=piece)
    count = "_n_words" if "n_words" in docs.columns else "n_words"  # an input column of that name stays as it is
    assert out.columns == [*docs.columns, count, "n_removed", "kept_text"]
    assert Counter((*r[: len(docs.columns)], r[count], r.n_removed, r.kept_text) for r in out.collect()) == Counter((*r, *want[(r.doc_id, r.text)]) for r in docs.collect())


def test_substring_packing_and_empty(empty):
    import numpy as np

    ids, places = np.array([-5, -5, 3, 3, 3, 2**40]), np.array([2, 9, 0, 1, 70000, 4])
    a, b, c = substring_dedup.unpack_places(substring_dedup.pack_places(ids, places, places * 2))
    assert (a == ids).all() and (b == places).all() and (c == 2 * places).all()
    assert substring_dedup.without_repeats(empty).count() == 0


def naive_best_fit(rows, capacity):
    """Every open bin is looked at; the tightest compatible one wins, then the smaller number."""
    bins, out = [], []
    for d, n, s, c in sorted([r for r in rows if r[1] % capacity], key=lambda r: (-(r[1] % capacity), r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        size = n % capacity
        fits = [(capacity - used - size, k) for k, (used, ss, cs) in enumerate(bins) if used + size <= capacity and used < capacity and (s is None or s not in ss) and (c is None or c not in cs)]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([0, set(), set()])
        out.append((d, n // capacity, size, k, bins[k][0]))
        bins[k][0] += size
        bins[k][1].add(s)
        bins[k][2].add(c)
    return out


def test_best_fit_equals_naive():
    r = random.Random(2)
    rows = [(k, r.choice([0, 5, 30, 64, 100, 130, 250]) + r.randint(0, 20), r.choice(["hot"] * 3 + ["a", "b", None]), r.choice([None, "x", "y", f"c{k}"])) for k in range(400)]
    rows += rows[:20]
    got = packing.pack_shard(rows, 100)
    small = [x for x in got if x[2] % 100]
    assert sorted(map(str, small)) == sorted(map(str, naive_best_fit(rows, 100)))
    assert Counter(x[0] for x in got if x[2]) == Counter(d for d, n, _, _ in rows for _ in range(-(-n // 100)))


def test_packing_spreads_repeated_rows(spark):
    """A row that fills a third of the table, and null ids of one length, go to many shards."""
    items = spark.createDataFrame([(None, 5, "s", "c")] * 3000 + [(None, 7, "s", f"c{k}") for k in range(3000)], "doc_id long, n_words long, source string, cluster string")
    out = packing.packed(items, 100, 500).collect()
    shards = Counter(r.bin >> 32 for r in out)
    assert len(out) == 6000 and len(shards) >= 8 and max(shards.values()) < 2500


@pytest.mark.parametrize("shard_rows", [7, 4096])
def test_packing(edge, empty, shard_rows):
    items = packing.sized(edge)
    want = Counter((r.doc_id, len(words(t))) for r, t in ((r, r.text) for r in edge.collect()))
    assert Counter((r.doc_id, r.n_words) for r in items.collect()) == want
    out = packing.packed(items, 100, shard_rows).collect()
    assert Counter({k: v for k, v in Counter((r.doc_id) for r in out for _ in range(r.n_words)).items()}) == Counter({d: n for d, n in Counter(d for d, _ in want.elements()).items() for n in [sum(m * c for (e, m), c in want.items() if e == d)] if n})
    by_bin = defaultdict(list)
    for r in out:
        by_bin[r.bin].append(r)
    source = {r.doc_id: r.source for r in edge.collect()}
    for k, rows in by_bin.items():
        if k is None:
            assert all(r.n_words == 0 for r in rows)
            continue
        assert sum(r.n_words for r in rows) <= 100
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.n_words
        known = [source[r.doc_id] for r in rows if source[r.doc_id]]
        assert len(known) == len(set(known))
    assert packing.packed(packing.sized(empty)).count() == 0


URLS = ["http://www.Example.com/en/x?q#f", "https://a.example.com/en/", "http://example.com/fr", "http://x.net/es/1", "http://x.net/de/1", "http://spam-farm.org/a/", "https://www.spam-farm.org/a.html?x=1", "http://spam-farm.org/b", "http://b.com", "no scheme", None, "", "ftp://Q.ORG", "http://notcom/x", "http://a.org://b/c", "http://long.org/" + "x/" * 50_000]


def test_url_filter(spark):
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS + URLS[5:7])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, canonical string")
    listed = spark.createDataFrame([("spam-farm.org/a",), ("spam-farm.org/a",), (None,), ("q.org",), ("long.org/" + "x/" * 49_999 + "x",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed, url_filter.Bloom(4)).collect()}
    for bloom in (None, url_filter.Bloom(0), url_filter.Bloom(4, small=False), url_filter.Bloom.of(5, most=1)):  # by the list's size, none at all, not broadcast; URLs in many rows, salted
        many = spark.createDataFrame(rows + rows[5:7] * 40 + [(None, *rows[5][1:])] * 30 + [(100 + k, *rows[6][1:]) for k in range(50)], pages.schema)
        found = Counter(tuple(r) for r in url_filter.url_filter(many, listed, bloom, heavy=3).collect())
        assert found == Counter({(k, *v): 1 + 40 * (k in (5, 6)) for k, v in got.items()}) + Counter({(None, *got[5]): 30}) + Counter({(100 + k, *got[6]): 1 for k in range(50)})
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2][2:] == ("com/", "allow") and got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "allow")
    assert len(got[15][1]) == 100_001 and got[15][3] == "block"
    assert [got[k][3] for k in (5, 6, 7, 16, 17)] == ["block", "block", "allow", "block", "block"]
    assert got[8] == ("b.com", "", None, "allow") and got[9] == got[10] == got[11] == ("", "", None, "allow")
    assert got[12] == ("q.org", "", None, "block") and got[13][2] is None and got[14][:2] == ("a.org:", "//b/c")
    assert len(got) == len(URLS) + 2
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, listed.limit(0)).where("rule IS NULL").collect()} == {"allow"}


def test_large_filters_are_joined(spark):
    """A filter beyond the bound flags the same keys, in hot blocks too, and isn't broadcast."""
    keys = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("key"))
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise(F.col("id").cast("string")).alias("key"))
    small, large = url_filter.Bloom.of(2000), url_filter.Bloom.of(2000, most=32)
    assert small.small and not large.small and small.n_blocks == large.n_blocks == url_filter.Bloom.sized(2000).n_blocks
    flagged = large.flagged(rows, large.build(keys, "key"), "key", "hit", heavy=100)
    assert sorted(flagged.collect()) == sorted(small.flagged(rows, small.build(keys, "key"), "key", "hit").collect())


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("key"))
    bloom = url_filter.Bloom(128)
    flagged = bloom.flagged(spark.range(4000).select(F.col("id").cast("string").alias("key")), bloom.build(keys, "key"), "key", "hit")
    rows = flagged.collect()
    assert all(r.hit for r in rows if int(r.key) % 2 == 0)
    assert sum(r.hit for r in rows if int(r.key) % 2) < 200
    assert bloom.build(keys, "key").count() <= 128


def brute_pipeline(spark, rows):
    """The pipeline by the brute-force versions of its stages: rows (doc_id, text, lang, source) to packed rows."""
    def good(t):
        w = words(t)
        rep = lambda size: len({p for v in _windows(w, size).values() if len(v) > 1 for k in v for p in range(k, k + size)})
        return len(w) >= 20 and 100 * rep(8) <= 30 * len(w) and 100 * rep(4) <= 40 * len(w) and not rep(101)

    rows = [r for r in rows if good(r[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs.where(~language_id.held_out()), "text", "lang")
    fine = {r.doc_id for r in language_id.predict(docs, model).where(f"lang_pred <> 'und' AND score >= {corpus_pipeline.LEAST_SCORE}").collect()}
    rows = [r for r in rows if r[0] in fine]
    roots = brute_components([r[:2] for r in rows])
    rows = [r for r in rows if roots[r[0]] == r[0]]
    out = brute_removal([r[:2] for r in rows])
    texts = [(d, t if not out[(d, t)][1] else out[(d, t)][2], s) for d, t, _, s in rows]
    return packing.pack_shard([(d, len(words(t)), s, hashlib.md5(t.encode()).hexdigest()) for d, t, s in texts], packing.CAPACITY)


def _windows(w, size):
    at = defaultdict(list)
    for k in range(len(w) - size + 1):
        at[tuple(w[k : k + size])].append(k)
    return at


def test_pipeline(spark, sf_dir, documents):
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    want = brute_pipeline(spark, [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()])
    assert got == Counter(want)


@pytest.mark.parametrize("name", ["edge", "empty"])
def test_stages_on_edge_cases(spark, name, request, tmp_path):
    """Columns stay, and so do the values of those whose names the operators use themselves."""
    names = ["n_words", "node", "kept", "bucket", "group", "_id", "n_removed", "_document_group", "key", "maybe", "c0", "marks", "places"]
    docs = request.getfixturevalue(name).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{c} "), F.xxhash64("text").cast("string"), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(c) for c in names])
    before = {r["_id"]: r for r in docs.collect()}
    for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, stage
            for r in out.collect():
                old = before[r["_id"]]
                assert all(r[c] == old[c] for c in docs.columns if c not in ("text", "n_chars")), stage
                assert stage == "repeated_passages" or r.text == old.text
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        else:
            assert set(out.columns) == {"doc_id", "piece", "n_words", "bin", "start"} and (out.count() > 0) == (name == "edge")
