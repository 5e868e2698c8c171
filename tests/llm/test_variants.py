"""Nearest neighbours, fill-in-middle and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, nearest, queries, spelling
from tessera.llm.common import WorkTables

SMALL = nearest.Settings(block_rows=64, bucket_rows=8, slot_queries=7, sample_rows=400)


def brute_nearest(ids, vectors, k=5, every=50):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        others = np.flatnonzero(ids != ids[q])
        out[int(ids[q])] = [(int(ids[o]), float(s[o])) for o in others[np.lexsort((ids[others], -s[others].round(12)))][:k]]
    return out


def by_query(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


@pytest.mark.parametrize("settings", [nearest.Settings(), SMALL])
def test_nearest_recall(settings, spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.toPandas()
    got = by_query(nearest.nearest(nearest.built(vectors, 5, s=settings), vectors.where("vec_id % 50 = 0")))
    want = brute_nearest(rows.vec_id.to_numpy(), rows.embedding.tolist())
    assert got.keys() == want.keys()
    hits = sum(len({x[1] for x in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {q: {row[0]: row[1] for row in brute_nearest(rows.vec_id.to_numpy(), rows.embedding.tolist(), 10**6)[q]} for q in want}
    for q, found in got.items():
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert all(abs(score - exact[q][v]) < 1e-12 for _, v, score in found)
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))


def test_nearest_copies_and_odd_vectors(spark):
    """Copies by the hundred (ties to the least ids), vectors that take no part, other lengths, repeated ids and rows."""
    r = np.random.default_rng(3)
    hot = [1.0, 2.0, 3.0, 4.0]
    rows = [(k, hot) for k in range(0, 900, 2)] + [(k, [3.0 * float(x) for x in r.normal(size=4)]) for k in range(1, 900, 2)]
    rows += [(0, hot)] * 3 + [(None, hot), (1000, None), (1050, []), (1100, [0.0] * 4), (1150, [1.0, None, 0.0, 0.0]), (1200, [float("nan"), 1.0, 1.0, 1.0]), (1250, [float("inf"), 1.0, 1.0, 1.0]), (1300, [1.0, 1.0]), (1301, [1.0, 0.0]), (1350, [-0.0, 0.0, 1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query": F.lit(1), "cell": F.lit("x"), "id": F.lit(2)}).repartition(5)
    got = by_query(nearest.nearest(nearest.built(df, 5, s=SMALL), df.where("vec_id % 50 = 0")))
    for q in range(0, 900, 50):  # all of them copies of the hot vector
        assert [x[1] for x in got[q]] == [k for k in range(0, 14, 2) if k != q][:5] and all(x[2] == pytest.approx(1) for x in got[q])
    assert not {1000, 1050, 1100, 1150, 1200, 1250} & got.keys()
    assert [(x[1], round(x[2], 6)) for x in got[1300]] == [(1301, 0.707107)]
    own = [(k, v) for k, v in rows if k is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all() and any(v)]
    ids, first = np.unique([k for k, _ in own], return_index=True)
    want = brute_nearest(ids, [[1e300 * x for x in own[i][1]] if own[i][0] == 1350 else own[i][1] for i in first])
    assert len(set(x[1] for x in got[1350]) & set(x[0] for x in want[1350])) >= 4


def test_nearest_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest(nearest.built(none, 5), none).count() == 0
    assert nearest.nearest(nearest.built(one, 5), one).count() == 0


def test_chi_square():
    x = (np.random.default_rng(1).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert abs((x <= nearest.chi_square_bound(0.95, 8)).mean() - 0.95) < 0.003


def brute_middle(doc, text, moved=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    cuts = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[: cuts[0]], units[cuts[0] : cuts[1]], units[cuts[1] :]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= moved:
        return (doc, len(units), "plain", None, None, text, text)
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc, len(units), form, len(prefix), len(middle), out, text)


def test_fill_middle(edge, documents, empty, spark, monkeypatch):
    odd = ["\n", "\n\n", "a\n", "a\n\nb", "x<P>y\nz", "<S>", "é\r\n中文\n<\nP>\n", "<", "a<S\n><M", "\x00\n\x01", "𝒳\n" * 50]
    special = spark.createDataFrame([(k, t) for k, t in enumerate(odd)] * 2, "doc_id long, text string")
    monkeypatch.setattr(fill_middle, "PIECE", 1 << 12)
    for docs, rates in ((edge, fill_middle.Rates()), (documents, fill_middle.Rates()), (special, fill_middle.Rates()), (documents, fill_middle.Rates(60, 20))):
        rows = fill_middle.restored(fill_middle.fill_in_middle(docs, rates))
        got = Counter(map(tuple, rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()))
        assert got == Counter(brute_middle(r.doc_id, r.text, rates.moved, rates.spm) for r in docs.select("doc_id", "text").collect())
    assert fill_middle.restored(fill_middle.fill_in_middle(empty)).count() == 0


def brute_spelling(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += len(word) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def brute_near(vocabulary):
    around, near = defaultdict(set), {w: set() for w in vocabulary}
    for w in vocabulary:
        for k in range(len(w)):
            around[w[:k], w[k + 1 :]].add(w)
    for (a, b), group in around.items():
        for w in group:
            near[w] |= group - {w}
            if a + b in near:
                near[w].add(a + b)
                near[a + b].add(w)
    return near


def variants(vocabulary):
    near, form = brute_near(vocabulary), {}
    for w, n in vocabulary.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-vocabulary[x], x))
            if vocabulary[best] >= 10 * n:
                form[w] = best
    out = set()
    for w, n in vocabulary.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), vocabulary[form[w]] if w in form else None))
    return out


def test_spelling_variants(edge, documents, empty, spark):
    chain = ["letters " * 3000, "letterss " * 200, "lettersss " * 15, "\nletterssss letterssss " + "Öffnung öffnung ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷ ", "z" * 40_000 + " ", ("z" * 40_000 + "q ") * 2, "z" * 40_000 + " "]
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(chain)], "doc_id int, text string")
    for docs in (edge, documents, odd):
        got = [tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(set(got)) == len(got)
        assert set(got) == variants(brute_spelling(docs.select("doc_id", "text").collect()))
    assert spelling.spelling_variants(empty).count() == 0


def test_spelling_groups_are_cut(spark):
    """Words that share most letters, in groups far beyond the limit: cut down to single positions, without a lost pair."""
    r = np.random.default_rng(4)
    stem = "abcdefgh"
    made = {stem[:k] + x + stem[k + 1 :] for k in range(8) for x in "abcxyz"} | {stem[:k] + x + stem[k:] for k in range(9) for x in "abcxyz"}
    made |= {"aaaaaaa" + "".join(r.choice(list("ab"), int(n))) for n in r.integers(0, 6, 200)} | {"".join(r.choice(list("ab"), 9)) for _ in range(300)}
    words = spark.createDataFrame([(w, 1) for w in sorted(made)], "word string, n long")
    want = {(a, b) for a, group in brute_near({w: 1 for w in made}).items() for b in group}
    for settings in (spelling.Settings(), spelling.Settings(block_words=5), spelling.Settings(block_letters=60)):
        work = WorkTables(spark)
        assert {(x.word, x.near) for x in spelling.near_words(words, work, settings).distinct().collect()} == want
        work.drop()


@pytest.mark.parametrize("name", ["op12_fill_middle"])
def test_sql(name, spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = c.sql(queries.ORACLE_SQL[name])
    assert df.columns == want.columns
    assert Counter(map(tuple, df.collect())) == Counter(want.fetchall())


def test_a_family_is_asked(spark):
    """Of a family of many nodes and a group without one, the few nodes ask, whatever the groups' order."""
    from tessera.llm import jaccard_join as J

    columns = "tok long, hi long, node long, n long, fam long, comp long"
    for fam, other in ((1, 2), (2, 1)):
        held = spark.createDataFrame([(t, k, k, 20, fam, 100) for t in range(3) for k in range(100, 140)] + [(t, 7, 7, 20, other, None) for t in range(3)], columns)
        groups = held.selectExpr("tok", "fam AS to", "comp AS to_comp", "n AS lo_n", "n AS hi_n").distinct()
        got = J._asking(held, groups, J.Settings()).select("node", "to", "tok").collect()
        assert sorted(tuple(r) for r in got) == [(7, fam, t) for t in range(3)]
