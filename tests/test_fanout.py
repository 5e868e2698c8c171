"""Requests as a data source: a partition for each, pages by token, page and offset, a stream that goes on after a stop."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import fanout

ANSWERS = {f"https://x/{c}?t={t}": {"items": [{"id": f"{c}{k}"} for k in ids], "next": n} for c in "abcdefg" for t, ids, n in (("", (1, 2), "p"), ("p", (3,), "q"), ("q", (4, 5), None))}


def fetch_of(answers):
    return lambda url: json.dumps(answers[url])  # not a name of this module, which workers can't import


fetch = fetch_of(ANSWERS)

TOKENS = fanout.Paging(items_key="items", token_key="next")


def test_pages_stop_rightly():
    empty = {1: [1, 2], 2: [], 3: [3], 4: [], 5: [], 6: [4]}
    fetched = lambda url: json.dumps([{"id": k} for k in empty.get(int(url), [])])
    ids = lambda paging: [x["id"] for _, body, _ in fanout.pages("{page}", fetched, paging) for x in json.loads(body)]
    assert ids(fanout.Paging()) == [1, 2] and ids(fanout.Paging(empty_pages=2)) == [1, 2, 3]
    turned = lambda url: json.dumps([{"id": k, "seen": url} for k in ([1, 2] if int(url) % 2 else [2, 1])])
    assert len(list(fanout.pages("{page}", turned, fanout.Paging()))) == 1  # the same ids in another order, with other fields
    assert [n for n, _, _ in fanout.pages("https://x/a?t={token}", fetch, TOKENS)] == [0, 1, 2]
    assert len(list(fanout.pages("single", lambda url: "[1]", fanout.Paging()))) == 1


def test_batch_source(spark):
    spark.dataSource.register(fanout.paged_source("paged_batch", fetch_of(ANSWERS), TOKENS))
    df = spark.read.format("paged_batch").option("requests", json.dumps([f"https://x/{c}?t={{token}}" for c in "abc"])).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r.at, r.page, r.body) for r in df.collect()) == [(k, n, fetch(f"https://x/{c}?t={t}")) for k, c in enumerate("abc") for n, t in enumerate(("", "p", "q"))]


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """The first run fails at the fourth request; the second one asks for it and the rest only, and no row comes twice."""
    log, broken = tmp_path / "log", tmp_path / "broken"
    log.mkdir()
    broken.touch()

    own = fetch_of(ANSWERS)

    def logged(url):
        (log / url.replace("/", "_")).open("a").write(".")
        if broken.exists() and "/d?" in url:
            raise OSError("gone")
        return own(url)

    spark.dataSource.register(fanout.paged_source("paged_stream", logged, TOKENS))

    def run():
        source = spark.readStream.format("paged_stream").option("requests", json.dumps([f"https://x/{c}?t={{token}}" for c in "abcdefg"])).option("step", "1").load()
        return source.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))

    first = run()
    with pytest.raises(Exception, match="gone"):
        first.processAllAvailable()
    asked = {f.name: f.stat().st_size for f in log.iterdir()}
    broken.unlink()
    second = run()
    second.processAllAvailable()
    second.stop()
    rows = [(r.url[10], r.page) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == [(c, n) for c in "abcdefg" for n in range(3)]
    later = {f.name: f.stat().st_size for f in log.iterdir()}
    assert all(later[name] == asked[name] for name in asked if name[9] in "abc" and "x" in name)


def test_landed_pages_are_followed_as_live_ones(spark, monkeypatch):
    """Long, broken, turning and repeating requests end where one page after another would; 300 pages take few tables."""
    tables = []
    written = fanout.WorkTables.written
    monkeypatch.setattr(fanout.WorkTables, "written", lambda self, df, name: tables.append(name) or written(self, df, name))
    body = lambda ids, next=None, total=99: json.dumps({"items": [{"id": k} for k in ids], "next": next, "total": total})
    landed = {f"https://x/long?t={f't{k}' if k else ''}": body([k], f"t{k + 1}" if k < 299 else None, 999) for k in range(300)}
    landed |= {f"https://x/turn?t={t}": body(ids, following) for t, ids, following in (("", [1], "a"), ("a", [2], "b"), ("b", [3], "a"))}
    landed |= {f"https://x/same?t={t}": body(ids, following) for t, ids, following in (("", [1, 2], "a"), ("a", [2, 1], "b"), ("b", [3], None))}
    landed |= {f"https://x/gap/{k}/a": body([k]) for k in (1, 2, 4)} | {f"https://x/gap/{k}/b": body([k]) for k in (2, 3)} | {"https://x/gap/01/b": body([1])}
    landed |= {f"https://x/total{k}1.": body([k, k + 100], total=5) for k in range(1, 13)} | {f"https://x/o?at={2 * k}&p={k + 1}": body([k, 50 + k][: 2 - k // 4]) for k in range(6)}
    landed |= {f"https://x/both?p={k + 1}&t={'' if k == 0 else f'u{k}'}": body([k], f"u{k + 1}" if k < 3 else None) for k in range(4)} | {"https://x/one": body([5])}
    asked = ["https://x/long?t={token}", "https://x/turn?t={token}", "https://x/same?t={token}", "https://x/gap/{page}/a", "https://x/gap/{page}/b", "https://x/total{page}1.", "https://x/o?at={offset}&p={page}", "https://x/both?p={page}&t={token}", "https://x/one", "https://x/none?{page}"]
    answers = spark.createDataFrame(list(landed.items()), "url string, body string")
    requests = spark.createDataFrame([(str(k), url) for k, url in enumerate(asked)], "request string, url string")
    for paging in (TOKENS, fanout.Paging(items_key="items"), fanout.Paging(items_key="items", total_key="total"), fanout.Paging(items_key="items", size=2), fanout.Paging(items_key="items", token_key="next", max_pages=2)):
        tables.clear()
        own = [k for k, url in enumerate(asked) if not paging.token_key or "{token}" in url or "{" not in url]  # a token that is asked for counts in every template there
        got = sorted((r.request, r.page, r.body, r.n) for r in fanout.followed(requests.where(F.col("request").isin(*map(str, own))), answers, paging).collect())
        want = sorted((str(k), n, text, len(json.loads(text)["items"])) for k in own for n, text, _ in fanout.pages(asked[k], lambda u: landed.get(u, "[]"), paging))
        assert got == want and len(tables) < 50
