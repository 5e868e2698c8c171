"""Requests fanned out over tasks: by country, centre, box or prefix, page after page.

Live answers come through a fetch function, either in one run (:func:`fetched`) or as a data source with a partition for
each request (:func:`paged_source`), whose stream goes on where a stopped run ended. Landed answers, a table of URL and
body, are followed by joins (:func:`followed`): all pages of all requests are found together.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import records
from ..plans.work import WorkTables, written

Fetch = Callable[..., str]


@dataclass(frozen=True)
class Paging:
    """How a request goes on. ``url`` may hold {page}, {offset} or {token}; a page that is empty (``empty_pages`` of them in
    turn), short, of the same ids as an earlier one, without a next token or that says there is no more ends it. ``max_pages`` is a limit only where one is wanted (the last row then says that it was cut)."""

    size: int = 0
    first: int = 1
    max_pages: int | None = None
    more_key: str | None = None
    total_key: str | None = None
    items_key: str | None = None
    token_key: str | None = None
    id_key: str = "id"
    empty_pages: int = 1


def _items(body: str, key: str | None) -> list[Any]:
    try:
        data = json.loads(body)
    except ValueError:
        return []
    if key and isinstance(data, dict):
        data = data.get(key)
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), [])
    return data if isinstance(data, list) else []


def fingerprint(items: list[Any], id_key: str) -> str:
    """The ids of a page's records in order; of records without ids all they hold."""
    marks = [str(x[id_key]) if isinstance(x, dict) and x.get(id_key) is not None else json.dumps(x, sort_keys=True) for x in items]
    return json.dumps(sorted(marks))


def pages(url: str, fetch: Fetch, paging: Paging, body: str | None = None) -> Iterator[tuple[int, str, bool]]:
    """(page, body, was it the last that may be asked for)."""
    seen: set[str] = set()
    got, empty, token = 0, 0, ""
    wanted = {mark for mark in ("{page}", "{offset}", "{token}") if mark in url + (body or "")}
    for n in count() if paging.max_pages is None else range(paging.max_pages):
        put = lambda text: text.replace("{page}", str(paging.first + n)).replace("{offset}", str(n * paging.size)).replace("{token}", token)  # noqa: E731, B023
        answer = fetch(put(url)) if body is None else fetch(put(url), put(body))
        items = _items(answer, paging.items_key)
        if not items:
            empty += 1
            if empty >= paging.empty_pages or not wanted or "{token}" in wanted:
                return
            continue
        empty, mark = 0, fingerprint(items, paging.id_key)
        if mark in seen:
            return
        seen.add(mark)
        got += len(items)
        yield n, answer, paging.max_pages is not None and n == paging.max_pages - 1
        state = json.loads(answer)
        state = state if isinstance(state, dict) else {}
        token = str(state.get(paging.token_key or "") or "")
        if not wanted or ("{token}" in wanted and not token) or (paging.more_key and not state.get(paging.more_key)) or (paging.total_key and got >= int(state.get(paging.total_key) or 0)) or (paging.size and len(items) < paging.size):
            return


def fetched(requests: DataFrame, fetch: Fetch, paging: Paging = Paging(), url_col: str = "url", body_col: str | None = None) -> DataFrame:
    """(request's columns, page, body, cut): every page of every request; requests are spread over tasks.

    With ``body_col`` requests are posted: ``fetch`` gets the URL and that column's text, in which {page} and {offset} are
    put in too (other values, such as a country, are put in by the caller, as columns).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(url_col)
            bodies = batch.column(batch.schema.get_field_index(body_col)).to_pylist() if body_col else [None] * batch.num_rows
            for k, url in enumerate(batch.column(at).to_pylist()):
                for page, body, cut in pages(url, fetch, paging, bodies[k]):
                    row = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([page], pa.int32()), pa.array([body]), pa.array([cut])], [*batch.schema.names, "page", "answer" if body_col == "body" else "body", "cut"])

    schema = T.StructType(list(requests.schema.fields)).add("page", T.IntegerType()).add("answer" if body_col == "body" else "body", T.StringType()).add("cut", T.BooleanType())
    return requests.mapInArrow(run, schema)


PLACEHOLDER = r"\{(?:page|offset|token)\}"


def _put(paging: Paging, page: Column, token: Column) -> Column:
    """The URL that a template gives for a page and a token."""
    text = F.col("_template")
    for mark, value in (("{page}", (page + paging.first).cast("string")), ("{offset}", (page * paging.size).cast("string")), ("{token}", token)):
        text = F.replace(text, F.lit(mark), value)
    return text


def _judged(met: DataFrame, paging: Paging) -> DataFrame:
    """Of answers (body): how many records, a mark of their ids, the next token, the total that is said, may a page follow?"""
    value = lambda name: records.value(F.col("body"), name)
    met = met.withColumn("_items", F.coalesce(records.record_array(F.col("body"), paging.items_key), F.array().cast("array<string>")))
    ids = F.array_sort(F.transform("_items", lambda r: F.coalesce(records.value(r, paging.id_key), r)))
    more = F.col("_template").rlike(PLACEHOLDER)
    if paging.token_key:
        more = more & (F.coalesce(value(paging.token_key), F.lit("")) != "")
    if paging.more_key:
        more = more & F.coalesce(value(paging.more_key), F.lit("")).isin("true", "1")
    n = F.size("_items").cast("long")
    if paging.size:
        more = more & (n >= paging.size)
    following = F.coalesce(value(paging.token_key), F.lit("")) if paging.token_key else F.lit("")
    total = F.coalesce(value(paging.total_key).try_cast("long"), F.lit(0)) if paging.total_key else F.lit(None)
    return met.withColumns({"n": n, "_mark": F.sha2(F.to_json(ids).cast("binary"), 256), "_next": following, "_total": total.cast("long"), "_more": more}).drop("_items", "body")


def _candidates(asked: DataFrame, urls: DataFrame, paging: Paging) -> DataFrame:
    """(_request, url, page, _token): landed URLs that templates give, page null where a token says where it stands.

    A URL meets templates by what stands before the first and behind the last placeholder. What it has between them must
    give the URL again. Of these two lengths there are few pairs; each URL is cut once for each.
    """
    literal = F.length(F.regexp_replace("_template", PLACEHOLDER, ""))
    several = F.col("_template").rlike(PLACEHOLDER)
    head = F.when(several, F.regexp_extract("_template", f"(?s)^(.*?){PLACEHOLDER}", 1)).otherwise(F.col("_template"))
    tail = F.when(several, F.regexp_extract("_template", f"(?s)^.*{PLACEHOLDER}(.*)$", 1)).otherwise(F.lit(""))
    cut = asked.withColumns({"_head": head, "_tail": tail}).withColumns({"_h": F.length("_head"), "_t": F.length("_tail"), "_literal": literal})
    lengths = cut.select("_h", "_t").distinct()
    ends = urls.crossJoin(F.broadcast(lengths)).where(F.length("url") >= F.col("_h") + F.col("_t")).withColumns({"_head": F.left("url", F.col("_h")), "_tail": F.right("url", F.col("_t"))})
    met = ends.join(cut, ["_h", "_t", "_head", "_tail"])
    count = F.regexp_count("_template", F.lit(r"\{token\}"))
    token = F.when(count > 0, F.substring("url", F.col("_h") + 1, F.floor((F.length("url") - F.col("_literal")) / count).cast("int"))).otherwise(F.lit(""))
    digits = F.regexp_extract(F.substring("url", F.col("_h") + 1, F.length("url")), r"^\d{1,18}", 0)
    number = lambda size: F.left(digits, size).cast("long")
    by_offset = F.regexp_extract("_template", PLACEHOLDER, 0) == "{offset}"
    page = lambda size: F.when(by_offset, F.floor(number(size) / max(paging.size, 1)).cast("long")).otherwise(number(size) - paging.first)
    single = F.array(F.lit(0).cast("long"))
    pages_of = F.when((count > 0) | ~several, single).otherwise(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), lambda size: F.when(digits != "", page(size))), lambda p: p.between(0, 2**31 - 1)))
    found = met.select("_request", "url", "_template", token.alias("_token"), F.explode(pages_of).alias("page"), (count > 0).alias("_by_token"))
    found = found.where(_put(paging, F.col("page"), F.col("_token")) == F.col("url"))
    return found.select("_request", "_template", "url", F.when(~F.col("_by_token"), F.col("page")).cast("int").alias("page"), "_token").distinct()


def _chained(nodes: DataFrame, work: WorkTables) -> DataFrame:
    """(_request, _token, page): how many tokens lead from the first, empty one to each.

    Steps double: from all tokens within n steps the next n are reached at once, so rounds grow with the logarithm of the
    longest request. A token that comes again keeps its first place.
    """
    steps, size = 1, 0
    jumps = work.written(nodes.where("_more AND n > 0").select("_request", "_token", F.col("_next").alias("_to")), "jumps")
    reached = work.written(nodes.where("_token = ''").select("_request", "_token", F.lit(0).cast("long").alias("page")), "reached")
    while (now := reached.count()) > size:
        size = now
        ahead = reached.join(jumps, ["_request", "_token"]).select("_request", F.col("_to").alias("_token"), (F.col("page") + steps).alias("page"))
        reached = work.written(reached.unionByName(ahead).groupBy("_request", "_token").agg(F.min("page").alias("page")), "reached")
        further = jumps.select("_request", F.col("_token").alias("_from"), F.col("_to").alias("_token")).join(jumps, ["_request", "_token"])
        jumps, steps = work.written(further.select("_request", F.col("_from").alias("_token"), "_to"), "jumps"), 2 * steps
    return reached


def _in_rounds(asked: DataFrame, answers: DataFrame, paging: Paging, work: WorkTables) -> DataFrame:
    """(_request, page, url, n) of templates with a token beside a page or offset: a round for each page of the longest."""
    spark, paths, turn = asked.sparkSession, [], 0
    state = asked.withColumns({"page": F.lit(0), "_token": F.lit(""), "_got": F.lit(0).cast("long")})
    columns = "_request string, page int, url string, n long, _mark string"
    while paging.max_pages is None or turn < paging.max_pages:
        met = _judged(state.withColumn("url", _put(paging, F.col("page"), F.col("_token"))).join(answers, "url"), paging).where("n > 0")
        if paths:
            met = met.join(spark.read.schema(columns).parquet(*paths).select("_request", "_mark"), ["_request", "_mark"], "left_anti")
        found = work.written(met, "pages")
        if found.isEmpty():
            break
        paths.append(work.paths[-1])
        follow = F.col("_more") & (F.col("_got") + F.col("n") < F.col("_total") if paging.total_key else F.lit(True))
        state = found.where(follow).select("_request", "_template", (F.col("page") + 1).alias("page"), F.col("_next").alias("_token"), (F.col("_got") + F.col("n")).alias("_got"))
        turn += 1
    found = spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)
    return found.select("_request", "page", "url", "n")


def followed(requests: DataFrame, answers: DataFrame, paging: Paging = Paging(), keys: tuple[str, ...] = ("request",)) -> DataFrame:
    """(keys, page, url, body, n): every page of requests (keys, url) that landed answers (url, body) hold.

    By the rules of :class:`Paging` (``max_pages`` cuts, ``empty_pages`` isn't used: an empty or missing answer ends a
    request). All landed pages of a request are found at once, by their numbers or, by doubling steps, by the tokens that
    lead to them; then windows over short rows (no bodies) tell where it ends. Only templates with a token beside a page
    or offset are followed page after page. A request or URL that comes twice counts once (of bodies the least).
    """
    work, key = WorkTables(requests.sparkSession), list(keys)
    asked = requests.select(*key, F.col("url").alias("_template")).distinct()
    asked = work.written(asked.withColumn("_request", F.md5(F.to_json(F.struct(*key, "_template"), {"ignoreNullFields": "false"}).cast("binary"))), "asked")
    once = work.written(answers.groupBy("url").agg(F.min("body").alias("body")), "answers")
    mixed = F.contains("_template", F.lit("{token}")) & F.col("_template").rlike(r"\{(page|offset)\}")
    plain = asked.where(~mixed).select("_request", "_template")
    nodes = work.written(_judged(_candidates(plain, once.select("url"), paging).join(once, "url"), paging), "nodes")
    at = _chained(nodes.where("page IS NULL"), work)
    paged = nodes.where("page IS NOT NULL").unionByName(nodes.where("page IS NULL").drop("page").join(at.withColumn("page", F.col("page").cast("int")), ["_request", "_token"]))
    if paging.max_pages is not None:
        paged = paged.where(F.col("page") < paging.max_pages)
    in_turn = Window.partitionBy("_request").orderBy("page")
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    again = Window.partitionBy("_request", "_mark").orderBy("page")
    paged = paged.withColumns({"_first": F.row_number().over(again) == 1, "_at": F.row_number().over(in_turn) - 1, "_got": F.coalesce(F.sum("n").over(before), F.lit(0))})
    taken = F.col("_first") & (F.col("_at") == F.col("page")) & (F.col("n") > 0)
    follow = F.col("_more") & (F.col("_got") + F.col("n") < F.col("_total") if paging.total_key else F.lit(True))
    paged = paged.withColumns({"_taken": taken, "_open": F.coalesce(F.min((taken & follow).cast("int")).over(before), F.lit(1)) == 1}).where("_taken AND _open")
    found = paged.select("_request", "page", "url", "n")
    if not asked.where(mixed).isEmpty():
        found = found.unionByName(_in_rounds(asked.where(mixed).select("_request", "_template"), once, paging, work))
    out = found.join(asked, "_request").join(once, "url").select(*key, "page", "url", "body", "n")
    out = written(out, "followed")
    work.drop()
    return out


def dependent(catalog: DataFrame, answers: DataFrame, template: str, id_key: str = "id", items_key: str | None = None, paging: Paging = Paging()) -> DataFrame:
    """Pages of the requests that another answer lists: one for each record of ``catalog`` (body), by ``template`` with {id}."""
    listed = catalog.select(F.explode(records.record_array(F.col("body"), items_key)).alias("record")).select(records.value(F.col("record"), id_key).alias("request")).where("request IS NOT NULL").distinct()
    return followed(listed.withColumn("url", F.replace(F.lit(template), F.lit("{id}"), F.col("request"))), answers, paging)


class _Request(InputPartition):
    def __init__(self, at: int, request: str) -> None:
        super().__init__(at)
        self.at, self.request = at, request


def paged_source(name: str, fetch: Fetch, paging: Paging = Paging()) -> type[DataSource]:
    """A data source to register with ``spark.dataSource``: each partition is one request, followed page after page.

    Option ``requests``: a JSON list of URLs. Rows: (at, url, page, body, cut). As a stream, a batch takes ``step`` requests
    (option, 100 if unset); its offset is how many have been taken, so that with a checkpoint a stopped run goes on there.
    """

    def read(partition: _Request) -> Iterator[tuple]:
        for page, body, cut in pages(partition.request, fetch, paging):
            yield partition.at, partition.request, page, body, cut

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.requests = json.loads(options["requests"])

        def partitions(self) -> list[InputPartition]:
            return [_Request(k, url) for k, url in enumerate(self.requests)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return read(partition)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.requests, self.step, self.asked = json.loads(options["requests"]), int(options.get("step", "100")), None

        def initialOffset(self) -> dict:
            return {"taken": 0}

        def latestOffset(self) -> dict:
            taken = 0 if self.asked is None else self.asked
            self.asked = min(len(self.requests), taken + self.step)
            return {"taken": self.asked}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.asked = max(self.asked or 0, end["taken"])
            return [_Request(k, self.requests[k]) for k in range(start["taken"], end["taken"])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return read(partition)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "at int, url string, page int, body string, cut boolean"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(self.options)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return StreamReader(self.options)

    return Source
