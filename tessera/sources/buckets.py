"""Tables in buckets of keys: a batch rewrites the buckets that it touches, and a manifest, put in place by a rename, makes
the new files the table.

``data/v=<version>-<id>/b=<bucket>`` holds Parquet files, ``manifest/<version>.json`` says for each bucket in which of
these folders its rows are. A batch reads and writes only the buckets of its own keys, so the bytes written follow the
batch (and the size of a bucket), not the table. Until its manifest stands, a batch has changed nothing: one that fails
leaves the version before, and its files are no one's. Of two writers of one version the second fails at the rename and
may try again. A writer that numbers its batches gets each applied once, also when it is repeated after the commit.

The number of buckets is fixed when the table is made; the manifest, and what the driver holds, has one short entry for
each. Keys are hashed, so buckets are even; all rows of one key are in one bucket. Renames must be atomic, as on HDFS or a
shared file system. Defined results: null keys share a bucket; an empty batch makes no version; an empty table has no buckets and
keeps its columns; columns named as the two folders are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.work import WorkTables

#: Takes the rows of the touched buckets and the batch; gives these buckets' rows as they are to be.
Merge = Callable[[DataFrame, DataFrame], DataFrame]
VERSION, BUCKET = "v", "b"


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    n_buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n_buckets)).cast("int")


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n.split(".")[0]) for n in _names(spark, f"{root}/manifest") if n[:1].isdigit()]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """That of a version, or the newest."""
    if version is None:
        version = versions(spark, root)[-1]
    text = spark.read.text(f"{root}/manifest/{version:08d}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def _commit(spark: SparkSession, root: str, new: Manifest) -> None:
    jvm = spark.sparkContext._jvm
    fs, draft = _files(spark, f"{root}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(asdict(new)).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{new.version:08d}.json"), plain)
    finally:  # what a lost race leaves behind
        fs.delete(draft, False)


def _written(spark: SparkSession, root: str, df: DataFrame, m: Manifest) -> dict[str, str]:
    """Write rows by bucket into a folder of their own; the folder of each bucket that has rows."""
    folder = f"{VERSION}={m.version:08d}-{uuid.uuid4().hex}"
    df.withColumn(BUCKET, m.bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/data/{folder}")
    return {n.split("=")[1]: folder for n in _names(spark, f"{root}/data/{folder}") if n.startswith(f"{BUCKET}=")}


def create(df: DataFrame, root: str, key: str, n_buckets: int) -> Manifest:
    """Make the table (version 0) of a DataFrame."""
    if {VERSION, BUCKET} & set(df.columns):
        raise ValueError(f"columns can't be named {VERSION} or {BUCKET}")
    first = Manifest(0, key, n_buckets, df.schema.json())
    made = Manifest(**{**asdict(first), "folders": _written(df.sparkSession, root, df, first)})
    _commit(df.sparkSession, root, made)
    return made


def _rows(spark: SparkSession, root: str, m: Manifest, wanted: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(m.schema))
    paths = [f"{root}/data/{folder}/{BUCKET}={b}" for b, folder in m.folders.items() if wanted is None or b in wanted]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of a version, or as it is."""
    return _rows(spark, root, manifest(spark, root, version))


def apply(spark: SparkSession, root: str, batch: DataFrame, merge: Merge, writer: str = "", number: int | None = None) -> Manifest:
    """The table after a batch: rows of the touched buckets are replaced by what ``merge`` makes of them and the batch.

    With a ``number``, a batch that its writer has applied already (or a later one) is passed over.
    """
    now = manifest(spark, root)
    if number is not None and now.applied.get(writer, -1) >= number:
        return now
    work = WorkTables(spark)
    try:
        rows = work.written(batch.withColumn(BUCKET, now.bucket()), "batch")
        touched = {str(r[0]) for r in rows.select(BUCKET).distinct().collect()}
        if touched:
            new = merge(_rows(spark, root, now, touched), rows.drop(BUCKET)).select(*[F.col(f"`{c}`") for c in StructType.fromJson(json.loads(now.schema)).names])
            following = Manifest(now.version + 1, now.key, now.n_buckets, now.schema)
            placed = _written(spark, root, new, following)
            strangers = sorted(set(placed) - touched)
            if strangers:
                raise ValueError(f"a batch may only give rows of its own buckets, not of {strangers[:5]}")
            folders = {b: f for b, f in now.folders.items() if b not in touched} | placed
            applied = now.applied | ({writer: number} if number is not None else {})
            now = Manifest(following.version, now.key, now.n_buckets, now.schema, folders, applied)
            _commit(spark, root, now)
    finally:
        work.drop()
    return now


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove all versions but the last ones, and the buckets that none of these names; how many buckets went.

    For times when no batch is being applied: its files aren't in any manifest yet.
    """
    known = versions(spark, root)
    used = {(f, b) for v in known[-keep:] for b, f in manifest(spark, root, v).folders.items()}
    for v in known[:-keep]:
        fs, where = _files(spark, f"{root}/manifest/{v:08d}.json")
        fs.delete(where, False)
    gone = 0
    for folder in _names(spark, f"{root}/data"):
        for name in _names(spark, f"{root}/data/{folder}"):
            if name.startswith(f"{BUCKET}=") and (folder, name.split("=")[1]) not in used:
                fs, where = _files(spark, f"{root}/data/{folder}/{name}")
                fs.delete(where, True)
                gone += 1
        if not any(f == folder for f, _ in used):
            fs, where = _files(spark, f"{root}/data/{folder}")
            fs.delete(where, True)
    return gone
