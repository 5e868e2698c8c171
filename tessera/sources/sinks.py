"""Writers: canonical CSV, filtered exports, dropped rows, logs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validation import issues


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: str | None = None, single: bool = False) -> None:
    """Canonical columns in order, texts quoted where needed, ``\\n`` line ends; one file only if asked for."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in (columns or df.columns)])
    if order:
        out = out.orderBy(order)
    (out.coalesce(1) if single else out).write.option("header", True).option("lineSep", "\n").option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def write_excluded(rows: DataFrame, path: str) -> bool:
    """Dropped rows as JSON lines; nothing is written if there are none."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").json(path)
    return True


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new snapshot beside the old ones; what is being read is never overwritten."""
    path = f"{root}/v={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def validation_report(df: DataFrame) -> DataFrame:
    """One JSON text: rows, errors and warnings by field and issue."""
    found = df.select(F.explode(issues(df)).alias("i")).groupBy("i.severity", "i.field", "i.issue").agg(F.count(F.lit(1)).alias("n"))
    whole = found.agg(F.sort_array(F.collect_list(F.struct("severity", "field", "issue", "n"))).alias("issues"))
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    return whole.join(F.broadcast(total)).select(F.to_json(F.struct("rows", "issues")).alias("report"))


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)
