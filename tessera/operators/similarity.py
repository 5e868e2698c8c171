"""Joins of similar texts through inverted indexes: containment by a key's rarest gram, set similarity by rare tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.work import WorkTables, by_key, written

#: Letters of a gram where no least length of keys is given.
GRAM = 6


def grams(rows: DataFrame, key: str, size: int) -> DataFrame:
    """A row for each different gram of ``size`` letters of the key (the key itself if ``size`` is 0: one empty gram)."""
    if not size:
        return rows.withColumn("gram", F.lit(""))
    each = F.transform(F.sequence(F.lit(1), F.length(key) - size + 1), lambda i: F.substring(F.col(key), i, F.lit(size)))
    return rows.where(F.length(key) >= size).withColumn("gram", F.explode(F.array_distinct(each)))


def contained(short: DataFrame, long: DataFrame, by: list[str], key: str, least: int, extra: Column | None = None) -> DataFrame:
    """Pairs of rows a of ``short`` and b of ``long`` that agree on ``by`` where b's key, the longer one, holds a's.

    What holds a key holds its rarest gram, so a row asks once, by the gram that the fewest rows of ``long`` have; a key
    with a gram that none has asks nothing. ``least``: letters of a gram, and of the keys that take part. The result has
    the columns of both as ``a.*`` and ``b.*``; ``extra`` is a further test of them.
    """
    every = grams(long, key, least)
    common = every.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = grams(short, key, least).join(by_key(common), [*by, "gram"], "left")
    rarest = asked.groupBy(*short.columns).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_g")).where("_g.n > 0")
    a, b = rarest.select(*short.columns, F.col("_g.gram").alias("gram")).alias("a"), every.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "gram")]
    holds = (F.length(f"a.{key}") < F.length(f"b.{key}")) & F.contains(F.col(f"b.{key}"), F.col(f"a.{key}"))
    return a.join(by_key(b), [*on, holds] if extra is None else [*on, holds, extra])


def classes_of(df: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The different values of ``keys``, each with its first ``top`` + 1 handles in order (``h``)."""
    from .joins import first_of

    return first_of(df.select("handle", *keys), keys, ["handle"], top + 1).groupBy(*keys).agg(F.sort_array(F.collect_list("handle")).alias("h"))


def spelled(pairs: DataFrame, top: int) -> DataFrame:
    """(u, v, s) of the ``top`` best pairs of rows out of pairs of classes (s, x, y), x and y being lists of first handles.

    A pair of classes beyond the best ``top`` has no pair of rows before any of theirs, so these are enough.
    """
    best = pairs.withColumns({"u": F.least(F.col("x")[0], F.col("y")[0]), "v": F.greatest(F.col("x")[0], F.col("y")[0])})
    best = best.withColumn("v", F.when((F.col("x") == F.col("y")), F.get("x", 1)).otherwise(F.col("v"))).orderBy(F.desc("s"), "u", "v").limit(top)
    rows = best.select("s", F.explode("x").alias("x"), "y").select("s", "x", F.explode("y").alias("y")).where("x <> y")
    return rows.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "s").distinct().orderBy(F.desc("s"), "u", "v").limit(top)


def contained_top(df: DataFrame, by: list[str], key: str, top: int) -> DataFrame:
    """(u, v): of rows that agree on ``by`` with different keys of which one holds the other, the ``top`` with most letters.

    Keys shorter than a gram ask by themselves, by length; there are fewer lengths than letters in a gram.
    """
    work = WorkTables(df.sparkSession)
    rows = work.written(classes_of(df.dropna(subset=[*by, key]), [*by, key], top), "classes")
    classes = lambda found: found.select((F.length(f"a.{key}") + F.length(f"b.{key}")).alias("s"), F.col("a.h").alias("x"), F.col("b.h").alias("y"))
    pairs = classes(contained(rows, rows, by, key, GRAM))
    for n in sorted(r["n"] for r in rows.where(F.length(key) < GRAM).select(F.length(key).alias("n")).distinct().collect()):
        pairs = pairs.unionByName(classes(contained(rows.where(F.length(key) == n), rows, by, key, n)))
    out = written(spelled(pairs, top), "contained")
    work.drop()
    return out.select("u", "v").orderBy(F.desc("s"), "u", "v")


def token_order(sets: DataFrame, by: list[str], tokens: str) -> DataFrame:
    """The sets with their tokens in one order for all, rarest first (``tokens``), and ``n``, how many."""
    each = sets.select("id", *by, F.explode(tokens).alias("tok"))
    common = each.groupBy(*by, "tok").agg(F.count(F.lit(1)).alias("c"))
    ordered = each.join(common, [*by, "tok"]).groupBy("id", *by).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "tok"))), lambda t: t["tok"]).alias("tokens"))
    return ordered.withColumn("n", F.size("tokens"))


def alike(ordered: DataFrame, by: list[str], least: float) -> DataFrame:
    """(a, b, s): pairs of sets a < b that agree on ``by`` with a Jaccard similarity s above ``least``.

    Two such sets share one of their n - floor(least * n) rarest tokens. They meet by these alone, if their sizes allow it
    and if the tokens from there on could suffice (the first that they share passes this test); then whole sets are compared.
    """
    cut = lambda n: n - F.floor(F.lit(least) * n)
    prefix = ordered.select("id", *by, "n", F.posexplode(F.slice("tokens", 1, cut(F.col("n")).cast("int"))).alias("at", "tok"))
    a, b = prefix.alias("a"), prefix.alias("b")
    need = F.floor(F.lit(least / (1 + least)) * (F.col("a.n") + F.col("b.n")) - 1e-9) + 1
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    fits = (F.least("a.n", "b.n") > least * F.greatest("a.n", "b.n")) & (left >= need)
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "tok")] + [F.col("a.id") < F.col("b.id"), fits])
    pairs = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    own = lambda side: ordered.select(F.col("id").alias(side), F.col("tokens").alias(f"_{side}"))
    both = F.size(F.array_intersect("_a", "_b"))
    s = both / (F.size("_a") + F.size("_b") - both)
    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", s.alias("s")).where(F.col("s") > least)


def similar_top(df: DataFrame, text: Column, by: list[str], least: float, top: int) -> DataFrame:
    """(u, v, similarity): of rows that agree on ``by``, the ``top`` pairs most alike by trigrams, above ``least``.

    Rows with the same trigrams are one class. Classes are compared at a high similarity first: if that gives ``top`` pairs,
    these are the best of all, else the bound is lowered, at last to ``least``. The higher it is, the fewer classes meet.
    """
    work = WorkTables(df.sparkSession)
    sets = df.select("handle", *by, F.array_sort(F.transform(X.trigrams(text), lambda t: F.xxhash64(t))).alias("t")).where(F.size("t") > 0).dropna(subset=by)
    rows = work.written(classes_of(sets, [*by, "t"], top).withColumn("id", F.col("h")[0]), "classes")
    ordered = work.written(token_order(rows, by, "t"), "tokens")
    within = rows.where(F.size("h") > 1).select(F.lit(1.0).alias("s"), F.col("h").alias("x"), F.col("h").alias("y"))
    first = lambda side: rows.select(F.col("id").alias(side), F.col("h").alias({"a": "x", "b": "y"}[side]))
    for bound in sorted({least, *(b for b in (0.7, 0.9) if b > least)}, reverse=True):
        across = alike(ordered, by, bound).join(first("a"), "a").join(first("b"), "b").select("s", "x", "y")
        best = written(spelled(across.unionByName(within), top), "similar")
        if bound == least or best.where(F.col("s") > bound).count() >= top:
            work.drop()
            return best.withColumnRenamed("s", "similarity").orderBy(F.desc("similarity"), "u", "v")
    raise AssertionError("the last bound is the least")
