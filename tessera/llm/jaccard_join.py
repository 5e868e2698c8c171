"""N-gram Jaccard join with a token-group matrix, exact, up to components.

A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets are one node. Then:

1. Order. Shingles are ordered by how common they are (counts of all shingles in a sketch of fixed size, by powers of
   two), rare ones first. Linked sets x and y share at least min(m(x), m(y)) shingles among the first
   |x| - ceil(t|x|) + m(x) of each, where m(x) = floor(a|x|) + 1 (extended prefix filter). The order need not be exact
   for that, just the same everywhere. As |y| >= t|x|, a node needs floor(a * t|x|) + 1 shared prefix shingles to be
   linked with anything, and that many in common with a group to be linked with a member.
2. Groups. Nodes are partitioned into groups of similar ones: those whose most shared prefix shingle is the same, of like
   size, in blocks of bounded total size. A block's nodes are compared with each other and with the group's hub (the node
   with most in common), which goes to every block. So a family of near copies that fills many blocks is one component
   after a pass that is linear in its size.
3. Representatives. Components of LARGE nodes or more are families. One of each family and group is compared with the
   others of its kind (steps 4 and 5 for representatives alone); families that are linked become one.
4. Candidates. The matrix holds (shingle, group) for the groups' prefix shingles once; a family within a group is one
   row, however many nodes and blocks it has. A node queries the groups that hold enough of its prefix shingles and sets
   of fitting size, but not those of its own family. Rows are (node, group), never pairs of nodes. One of two groups
   queries the other: one that isn't a family queries families, so a family's many nodes don't query every group near it.
5. Bound, then open. A task gets a block of a group and some of its queries, builds the union of the members' shingles,
   and drops queries that share less than t|x| with the union; for the others it counts exact intersections with the
   members. Links within a task are reduced to a forest.
6. Components of the links, by large-star and small-star steps; every document gets its set's component.

So nodes of one family are never compared across blocks once they are known to be connected; what is left are nodes that
link with none in their block. Shingles in cells of the sketch beyond HOT rows are dealt out by shingle and salt. Exact
copies meet map-side before any shuffle of shingles. Texts are hashed once for the sketch, once for prefixes, and those
of candidates once for their sets, which are written. The driver gets the sketch (4 MB) and counts; tasks get its levels
and a Bloom filter of bounded size. Where only the first 64 bits of a set's 128 are compared, equal ones add candidates,
never links. Two shingles count as equal when their 64-bit hashes are.

Defined results: a document of fewer words than a shingle is one shingle, the whole sequence; a null text or one without
words has an empty set, links with nothing and is its own component; a very long text is one set, whole; rows that share a
doc_id count as versions of one document; a null doc_id sorts first and stays null (inside, it is the id -2**63, which
therefore comes back as null); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import WorkTables, array_parts, merged_array, numbered, partitions, written
from .textblocks import BASE, MIX1, MIX2, MIX3, U, blocks, mix
from .url_filter import Bloom

NULL_ID = -(2**63)
PROFILE = "doc_id long, n long, hi long, lo long, chunk int, part binary"
#: A shingle whose cell of the sketch holds more than 2**HOT rows is salted, 2**SALT_BITS ways at most.
HOT, SALT_BITS = 16, 16
#: Nodes from which on a component counts as a family.
LARGE = 32


@dataclass(frozen=True)
class Settings:
    """shingle: words in a shingle. percent: least Jaccard similarity. more_percent: the prefix is longer by this share
    of the set, and as much must be shared (a, in percent). sketch_bits: logarithm of the sketch's cells.
    block_tokens and chunk_tokens: shingles of a group's members, and of its queries, in a task. hot and large: see HOT
    and LARGE; they change the way, not the result."""

    shingle: int = 5
    percent: int = 75
    more_percent: int = 10
    sketch_bits: int = 22
    block_tokens: int = 1 << 17
    chunk_tokens: int = 1 << 16
    hot: int = HOT
    large: int = LARGE


def shingle_sets(values: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, ascending distinct shingle hashes) of each text; A-Z are lower-cased."""
    for block in blocks(values, 1 << 20):
        words = block.hashes(lower=True)
        bounds = block.word_bounds.tolist()
        if len(words) >= size:
            h = words[: len(words) - size + 1] * MIX1
            for k in range(1, size):
                h = (h ^ (h >> U(31))) * MIX2 + words[k : len(words) - size + 1 + k]
            h = mix(h * BASE)
        for k in range(len(block)):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= size:
                yield block.first + k, np.unique(h[a : b - size + 1])
            elif b > a:
                x = np.full(1, b - a, U) * MIX3
                for w in words[a:b]:
                    x = mix(x * BASE + w)
                yield block.first + k, x
            else:
                yield block.first + k, np.zeros(0, U)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def prefix_length(n: int, percent: int, more_percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + more_percent * n // 100 + 1) if n else 0


class Group:
    """Members of a group with their union, for queries."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate([sets[k] for k in which]) if len(which) else np.zeros(0, U)
        owners = np.repeat(which, self.sizes[which])
        order = np.argsort(tokens, kind="stable")
        tokens, self.owners = tokens[order], owners[order]
        self.at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))[: len(tokens)]
        self.union, self.counts = tokens[self.at], np.diff(np.append(self.at, len(tokens)))

    def linked(self, x: np.ndarray, percent: int) -> np.ndarray:
        """Members whose similarity with ``x`` is high enough; the bound on the union comes first."""
        if not len(self.union) or not len(x):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.union, x), len(self.union) - 1)
        hits = place[self.union[place] == x]
        if 100 * len(hits) < percent * len(x):
            return np.zeros(0, np.int64)
        n = self.counts[hits]
        found = self.owners[np.repeat(self.at[hits] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        both = np.bincount(found, minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (100 * both >= percent * (len(x) + self.sizes - both)))


class Forest:
    """Links between numbered nodes, kept only where they connect what wasn't connected yet."""

    def __init__(self, nodes: list[int]) -> None:
        self.nodes, self.parent, self.links = nodes, list(range(len(nodes))), []

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((self.nodes[a], self.nodes[b]))


def links_within(nodes: list[int], sets: list[np.ndarray], percent: int, hubs: int = 4) -> list[tuple[int, int]]:
    """Links that connect what is connected by links between the nodes. What links with the same hub needn't be compared."""
    out, label, everyone = Forest(nodes), np.full(len(nodes), -1, np.int64), Group(sets, np.arange(len(nodes)))
    if len(nodes) > 8:
        for hub in range(len(nodes)):
            if hubs and label[hub] < 0:
                hubs -= 1
                near = everyone.linked(sets[hub], percent)
                label[near[label[near] < 0]] = hub
                for k in near.tolist():
                    out.join(hub, k)
    largest = int(np.bincount(label[label >= 0]).argmax()) if (label >= 0).any() else -2
    rest = Group(sets, np.flatnonzero(label != largest)) if largest >= 0 else everyone
    for k in range(len(nodes)):
        for j in (rest if label[k] == largest else everyone).linked(sets[k], percent).tolist():
            if j != k:
                out.join(j, k)
    return out.links


def links_across(nodes: list[int], sets: list[np.ndarray], n_members: int, percent: int) -> list[tuple[int, int]]:
    """Links between the members (the first n_members) and the others, as far as they connect anything."""
    out, members = Forest(nodes), Group(sets, np.arange(n_members))
    for k in range(n_members, len(nodes)):
        for j in members.linked(sets[k], percent).tolist():
            out.join(j, k)
    return out.links


def _profile(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n, hi, lo) of each row, then the task's part of the sketch."""
    shift = U(64 - s.sketch_bits)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << s.sketch_bits, np.uint32)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        names = ["doc_id", "n", "hi", "lo", "chunk", "part"]

        def count(held: list[np.ndarray]) -> None:
            np.add.at(sketch, (np.concatenate(held) >> shift).astype(np.int64), 1)
            held.clear()

        for batch in batches:
            sizes, sigs, held, n = [], [], [], 0
            for _, tokens in shingle_sets(batch.column(1), s.shingle):
                sizes.append(len(tokens))
                sigs.append(signature(tokens))
                held.append(tokens)
                n += len(tokens)
                if n > 1 << 17:
                    count(held)
                    n = 0
            if held:
                count(held)
            if sizes:
                none = [None] * len(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip((sizes, [a for a, _ in sigs], [b for _, b in sigs], none, none), types[1:])]], names)
        ids, data = array_parts(sketch)
        none = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, none, ids, data), types)], names)

    return profile


def _prefixes(s: Settings, levels: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(tok, salt, sig): prefix shingles of each distinct set that a task sees. ``salt`` is 0 but for hot shingles: the
    logarithm of the number of salts in the upper bits, one of them in the lower SALT_BITS."""
    shift = U(64 - s.sketch_bits)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()

        def rows(held: list[np.ndarray], sigs: list[int]) -> pa.RecordBatch:
            tok, sig = np.concatenate(held), np.repeat(np.array(sigs, np.int64), [len(h) for h in held])
            excess = np.clip(level[(tok >> shift).astype(np.int64)].astype(np.int64) - s.hot, 0, SALT_BITS)
            salt = excess << SALT_BITS | (mix(sig.view(U)) & ((1 << excess) - 1).astype(U)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(sig)], ["tok", "salt", "sig"])

        for batch in batches:
            held, sigs, n = [], [], 0
            for _, tokens in shingle_sets(batch.column(1), s.shingle):
                sig = signature(tokens)
                if len(tokens) and sig not in seen:  # copies meet here, before the shuffle
                    seen.add(sig)
                    order = np.argsort(level[(tokens >> shift).astype(np.int64)], kind="stable")
                    held.append(tokens[order[: prefix_length(len(tokens), s.percent, s.more_percent)]])
                    sigs.append(sig[0])
                    n += len(held[-1])
                    if n > 1 << 17:
                        yield rows(held, sigs)
                        held, sigs, n = [], [], 0
            if len(seen) > 1_000_000:  # copies that are missed here meet in the shuffle
                seen = set()
            if held:
                yield rows(held, sigs)

    return prefixes


def _sets(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, hi, lo, tokens) of each row, once for a task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["node", "hi", "lo", "tokens"])

        for batch in batches:
            ids, out, size = batch.column(0).to_pylist(), [], 0
            for k, tokens in shingle_sets(batch.column(1), s.shingle):
                one = (ids[k], *signature(tokens))
                if len(tokens) and one not in seen:
                    seen.add(one)
                    out.append((*one, tokens.tobytes()))
                    size += 8 * len(tokens)
                if size > 4 << 20:
                    yield rows(out)
                    out, size = [], 0
            if len(seen) > 1_000_000:
                seen = set()
            if out:
                yield rows(out)

    return sets


def _linked(table: pa.Table, across: bool, percent: int) -> pa.Table:
    """Links in a task's table (role, node, tokens): between all, or between members (role 0) and queries."""
    table = table.sort_by([("role", "ascending"), ("node", "ascending")])
    names, role = table["node"].to_pylist(), table["role"].to_pylist()
    sets = [np.frombuffer(x.as_buffer(), U) for x in table["tokens"]]
    links = links_across(names, sets, role.count(0), percent) if across else links_within(names, sets, percent)
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


def _enough(s: Settings) -> Column:
    """Shared prefix shingles below which a set of ``n`` shingles links with nothing."""
    return F.expr(f"{s.more_percent * s.percent} * n div 10000 + 1")


def _block_links(sets: DataFrame, s: Settings) -> DataFrame:
    """Links within blocks, and between each block and its group's hub."""
    blk = F.explode(F.when(F.col("is_hub"), F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array(F.col("blk").cast("int"))))
    rows = sets.where("m > 1").select("grp", blk.alias("blk"), F.when(F.col("is_hub"), 0).otherwise(1).alias("role"), "node", "tokens")
    return rows.groupBy("grp", "blk").applyInArrow(lambda table: _linked(table, False, s.percent), "u long, v long")


def _asking(held: DataFrame, columns: DataFrame, s: Settings) -> DataFrame:
    """Nodes (``held``: tok, node, n, fam, comp) with the groups of another family (``columns``: tok, to, to_comp, lo_n, hi_n)
    that share a shingle, one row for each; one of two groups asks.

    A family is asked by what isn't one: its nodes may be many, and each would ask every group near the family.
    """
    single, to_single = F.col("comp").isNull(), F.col("to_comp").isNull()
    asks = F.when(single == to_single, F.col("to") > F.col("fam")).otherwise(single)
    fits = asks & (100 * F.col("hi_n") >= s.percent * F.col("n")) & (s.percent * F.col("lo_n") <= 100 * F.col("n"))
    foreign = single | to_single | (F.col("comp") != F.col("to_comp"))
    return held.join(columns, "tok").where(fits & foreign)


def _cross_links(nodes: DataFrame, entries: DataFrame, sets: DataFrame, work: WorkTables, s: Settings) -> DataFrame:
    """Links between different groups. ``nodes`` has node, hi, n, its group ``fam`` and family ``comp`` (null: none)."""
    held = entries.select("tok", F.col("sig").alias("hi")).join(nodes.select("node", "hi", "n", "fam", "comp"), "hi")
    matrix = held.groupBy("tok", "fam", "comp").agg(F.min("n").alias("lo_n"), F.max("n").alias("hi_n"))
    several = matrix.groupBy("tok").agg(F.min("fam").alias("a"), F.max("fam").alias("b")).where("a < b").select("tok")
    columns = matrix.join(several, "tok").select("tok", F.col("fam").alias("to"), F.col("comp").alias("to_comp"), "lo_n", "hi_n")
    asked_for = _asking(held, columns, s).groupBy("node", "hi", "n", "to").agg(F.count(F.lit(1)).alias("in_common"))
    queries = work.written(asked_for.where(F.col("in_common") >= _enough(s)).select("node", "hi", "n", "to"), "queries")

    count = lambda total, size: F.greatest(F.lit(1), F.ceil(F.sum("n") / size)).cast("int").alias(total)
    asked = queries.groupBy(F.col("to").alias("fam")).agg(count("chunks", s.chunk_tokens))
    groups = nodes.groupBy("fam").agg(count("blocks", s.block_tokens)).join(asked, "fam")
    place = lambda n: F.pmod(F.xxhash64("node", "hi"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = nodes.select("node", "hi", "fam").join(groups, "fam").select("node", "hi", F.col("fam").alias("to"), place("blocks").alias("blk"), all_of("chunks").alias("chunk"), F.lit(0).alias("role"))
    asking = queries.join(groups.withColumnRenamed("fam", "to"), "to").select("node", "hi", "to", all_of("blocks").alias("blk"), place("chunks").alias("chunk"), F.lit(1).alias("role"))
    targets = work.written(members.unionByName(asking), "targets")
    asked_sets = Bloom.sized(targets.count())
    needed = asked_sets.flagged(sets.select("node", "hi", "tokens"), asked_sets.build(targets.select("node"), "node"), "node", "needed").where("needed").drop("needed")
    rows = targets.join(needed.hint("shuffle_merge"), ["node", "hi"])
    return rows.groupBy("to", "blk", "chunk").applyInArrow(lambda table: _linked(table, True, s.percent), "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    s, parts, cells = settings, partitions(spark), 1 << settings.sketch_bits
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    profiles = written(rows.mapInArrow(_profile(s), PROFILE), "profiles")
    counts = merged_array(profiles.where("chunk IS NOT NULL").select("chunk", "part"), cells, "uint32", "sum")
    levels = spark.sparkContext.broadcast(np.ceil(np.log2(counts.astype(np.float64) + 1)).astype(np.uint8))
    known = profiles.where("chunk IS NULL").select("doc_id", "n", "hi", "lo")

    # One shuffle of prefix shingles; the aggregate, the join and the removal of copies below all use it. Whether a salted
    # shingle is shared isn't asked: it counts as shared (which only adds candidates), and as common as its cell.
    dealt = rows.mapInArrow(_prefixes(s, levels), "tok long, salt int, sig long").repartition(parts, "tok", "salt")
    met = dealt.groupBy("tok", "salt").agg(F.min("sig").alias("a"), F.max("sig").alias("b"), F.count(F.lit(1)).alias("c"))
    common = F.call_function("shiftleft", F.lit(1).cast("long"), s.hot + F.shiftright("salt", SALT_BITS))
    shared = met.where("a < b OR salt > 0").select("tok", "salt", F.when(F.col("salt") > 0, common).otherwise(F.col("c")).alias("c"))
    work = WorkTables(spark)
    entries = work.written(dealt.join(shared, ["tok", "salt"]).distinct().drop("salt"), "entries")

    reps = known.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("node"))
    keys = entries.groupBy(F.col("sig").alias("hi")).agg(F.max(F.struct("c", "tok")).getField("tok").alias("key"), F.count(F.lit(1)).alias("in_common"))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / s.percent)))).cast("int")
    sized = reps.join(keys, "hi").where(F.col("in_common") >= _enough(s)).withColumn("grp", F.xxhash64("key", size_class))
    groups = sized.groupBy("grp").agg(F.ceil(F.sum("n") / s.block_tokens).alias("blocks"), F.count(F.lit(1)).alias("m"), F.max(F.struct("in_common", "hi", "lo")).alias("hub"))
    blocked = sized.join(groups, "grp").withColumns({"blk": F.pmod(F.xxhash64("node", "hi"), F.col("blocks")), "is_hub": (F.col("hub.hi") == F.col("hi")) & (F.col("hub.lo") == F.col("lo"))})
    nodes = work.written(blocked.select("node", "hi", "lo", "n", "in_common", "grp", "blk", "blocks", "m", "is_hub"), "nodes")

    bloom = Bloom.sized(nodes.count())
    likely = bloom.flagged(rows, bloom.build(nodes.select("node"), "node"), "doc_id", "maybe").where("maybe").drop("maybe")
    # Sets are joined by sorting, whatever their number: what is quicker for few of them doesn't hold for many.
    sets = work.written(likely.mapInArrow(_sets(s), "node long, hi long, lo long, tokens binary").join(nodes.hint("shuffle_merge"), ["node", "hi", "lo"]), "sets")

    found = work.written(components(_block_links(sets, s)), "components")

    def with_families(found: DataFrame) -> DataFrame:
        """The nodes with their family, and groups in which a family is one row of the matrix."""
        large = found.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= s.large).select("component")
        families = found.join(large, "component").select("node", F.col("component").alias("comp"))
        group = F.when(F.col("comp").isNull(), F.xxhash64("grp", "blk")).otherwise(F.xxhash64("grp", "comp", F.lit("family")))
        return nodes.join(families, "node", "left").withColumn("fam", group)

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        stars = found.where("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v"))
        return components(stars.unionByName(links))

    leaders = with_families(found).where("comp IS NOT NULL").groupBy("fam", "comp").agg(F.max(F.struct("in_common", "n", "node", "hi")).alias("one")).select("one.node", "one.hi", "one.n", "comp")
    leaders = work.written(leaders.withColumn("fam", F.xxhash64("node", "hi")), "leaders")
    if leaders.limit(2).count() > 1:
        found = work.written(joined(found, _cross_links(leaders, entries, sets, work, s)), "components")
    families = work.written(with_families(found).select("node", "hi", "n", "fam", "comp"), "families")
    found = joined(found, _cross_links(families, entries, sets, work, s))
    work.drop()  # what is left reads the profiles and the last round's edges

    labelled = reps.join(found, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component_id"))
    full = known.where("n > 0").join(labelled, ["hi", "lo"]).select("doc_id", "n", "component_id")
    empty = known.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    result = full.unionByName(empty)
    null_back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return result.select(null_back("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), null_back("component_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those of a component that isn't named after them.

    Rows that a Bloom filter of the dropped ids passes go to an exact anti join; the others aren't shuffled at all.
    """
    found = written(jaccard_components(docs, id_col, text_col, settings), "components")
    dropped = written(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    bloom, rows = Bloom.sized(dropped.count()), numbered(docs)
    key = F.col(rows.columns[docs.columns.index(id_col)]).cast("long")
    flagged = bloom.flagged(rows.withColumn("key", key), bloom.build(dropped, "dropped"), "key", "maybe")
    unsure = flagged.where("maybe").join(dropped, F.col("key") == F.col("dropped"), "left_anti")
    return flagged.where("NOT maybe").unionByName(unsure).select(*rows.columns).toDF(*docs.columns)
