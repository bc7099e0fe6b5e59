"""Exact Jaccard join of documents on word shingles: a grouped prefix join.

1. Shingles get one global order, rare ones first: by a fixed-size table of
   bucket counts over all documents, then by hash.
2. Documents with equal shingle sets collapse into a class, classes with equal
   prefixes and sizes into a group.  The prefix of a set of n is its first
   n - ceil(t n) + 1 shingles; two sets that link share one of them.
3. Group pairs that share a prefix shingle are filtered by size and by the
   number of shared prefix shingles: the group whose prefix ends first lacks
   every shingle of it that is not shared, which bounds the overlap.
4. The groups are expanded and the members' whole sets are compared exactly.

Keys that very many rows share never fill a task: they are broadcast, or dealt
into parts that meet in pairs.  Members of a run meet only within the sizes that
can link.

Only connections are asked for, so a first round compares every group with one
partner (its best among the busiest groups that share a shingle with it), the
components of the links found are merged, and a second round compares every
remaining pair whose ends lie in different components.  No pair is dropped
that could change the result, and copies never make all their pairs.

Defined results: a null or empty text, or one of white space, has no shingles
and links with nothing; texts of fewer words than a shingle have one, the whole
sequence; repeated rows link; null ids take part but never name a component;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import words
from larkspur.llm.common import HOT_ROWS, drop_table, join_counted, materialise, prepare_workers, release
from larkspur.llm.components import components

BUCKETS = 1 << 20
CHUNK = 1 << 14
NEVER = -1
#: Rows of five longs that are broadcast at most.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Threshold:
    """Link where over * intersection >= under * union; shingles of `words` words."""

    words: int = 5
    under: int = 80
    over: int = 100

    def prefix(self, size: int) -> int:
        return size - -(-self.under * size // self.over) + 1


def bucket_counts(rows: DataFrame, text: str, size: int) -> np.ndarray:
    """How often the shingles of each of BUCKETS hash buckets occur over all rows: a table of fixed size."""

    def count(batches):
        release()
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for first, found, offsets in words.blocks(batch.column(0).to_pylist()):
                if len(found) >= size:
                    flat = np.full(len(found) - size + 1, size, np.uint64)
                    for k in range(size):
                        flat += found[k : len(found) - size + 1 + k] * words.SHINGLE_WEIGHTS[k]
                    held += np.bincount((words.mix(flat) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        parts = [zlib.compress(held[i : i + CHUNK].tobytes(), 1) for i in range(0, BUCKETS, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(key, table):
        total = np.zeros(CHUNK, np.int64)
        for one in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(one), np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, counts binary"
    counted = rows.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(count, schema)
    salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    summed = salted.groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros(BUCKETS, np.int64)
    for row in summed.collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def set_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles."""
    a = words.mix(found ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
    b = words.mix(found * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(found))).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def profiles(rows: DataFrame, id: str, text: str, rule: Threshold) -> DataFrame:
    """(id, n, k1, k2, prefix) of every row; the prefix is in the global order."""
    counts = rows.sparkSession.sparkContext.broadcast(bucket_counts(rows, text, rule.words))

    def describe(batches):
        release()
        order = counts.value
        for batch in batches:
            n, k1, k2, prefixes = [], [], [], []
            for _, own in words.shingle_sets(batch.column(1).to_pylist(), rule.words):
                n.append(len(own))
                a, b = set_key(own)
                k1.append(a)
                k2.append(b)
                keep = rule.prefix(len(own)) if len(own) else 0
                rank = order[(own & np.uint64(BUCKETS - 1)).astype(np.int64)]
                if 4 * keep < len(own):  # only the front of the order is needed
                    edge = np.partition(rank, keep - 1)[keep - 1]
                    near = np.flatnonzero(rank <= edge)
                    own, rank = own[near], rank[near]
                own = own.view(np.int64)
                prefixes.append(own[np.lexsort((own, rank))[:keep]])
            offsets = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "n", "k1", "k2", "prefix"])

    picked = rows.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return picked.mapInArrow(describe, "id long, n long, k1 long, k2 long, prefix array<long>")


def whole_sets(rows: DataFrame, id: str, text: str, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, shingles) of the wanted classes (cid, id, k1, k2), from the texts of the rows that stand for them.

    Up to BROADCAST_ROWS of them are sent to the texts; beyond that both sides are shuffled.
    A class may come more than once where its row is repeated.
    """
    picked = rows.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = picked.join(F.broadcast(wanted) if few else wanted, picked["id"].eqNullSafe(wanted["id"])).select("cid", "k1", "k2", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def read(batches):
        release()
        seen = set()
        for batch in batches:
            cids, sets = [], []
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for i, own in words.shingle_sets(batch.column(3).to_pylist(), size):
                if keys[i][0] not in seen and set_key(own) == keys[i][1:]:
                    seen.add(keys[i][0])
                    cids.append(keys[i][0])
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return held.mapInArrow(read, "cid long, shingles binary")


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, id: str, text: str, rule: Threshold) -> DataFrame:
    """Those of the pairs (a, b) of classes whose whole sets link."""
    wanted = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = materialise(classes.select("cid", "id", "k1", "k2").join(wanted, "cid"), "wanted")
    sets = materialise(whole_sets(rows, id, text, wanted, rule.words), "sets")
    # A class of very many pairs is dealt into parts, each with a copy of its set.
    sizes = {side: materialise(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("size")), f"ends-{side}") for side in ("a", "b")}
    parts = F.ceil(F.col("size") / F.lit(HOT_ROWS)).cast("int")
    dealt = pairs
    for side, other in (("a", "b"), ("b", "a")):
        dealt = join_counted(dealt, sizes[side], [side], "size").withColumn(f"part_{side}", F.pmod(F.xxhash64(other), parts).cast("int")).drop("size")
    held = materialise(dealt, "dealt")
    for side in ("a", "b"):
        own = sets.select(F.col("cid").alias(side), F.col("shingles").alias(f"s{side}")).join(sizes[side], side)
        held = held.join(own.withColumn(f"part_{side}", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size"), [side, f"part_{side}"])

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(rule.over * both >= rule.under * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialise(held.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"), "links")
    drop_table(sets)
    return found


def link(rows: DataFrame, rule: Threshold = Threshold(), *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: (id, n_shingles, component), the smallest id reachable by links."""
    prepare_workers(rows.sparkSession)
    described = materialise(profiles(rows, id, text, rule), "profiles")
    some = described.where(F.col("n") > 0)
    classes = materialise(some.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", "n", F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit(1), "prefix").alias("p2"))
    grouped = members.groupBy("n", "p1", "p2").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("size"))
    groups = materialise(grouped.select("gid", "n", "size", "p1", "p2"), "groups")
    in_groups = materialise(join_counted(members, groups.where("size > 1"), ["n", "p1", "p2"], "size").select("cid", "gid"), "members")

    leaders = classes.join(groups.select(F.col("gid").alias("cid")), "cid")
    postings = materialise(leaders.select(F.posexplode("prefix").alias("place", "token"), F.col("cid").alias("gid")), "postings")
    counts = materialise(postings.groupBy("token").agg(F.count(F.lit(1)).alias("run")).where("run > 1"), "counts")
    runs = materialise(join_counted(postings, counts, ["token"], "run").select("token", "gid", "place", "run"), "runs")
    drop_table(postings)

    # First round: the busiest group of each run, then for every group its best partner among those.
    busy = runs.groupBy("gid").agg(F.sum("run").alias("busy"))
    extent = classes.select(F.col("cid").alias("gid"), "n", F.size("prefix").alias("p"))
    placed = runs.join(busy, "gid").join(extent, "gid")
    chosen = placed.groupBy("token").agg(F.max(F.struct("busy", "gid", "n", "p")).alias("best"), F.first("run").alias("run"))
    pivots = materialise(chosen.select("token", "run", F.col("best.gid").alias("pivot"), F.col("best.n").alias("y_n"), F.col("best.p").alias("y_p")), "pivots")
    near = join_counted(runs.drop("run"), pivots, ["token"], "run").where("gid != pivot").groupBy("gid", "pivot", "y_n", "y_p").agg(F.count(F.lit(1)).alias("shared"))
    near = near.join(extent.select("gid", F.col("n").alias("x_n"), F.col("p").alias("x_p")), "gid").where(may_link(rule))
    best = near.groupBy("gid").agg(F.max(F.struct("shared", "pivot")).getField("pivot").alias("pivot"))
    chain = in_groups.where("cid != gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    stars = best.select(F.col("gid").alias("a"), F.col("pivot").alias("b")).unionAll(chain)
    found = verified(materialise(stars, "stars"), classes, rows, id, text, rule)
    merged = components(found)

    # Second round: every pair that is left between different components.
    label = materialise(classes.select(F.col("cid")).join(merged.withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("component", "cid").alias("component")), "labels")
    rest = materialise(candidates(runs, groups, in_groups, label, classes, rule), "rest")
    more = verified(rest, classes, rows, id, text, rule)
    final = components(found.unionAll(more))

    named = materialise(classes.select("cid", "id", "k1", "k2", "copies").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "classes-named")
    least = materialise(named.groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")), "least")
    of_class = materialise(join_counted(named, least, ["component"], "size").select("k1", "k2", "least", "copies"), "named")
    linked = join_counted(some.select("id", "n", "k1", "k2"), of_class, ["k1", "k2"], "copies").select("id", "n", "least")
    alone = described.where(F.col("n") == 0).select("id", "n", F.col("id").alias("least"))
    return linked.unionAll(alone).select("id", F.col("n").alias("n_shingles"), F.col("least").alias("component"))


def may_link(rule: Threshold) -> Column:
    """Whether sets x and y may link that share so many shingles of their prefixes (columns x_n, x_p, y_n, y_p, shared).

    Of the two prefixes, the one that ends first in the order lacks every shingle of it that is
    not shared.  Which one that is, is not known here, so the larger of the two bounds holds.
    """
    overlap = F.greatest(F.col("x_n") - F.col("x_p"), F.col("y_n") - F.col("y_p")) + F.col("shared")
    size = (F.lit(rule.over) * F.col("x_n") >= F.lit(rule.under) * F.col("y_n")) & (F.lit(rule.over) * F.col("y_n") >= F.lit(rule.under) * F.col("x_n"))
    return size & (F.lit(rule.over + rule.under) * overlap >= F.lit(rule.under) * (F.col("x_n") + F.col("y_n")))


def candidates(runs: DataFrame, groups: DataFrame, in_groups: DataFrame, label: DataFrame, classes: DataFrame, rule: Threshold) -> DataFrame:
    """Member pairs (a, b) of different components that may link and were not joined by the first round."""
    # A group whose members are all of one component takes part as that component, else as mixed.
    of_group = in_groups.join(label, "cid").groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    state = groups.select("gid", "n").join(label.select(F.col("cid").alias("gid"), "component"), "gid").join(of_group, "gid", "left")
    state = state.select("gid", "n", F.when(F.col("low") != F.col("high"), F.lit(NEVER)).otherwise(F.col("component")).alias("component"))
    entries = materialise(runs.join(state, "gid"), "entries")
    mixed = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("run").alias("run")).where((F.col("low") != F.col("high")) | (F.col("low") == NEVER))
    open_runs = join_counted(entries.drop("run"), materialise(mixed.select("token", "run"), "mixed"), ["token"], "run")
    # Sets that link have sizes of one step of the scale, or of two that follow each other; a long run is dealt
    # into parts that meet in pairs, so that a task has some rows of either side.
    step = F.floor(F.log(F.col("n")) / F.lit(log(max(1.0, rule.over / rule.under) * 1.0001))).cast("int")
    parts = F.ceil(F.col("run") / F.lit(HOT_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("gid"), parts).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    x = open_runs.withColumns({"step": step, "i": own}).withColumn("j", F.explode(every)).select("token", "step", "i", "j", *[F.col(c).alias(f"x_{c}") for c in ("gid", "n", "component", "place")])
    y = open_runs.withColumn("step", F.explode(F.array(step, step - 1))).withColumn("j", own).withColumn("i", F.explode(every)).select("token", "step", "i", "j", *[F.col(c).alias(f"y_{c}") for c in ("gid", "n", "component", "place")])
    apart = (F.col("x_component") != F.col("y_component")) | (F.col("x_component") == NEVER)
    ordered = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_gid") < F.col("y_gid")))
    sizes = F.lit(rule.over) * F.col("x_n") >= F.lit(rule.under) * F.col("y_n")
    # Where a pair first meets in the order, neither has what came before it in the other; a pair that fails here met earlier, or not at all.
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    enough = F.lit(rule.over + rule.under) * left >= F.lit(rule.under) * (F.col("x_n") + F.col("y_n"))
    met = x.join(y, ["token", "step", "i", "j"]).where(ordered & sizes & apart & enough).select("x_gid", "y_gid").distinct()
    for side in ("x", "y"):
        met = met.join(classes.select(F.col("cid").alias(f"{side}_gid"), F.col("n").alias(f"{side}_n"), F.col("prefix").alias(f"{side}_prefix")), f"{side}_gid")
    counted = met.withColumns({"shared": F.size(F.array_intersect("x_prefix", "y_prefix")), "x_p": F.size("x_prefix"), "y_p": F.size("y_prefix")})
    pairs = materialise(counted.where(may_link(rule)).select("x_gid", "y_gid"), "group-pairs")

    # Only members of different components make pairs: the components meet first, then their members.
    own = materialise(groups.select("gid").join(in_groups, "gid", "left").select("gid", F.coalesce("cid", "gid").alias("cid")).join(label, "cid"), "own")
    kinds = own.groupBy("gid", "component").agg(F.count(F.lit(1)).alias("members"))
    some_x = kinds.select(F.col("gid").alias("x_gid"), F.col("component").alias("x_component"))
    some_y = kinds.select(F.col("gid").alias("y_gid"), F.col("component").alias("y_component"))
    across = pairs.join(some_x, "x_gid").join(some_y, "y_gid").where("x_component != y_component")
    inside = some_x.join(some_y, F.col("x_gid") == F.col("y_gid")).where("x_component < y_component")
    both = across.select("x_gid", "x_component", "y_gid", "y_component").unionAll(inside.select("x_gid", "x_component", "y_gid", "y_component"))
    xs = own.select(F.col("gid").alias("x_gid"), F.col("component").alias("x_component"), F.col("cid").alias("a"))
    ys = own.select(F.col("gid").alias("y_gid"), F.col("component").alias("y_component"), F.col("cid").alias("b"))
    return both.join(xs, ["x_gid", "x_component"]).join(ys, ["y_gid", "y_component"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
