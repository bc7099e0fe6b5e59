"""Cosine near-duplicates of vectors by a subspace pigeonhole join.

Vectors are scaled to length 1 and turned by a fixed rotation, and their
components are split into m blocks of few dimensions.  Two vectors with cosine c
are 2 - 2c apart in squared distance, so in at least one block they are within
(2 - 2c) / m, the block's share of the budget.  Every block is range-joined; the
pairs within a block's budget are candidates, and the cosine of the union of
candidates is computed in double precision from the stored components.  Equal
vectors form one class that meets others once.

The vectors of a label are dealt into parts, and parts meet in pairs, where all
blocks are joined at once: every vector is sent once for each part.  Where that
is more often than MOST_PARTS, a grid over two dimensions of every block, with
cells as wide as the budget's radius, brings together all pairs that are close
in that block: every vector is sent to five cells of each block, and a pair is
counted in the first block whose budget it meets.

A task returns counts and a spanning star of each connected set it sees, never
all the pairs.

Defined results: null labels, null or empty vectors, vectors of length 0 or with
null or non-finite components link with nothing, have no links and stand for
themselves; vectors of different lengths never link; repeated rows link; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import join_counted, materialise, prepare_workers
from larkspur.llm.components import components

BLOCK_DIMS = 8
ALL_BLOCKS = -1
#: Members of a cell that are compared in one task at most, about.
PART_ROWS = 2048
#: Members of a label that are compared in one task at most, about, and parts of a label beyond which the grid is used.
LABEL_ROWS = 8192
MOST_PARTS = 40
#: Rows of a part that are compared with another part at once.
TILE = 512
SLACK = 1e-9
#: Of a cell and its eight neighbours, those whose members also come to the cell.
AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def blocks_of(dims: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dims), max(1, dims // BLOCK_DIMS))


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(97).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The rows in double precision, times the power of two that brings their largest component near 1: no square is lost."""
    held = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(held).max(1, keepdims=True))
    return np.ldexp(held, -exponent)


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows, rotated."""
    held = scaled(vectors)
    return (held / np.sqrt((held**2).sum(1, keepdims=True))) @ rotation(held.shape[1])


def radius(cosine: float, dims: int) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine) / len(blocks_of(dims)))) + SLACK


def placed(classes: DataFrame, cosine: float) -> DataFrame:
    """Every class in its own cell of every block (home) and in the cells that it is ahead of."""

    def place(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() :]
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                vectors = flat[(starts[rows][:, None] + np.arange(dims))]
                units, width = turned(vectors), radius(cosine, int(dims))
                where = pa.array(rows)
                base = [batch.column(0).take(where), batch.column(1).take(where), lists.take(where), batch.column(3).take(where)]
                for b, own in enumerate(blocks_of(int(dims))):
                    x = np.floor(units[:, own[0]] / width).astype(np.int32)
                    y = np.floor(units[:, own[-1]] / width).astype(np.int32) if len(own) > 1 else np.zeros(len(rows), np.int32)
                    for home, dx, dy in [(True, 0, 0), *((False, -ax, -ay) for ax, ay in AHEAD)]:
                        yield pa.RecordBatch.from_arrays(
                            [*base, pa.array(np.full(len(rows), dims, np.int32)), pa.array(np.full(len(rows), b, np.int32)), pa.array(x + np.int32(dx)), pa.array(y + np.int32(dy)), pa.array(np.full(len(rows), home))],
                            ["cid", "label", "vector", "copies", "dims", "block", "x", "y", "home"],
                        )

    kind = classes.schema["vector"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    return classes.select("cid", "label", "vector", "copies").mapInArrow(place, f"cid long, label {label}, vector {kind}, copies long, dims int, block int, x int, y int, home boolean")


def compare(block: int, cosine: float, left: np.ndarray, right: np.ndarray | None):
    """Pairs (i, j) of rows of left and right, or of left alone, that this block owns and whose cosine is high enough."""
    units = turned(left)
    others = units if right is None else turned(right)
    parts = blocks_of(left.shape[1])
    budget = max(0.0, 2 - 2 * cosine) / len(parts) + SLACK
    far = lambda a, b: np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T))
    close = far(units[:, parts[block]], others[:, parts[block]]) <= budget
    if right is None:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    one = scaled(left)
    two = one if right is None else scaled(right)
    keep_i, keep_j = [], []
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        high = exact(one, two, a, b) >= cosine
        a, b = a[high], b[high]
        first = np.ones(len(a), bool)
        for p in parts[:block]:
            first &= ((units[a][:, p] - others[b][:, p]) ** 2).sum(1) > budget
        keep_i.append(a[first])
        keep_j.append(b[first])
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (i, j)


def exact(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows a of one with the rows b of two."""
    x, y = one[a], two[b]
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def compare_all(cosine: float, left: np.ndarray, right: np.ndarray | None):
    """Pairs (i, j) of rows of left and right, or of left alone (i < j), whose cosine is high enough: all blocks at once."""
    one = scaled(left)
    two = one if right is None else scaled(right)
    units = turned(left).astype(np.float32)
    others = units if right is None else turned(right).astype(np.float32)
    parts = blocks_of(left.shape[1])
    budget = max(0.0, 2 - 2 * cosine) / len(parts)
    # x . y - |x|^2 / 2 - |y|^2 / 2 is minus half the squared distance: one product for each block; single precision errs by less than the margin
    flat = [np.c_[units[:, p], (units[:, p] ** 2).sum(1) / -2, np.ones(len(units), np.float32)] for p in parts]
    tall = [np.c_[others[:, p], np.ones(len(others), np.float32), (others[:, p] ** 2).sum(1) / -2].T for p in parts]
    least = np.float32(-budget / 2 - 1e-5)
    keep_i, keep_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(left), TILE):
        first = lo + 1 if right is None else 0
        close = flat[0][lo : lo + TILE] @ tall[0][:, first:] >= least
        for x, y in zip(flat[1:], tall[1:], strict=True):
            close |= x[lo : lo + TILE] @ y[:, first:] >= least
        if right is None:
            close = np.triu(close)
        i, j = np.nonzero(close)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)] + lo, j[at : at + (1 << 16)] + first
            high = exact(one, two, a, b) >= cosine
            keep_i.append(a[high])
            keep_j.append(b[high])
    return np.concatenate(keep_i), np.concatenate(keep_j)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the pairs (a, b) of ids: every id but the smallest of its connected set, with that smallest."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        then = label.copy()
        np.minimum.at(then, x, low)
        np.minimum.at(then, y, low)
        then = then[then]
        if (then == label).all():
            break
        label = then
    rest = label != np.arange(len(ids))
    return ids[rest], ids[label[rest]]


def link(rows: DataFrame, cosine: float, *, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component) of every row."""
    prepare_workers(rows.sparkSession)
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    able = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    picked = rows.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    keyed = picked.select("id", "label", "vector", F.coalesce(able, F.lit(False)).alias("able"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    grouped = keyed.where("able").groupBy("label", "h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    cell = ["label", "dims", "block", "x", "y"]
    counted = classes.withColumn("dims", F.size("vector"))
    labels = materialise(counted.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "vector-labels")
    known = join_counted(counted, labels, ["label", "dims"], "n").withColumn("parts", F.ceil(F.col("n") / F.lit(LABEL_ROWS)).cast("int"))
    columns = [*cell, "cid", "copies", "vector", "home", "parts"]
    none = F.lit(0)
    sized = known.where(F.col("parts") <= MOST_PARTS).withColumns({"block": F.lit(ALL_BLOCKS), "x": none, "y": none, "home": F.lit(True)}).select(*columns)
    if labels.where(F.col("n") > LABEL_ROWS * MOST_PARTS).limit(1).count():
        spread = placed(known.where(F.col("parts") > MOST_PARTS), cosine)
        cells = spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where("any_home and n > 1")
        gridded = join_counted(spread, materialise(cells, "vector-cells"), cell, "n").withColumn("parts", F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int"))
        sized = sized.unionByName(gridded.select(*columns))
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*cell, "i", "j", "cid", "copies", "vector", "own", "home")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        block, i, j = (key[n].as_py() for n in (2, 5, 6))
        cid, copies, home = (table.column(c).to_numpy() for c in ("cid", "copies", "home"))
        vectors = np.stack([x.values.to_numpy(zero_copy_only=False) for x in table.column("vector")])
        part = table.column("own").to_numpy()
        found_a, found_b = [], []
        # home with home once; home with those ahead; with two parts only pairs across them
        for one, two in ([((home), None), (home, ~home)] if i == j else [(home & (part == i), home & (part == j)), (home & (part == i), ~home & (part == j)), (home & (part == j), ~home & (part == i))]):
            left = np.flatnonzero(one)
            right = left if two is None else np.flatnonzero(two)
            if len(left) and len(right):
                held = vectors[left], None if two is None else vectors[right]
                x, y = compare_all(cosine, *held) if block == ALL_BLOCKS else compare(block, cosine, *held)
                found_a.append(left[x])
                found_b.append(right[y])
        a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        links = np.bincount(a, copies[b], len(cid)) + np.bincount(b, copies[a], len(cid))
        some = np.flatnonzero(links)
        node, centre = stars(cid[a], cid[b]) if len(a) else (np.zeros(0, np.int64),) * 2
        return pa.table({"cid": np.r_[cid[some], node], "links": np.r_[links[some].astype(np.int64), np.zeros(len(node), np.int64)], "centre": pa.array(np.r_[np.full(len(some), -1), centre], pa.int64())})

    met = materialise(dealt.groupBy(*cell, "i", "j").applyInArrow(meet, "cid long, links long, centre long"), "vector-links")
    counts = met.where("centre < 0").groupBy("cid").agg(F.sum("links").alias("links"))
    merged = components(met.where("centre >= 0").select(F.col("cid").alias("a"), F.col("centre").alias("b")))
    named = classes.select("cid", "label", "h1", "h2", "least", "copies").join(merged.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    named = named.select("label", "h1", "h2", "least", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    best = named.groupBy("component").agg(F.min("least").alias("first"))
    known = materialise(named.join(best, "component").select("label", "h1", "h2", "n_links", "first", F.lit(True).alias("able")), "vector-named")
    out = keyed.select("id", "label", "h1", "h2", "able").join(known, ["label", "h1", "h2", "able"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component"))
