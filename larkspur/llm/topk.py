"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are whole numbers.  Within a block of candidates every component gives
two terms, one for queries with a positive and one for queries with a negative
weight there; a posting's impact, its distance from the block's least (or
greatest) component, is never negative.  The index keeps each term's documents
ordered by quantised impact, in segments of equal impact.  A block of queries
processes the segments highest impact first, several levels at a time, adding to
a lower and an upper bound of every score; it stops only once the bounds prove which
documents may be among the best, and those are scored again exactly.

Candidates are dealt into blocks of bounded size and sent once; the queries
follow every block's candidates in sorted rows, so that a task builds a block's
index once and reads the queries against it in chunks.

Defined results: vectors that are null or empty or hold null or non-finite
components, or have a null id, take no part; vectors of different lengths never
meet; repeated rows are candidates of each other; ties go to the smaller id;
with fewer candidates than asked for, all are returned; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, prepare_workers, shuffle_partitions

BLOCK_ROWS = 2048
QUERY_ROWS = 1024
LEVELS = 32
#: Tasks that blocks are dealt to at most, unless the session asks for more; a task takes one block at a time.
MOST_PARTITIONS = 10_000
#: Levels after which the bounds are looked at.
LOOK = (22, 26, 29)


class ImpactIndex:
    """The postings of one block of candidates: for each term its documents by descending quantised impact."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors, self.levels = vectors, levels
        self.low, self.high = vectors.min(0), vectors.max(0)
        impacts = np.concatenate([vectors - self.low, self.high - vectors], axis=1)
        self.width = max(1, -(-(int(impacts.max()) + 1) // levels))
        quantised = impacts // self.width
        self.order = np.argsort(-quantised, axis=0, kind="stable")
        self.ranked = np.take_along_axis(quantised, self.order, 0)
        self.ends = np.stack([(self.ranked >= level).sum(0) for level in range(levels - 1, -1, -1)])

    def segments(self, first: int, last: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
        """(documents, terms) twice, of the segments of the first-th to the last-th highest impact: 1 where a document is in one, and its impact there."""
        starts = self.ends[first - 1] if first else np.zeros(self.order.shape[1], np.int64)
        sizes = self.ends[last] - starts
        terms = np.repeat(np.arange(len(sizes)), sizes)
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        here, impact = np.zeros((2, self.vectors.shape[0], self.order.shape[1]), dtype)
        here[self.order[places, terms], terms] = 1
        impact[self.order[places, terms], terms] = self.ranked[places, terms] * self.width
        return here, impact

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of every document that may be among each query's k best; own: the query's place here or -1."""
        count = len(self.vectors)
        weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
        total = weights.sum(1)
        exact = int(total.max(initial=0)) * (self.width * self.levels) < 2**23
        dtype = np.float32 if exact else np.float64
        weights, total = weights.astype(dtype), total.astype(dtype)[:, None]
        lower = np.zeros((len(queries), count), dtype)
        seen = np.zeros_like(lower)
        here = np.flatnonzero(own >= 0)
        open_rows = None
        first = 0
        for last in (*(s for s in LOOK if s < self.levels - 1), self.levels - 1):
            level = self.levels - 1 - last
            segment, impact = self.segments(first, last, dtype)
            seen += weights @ segment.T
            lower += weights @ impact.T
            first = last + 1
            # What is left to add lies between 0 and the next level's top for every weight not seen, and a level's width for those seen.
            spare = seen * dtype(self.width - 1) + (total - seen) * dtype(max(0, level * self.width - 1))
            lower_seen = lower.copy()
            lower_seen[here, own[here]] = -np.inf
            if count > k:
                bar = np.partition(lower_seen, count - k, axis=1)[:, count - k][:, None]
                open_rows = lower_seen + spare >= bar
            else:
                open_rows = np.ones(lower.shape, bool)
            open_rows[here, own[here]] = False
            if open_rows.sum() <= 4 * k * len(queries):
                break
        out = []
        for q in range(len(queries)):
            places = np.flatnonzero(open_rows[q])
            out.append((places, inner(self.vectors[places], queries[q])))
        return out


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact in 64 bits."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).sum())
    if most < 2**53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return (vectors * query).sum(1)


def whole(rows: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(row, id, dims, vector) of the rows that take part, each component floor(scale * x), as 64-bit numbers."""

    def quantise(batches):
        for batch in batches:
            ids, dims, out = [], [], []
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name is None or not own.is_valid or own.values.null_count or not len(own.values):
                    continue
                held = own.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(held).all():
                    ids.append(name)
                    dims.append(len(held))
                    out.append(np.floor(held * scale).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dims", "vector"])

    picked = rows.select(F.col(id).cast("long"), F.col(vector))
    return materialise(picked.mapInArrow(quantise, "id long, dims int, vector binary").withColumn("row", F.monotonically_increasing_id()), "vectors")


def top_k(rows: DataFrame, is_query: Column, k: int, *, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k best rows for every row that is a query (a condition on the column id)."""
    prepare_workers(rows.sparkSession)
    held = whole(rows, id, vector, scale)
    queries = held.where(is_query)
    blocks = max(1, -(-held.count() // BLOCK_ROWS))
    columns = ("dims", "block", "asks", "row", "id", "vector")
    left = held.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "asks": F.lit(False)}).select(*columns)
    right = queries.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(True)}).select(*columns)
    partitions = min(2 * blocks, max(MOST_PARTITIONS, shuffle_partitions(rows.sparkSession)))
    dealt = left.unionByName(right).repartition(partitions, "dims", "block").sortWithinPartitions("dims", "block", "asks")

    def meet(batches):
        for block, asked in _met(batches):
            found = list(_best(block, asked, k))
            if found:
                yield pa.RecordBatch.from_arrays([np.concatenate(c) for c in zip(*found, strict=True)], ["query_row", "query_id", "id", "score"])

    met = dealt.mapInArrow(meet, "query_row long, query_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("id")))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _met(batches):
    """(index of a block, ids, rows), then up to QUERY_ROWS of the queries that follow its candidates in the sorted rows."""
    now, held, waiting, block = None, [], [], None
    for batch in batches:
        marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        edges = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(marks)] if len(marks) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key, part = tuple(marks[lo, :2]), batch.slice(lo, hi - lo)
            if key != now:
                if waiting and block:
                    yield block, pa.Table.from_batches(waiting)
                now, held, waiting, block = key, [], [], None
            if not marks[lo, 2]:
                held.append(part)
                continue
            if held:  # all candidates of the block are here: its index is built once
                block, held = _indexed(pa.Table.from_batches(held)), []
            waiting.append(part)
            if sum(len(w) for w in waiting) >= QUERY_ROWS:
                if block:
                    yield block, pa.Table.from_batches(waiting)
                waiting = []
    if waiting and block:
        yield block, pa.Table.from_batches(waiting)


def _read(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vector").to_pylist()), "<i8").reshape(table.num_rows, -1)


def _indexed(candidates: pa.Table) -> tuple[ImpactIndex, np.ndarray, np.ndarray]:
    return ImpactIndex(_read(candidates)), candidates.column("id").to_numpy(), candidates.column("row").to_numpy()


def _best(block: tuple[ImpactIndex, np.ndarray, np.ndarray], asked: pa.Table, k: int):
    """(query rows, query ids, ids, scores) of the k best here for every query."""
    index, ids, rows = block
    order = np.argsort(rows)
    query_ids, query_rows, vectors = asked.column("id").to_numpy(), asked.column("row").to_numpy(), _read(asked)
    at = np.minimum(np.searchsorted(rows, query_rows, sorter=order), len(rows) - 1)
    own = np.where(rows[order[at]] == query_rows, order[at], -1)
    for q, (places, scores) in enumerate(index.search(vectors, own, k)):
        best = np.lexsort((ids[places], -scores))[:k]
        yield np.full(len(best), query_rows[q]), np.full(len(best), query_ids[q]), ids[places][best], scores[best]
