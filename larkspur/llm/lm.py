"""Language-model scores of whole texts: context-tree weighting over bytes, and a word unigram baseline.

Nothing of the model is held in one place but its crown, the nodes of contexts of
up to two bytes.  The texts are written once in compressed blocks.  Every block
lists the grams and words that it needs, with their counts in training texts,
dealt by hash into buckets; a bucket adds up what all blocks counted (in parts
first, where it is large), grows the context trees of its own grams, and sends
every block the code lengths of just the grams that it asked for.  So every text
is scored from counts over the whole corpus, and what is moved grows in
proportion to the input.

Texts are lower-cased (A-Z).  A text's probability includes its end, coded as a
byte that no text in UTF-8 holds; the same byte stands before a text.

Defined results: a null text is empty and is scored as its end alone; without
training texts the model predicts every bit with 1/2 and the baseline's N is 0;
repeated rows get equal scores; null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import ctw, words
from larkspur.llm.common import materialise, prepare_workers, release

#: Context depths: all, the crown's greatest, and the first that buckets hold whole.
FULL, CROWN, LEAST = 6, 2, 3
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20
#: Bytes of text for a bucket, and rows of a bucket that one task takes.
BUCKET_BYTES = 16 << 20
PART_ROWS = 4_000_000
#: Tasks of one shuffle at most; a task takes one group of bounded size at a time.
MOST_PARTITIONS = 20_000
GRAM, WORD = 0, 1


# Sorted integers as bytes: differences, split by byte place so that they compress.
def squeeze(values: np.ndarray) -> bytes:
    held = np.ascontiguousarray(values)
    if held.dtype == np.uint64:
        held = np.diff(held, prepend=np.uint64(0))
    return zlib.compress(held.view(np.uint8).reshape(-1, held.itemsize).T.tobytes(), 1)


def expand(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    held = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)
    return np.cumsum(held, dtype=np.uint64) if kind is np.uint64 else held


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat, weight = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, weight = flat[order], weight[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    return flat[start], np.add.reduceat(weight, start) if len(start) else weight


class Tally:
    """Distinct keys with counts, added to in slices."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counted: bool) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.waiting.append((found, n if counted else np.zeros(len(n), np.int64)))
        if sum(len(k) for k, _ in self.waiting) > max(1 << 21, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            parts = [(self.keys, self.counts), *self.waiting]
            self.keys, self.counts = merged([k for k, _ in parts], [c for _, c in parts])
            self.waiting = []
        return self.keys, self.counts


def blocks(rows: DataFrame, id: str, text: str, trains: Column) -> DataFrame:
    """(block, ids, trains, sizes, texts): the lower-cased texts in compressed chunks; a block is about BLOCK_BYTES of one task's rows."""

    def pack(batches):
        release()
        base, number, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            ids, flags, texts = (batch.column(i).to_pylist() for i in range(3))
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_BYTES):
                    size += len(texts[hi])
                    hi += 1
                if held and held + size > BLOCK_BYTES:
                    number, held = number + 1, 0
                held += size
                joined = b"".join(texts[lo:hi]).lower()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + number], pa.int64()), pa.array([ids[lo:hi]], pa.list_(pa.int64())), pa.array([flags[lo:hi]], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts[lo:hi]]], pa.list_(pa.int64())), pa.array([pa.compress(joined, "zstd", asbytes=True)], pa.binary())],
                    ["block", "ids", "trains", "sizes", "texts"],
                )
                lo = hi

    picked = rows.select(F.col(id).cast("long").alias("id"), F.coalesce(trains, F.lit(False)).alias("trains"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return materialise(picked.mapInArrow(pack, "block long, ids array<long>, trains array<boolean>, sizes array<long>, texts binary"), "lm-blocks")


def opened(sizes: list[int], texts: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(pa.decompress(texts, decompressed_size=sum(sizes), codec="zstd", asbytes=True), np.uint8) if sum(sizes) else np.zeros(0, np.uint8)
    return np.split(flat, np.cumsum(sizes)[:-1])


def context_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the nearest LEAST context bytes, so that a bucket has every gram of its contexts from that depth on."""
    return (words.mix(grams >> np.uint64(8 * (FULL - LEAST + 1))) % np.uint64(buckets)).astype(np.int64)


def needs(held: DataFrame, buckets: int) -> DataFrame:
    """(block, kind, bucket, n, keys, counts): the distinct grams and words of every block, with their training counts."""

    def emit(block, grams: Tally, tokens: Tally, ends: int):
        out = []
        for kind, tally in ((GRAM, grams), (WORD, tokens)):
            keys, counts = tally.settle()
            bucket = context_bucket(keys, buckets) if kind == GRAM else (words.mix(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            present, first = np.unique(bucket[order], return_index=True)
            for b, at in zip(present.tolist(), np.split(order, first[1:]), strict=True):
                out.append((block, kind, b, len(at), squeeze(keys[at]), squeeze(counts[at]), 0))
        out.append((block, WORD, -1, 0, b"", b"", ends))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["block", "kind", "bucket", "n", "keys", "counts", "ends"])

    def count(batches):
        release()
        now, grams, tokens, ends = None, Tally(), Tally(), 0
        for batch in batches:
            for block, flags, sizes, texts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != now:
                    if now is not None:
                        yield emit(now, grams, tokens, ends)
                    now, grams, tokens, ends = block, Tally(), Tally(), 0
                own = opened(sizes, texts)
                ends += sum(flags)
                for flag in (True, False):
                    some = [t for t, f in zip(own, flags, strict=True) if f == flag]
                    if not some:
                        continue
                    flat = np.concatenate([x for t in some for x in (np.full(FULL, ctw.END, np.uint8), t, np.full(1, ctw.END, np.uint8))])
                    # the gram at every place but those of the bytes before a text
                    lengths = np.array([len(t) + 1 for t in some])
                    starts = np.cumsum(lengths + FULL) - lengths
                    for a, b in _slices(starts, lengths, 1 << 21):
                        grams.add(_grams(flat, a, b), flag)
                    for _, found, _ in words.blocks([t.tobytes() for t in some]):
                        tokens.add(found, flag)
        if now is not None:
            yield emit(now, grams, tokens, ends)
        del grams, tokens
        release()

    picked = held.select("block", "trains", "sizes", "texts")
    return materialise(picked.mapInArrow(count, "block long, kind int, bucket int, n long, keys binary, counts binary, ends long"), "lm-needs")


def _slices(starts: np.ndarray, lengths: np.ndarray, most: int):
    """Runs of places (as arrays of first places and lengths) of about `most` places each."""
    lo = 0
    while lo < len(starts):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(lengths[lo:]), most)))
        if hi == lo + 1 and lengths[lo] > most:
            for at in range(0, int(lengths[lo]), most):
                yield starts[lo : lo + 1] + at, np.minimum(lengths[lo : lo + 1] - at, most)
        else:
            yield starts[lo:hi], lengths[lo:hi]
        lo = hi


def _grams(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    low, high = int(starts[0]) - FULL, int(starts[-1] + lengths[-1])
    part = flat[low:high].astype(np.uint64)
    n = high - low - FULL
    out = part[FULL:].copy()
    for d in range(1, FULL + 1):
        out |= part[FULL - d : FULL - d + n] << np.uint64(8 * (FULL - d + 1))
    if len(starts) == 1:
        return out
    keep = np.ones(n, bool)
    for d in range(FULL):
        keep[starts[1:] - starts[0] - FULL + d] = False
    return out[keep]


def spread(groups: int) -> int:
    """Tasks for so many groups of bounded size: they grow with the input, whatever the session's number is."""
    return min(max(8, 2 * groups), MOST_PARTITIONS)


def grown(need: DataFrame, parts: DataFrame, tasks: int) -> DataFrame:
    """For every (kind, bucket) the sums over all blocks; for grams also what the bucket's trees hand to the crown."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merged([expand(k, np.uint64) for k in table.column("keys").to_pylist()], [expand(c, np.int64) for c in table.column("counts").to_pylist()])
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()), "keys": pa.array([squeeze(keys)], pa.binary()), "counts": pa.array([squeeze(counts)], pa.binary())})

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        release()
        out = add(key, table)
        keys, counts = expand(out.column("keys")[0].as_py(), np.uint64), expand(out.column("counts")[0].as_py(), np.int64)
        crown = [b""] * 4
        if key[0].as_py() == GRAM and (counts > 0).any():
            depths, _ = ctw.grow(keys[counts > 0], counts[counts > 0], FULL, LEAST)
            short, at = ctw.shorten(depths[-1])
            below = ctw.gathered(depths[-1], short, at)
            names = np.concatenate([ctw.Crown.name(short.grams[short.first[b]], b) for b in range(8)])
            crown = [short.grams.tobytes(), short.count.tobytes(), names.tobytes(), np.concatenate(below).tobytes()]
        for n, data in zip(("crown_grams", "crown_counts", "crown_names", "crown_below"), crown, strict=True):
            out = out.append_column(n, pa.array([data], pa.binary()))
        return out.append_column("tokens", pa.array([int(counts.sum())], pa.int64())).append_column("types", pa.array([int((counts > 0).sum())], pa.int64()))

    schema = "kind int, bucket int, keys binary, counts binary"
    dealt = need.where("bucket >= 0").join(parts, ["kind", "bucket"]).withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")))
    summed = dealt.select("kind", "bucket", "part", "keys", "counts").repartition(tasks, "kind", "bucket", "part").groupBy("kind", "bucket", "part").applyInArrow(add, schema)
    return materialise(summed.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(finish, schema + ", crown_grams binary, crown_counts binary, crown_names binary, crown_below binary, tokens long, types long"), "lm-trees")


def crown_of(trees: DataFrame) -> ctw.Crown | None:
    """The nodes of contexts of up to CROWN bytes, at most 256**CROWN * 255 of the greatest depth; merged in tasks first."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        grams, counts = merged(read("crown_grams", np.uint64), read("crown_counts", np.int64))
        names, below = merged(read("crown_names", np.uint64), read("crown_below", np.float64))
        return pa.table({"crown_grams": [grams.tobytes()], "crown_counts": [counts.tobytes()], "crown_names": [names.tobytes()], "crown_below": [below.tobytes()]}, schema=pa.schema([(c, pa.binary()) for c in ("crown_grams", "crown_counts", "crown_names", "crown_below")]))

    some = trees.where((F.col("kind") == GRAM) & (F.length("crown_grams") > 0)).select(F.pmod("bucket", F.lit(16)).alias("part"), "crown_grams", "crown_counts", "crown_names", "crown_below")
    got = some.groupBy("part").applyInArrow(add, "crown_grams binary, crown_counts binary, crown_names binary, crown_below binary").collect()
    if not got:
        return None
    read = lambda c, t: [np.frombuffer(bytes(r[c]), t) for r in got]
    grams, counts = merged(read("crown_grams", np.uint64), read("crown_counts", np.int64))
    names, below = merged(read("crown_names", np.uint64), read("crown_below", np.float64))
    top = ctw.depth(grams, counts)
    ctw.weigh(top, [below[np.searchsorted(names, ctw.Crown.name(grams[top.first[b]], b))] for b in range(8)])
    depths = [top]
    for _ in range(CROWN):
        short, at = ctw.shorten(depths[-1])
        ctw.weigh(short, ctw.gathered(depths[-1], short, at))
        depths.append(short)
    return ctw.Crown.of(depths[::-1])


def answers(need: DataFrame, trees: DataFrame, parts: DataFrame, crown: ctw.Crown | None, tasks: int) -> DataFrame:
    """(block, kind, keys, values): log10 of the probability of every gram, or the count of every word, that a block asked for."""
    shared = need.sparkSession.sparkContext.broadcast(crown)

    def lengths(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if shared.value is None:
            return np.full(len(keys), 8 * np.log10(0.5))
        depths, ups = ctw.grow(keys, counts, FULL, LEAST)
        short, at = ctw.shorten(depths[-1])
        return ctw.walk(shared.value.mixture(short.grams).take(at), depths, ups).log10()

    def reply(asked: pa.Table, tree: pa.Table) -> pa.Table:
        release()
        blocks, kinds, out_keys, out_values = [], [], [], []
        if asked.num_rows and tree.num_rows:
            kind = tree.column("kind")[0].as_py()
            keys, counts = expand(tree.column("keys")[0].as_py(), np.uint64), expand(tree.column("counts")[0].as_py(), np.int64)
            values = lengths(keys, counts).astype(np.float32) if kind == GRAM else counts
            for block, own in zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist(), strict=True):
                blocks.append(block)
                kinds.append(kind)
                out_keys.append(own)
                out_values.append(squeeze(values[np.searchsorted(keys, expand(own, np.uint64))]))
        return pa.table([pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(out_keys, pa.binary()), pa.array(out_values, pa.binary())], ["block", "kind", "keys", "values"])

    dealt = need.where("bucket >= 0").join(parts, ["kind", "bucket"]).withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).select("kind", "bucket", "part", "block", "keys")
    sent = trees.select("kind", "bucket", "keys", "counts").join(parts, ["kind", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("kind", "bucket", "part", "keys", "counts")
    by = ("kind", "bucket", "part")
    return dealt.repartition(tasks, *by).groupBy(*by).cogroup(sent.repartition(tasks, *by).groupBy(*by)).applyInArrow(reply, "block long, kind int, keys binary, values binary")


class Lookup:
    """Values of integer keys by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slots = np.zeros(1 << bits, np.uint64)
        self.used = np.zeros(1 << bits, bool)
        self.values = np.zeros(1 << bits, values.dtype)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[at[left]]]
            self.slots[at[free]] = keys[free]
            self.used[at[free]] = True
            own = free[self.slots[at[free]] == keys[free]]
            self.values[at[own]] = values[own]
            left = left[~(self.used[at[left]] & (self.slots[at[left]] == keys[left]))]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.values[at]
        left = np.flatnonzero(self.slots[at] != keys)
        at = at[left]
        while len(left):
            at = (at + np.uint64(1)) & self.mask
            if not self.used[at].all():
                raise KeyError("a key was asked for that the block did not name")
            here = self.slots[at] == keys[left]
            out[left[here]] = self.values[at[here]]
            left, at = left[~here], at[~here]
        return out


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int
    ends: int


def scored(held: DataFrame, replies: DataFrame, totals: Totals, tasks: int) -> DataFrame:
    def score(texts: pa.Table, model: pa.Table) -> pa.Table:
        out = of_block(texts, model)
        release()
        return out

    def of_block(texts: pa.Table, model: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(7)]
        if texts.num_rows:
            found = []
            for kind, value in ((GRAM, np.float32), (WORD, np.int64)):
                rows = [i for i, k in enumerate(model.column("kind").to_pylist()) if k == kind]
                keys = [expand(model.column("keys")[i].as_py(), np.uint64) for i in rows]
                values = [expand(model.column("values")[i].as_py(), value) for i in rows]
                found.append(Lookup(np.concatenate(keys), np.concatenate(values)) if keys else None)
            grams, tokens = found
            scale = np.log10(totals.tokens + 0.5 * (totals.types + 1))
            end = np.log10(totals.ends + 0.5) - scale
            for ids, flags, sizes, data in zip(*(texts.column(c).to_pylist() for c in ("ids", "trains", "sizes", "texts")), strict=True):
                own = opened(sizes, data)
                flat = np.concatenate([x for t in own for x in (np.full(FULL, ctw.END, np.uint8), t, np.full(1, ctw.END, np.uint8))])
                lengths = np.array([len(t) + 1 for t in own])
                starts = np.cumsum(lengths + FULL) - lengths
                model_score = np.zeros(len(own))
                at = 0
                for a, b in _slices(starts, lengths, 1 << 20):
                    values = grams.get(_grams(flat, a, b)).astype(np.float64)
                    if len(a) == 1 and b[0] != lengths[at]:  # a part of one long text
                        model_score[at] += values.sum()
                        at += int(a[0] + b[0] == starts[at] + lengths[at])
                    else:
                        model_score[at : at + len(a)] += np.add.reduceat(values, np.cumsum(b) - b)
                        at += len(a)
                for first, hashes, offsets in words.blocks([t.tobytes() for t in own]):
                    count = tokens.get(hashes) if len(hashes) else np.zeros(0, np.int64)
                    logs = np.log10(count + 0.5) - scale
                    for n in range(len(offsets) - 1):
                        part = slice(offsets[n], offsets[n + 1])
                        i = first + n
                        size = int(offsets[n + 1] - offsets[n]) + 1
                        known = int((count[part] > 0).sum()) + int(totals.ends > 0)
                        for c, v in zip(cols, (ids[i], flags[i], size, known, float(logs[part].sum() + end), float(model_score[i]), sizes[i]), strict=True):
                            c.append(v)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "trained", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    left, right = held.repartition(tasks, "block").groupBy("block"), replies.repartition(tasks, "block").groupBy("block")
    return left.cogroup(right).applyInArrow(score, "id long, trained boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")


def score(rows: DataFrame, trains: Column, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    trains: a condition on the rows that the model and the baseline learn from.
    """
    prepare_workers(rows.sparkSession)
    held = blocks(rows, id, text, trains)
    size = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    need = needs(held, max(8, -(-size // BUCKET_BYTES)))
    rows_of = need.where("bucket >= 0").groupBy("kind", "bucket").agg(F.sum("n").alias("rows"))
    parts = materialise(rows_of.select("kind", "bucket", F.ceil(F.col("rows") / F.lit(PART_ROWS)).cast("int").alias("parts")), "lm-parts")
    meetings = spread(parts.agg(F.sum("parts")).first()[0] or 0)
    trees = grown(need, parts, meetings)
    ends = need.agg(F.sum("ends")).first()[0] or 0
    counted = trees.where(F.col("kind") == WORD).agg(F.sum("tokens"), F.sum("types")).first()
    totals = Totals((counted[0] or 0) + ends, (counted[1] or 0) + int(ends > 0), ends)
    replies = answers(need, trees, parts, crown_of(trees), meetings)
    out = scored(held, replies, totals, spread(held.agg(F.count_distinct("block")).first()[0]))
    return out.withColumns({"train_tokens": F.lit(totals.tokens).cast("long"), "bits_per_byte": -F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)})
