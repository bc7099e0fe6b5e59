"""K-d tree sharding with DataFrame operations only.

The rows' metadata (id, size, language, source, checksum of the text) span a
box.  A node of the tree that is to become k shards is cut along its widest
dimension where floor(k / 2) / k of its bytes lie below, until every leaf holds
the target bytes, the total over the number of shards.  The weighted medians
are found by distributed histograms of fixed size that close in on the cut;
behind a dimension's value comes a hash of the row, so that equal values, and
copies of one text, can be cut anywhere.  Only metadata are shuffled, no text.

Defined results: a null text has no bytes but its fixed cost; null metadata
count as 0; repeated rows are placed one by one; an empty table gives no row;
with fewer rows than shards some shards are empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialise

ROW_COST = 16
BITS = 30
BINS = 1024
TIE_BITS = 32
#: Levels of the tree after which its nodes are written, so that no plan grows with the tree's depth.
LEVELS = 3
#: Rows numbered together at most, about.
SLOT_ROWS = 50_000


def _scaled(value: Column, low: float, high: float) -> Column:
    """A dimension's value as a whole number of BITS bits."""
    span = max(float(high) - float(low), 1e-300)
    part = (F.coalesce(value.cast("double"), F.lit(float(low))) - F.lit(float(low))) / F.lit(span)
    return F.floor(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * F.lit(2**BITS - 1)).cast("long")


def metadata(rows: DataFrame, *, id: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, size, text_crc32, row, d0, d1, ...): one pass over the texts, written as a table."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = {c.lower() for c in rows.columns}
    picked = rows.select(
        F.col(id).cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + ROW_COST).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *[F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(2**BITS)).alias(f"g{i}") for i, c in enumerate(groups) if c.lower() in named],
        F.monotonically_increasing_id().alias("row"),
    )
    return materialise(picked, "metadata")


def keyed(meta: DataFrame) -> tuple[DataFrame, int]:
    """meta with the keys of every dimension and the root as every row's node, written as a table; and all bytes."""
    g = [c for c in meta.columns if c.startswith("g") and c[1:].isdigit()]
    logs = F.log2(F.col("size").cast("double"))
    known = meta.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min(logs).alias("c"), F.max(logs).alias("d"), F.sum("size").alias("total")).first()
    if known["total"] is None:
        return meta.select("doc_id", "size", "text_crc32", "row", F.array().cast("array<bigint>").alias("keys"), F.lit(0).alias("shard")), 0
    dims = [_scaled(F.col("doc_id"), known["a"] or 0, known["b"] or 0), _scaled(logs, known["c"], known["d"]), _scaled(F.col("text_crc32"), 0, 2**32 - 1), *[F.col(c) for c in g]]
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "row", F.lit(5)), 64 - TIE_BITS)
    keys = [F.shiftleft(d, TIE_BITS) + tie for d in dims]
    return materialise(meta.select("doc_id", "size", "text_crc32", "row", F.array(*keys).alias("keys"), F.lit(0).alias("shard")), "tree"), known["total"]


def tree(meta: DataFrame, shards: int) -> DataFrame:
    """meta with the leaf (0 to shards - 1) of every row."""
    now, total = keyed(meta)
    if not total:
        return now.drop("keys")
    return split(now, shards, total / shards)


def split(now: DataFrame, shards: int, target: float) -> DataFrame:
    """keyed's rows with the leaf of every row; the nodes are written as a table every LEVELS levels."""
    dims = len(now.first()["keys"])
    level = 0
    parts = {0: shards}  # first shard of a node: how many shards it becomes
    while any(k > 1 for k in parts.values()):
        level += 1
        cuts = _cuts(now, {n: k for n, k in parts.items() if k > 1}, dims, target)
        table = _small(now, "shard int, dim int, cut long, shift int", [(n, d + 1, c, parts[n] // 2) for n, (d, c) in cuts.items()])
        beyond = F.element_at("keys", F.col("dim")) > F.col("cut")
        now = now.join(F.broadcast(table), "shard", "left").withColumn("shard", F.col("shard") + F.when(beyond, F.col("shift")).otherwise(F.lit(0))).drop("dim", "cut", "shift")
        then = {}
        for node, k in parts.items():
            if k == 1 or node not in cuts:
                then[node] = 1
            else:
                then[node], then[node + k // 2] = k // 2, k - k // 2
        parts = then
        if level % LEVELS == 0:
            now = materialise(now, "tree")
    return now.select("doc_id", "size", "text_crc32", "row", "shard")


def _cuts(now: DataFrame, parts: dict[int, int], dims: int, target: float) -> dict[int, tuple[int, int]]:
    """For every node its widest dimension and the key there with floor(k / 2) / k of the node's bytes at or below it."""
    held = now.join(F.broadcast(_small(now, "shard int", [(n,) for n in parts])), "shard")
    box = held.groupBy("shard").agg(F.sum("size").alias("bytes"), *[f(F.element_at("keys", i + 1)).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    state = {}
    for r in box:
        dim = max(range(dims), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
        state[r["shard"]] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"], "below": 0, "goal": r["bytes"] * (parts[r["shard"]] // 2) / parts[r["shard"]], "cut": None}
    while any(s["cut"] is None for s in state.values()):
        open_nodes = {n: s for n, s in state.items() if s["cut"] is None}
        table = _small(now, "shard int, dim int, low long, high long, step long", [(n, s["dim"] + 1, s["lo"], s["hi"], max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))) for n, s in open_nodes.items()])
        keyed = now.join(F.broadcast(table), "shard").withColumn("key", F.element_at("keys", F.col("dim"))).where("key BETWEEN low AND high")
        bins = keyed.groupBy("shard", F.expr("(key - low) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        by_node: dict[int, list] = {}
        for r in bins:  # BINS rows for each of at most as many nodes as shards
            by_node.setdefault(r["shard"], []).append(r)
        for n, s in open_nodes.items():
            for r in sorted(by_node[n], key=lambda r: r["bin"]):
                if s["below"] + r["bytes"] < s["goal"]:
                    s["below"] += r["bytes"]
                    last = r["hi"]
                    continue
                if r["lo"] == r["hi"] or r["bytes"] <= target / 4096:  # which side is nearer
                    s["cut"] = r["hi"] if s["below"] + r["bytes"] - s["goal"] <= s["goal"] - s["below"] else r["lo"] - 1
                else:
                    s["lo"], s["hi"] = r["lo"], r["hi"]
                break
            else:
                s["cut"] = last
    return {n: (s["dim"], s["cut"]) for n, s in state.items()}


def _small(like: DataFrame, schema: str, rows: list[tuple]) -> DataFrame:
    """A literal table of a row for each node."""
    names = ", ".join(part.split()[0] for part in schema.split(", "))
    kinds = [part.split()[1] for part in schema.split(", ")]
    values = ", ".join("(" + ", ".join(f"CAST({v} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return like.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Number every shard's rows from 0 without a gap; rows are numbered in parts of bounded size."""
    parts = max(1, -(-rows // (shards * SLOT_ROWS)))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("ahead"))
    own = dealt.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")))
    return own.join(ahead, ["shard", "part"]).withColumn("slot", F.col("ahead") + F.col("at") - 1).drop("ahead", "at", "part")


def shard(rows: DataFrame, shards: int = 40, *, id: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; the shards' bytes are near equal."""
    meta = metadata(rows, id=id, text=text, groups=groups)
    placed = tree(meta, shards)
    return slots(placed, meta.count(), shards).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
