"""Top-k search, the vector join and components against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import write
from pyspark.sql import functions as F

from larkspur.llm import queries, topk, vector_join
from larkspur.llm.components import components


def odd_vectors(rng):
    v = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [0.0, 0.0], [1.0, 2.0, 3.0], [-0.0, 1.0], [0.0, 1.0], [2.0, 0.0], [1e-3, 7.0]]
    v += [list(map(float, x)) for x in rng.normal(size=(60, 2)).astype(np.float32)] + [[0.5, 0.5]] * 30
    n = len(v)
    ids = [None, *range(1, n - 2), 7, 7]
    labels = [None if i % 11 == 3 else i % 2 for i in range(n)]
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(v, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32()), "cid": ["clash"] * n, "block": [None] * n, "home": ["x"] * n, "score": [1] * n})


def brute_top(ids, vectors, k):
    able = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), r) for r, (i, v) in enumerate(zip(ids, vectors, strict=True)) if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for i, v, r in able:
        if i % 50 == 0:
            scored = sorted((-int(v @ w), j) for j, w, s in able if s != r and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "wide", "few"])
def test_index_proves_the_best(kind):
    rng = np.random.default_rng(3)
    v = {"random": rng.integers(-200, 200, (500, 16)), "ties": rng.integers(-2, 2, (500, 8)), "wide": rng.integers(-(10**7), 10**7, (300, 8)), "few": rng.integers(-5, 5, (3, 4))}[kind]
    index = topk.ImpactIndex(v)
    q = np.concatenate([v[:20], rng.integers(-9, 9, (5, v.shape[1]))])
    own = np.r_[np.arange(min(20, len(v))), np.full(len(q) - min(20, len(v)), -1)]
    for (places, scores), w, o in zip(index.search(q, own, 5), q, own, strict=True):
        want = sorted((-int(x @ w), i) for i, x in enumerate(v) if i != o)[:5]
        got = sorted((-int(s), int(p)) for p, s in zip(places, scores, strict=True))[:5]
        assert got == want


def test_search_stops_early_and_rescores_few():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(2048, 64)) / 8 * 256).astype(np.int64)
    places = topk.ImpactIndex(v).search(v[:40], np.arange(40), 5)
    assert np.mean([len(p) for p, _ in places]) < 0.5 * len(v)


def test_top_k_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 1)
    t = odd_vectors(np.random.default_rng(1))
    sf = write(tmp_path, "embeddings", t)
    got = sorted(tuple(r) for r in queries.op3_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    want = brute_top(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), 5)
    assert [(q, r, s) for q, r, _, s in got] == [(q, r, s) for q, r, _, s in want]
    assert got == want


def brute_links(ids, vectors, labels, cosine):
    able = {r for r, (v, lab) in enumerate(zip(vectors, labels, strict=True)) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {r: set() for r in range(len(ids))}
    for a in able:
        for b in able:
            if a < b and labels[a] == labels[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], np.float64), np.array(vectors[b], np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for r in links:
        seen, todo = {r}, [r]
        while todo:
            for s in links[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        named = [ids[s] for s in seen if ids[s] is not None]
        out.append((ids[r], len(links[r]), min(named) if named else None))
    return out


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize(("part", "label", "most"), [(2048, 8192, 40), (2048, 9, 40), (2048, 9, 2), (7, 9, 2)])
def test_vector_join(spark, tmp_path, monkeypatch, part, label, most):
    """One part, several parts, and the grid with whole and with dealt cells."""
    monkeypatch.setattr(vector_join, "PART_ROWS", part)
    monkeypatch.setattr(vector_join, "LABEL_ROWS", label)
    monkeypatch.setattr(vector_join, "MOST_PARTS", most)
    monkeypatch.setattr(vector_join, "TILE", 16)
    t = odd_vectors(np.random.default_rng(2))
    sf = write(tmp_path, "embeddings", t)
    got = [tuple(r) for r in queries.op9_vector_join(spark, sf).select("vec_id", "n_links", "component_id").collect()]
    assert key(got) == key(brute_links(*(t[c].to_pylist() for c in ("vec_id", "embedding", "label")), 0.93))


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e-200, 2e-200]), (3, [2e-200, 4e-200]), (4, [1e200, 2e200]), (5, [5e-324, 5e-324]), (6, [2.0, -1.0])]
    got = vector_join.link(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int"), 0.999).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6)]


@pytest.mark.parametrize("most", [40, 0])
def test_vector_join_of_clusters(spark, monkeypatch, most):
    monkeypatch.setattr(vector_join, "MOST_PARTS", most)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    v = np.concatenate([centres[i % 12] + rng.normal(size=32) * 0.05 * (i % 9) for i in range(240)]).reshape(240, 32).astype(np.float32)
    rows = [(i, v[i].tolist(), "x") for i in range(240)]
    got = [tuple(r) for r in vector_join.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), 0.9).collect()]
    assert key(got) == key(brute_links([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], 0.9))


def test_pigeonhole_blocks_cover_all_dims():
    for dims in (1, 2, 7, 8, 9, 64, 100):
        parts = vector_join.blocks_of(dims)
        assert sorted(np.concatenate(parts)) == list(range(dims))
        assert np.allclose(vector_join.rotation(dims) @ vector_join.rotation(dims).T, np.eye(dims))


def test_empty_tables(spark, tmp_path):
    sf = write(tmp_path, "embeddings", odd_vectors(np.random.default_rng(1)).slice(0, 0))
    assert queries.op3_top_k(spark, sf).count() == 0
    assert queries.op9_vector_join(spark, sf).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, x) for x in range(5001, 5060)] + [(3, 3), (None, 4), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_distinct_rows_stay_whole(spark):
    df = spark.range(0, 100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    got = vector_join.link(df, 0.93).collect()
    assert {(r.n_links, r.component) for r in got} == {(99, 0)} and len(got) == 100


def test_shared_folder_and_settings(spark, monkeypatch):
    from larkspur.llm import common

    class Session:
        def __init__(self, master):
            self.conf = type("Conf", (), {"get": lambda self, name, default=None: default})()
            self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test-{master}"})()

    with pytest.raises(ValueError):
        common.work_folder(Session("spark://host:7077"))
    local = Session("local[2]")
    assert common.work_folder(local).startswith("file:") and common.work_folder(local) == common.work_folder(local)
    with pytest.raises(KeyError):
        common.only(spark.range(1), "nothing")
    common.prepare_workers(spark)
    name = common.BATCH_SETTINGS[0]
    before = common._before.get((spark.sparkContext.applicationId, name))
    assert int(spark.conf.get(name)) <= common.BATCH_ROWS
    common.restore_settings(spark)
    assert before is None or spark.conf.get(name) == before
    common.prepare_workers(spark)


def test_counted_join_is_a_join(spark, monkeypatch):
    from larkspur.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.range(60).selectExpr("id", "CASE WHEN id < 30 THEN 0 ELSE id % 7 END AS k")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k != 3")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for keys in (200_000, 0):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert sorted(map(tuple, common.join_counted(rows, table, ["k"], "n").select("k", "id", "n").collect())) == want
