"""Shingles, the n-gram join and the pipeline's near-copy stage against brute force."""

import random

import duckdb
import numpy as np
import pytest
from odd_tables import LONG, odd_documents, rows_of, write

import corpus_pipeline
from larkspur.llm import ngram_join, queries, words


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def brute(rows, size, under, over=100):
    """(id, n, smallest id reachable) of every row, by comparing all pairs."""
    held = [sets_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if held[i] and held[j]:
                both = len(held[i] & held[j])
                if over * both >= under * (len(held[i]) + len(held[j]) - both):
                    parent[find(i)] = find(j)
    named = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            named[find(i)] = min(name, named.get(find(i), name))
    return sorted((str(n), len(held[i]), str(named.get(find(i)))) for i, (n, _) in enumerate(rows))


def family(rng, vocabulary, length, copies, edits):
    base = [rng.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("size", "under"), [(3, 90), (5, 80)])
def test_join_matches_brute_force(spark, size, under):
    rng = random.Random(size)
    many, few = [f"w{i}" for i in range(400)], ["a", "b", "c"]
    texts = []
    for _ in range(6):
        texts += family(rng, many, 80, 10, 4)
    texts += family(rng, few, 30, 25, 3) + family(rng, few, 4, 15, 1) + family(rng, many, 300, 6, 12)
    texts += ["the same line " * 3 + " ".join(rng.choice(many) for _ in range(20)) for _ in range(15)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ngram_join.Threshold(size, under, 100)).collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in got) == brute(rows, size, under)


def test_odd_documents(spark, tmp_path):
    t = odd_documents()
    got = queries.op5_ngram_join(spark, write(tmp_path, "documents", t)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)), 3, 90)


def test_empty_table(spark, tmp_path):
    assert queries.op5_ngram_join(spark, write(tmp_path, "documents", odd_documents().slice(0, 0))).count() == 0


def test_sql_gives_the_same(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        rows = rows_of(sf_dir, t, "*")
        assert rows
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'' if __import__('os').path.isfile(f'{sf_dir}/{t}.parquet') else '/*.parquet'}')")
    for name, sql in queries.ORACLE_SQL.items():
        ref = c.sql(sql)
        mine = queries.QUERIES[name](spark, sf_dir).select(*ref.columns).collect()
        assert sorted(map(tuple, mine)) == sorted(ref.fetchall()), name


def test_words_and_hashes():
    texts = [b"", b" \n", b"A b\tC\x0bd", b"a B c D", b"x" * 100, LONG.encode() * 4, "É é".encode()]
    found = {}
    for first, hashes, offsets in words.blocks(texts):
        for n in range(len(offsets) - 1):
            found[first + n] = hashes[offsets[n] : offsets[n + 1]]
    assert [len(found[i]) for i in range(len(texts))] == [len(t.split()) for t in texts]
    assert (found[2] == found[3]).all()
    rng = random.Random(0)
    vocabulary = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(5000)})
    own = next(words.blocks([" ".join(vocabulary).encode()]))[1]
    assert len(np.unique(own)) == len(vocabulary)
    for i, s in words.shingle_sets(texts, 3):
        assert len(s) == len(sets_of(texts[i].decode(), 3))


def test_near_copy_stage(spark, tmp_path):
    t = odd_documents()
    docs = spark.read.parquet(f"{write(tmp_path, 'documents', t)}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = [r["text"] for r in kept.collect()]
    groups = {}
    for i, text in enumerate(t["text"].to_pylist()):
        groups.setdefault(frozenset(sets_of(text, 5)) or i, text)
    # equal sets are one group; the two eight-word texts differ in one of four shingles and stay apart
    assert sorted(map(str, got)) == sorted(map(str, groups.values()))
