"""SentencePiece, packing, sharding and language-model scores."""

import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import LONG, odd_documents, odd_labels, rows_of, write

import corpus_pipeline
from larkspur.llm import ctw, lm, packing, queries, sentencepieces, sharding

P = pytest.importorskip("public_tokenizers")
TRICKY = ["", " ", "  a  b ", "\n\n", "a\tb\nc", "internationalization's", "▁x", "aaaaaaaaaaaaaaaa", "ΑΣ İstanbul é é", "it's I'LL we've '''s", "x1y22z ٣٤ ½²", "😀👍🏽 !!??--", "\x1c\x85 a\x1fb", "a b　c", "<|endoftext|>x y<|startoftext|>", "日本語 テスト"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    write(path, "labels", odd_labels())
    return write(path, "documents", odd_documents())


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    write(path, "labels", odd_labels().slice(0, 0))
    return write(path, "documents", odd_documents().slice(0, 0))


# SentencePiece


def test_ids_are_the_library_s(sf_dir):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    ref, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Encoder(path)
    texts = [t for (t,) in rows_of(sf_dir, "documents", "text")] + TRICKY + [LONG, "y" * 3000]
    flat, edges = mine.ids(texts)
    got = [flat[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    assert got == ref.encode(texts, num_threads=1)
    assert [mine.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]


def test_table_of_words_may_be_emptied(sf_dir):
    path = P.path("piece_bpe_32k.model")
    whole, small = sentencepieces.Encoder(path), sentencepieces.Encoder(path)
    small.most = 50
    texts = [t for (t,) in rows_of(sf_dir, "documents", "text")][:30]
    want = whole.ids(texts)[0]
    assert (np.concatenate([small.ids([t])[0] for t in texts]) == want).all()


def test_unigram_search_is_best(tmp_path):
    import itertools
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁a", -2.9, 1), ("ba", -4.0, 1), ("aba", -5.5, 1)]
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    data = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    data += field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    enc = sentencepieces.Encoder(str(path))
    scores = {p: s for p, s, t in pieces if t == 1}

    def best(w):
        if not w:
            return 0.0
        return max((scores[w[:n]] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in scores), default=-1e9)

    for n in range(1, 7):
        words = ["".join(x) for x in itertools.product("ab", repeat=n)]
        flat, edges = enc.ids(words)
        for i, w in enumerate(words):
            own = [pieces[k][0] for k in flat[edges[i] : edges[i + 1]]]
            assert "".join(own) == "▁" + w and math.isclose(sum(scores[p] for p in own), best("▁" + w), abs_tol=1e-5)


def test_sentencepiece_query(spark, odd, empty):
    got = queries.op1_sentencepiece(spark, odd).collect()
    assert len(got) == odd_documents().num_rows
    assert all(r["round_trip"] for r in got if r["doc_id"] != 10) and {r["n_ids"] for r in got if r["doc_id"] in (None, 1)} == {0}
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert queries.op1_sentencepiece(spark, empty).count() == 0
    path = P.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "hello there", "x"), (2, None, "y")], "id long, text string, keep string")
    back = sentencepieces.decode(sentencepieces.encode(df, path), path).orderBy("id").collect()
    assert [r["decoded"] for r in back] == ["hello there", ""] and back[0]["keep"] == "x"


# packing


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_are_the_tokenizer_s(sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 1000)
    texts = [t for (t,) in rows_of(sf_dir, "documents", "text")] + TRICKY
    held = packing.TextIds(P.path("word_bpe_49k.json"))
    assert held.pattern is not None
    assert [held.ids(t).tolist() for t in texts] == reference_ids(texts)
    joined = " ".join(texts) * 3
    assert held.ids(joined).tolist() == reference_ids([joined])[0]
    other = packing.TextIds(P.path("byte_bpe_50k.json"))  # another structure: the library encodes whole texts
    assert other.pattern is None and other.ids("Hello there").tolist() == other.tokenizer.encode("Hello there", add_special_tokens=False).ids


def test_word_ids_of_every_character_and_of_random_texts():
    held = packing.TextIds(P.path("word_bpe_49k.json"))
    assert packing.TextIds(P.path("word_bpe_49k.json"), held.strange).avoided.pattern == held.avoided.pattern
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    pools = [every, every[:0x300], every[:0x3000], [c for c in every if ord(c) < 0x20000 and unicodedata.category(c)[0] in "LMN"], list("aZ ß'sŁl09\t\u0301\u0327Éİ.")]
    texts = [f"a{c}." for c in every[:0x30000]] + ["".join(rng.choices(rng.choice(pools), k=rng.randint(1, 12))) for _ in range(20_000)]
    differ = [t for t, ids in zip(texts, reference_ids(texts), strict=True) if held.ids(t).tolist() != ids]
    assert not differ


def plain_best_fit(lengths, cap):
    """Vector best fit by looking at every sequence that was ever opened."""
    full = [cap.tokens, cap.documents, cap.attention]
    need = [[int(n), 1, int(n) ** 2] for n in lengths]
    left, out = [], [0] * len(need)
    for i in sorted(range(len(need)), key=lambda i: (-sum(w * x / f for w, x, f in zip(cap.weights, need[i], full, strict=True)), i)):
        best = None
        for s, room in enumerate(left):
            if all(r >= x for r, x in zip(room, need[i], strict=True)):
                if cap.rule == "dot":
                    value = -sum(w * (r / f) * (x / f) for w, r, x, f in zip(cap.weights, room, need[i], full, strict=True))
                else:
                    value = sum(w * ((r - x) / f) ** 2 for w, r, x, f in zip(cap.weights, room, need[i], full, strict=True))
                if best is None or value < best[0] - 1e-15:
                    best = (value, s)
        if best is None:
            left.append(list(full))
        out[i] = best[1] if best else len(left) - 1
        left[out[i]] = [r - x for r, x in zip(left[out[i]], need[i], strict=True)]
    return out


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(4096, 5, 5_000_000), packing.Capacity(4096, 7, 9_000_000, (1.0, 0.3, 0.5), "dot"), packing.Capacity(4096, 3, 4096**2, (0.5, 1.0, 0.0))])
def test_best_fit_against_a_plain_loop(cap):
    rng = np.random.default_rng(7)
    lengths = np.minimum(rng.geometric(0.003, 400), int(cap.attention**0.5))
    mine, _ = packing.best_fit(lengths, cap)
    plain = plain_best_fit(lengths, cap)
    # ties may go to another sequence of the same room: what every sequence holds is compared
    held = lambda seq: sorted(tuple(sorted(lengths[np.flatnonzero(np.array(seq) == s)])) for s in set(seq))
    assert held(mine.tolist()) == held(plain)
    if cap.documents < 9:  # every capacity binds somewhere
        sizes = [len(h) for h in held(plain)]
        assert max(sizes) == cap.documents


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.geometric(0.002, 3000), 4096)
    cap = packing.Capacity(4096, 9, 6_000_000 if rule == "norm" else 4096 * 4096, rule=rule)
    lengths = lengths[lengths.astype(np.int64) ** 2 <= cap.attention]
    seq, place = packing.best_fit(lengths, cap)
    for s in np.unique(seq):
        own = np.flatnonzero(seq == s)
        own = own[np.argsort(place[own])]
        assert (place[own] == np.r_[0, np.cumsum(lengths[own])[:-1]]).all()
        assert lengths[own].sum() <= cap.tokens and len(own) <= cap.documents and (lengths[own] ** 2).sum() <= cap.attention
    plain, _ = packing.best_fit(lengths, packing.Capacity())
    assert len(np.unique(plain)) <= math.ceil(lengths.sum() / 4096) + 2
    assert len(packing.best_fit(np.zeros(0, np.int64), cap)[0]) == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5000]), packing.Capacity())


def check_packed(rows, packed, texts):
    by_doc = {}
    for r in packed:
        by_doc.setdefault((r["doc_id"], r["piece"]), []).append(r)
    want = Counter()
    for (d, _), ids in zip(rows, reference_ids(texts), strict=True):
        own = np.array([*ids, 1], "<u4")
        for i, at in enumerate(range(0, len(own), 4096)):
            want[d, i, at, len(own[at : at + 4096]), zlib.crc32(own[at : at + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_sequence)


def test_packing_query(spark, sf_dir, odd, empty):
    rows = rows_of(sf_dir, "documents", "doc_id, text")
    packed = queries.op7_best_fit(spark, sf_dir).collect()
    used = check_packed(rows, packed, [t or "" for _, t in rows])
    assert used <= math.ceil(sum(r["length"] for r in packed) / 4096) + 2
    t = odd_documents()
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    check_packed(rows, queries.op7_best_fit(spark, odd).collect(), [x or "" for _, x in rows])
    assert queries.op7_best_fit(spark, empty).count() == 0


# sharding


@pytest.mark.parametrize("which", ["sf", "odd", "empty"])
def test_sharding_query(spark, sf_dir, odd, empty, which):
    sf = {"sf": sf_dir, "odd": odd, "empty": empty}[which]
    df = queries.op10_sharding(spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString()
    got = df.collect()
    rows = rows_of(sf, "documents", "doc_id, text")
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    load, slots = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if which == "sf":
        largest = max(s for _, s, _ in want)
        assert max(load.values()) - min(load.get(i, 0) for i in range(40)) <= 2 * largest


def test_copies_are_dealt_evenly(spark):
    df = spark.range(2000).selectExpr("1L doc_id", "'same text' text", "'en' lang", "'s' source")
    got = sharding.shard(df, 7).groupBy("shard").count().collect()
    assert len(got) == 7 and max(r["count"] for r in got) - min(r["count"] for r in got) <= 2


def exact_tree(rows, shards, first=0):
    """Row to shard by sorting: the widest key's cut whose bytes at or below it are nearest to floor(shards / 2) / shards of all."""
    if shards == 1:
        return {r["row"]: first for r in rows}
    dims = len(rows[0]["keys"])
    spans = [max(r["keys"][i] for r in rows) - min(r["keys"][i] for r in rows) for i in range(dims)]
    dim = spans.index(max(spans))
    goal = sum(r["size"] for r in rows) * (shards // 2) / shards
    ordered = sorted(rows, key=lambda r: r["keys"][dim])
    below = list(itertools.accumulate((r["size"] for r in ordered), initial=0))
    cut = min(range(len(below)), key=lambda i: (abs(below[i] - goal), -i))
    return exact_tree(ordered[:cut], shards // 2, first) | exact_tree(ordered[cut:], shards - shards // 2, first + shards // 2)


@pytest.mark.parametrize("shards", [2, 7, 20])
def test_cuts_are_exact_weighted_medians(spark, shards):
    df = spark.range(700).selectExpr("id * id % 1009 doc_id", "repeat(chr(97 + id % 5), cast(id * 37 % 211 as int)) text", "array('en', 'de', 'fr')[id % 3] lang", "concat('s', id % 2) source")
    now, total = sharding.keyed(sharding.metadata(df))
    want = exact_tree([r.asDict() for r in now.collect()], shards)
    got = {r["row"]: r["shard"] for r in sharding.split(now, shards, total / shards).collect()}
    assert got == want


# language model


def slow_ctw(train, text, depth):
    """Context-tree weighting by the definition, one context at a time."""
    counts = {}

    def steps(t):
        data = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(data)):
            node = 1
            for b in range(7, -1, -1):
                bit = data[i] >> b & 1
                yield data[i - depth : i][::-1], node, bit
                node = node * 2 + bit

    for t in train:
        for context, node, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((context[:d], node), [0, 0])[bit] += 1
    longer = {}
    for context, node in counts:
        if context:
            longer.setdefault((context[:-1], node), []).append(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(context, node):
        key = context, node
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if len(context) == depth else np.logaddexp(own, sum(weighted(c, node) for c in longer.get(key, ()))) + math.log(0.5)
        return memo[key]

    total = 0.0
    for context, node, bit in steps(text):
        done, rest, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            key = context[:d], node
            if key not in counts:
                break
            n = counts[key]
            last = (n[bit] + 0.5) / (sum(n) + 1)
            a = 1.0 if d == depth else math.exp(math.log(0.5) + kt(*n) - weighted(*key))
            done, rest = done + rest * a * last, rest * (1 - a)
        total += math.log10(done + rest * last)
    return total


def lm_rows(spark, sf):
    return {r["doc_id"]: r for r in queries.op4_lm_score(spark, sf).collect()}


def check_base(rows, got):
    trains = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1
    counts, ends = Counter(), 0
    for d, t in rows:
        if trains(d):
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + bool(ends)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        logs = [math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[x] for x in w), ends]]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (not trains(d), len(w) + 1, n)
        assert r["n_known"] == sum(counts[x] > 0 for x in w) + bool(ends)
        assert math.isclose(r["base_score"], sum(logs), rel_tol=1e-9)
    return trains


def test_lm_matches_the_definition(spark, tmp_path, monkeypatch):
    texts = ["the cat sat", "the cat ran", "a dog sat", "THE CAT", "", None, "zzz \0 x", "zzz \0", "zzz ", "\0", "the dog the dog"] * 2
    rows = [(i, t) for i, t in enumerate(texts)]
    sf = write(tmp_path, "documents", pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "score": ["clash"] * len(rows), "block": [1] * len(rows)}))
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 30)
    monkeypatch.setattr(lm, "PART_ROWS", 10)
    got = lm_rows(spark, sf)
    trains = check_base(rows, got)
    train = [(t or "").encode().lower() for d, t in rows if trains(d)]
    for d, t in rows:
        assert math.isclose(got[d]["score"], slow_ctw(train, (t or "").encode().lower(), lm.FULL), rel_tol=1e-5)
        assert math.isclose(got[d]["bits_per_byte"], -got[d]["score"] / math.log10(2) / (len((t or "").encode()) + 1), rel_tol=1e-9)


def test_lm_of_odd_tables(spark, odd, empty):
    t = odd_documents()
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = lm_rows(spark, odd)
    check_base(rows, got)
    assert all(r["score"] < 0 for r in got.values())
    assert queries.op4_lm_score(spark, empty).count() == 0


def test_lm_beats_the_baseline_per_byte(spark):
    got = [r for r in queries.op4_lm_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) / sum(r["n_bytes"] + 1 for r in got) / math.log10(2) > -2.3


def test_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 101, 400).astype(np.uint8)
    keys, n = np.unique(ctw.grams_of(text, 3), return_counts=True)
    contexts = np.r_[np.unique(keys >> np.uint64(8))[:9], np.uint64(0x616161), np.uint64(0x010203), np.uint64(0x610203)]
    asked = np.unique(np.concatenate([(c << np.uint64(8)) | np.arange(256, dtype=np.uint64) for c in contexts]))
    every = np.union1d(keys, asked)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, keys)] = n
    depths, ups = ctw.grow(every, counts, 3, 0)
    p = 10 ** ctw.walk(ctw.Mixture.start(len(depths[-1].grams)), depths, ups).log10()
    at = np.searchsorted(every, asked)
    sums = np.bincount(np.unique(asked >> np.uint64(8), return_inverse=True)[1], p[at])
    assert np.allclose(sums, 1)


def test_lookup():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    held = lm.Lookup(np.r_[np.uint64(0), keys], np.arange(len(keys) + 1))
    assert (held.get(np.r_[keys[::-1], np.uint64(0)]) == np.r_[np.arange(len(keys), 0, -1), 0]).all()
    with pytest.raises(KeyError):
        held.get(np.array([2**63 + 1], np.uint64))


# the pipeline


def test_pipeline(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    kept = sorted({r["doc_id"] for r in packed})
    check_packed([(d, texts[d]) for d in kept], packed, [texts[d] for d in kept])
    labels = dict(rows_of(sf_dir, "labels", "doc_id, quality"))
    assert np.mean([labels[d] for d in kept if d in labels]) > 0.95
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, odd).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
