"""Language, quality and toxicity on rows held out, and on odd tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import odd_documents, odd_labels, rows_of, write
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import bytecnn, language, quality, queries, sampling, toxicity

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def results(spark):
    return {n: {r["doc_id"]: r for r in queries.QUERIES[n](spark, SF).collect()} for n in ("op2_language_id", "op6_quality", "op8_toxicity")}


def test_language_of_held_out_rows(results):
    got, rows = results["op2_language_id"], rows_of(SF, "documents", "doc_id, lang")
    assert len(got) == len(rows) and all(got[d]["held_out"] == held(d) for d, _ in rows)
    assert np.mean([got[d]["lang_pred"] == lang for d, lang in rows if held(d)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality", "quality", 0.93), ("op8_toxicity", "toxic", 0.93)])
def test_labels_of_held_out_rows(results, name, label, least):
    got, rows = results[name], rows_of(SF, "labels", f"doc_id, {label}")
    assert all(r["held_out"] == held(d) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert np.mean([got[d]["predicted"] == y for d, y in rows if held(d)]) > least
    cut = {"quality": 0.7, "toxic": 0.3}[label]
    assert all(r["predicted"] == int(r["score"] >= cut) for r in got.values())


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    write(path, "documents", odd_documents())
    return write(path, "labels", odd_labels())


@pytest.mark.parametrize("name", ["op2_language_id", "op6_quality", "op8_toxicity"])
def test_odd_documents(spark, odd, name):
    got = queries.QUERIES[name](spark, odd).collect()
    assert len(got) == odd_documents().num_rows
    by_id = {}
    for r in got:
        assert by_id.setdefault(r["doc_id"], tuple(r)) == tuple(r)  # repeated rows
    if name == "op2_language_id":
        assert all(by_id[i][2:] == ("und", 0.0) for i in (None, 1, 2, 9))


@pytest.mark.parametrize("name", ["op2_language_id", "op6_quality", "op8_toxicity"])
def test_empty_tables(spark, tmp_path, name):
    write(tmp_path, "documents", odd_documents().slice(0, 0))
    sf = write(tmp_path, "labels", odd_labels().slice(0, 0))
    assert queries.QUERIES[name](spark, sf).count() == 0
    write(tmp_path, "documents", odd_documents())
    got = queries.QUERIES[name](spark, sf).collect()
    assert len(got) == odd_documents().num_rows
    if name == "op6_quality":
        assert {r["score"] for r in got} == {0.5}
    if name == "op8_toxicity":
        assert {r["score"] for r in got} == {0.0}


def test_windows_cover_every_byte():
    shape = bytecnn.Shape(classes=2, window=32, filters=3)
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (0, 1, 4, 5, 31, 32, 33, 60, 500)]
    buffer, starts, first = bytecnn.cut(texts, shape)
    x = bytecnn.windows(buffer, starts, shape)
    for i, t in enumerate(texts):
        own = x[first[i] : first[i + 1]]
        for n in range(2, shape.reach + 1):
            grams = {t[k : k + n] for k in range(len(t) - n + 1)}
            assert grams <= {bytes(w[k : k + n]) for w in own for k in range(len(w) - n + 1)}


def small_network(classes=3, dtype=np.float64):
    shape = bytecnn.Shape(classes=classes, window=16, dims=3, widths=(2, 3), filters=2)
    net, rng = bytecnn.Network.fresh(shape, 2), np.random.default_rng(1)
    net.dense, net.bias, net.offset = rng.normal(size=net.dense.shape), rng.normal(size=net.bias.shape) * 0.1, rng.normal(size=classes)
    for name in ("embed", "kernel", "bias", "dense", "offset"):
        setattr(net, name, getattr(net, name).astype(dtype))
    return net


def plain_probabilities(net, text):
    """The definition: filters at every place of every window, their maxima, the mean over the windows, softmax."""
    s = net.shape
    stride, count = s.window - s.reach + 1, max(1, math.ceil((len(text) - s.reach + 1) / (s.window - s.reach + 1)))
    mean = np.zeros(s.features)
    for w in range(count):
        own = text[w * stride : w * stride + s.window].ljust(s.window, b"\0")
        for f in range(s.features):
            width = s.widths[f // s.filters]
            best = 0.0
            for at in range(s.window - s.reach + 1):
                seen = sum(float(net.embed[own[at + k], d]) * float(net.kernel[k * s.dims + d, f]) for k in range(width) for d in range(s.dims))
                best = max(best, seen + float(net.bias[f]))
            mean[f] += best / count
    z = np.exp(mean @ net.dense + net.offset)
    return z / z.sum()


def test_network_against_plain_convolution():
    net, rng = small_network(), np.random.default_rng(5)
    texts = [bytes(rng.integers(1, 255, n).astype(np.uint8)) for n in (0, 1, 2, 3, 15, 16, 17, 100, 333)]
    got = net.probabilities(texts)
    assert np.allclose(got, [plain_probabilities(net, t) for t in texts], atol=1e-9)


def test_gradients_agree_with_differences(monkeypatch):
    monkeypatch.setattr(bytecnn, "SLICE", 4)
    net, rng = small_network(), np.random.default_rng(1)
    x, counts, target, weight, decay = rng.integers(1, 60, (6, 16)).astype(np.uint8), np.array([2, 1, 3]), np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5]), 0.1

    def loss():
        seen, _ = net.pooled(x)
        mean = np.add.reduceat(seen, np.cumsum(counts) - counts, axis=0) / counts[:, None]
        p = bytecnn.softmax(mean @ net.dense + net.offset)[np.arange(3), target]
        return -(weight * np.log(p)).sum() / weight.sum() + decay * (net.dense**2).sum() / 2

    found = net.gradients(x, counts, target, weight, decay)
    mask = bytecnn.shape_mask(net.shape)
    for name, own in zip(("embed", "kernel", "bias", "dense", "offset"), found, strict=True):
        held = getattr(net, name)
        for place in np.ndindex(held.shape):
            if (name == "kernel" and not mask[place]) or (name == "embed" and place[0] == 0):
                assert own[place] == 0
                continue
            before = held[place]
            held[place] = before + 1e-6
            high = loss()
            held[place] = before - 1e-6
            low = loss()
            held[place] = before
            assert abs((high - low) / 2e-6 - own[place]) < 1e-5, (name, place)


def test_a_sign_anywhere_in_a_long_text_is_learned(spark):
    """One word among 20,000 bytes tells the labels apart; it stands where it likes."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(300)]

    def text(sign):
        words = rng.choices(vocabulary, k=1500)
        for _ in range(40 if sign else 0):
            words.insert(rng.randrange(len(words)), "zqzxv")
        return " ".join(words)

    rows = [(i, text(i % 2), "good" if i % 2 else "bad") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = quality.train(df, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in quality.score(df, network).collect()}
    assert np.mean([got[i] == bool(i % 2) for i in range(80, 120)]) > 0.9
    model = language.train(df.where("doc_id < 80"), tie=("doc_id",))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert np.mean([got[i] == rows[i][2] for i in range(80, 120)]) > 0.9


def test_the_rarest_of_many_languages_is_learned(spark):
    rng = random.Random(8)
    alphabets = [rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèàçñø", 7) for _ in range(150)]

    def text(n):
        return " ".join("".join(rng.choices(alphabets[n], k=rng.randint(2, 9))) for _ in range(60))

    rows = [(i, text(i % 150 if i % 150 != 77 or i < 900 else 3), f"l{i % 150 if i % 150 != 77 or i < 900 else 3:03d}") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert len(model.languages) == 150
    asked = spark.createDataFrame([(i, text(i % 150)) for i in range(600)] + [(10_000 + i, text(77)) for i in range(20)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, model).collect()}
    assert np.mean([got[10_000 + i] == "l077" for i in range(20)]) >= 0.8
    assert np.mean([got[i] == f"l{i % 150:03d}" for i in range(600)]) > 0.8


def test_class_sample_is_balanced(spark):
    rows = [("big", f"t{i}", i) for i in range(5000)] + [("hot", "one text", i) for i in range(3000)] + [("rare", "x", 1)]
    df = spark.createDataFrame(rows, "lang string, text string, doc_id long")
    labels, texts = sampling.class_sample(df, "lang", "text", 50, 1000, "doc_id")
    assert Counter(labels) == {"big": 50, "hot": 50, "rare": 1} and len(texts) == 101
    labels, _ = sampling.class_sample(df, "lang", "text", 50, 30, "doc_id")
    assert Counter(labels) == {"big": 10, "hot": 10, "rare": 1}
    assert sampling.class_sample(df, "lang", "text", 50, 2, "doc_id")[0] == ["big", "hot"] or set(sampling.class_sample(df, "lang", "text", 50, 2, "doc_id")[0]) == {"big", "hot"}
    assert sampling.class_sample(df.limit(0), "lang", "text", 50, 1000) == ([], [])


def test_folding():
    assert toxicity.fold("1d10t, IDIÖT!").split() == ["idiot", "idiot"]
    assert toxicity.fold("ｉdｉot іdіоt i​diot").split() == ["idiot"] * 3
    assert toxicity.fold("$cum @ home tr@sh").split() == ["scum", "home", "trash"]


def test_lexicon_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " lowei": 1.0}, (toxicity.fold("trash can"),), power=0.5, slope=4.0, base=-3.0)
    a = lexicon.automaton()
    assert lexicon.measure(a, "the trash can is full") == (0.0, 5)
    assert lexicon.measure(a, "trash! loweiung trash can tra5h") == (5.0, 5)
    assert lexicon.probability(0, 10) < 0.3 < lexicon.probability(4, 10)
    assert lexicon.probability(4, 10_000) < lexicon.probability(4, 10)


def plain_measure(lexicon, text):
    """Every entry at every place of the folded text, unless an exception phrase covers it."""
    folded = toxicity.fold(text)
    places = lambda term: [i for i in range(len(folded)) if folded.startswith(term, i)]
    safe = [(i, i + len(p)) for p in lexicon.exceptions for i in places(p)]
    total = 0.0
    for term, weight in lexicon.entries.items():
        for i in places(term):
            if not any(a <= i and i + len(term) <= b for a, b in safe):
                total += weight
    return total, len(folded.split())


def test_matching_against_a_plain_search():
    rng = random.Random(2)
    words = ["trash", "trashy", "can", "idiot", "idiotic", "tr", "id", "scum", "a", "the"]
    lexicon = toxicity.Lexicon({" trash ": 2.0, " trash": 0.5, " idiot": 1.25, " scum ": 3.0, " tr ": 0.25, " id": 0.125}, (toxicity.fold("trash can"), toxicity.fold("the idiot"), toxicity.fold("a scum a")))
    automaton = lexicon.automaton()
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "-", "  ", ""]) for _ in range(rng.randint(0, 12)))
        text = "".join(rng.choice({"a": "a4@", "i": "i1!", "o": "o0", "s": "s$5"}.get(c, c)) for c in text)
        assert lexicon.measure(automaton, text) == plain_measure(lexicon, text), text


def test_entries_against_plain_counts(spark):
    """Terms that could never pass the test are left out of the count of tests, and no other."""
    rows_of = {1: 1000, 2: 300, 3: 40, 5: 7, 20: 2}
    least, tested = toxicity.testable(rows_of, 0.1, 0.05)
    for k in range(1, 30):
        m = sum(n for support, n in rows_of.items() if support >= k)
        if m * 0.1**k <= 0.05:
            assert (least, tested) == (k, m)
            break
    assert toxicity.testable({}, 0.1, 0.05) == (1, 0)
    many = [f"insult{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = [(i, f"{many[i % 400]} some words here number{i}", 1) for i in range(2400)] + [(10_000 + i, f"some words here number{i}", 0) for i in range(2400)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lexicon = toxicity.train(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    automaton = lexicon.automaton()
    assert all(lexicon.measure(automaton, m)[0] > 0 for m in many)  # as many entries as the sample proves
    assert lexicon.measure(automaton, "some words here")[0] == 0


def test_hits_are_shown(spark):
    lexicon = toxicity.Lexicon({" trash ": 2.0, " lowei": 1.0}, (toxicity.fold("trash can"),))
    df = spark.createDataFrame([(1, "loweiung TR4SH, trash can"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in toxicity.explain(df, lexicon).collect()}
    assert got == {1: [("lowei", 1.0), ("trash", 2.0)], 2: []}


def test_disguised_words_are_found(spark, tmp_path, results):
    clean = [r for r in rows_of(SF, "documents", "doc_id, text, lang, source") if results["op8_toxicity"][r[0]]["predicted"] == 0]
    texts = [(r[0], r[1], r[2], r[3], None) for r in rows_of(SF, "documents", "doc_id, text, lang, source")]
    planted = [(10_000_000 + i, f"{c[1][:300]} 1d10t {c[1][300:500]} m0r0n lоser", "en", "x", None) for i, c in enumerate(clean[:20])]
    t = pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*texts, *planted, strict=True)), strict=True)))
    write(tmp_path, "documents", t)
    rows = rows_of(SF, "labels", "doc_id, quality, toxic")
    sf = write(tmp_path, "labels", pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*rows, strict=True)), strict=True))))
    got = {r["doc_id"]: r["predicted"] for r in queries.op8_toxicity(spark, sf).where(F.col("doc_id") >= 10_000_000).collect()}
    assert sum(got.values()) >= 15


def test_filtering_stages(spark, odd, results):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() > 0.99 * docs.count()
    good = corpus_pipeline.judge_quality(spark, docs, SF)
    ids = {r[0] for r in good.select("doc_id").collect()}
    labels = rows_of(SF, "labels", "doc_id, quality")
    assert np.mean([(d in ids) == bool(q) for d, q in labels]) > 0.95
    strange = spark.read.parquet(f"{odd}/documents.parquet")
    assert corpus_pipeline.identify_language(spark, strange, odd).columns == strange.columns
    assert corpus_pipeline.judge_quality(spark, strange, odd).columns == strange.columns
