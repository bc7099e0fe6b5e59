"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits and signs that stand for
letters, punctuation to spaces) and matched in one Aho-Corasick pass.  The
lexicon is learned from labels: words, and stems that many words begin with,
that occur in toxic documents far more often than chance allows.  A hit inside
an exception phrase does not count.  The hits' weights are normalised by a power
of the text's length and turned into a probability.

Defined results: a null or empty text has no hit; without labelled rows of both
classes the lexicon is empty and every score is 0; repeated rows get equal
scores; extra columns stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import sampling
from larkspur.llm.common import materialise, prepare_workers

# Signs that are written for Latin letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
CYRILLIC = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x"}
GREEK = {"α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w"}
OTHER = {"ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ℓ": "l"}
UNSEEN = "­​‌‍⁠﻿"

_SIGN = re.compile(r"(?<![^\W_])?[@$!|+](?=[^\W_])")
_SPACED = re.compile(r"[@$!|+]")


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        if base != chr(code):
            table[code] = "".join(c if c.isalnum() else " " for c in base) or None
        elif not chr(code).isalnum():
            table[code] = " "
    for code in range(0x300, 0x370):
        table[code] = None
    for code in [*range(128), *range(0x2000, 0x2070)]:
        if not chr(code).isalnum():
            table[code] = " "
    for pairs in (DIGITS, CYRILLIC, GREEK, OTHER):
        table.update({ord(k): v for k, v in pairs.items()})
    table.update({ord(c): None for c in UNSEEN})
    return table


FOLD = _fold_table()
_SIGN_TABLE = str.maketrans(SIGNS)


def fold(text: str) -> str:
    """The text as words of plain lower-case letters between single or more spaces, with one at either end."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SIGN.sub(lambda m: m[0].translate(_SIGN_TABLE), text)
    return f" {text.translate(FOLD)} "


@dataclass(frozen=True)
class Settings:
    """toxic and clean bound the labelled rows that are learned from; they bound nothing else.

    The entries and phrases have no bound of their own: they are words of those rows.
    """

    toxic: int = 3000
    clean: int = 12000
    stem_least: int = 4
    stem_most: int = 8
    phrase_least: int = 3  # clean rows that an exception phrase must occur in
    explained: float = 0.7  # what a document counts for after each entry found in it
    odds: float = 4.0  # how many times commoner in toxic rows an entry must be
    doubt: float = 0.05  # expected number of entries that chance would add
    powers: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)
    phrases: tuple[str, ...] = ()  # further exception phrases


@dataclass
class Lexicon:
    """entries: folded ' word ' or ' stem' to weight; exceptions: folded ' phrase '."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    power: float = 0.5
    slope: float = 0.0
    base: float = -40.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.entries.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            held = found.get(phrase, None)
            if held is None:
                found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """(first place, last place, weight) of the hits of a folded text that lie in no exception phrase."""
        if not len(automaton):
            return []
        hits, safe = [], []
        for end, (size, weight) in automaton.iter(folded):
            (safe if weight is None else hits).append((end - size + 1, end, weight))
        if safe:
            safe.sort()
            starts = [s for s, _, _ in safe]
            reach = list(np.maximum.accumulate([e for _, e, _ in safe]))
            hits = [h for h in hits if not ((i := bisect_right(starts, h[0])) and reach[i - 1] >= h[1])]
        return hits

    def measure(self, automaton, text: str) -> tuple[float, int]:
        """(sum of the weights of the hits, number of words) of a text."""
        folded = fold(text)
        return math.fsum(w for _, _, w in self.hits(automaton, folded)), len(folded.split())

    def density(self, weight: float, length: int) -> float:
        return weight / max(1, length) ** self.power

    def probability(self, weight: float, length: int) -> float:
        z = self.base + self.slope * self.density(weight, length)
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def _terms(folded: str, settings: Settings) -> set[str]:
    """The words of a folded text, and their stems."""
    out = set()
    for word in set(folded.split()):
        if len(word) > 1:
            out.add(f" {word} ")
        for n in range(settings.stem_least, min(len(word), settings.stem_most) + 1):
            out.add(f" {word[:n]}")
    return out


def _log10_tail(k: int, n: int, p: float) -> float:
    """log10 of the chance of k or more of n when each comes with chance p (bounded by its first terms)."""
    total, term = 0.0, math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio, lead = 1.0, term
    for i in range(k, min(n, k + 200) + 1):
        total += ratio
        ratio *= (n - i) / (i + 1) * p / (1 - p)
    return (lead + math.log(total)) / math.log(10)


def testable(rows_of: dict[int, int], share: float, doubt: float) -> tuple[int, int]:
    """The fewest toxic documents that can make a term an entry, and how many terms have as many.

    rows_of: how many terms occur in each number of toxic documents.  A term of k toxic documents comes
    by chance with share ** k or more; those that could not stand the test of all terms of their support
    need not be tested, nor count among the tests.
    """
    left, least = sum(rows_of.values()), 1
    while left and math.log10(left) + least * math.log10(share) > math.log10(doubt):
        left -= rows_of.get(least, 0)
        least += 1
    return least, left


def select_entries(sure: list[tuple[str, int, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Of the terms that chance does not explain, the longest form of each that loses no toxic document.

    sure: term, its toxic and clean documents, and the toxic documents of the longer term that has most.
    """
    support = {term: p for term, p, _, _ in sure}
    closed = {t: math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1)) for t, p, n, longer in sure if t.endswith(" ") or longer < p}
    kept: dict[str, float] = {}
    covered: dict[str, int] = {}
    for term in sorted(closed, key=lambda t: (-closed[t], len(t), t)):
        if any(term[:n] in kept for n in range(2, len(term))) or covered.get(term, 0) > 0.8 * support[term]:
            continue
        kept[term] = closed[term]
        for n in range(2, len(term)):
            covered[term[:n]] = covered.get(term[:n], 0) + support[term]
    return kept


def unexplained(entries: dict[str, float], counts: dict[str, tuple[int, int]], found: list[list[str]], clean: int, tested: int, settings: Settings) -> dict[str, float]:
    """The entries that still stand when the documents that stronger entries explain count less.

    Copies of a toxic document repeat all its words; its insults explain it, and the rest falls away.
    """
    where: dict[str, list[int]] = {}
    for i, own in enumerate(found):
        for term in set(own):
            where.setdefault(term, []).append(i)
    left = np.ones(len(found))
    share = len(found) / max(1, len(found) + clean)
    limit = math.log10(settings.doubt / max(1, tested))
    kept = {}
    for term in sorted(entries, key=lambda t: (-len(where.get(t, ())) / (1 + counts[t][1]), t)):
        places = where.get(term, [])
        support = int(left[places].sum())
        clean_count = counts[term][1]
        if support and support / len(found) > settings.odds * (clean_count + 0.5) / clean and _log10_tail(support, support + clean_count, share) < limit:
            kept[term] = entries[term]
            left[places] *= settings.explained
    return kept


def train(rows: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Learn from rows whose label in the table `labels` (id, label) is 0 or 1."""
    prepare_workers(rows.sparkSession)
    toxic_ids = sampling.labelled_ids(labels, id, label, settings.toxic).where("label = 1")
    clean_ids = sampling.labelled_ids(labels, id, label, settings.clean).where("label = 0")
    sample = materialise(sampling.labelled_rows(rows, toxic_ids.unionAll(clean_ids), id, text).select("label", "text"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()

    def count(batches):
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for value, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[value].update(_terms(fold(own), settings))
            if len(held[0]) + len(held[1]) > 400_000:
                yield table(held)
                held = (Counter(), Counter())
        yield table(held)

    def table(held):
        terms = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[1][t] for t in terms], pa.int64()), pa.array([held[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    counted = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = materialise(counted.where("toxic > 0"), "terms")
    share = toxic / (toxic + clean)
    least, tested = testable({r["toxic"]: r["n"] for r in counted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}, share, settings.doubt)
    limit = math.log10(settings.doubt / max(1, tested))

    def test(batches):
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield batch.filter(pa.array([_log10_tail(p, p + n, share) < limit for p, n in pairs], pa.bool_()))

    longer = counted.groupBy(F.expr("substring(term, 1, length(term) - 1)").alias("term")).agg(F.max("toxic").alias("longer"))
    able = counted.where((F.col("toxic") >= least) & (F.col("toxic") / F.lit(toxic) > settings.odds * (F.col("clean") + 0.5) / F.lit(clean))).join(longer, "term", "left")
    sure = able.select("term", "toxic", "clean", F.coalesce("longer", F.lit(0)).alias("longer")).mapInArrow(test, "term string, toxic long, clean long, longer long").collect()
    counts = {r["term"]: (r["toxic"], r["clean"]) for r in sure}
    lexicon = Lexicon(entries=select_entries([tuple(r) for r in sure], toxic, clean))
    names = list(lexicon.entries)

    def present(batches):
        automaton, place = lexicon.automaton(), {t: i for i, t in enumerate(names)}
        for batch in batches:
            found = []
            for own in batch.column(0).to_pylist():
                folded = fold(own)
                found.append(sorted({place[folded[end - size + 1 : end + 1]] for end, (size, _) in automaton.iter(folded)}) if names else [])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["found"])

    toxic_rows = sample.where("label = 1").select("text").distinct()
    found = [[names[i] for i in r["found"]] for r in toxic_rows.mapInArrow(present, "found array<int>").collect()]
    found.sort()
    lexicon.entries = unexplained(lexicon.entries, counts, found, clean, tested, settings)
    lexicon.exceptions = tuple(dict.fromkeys([fold(p) for p in settings.phrases] + _exceptions(sample, lexicon, clean / toxic, settings.phrase_least)))

    def measure(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            found = [lexicon.measure(automaton, own) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["label", "weight", "length"])

    measured = sorted(sample.mapInArrow(measure, "label int, weight double, length long").collect())  # a row for each of the sample
    return calibrate(lexicon, np.array([r["label"] for r in measured]), np.array([r["weight"] for r in measured]), np.array([r["length"] for r in measured]), settings)


def _exceptions(sample: DataFrame, lexicon: Lexicon, odds: float, least: int) -> list[str]:
    """Two-word phrases around hits that are far commoner in clean documents than in toxic ones."""

    def phrases(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            terms, clean, toxic = [], [], []
            for value, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = re.sub(" +", " ", fold(own))
                seen = set()
                for end, (size, _) in automaton.iter(folded) if len(automaton) else ():
                    start = end - size + 1
                    stop = folded.index(" ", start + 1)
                    after = folded.find(" ", stop + 1)
                    before = folded.rfind(" ", 0, start)
                    if after > 0:
                        seen.add(folded[start : after + 1])
                    if before >= 0:
                        seen.add(folded[before : stop + 1])
                terms += seen
                clean += [1 - value] * len(seen)
                toxic += [value] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["phrase", "clean", "toxic"])

    found = sample.mapInArrow(phrases, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    good = found.where((F.col("clean") >= least) & (F.col("clean") > 8 * odds * F.col("toxic"))).orderBy(F.desc("clean"), "phrase")
    return [r["phrase"] for r in good.collect()]


def calibrate(lexicon: Lexicon, label: np.ndarray, weight: np.ndarray, length: np.ndarray, settings: Settings) -> Lexicon:
    """The power of the length and the logistic curve that fit the labels best."""
    best = math.inf
    for power in settings.powers:
        x = weight / np.maximum(1, length) ** power
        scale = max(float(np.median(x[x > 0])) if (x > 0).any() else 1.0, 1e-9)
        design = np.c_[np.ones(len(x)), x / scale]
        beta = np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            gradient = design.T @ (p - label) + 1e-3 * beta
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            move = np.linalg.solve(hessian, gradient)
            beta -= move * min(1, 4 / max(1e-9, float(np.abs(move).max())))
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -float(np.log(np.where(label == 1, p, 1 - p)).sum())
        if loss < best:
            best, lexicon.power, lexicon.base, lexicon.slope = loss, power, float(beta[0]), max(0.0, float(beta[1] / scale))
    return lexicon


def score(rows: DataFrame, lexicon: Lexicon, *, text: str = "text", score_out: str = "score") -> DataFrame:
    """Add the probability that a row is toxic."""
    if not lexicon.entries:
        return rows.withColumn(score_out, F.lit(0.0))
    prepare_workers(rows.sparkSession)
    held: list = []

    @F.arrow_udf("double")
    def measure(column: pa.Array) -> pa.Array:
        if not held:
            held.append(lexicon.automaton())
        return pa.array([lexicon.probability(*lexicon.measure(held[0], own)) for own in column.to_pylist()], pa.float64())

    return rows.withColumn(score_out, measure(F.coalesce(F.col(text), F.lit(""))))


def explain(rows: DataFrame, lexicon: Lexicon, *, text: str = "text", hits_out: str = "hits") -> DataFrame:
    """Add what was found in every row: the entries in the order of the text, with their weights."""
    prepare_workers(rows.sparkSession)
    held: list = []

    @F.arrow_udf("array<struct<entry string, weight double>>")
    def find(column: pa.Array) -> pa.Array:
        if not held:
            held.append(lexicon.automaton())
        out = []
        for own in column.to_pylist():
            folded = fold(own)
            out.append([{"entry": folded[a : b + 1].strip(), "weight": w} for a, b, w in lexicon.hits(held[0], folded)])
        return pa.array(out, pa.list_(pa.struct([("entry", pa.string()), ("weight", pa.float64())])))

    return rows.withColumn(hits_out, find(F.coalesce(F.col(text), F.lit(""))))
