"""Language identification by a byte convolutional network.

Filters of several widths, max pooling over fixed-length windows and a softmax
layer, trained in numpy on labelled text and applied to every window of every
whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with nothing to learn from, every text is ``und``; equal probabilities go to the
language that sorts first; repeated rows get equal results; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import bytecnn, sampling
from larkspur.llm.common import fresh, prepare_workers, release

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """per_language and rows bound the labelled rows that are learned from; they bound nothing else.

    Every language is learned from per_language rows, or rows / languages where that is less, and
    every such text is read whole.  The filters grow with the number of languages.
    """

    per_language: int = 600
    rows: int = 40_000
    window: int = 256
    filters: int = 10
    languages_per_filter: int = 8
    widths: tuple[int, ...] = (2, 3, 4, 5)
    steps: int = 500
    visits: int = 100_000
    epochs: int = 3
    seed: int = 11


@dataclass
class Model:
    languages: list[str]
    network: bytecnn.Network | None


def train(rows: DataFrame, settings: Settings = Settings(), *, text: str = "text", lang: str = "lang", tie: tuple[str, ...] = ()) -> Model:
    """Learn from rows whose lang and text are not null; tie: further columns by which copies of a text are told apart when rows are drawn."""
    usable = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), *tie)
    labels, texts = sampling.class_sample(usable, "lang", "text", settings.per_language, settings.rows, *tie)
    languages = sorted(set(labels))
    if not languages:
        return Model([], None)
    more_labels, more = sampling.crops(labels, texts, settings.seed)
    labels, texts = labels + more_labels, texts + more
    shape = bytecnn.Shape(classes=len(languages), window=settings.window, widths=settings.widths, filters=settings.filters + len(languages) // settings.languages_per_filter)
    place = {name: i for i, name in enumerate(languages)}
    target = np.array([place[name] for name in labels])
    weight = 1 / np.bincount(target, minlength=len(languages))[target]
    network = bytecnn.Network.fresh(shape, settings.seed).fit(texts, target, weight, epochs=settings.epochs, batch=32, rate=0.01, decay=1e-4, steps=settings.steps, visits=settings.visits, seed=settings.seed)
    return Model(languages, network)


def identify(rows: DataFrame, model: Model, *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its probability to every row."""
    if model.network is None:
        return rows.withColumns({lang_out: F.lit(UNDETERMINED), score_out: F.lit(0.0)})
    prepare_workers(rows.sparkSession)
    languages, network = model.languages, model.network

    @F.arrow_udf("struct<lang string, score double>")
    def predict(column: pa.Array) -> pa.Array:
        release()
        p = network.probabilities(column.to_pylist())
        best = p.argmax(1)
        return pa.StructArray.from_arrays([pa.array([languages[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best], pa.float64())], ["lang", "score"])

    seen = fresh(rows, "__seen")
    held = rows.withColumn(seen, F.when(F.col(text).rlike(r"\p{L}"), predict(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return held.withColumns({lang_out: F.coalesce(F.col(f"{seen}.lang"), F.lit(UNDETERMINED)), score_out: F.coalesce(F.col(f"{seen}.score"), F.lit(0.0))}).drop(seen)
