"""Quality classification by a byte-level convolutional network.

Learned filters slide over overlapping chunks that together cover the whole
document; each filter's maximum in a chunk is averaged over the chunks and one
dense layer makes a single probability of it.

Defined results: a null or empty text is scored as one blank chunk; without
labelled rows of both classes every score is 0.5; repeated rows get equal
scores; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import bytecnn, sampling
from larkspur.llm.common import prepare_workers, release


@dataclass(frozen=True)
class Settings:
    """per_class bounds the labelled rows that are learned from; it bounds nothing else: their texts are read whole."""

    per_class: int = 1500
    window: int = 256
    filters: int = 12
    widths: tuple[int, ...] = (2, 3, 4, 5)
    steps: int = 900
    visits: int = 200_000
    epochs: int = 4
    crop_weight: float = 0.5
    clean_weight: float = 2.0
    seed: int = 7

    @property
    def shape(self) -> bytecnn.Shape:
        return bytecnn.Shape(classes=2, window=self.window, widths=self.widths, filters=self.filters)


def train(rows: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, id: str = "doc_id", text: str = "text", label: str = "quality") -> bytecnn.Network | None:
    """Learn from rows whose label in the table `labels` (id, label) is 0 or 1; other labels are passed over."""
    found, texts = sampling.labelled_texts(rows, labels, id, text, label, settings.per_class)
    if len(set(found)) < 2:
        return None
    more_labels, more = sampling.crops(found, texts, settings.seed)
    target = np.array(found + more_labels)
    weight = np.where(np.arange(len(target)) < len(found), 1.0, settings.crop_weight)
    weight /= np.bincount(target, weight, 2)[target]
    weight = np.where(target == 1, settings.clean_weight, 1.0) * weight
    return bytecnn.Network.fresh(settings.shape, settings.seed).fit(texts + more, target, weight, epochs=settings.epochs, batch=32, rate=0.01, decay=1e-4, steps=settings.steps, visits=settings.visits, seed=settings.seed)


def score(rows: DataFrame, network: bytecnn.Network | None, *, text: str = "text", score_out: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row."""
    if network is None:
        return rows.withColumn(score_out, F.lit(0.5))
    prepare_workers(rows.sparkSession)

    @F.arrow_udf("double")
    def predict(column: pa.Array) -> pa.Array:
        release()
        return pa.array(network.probabilities(column.to_pylist())[:, 1], pa.float64())

    return rows.withColumn(score_out, predict(F.coalesce(F.col(text), F.lit("")).cast("binary")))
