"""Bounded labelled samples for the classifiers: only the number of rows is bounded, their texts are whole.

Only training reads them; every score is computed over all rows and whole texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(*columns: Column) -> Column:
    """A fixed pseudo-random order of rows: it depends on their values alone."""
    return F.xxhash64(*columns, F.lit(20_011))


def class_sample(rows: DataFrame, label: str, text: str, per_class: int, most: int, *tie: str) -> tuple[list, list[bytes]]:
    """Labels and whole texts of min(per_class, most / labels) rows of every label, of all its rows where there are fewer.

    The rows are those with the lowest hashes of `tie` and the text.  Where there are more than
    `most` labels, one row of each of the `most` most frequent is taken.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.count()
    if not classes:
        return [], []
    share = max(1, min(per_class, most // classes))
    # So many rows of a label are looked at that chance leaves `share` of them: then the exact number is cut.
    looked = share + 8 * share**0.5 + 16
    rate = F.lit(float(looked)) / F.col("n")
    limits = counts.orderBy(F.desc("n"), label).limit(most).select(label, F.when(rate >= 1, F.lit(2**63 - 1)).otherwise(((rate * 2 - 1) * F.lit(2.0**63)).cast("long")).alias("limit"))
    keyed = rows.withColumn("key", order_key(*map(F.col, tie), F.col(text)))
    near = keyed.join(F.broadcast(limits), label).where(F.col("key") <= F.col("limit"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("key", text))
    held = near.withColumn("place", place).where(F.col("place") <= share).select("key", label, F.col(text).cast("binary").alias("text")).collect()
    held.sort(key=lambda r: (r["key"], r[label], bytes(r["text"])))
    return [r[label] for r in held], [bytes(r["text"]) for r in held]


def labelled_ids(labels: DataFrame, id: str, label: str, per_class: int) -> DataFrame:
    """(id, label) of at most per_class ids of each of the labels 0 and 1, those with the lowest keys."""
    rows = labels.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).distinct()
    keyed = rows.withColumn("key", order_key(F.col("id")))
    picked = [keyed.where(F.col("label") == value).orderBy("key", "id").limit(per_class) for value in (0, 1)]
    return picked[0].unionAll(picked[1]).drop("key")


def labelled_rows(rows: DataFrame, ids: DataFrame, id: str, text: str) -> DataFrame:
    """(id, label, text) of every one of the ids that rows has; the ids go to the rows, so that only the sample is moved.

    Of an id that comes with several texts, the one with the lowest hash is taken.
    """
    held = rows.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return held.groupBy("id", "label").agg(F.min_by("text", order_key(F.col("text"))).alias("text"))


def labelled_texts(rows: DataFrame, labels: DataFrame, id: str, text: str, label: str, per_class: int) -> tuple[list[int], list[bytes]]:
    """Labels and whole texts of at most per_class ids of each of the labels 0 and 1."""
    held = labelled_rows(rows, labelled_ids(labels, id, label, per_class), id, text)
    picked = held.select(order_key(F.col("id"), F.col("text")).alias("key"), "label", F.col("text").cast("binary").alias("text")).collect()
    got = sorted((r["key"], r["label"], bytes(r["text"])) for r in picked)
    return [label for _, label, _ in got], [text for _, _, text in got]


def crops(labels: list, texts: list[bytes], seed: int, least: int = 12, most: int = 160, reach: int = 256) -> tuple[list, list[bytes]]:
    """One short cut of each text, starting and ending at a space where there is one: short texts are rare in a sample."""
    rng, more_labels, more = np.random.default_rng(seed), [], []
    for label, own in zip(labels, texts, strict=True):
        at = int(rng.integers(0, max(1, len(own) - reach + 1)))
        piece = own[at : at + reach]
        size = int(rng.integers(least, most))
        words = piece.split(b" ")
        if len(piece) <= size or len(words) < 4:
            continue
        begin = int(rng.integers(0, len(words) - 2))
        cut = b" ".join(words[begin:])[:size]
        cut = cut[: cut.rindex(b" ")] if b" " in cut else cut
        if len(cut) >= least:
            more_labels.append(label)
            more.append(cut)
    return more_labels, more
