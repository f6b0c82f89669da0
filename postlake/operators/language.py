"""Language identification from character trigrams (LG family).

The model is one bounded table: trigrams are hashed into a fixed number of
buckets, so its size depends on the number of languages and not on the corpus.
Weights are whole numbers, which keeps sums exact in any order. Scoring is
a projection over the whole text: no explode, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postlake.lists import ENGLISH_THRESHOLD

BUCKETS = 1 << 15
MULTIPLIERS = (9973, 613, 1)
WEIGHT_SCALE = 1 << 16
# Trigrams are not independent: a longer text, read in full, counts as this many.
EVIDENCE = 200
#: Languages whose counts one task holds at once before it hands them on (a memory bound only).
MAX_LANGUAGES = 256
CHUNK = 1 << 20


def normalise(text: Column) -> Column:
    """Lower case on one line."""
    return F.lower(F.translate(text, "\n\r", " "))


def trigram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """LG1: how often each hashed trigram occurs per language.

    Counts are combined inside each task, so the shuffle carries at most languages x
    buckets rows per task, whatever the share of one language.
    """
    labelled = df.filter(F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), normalise(F.col(text)).alias("text")
    )
    return (
        labelled.mapInPandas(_count_trigrams, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )


def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one partition, at most MAX_LANGUAGES arrays of BUCKETS at a time."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if lang not in counts:
                if len(counts) == MAX_LANGUAGES:
                    yield from _nonzero(counts)
                    counts = {}
                counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
            for bucket in _trigram_buckets(text or ""):
                np.add.at(counts[lang], bucket, 1)
    yield from _nonzero(counts)


def _nonzero(counts: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for lang, found in counts.items():
        bucket = np.flatnonzero(found)
        yield pd.DataFrame({"lang": lang, "bucket": bucket.astype(np.int32), "n": found[bucket]})


def language_weights(counts: DataFrame) -> DataFrame:
    """Log probabilities with add-one smoothing, scaled to whole numbers.

    A row with bucket -1 holds the weight of buckets a language never showed. The
    windows hold one language each, at most BUCKETS rows.
    """
    per_lang = W.partitionBy("lang")
    smoothed = F.sum("n").over(per_lang) + BUCKETS
    scaled = counts.select(
        "lang", "bucket", "n", smoothed.alias("total"),
        F.row_number().over(per_lang.orderBy("bucket")).alias("i"),
    )
    unseen = scaled.filter("i = 1").select(
        "lang", F.lit(-1).alias("bucket"), F.lit(0).cast("bigint").alias("n"), "total"
    )
    weight = F.round(F.ln((F.col("n") + 1) / F.col("total")) * WEIGHT_SCALE).cast("bigint")
    return scaled.drop("i").unionByName(unseen).select("lang", "bucket", weight.alias("weight"))


def fit_language_id(df: DataFrame, text: str = "text", lang: str = "lang") -> "LanguageModel":
    """Fit on labelled texts; brings the bounded weight table to the driver."""
    counts = trigram_counts(df, text, lang)
    return LanguageModel.load(language_weights(counts))


class LanguageModel:
    """Scores text against a weight table small enough to send to every task."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages = languages
        self.table = table

    @classmethod
    def load(cls, weights: DataFrame) -> "LanguageModel":
        """The dense table, packed per language by executors: one row of BUCKETS weights each.

        The driver receives one packed row per language (4 bytes a bucket), never the
        weight rows themselves; any number of languages is taken.
        """
        packed = weights.groupBy("lang").applyInPandas(_pack_language, "lang string, table binary")
        rows = sorted(packed.collect(), key=lambda r: r["lang"])
        languages = [r["lang"] for r in rows]
        if not rows:
            return cls([], np.zeros((BUCKETS, 0), dtype=np.int32))
        table = np.stack([np.frombuffer(r["table"], dtype=np.int32) for r in rows], axis=1)
        return cls(languages, np.ascontiguousarray(table))

    def score_texts(self, texts: pd.Series) -> pd.DataFrame:
        """Most likely language and its posterior for texts already normalised."""
        names, probabilities = [], []
        for text in texts:
            totals, n = _trigram_totals(text or "", self.table)
            if n:
                # Neighbouring trigrams repeat each other's evidence: n of them count as
                # EVIDENCE * n / (EVIDENCE + n), one rule for all lengths.
                totals = totals * (EVIDENCE / ((n + EVIDENCE) * WEIGHT_SCALE))
            odds = np.exp(totals - totals.max())
            best = int(odds.argmax())
            names.append(self.languages[best])
            probabilities.append(float(odds[best] / odds.sum()))
        return pd.DataFrame({"lang": names, "probability": probabilities})

    def score(self, text: Column) -> Column:
        """LG2: struct(lang, probability)."""
        model = self

        @F.pandas_udf("lang string, probability double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield model.score_texts(texts)

        return scored(normalise(text))

    def is_english(self, text: Column) -> Column:
        """FL3 as one boolean column."""
        model = self

        @F.pandas_udf("boolean")
        def english(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                found = model.score_texts(texts)
                yield (found["lang"] == "en") & (found["probability"] > ENGLISH_THRESHOLD)

        return english(normalise(text))


def _trigram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams of the whole text, a chunk at a time."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    a, b, c = MULTIPLIERS
    for start in range(0, max(len(points) - 2, 0), CHUNK):
        p = points[start:start + CHUNK + 2].astype(np.int64)
        yield (p[:-2] * a + p[1:-1] * b + p[2:] * c) % BUCKETS


def _trigram_totals(text: str, table: np.ndarray) -> tuple[np.ndarray, int]:
    """Summed weights per language over every trigram of a text, and their number."""
    totals, n = np.zeros(table.shape[1], dtype=np.int64), 0
    for bucket in _trigram_buckets(text):
        n += len(bucket)
        if len(bucket) < BUCKETS:
            totals += table[bucket].sum(axis=0, dtype=np.int64)
        else:
            totals += np.bincount(bucket, minlength=BUCKETS) @ table
    return totals, n


def _pack_language(rows: pd.DataFrame) -> pd.DataFrame:
    """One language's weights as BUCKETS int32 values: unseen buckets take the bucket -1 weight."""
    unseen = rows.loc[rows["bucket"] == -1, "weight"]
    table = np.full(BUCKETS, int(unseen.iloc[0]) if len(unseen) else 0, dtype=np.int32)
    seen = rows[rows["bucket"] >= 0]
    table[seen["bucket"].to_numpy()] = seen["weight"].to_numpy()
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "table": [table.tobytes()]})
