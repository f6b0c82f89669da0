"""Toxic passages as maximum-scoring segments over token log-odds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlake.llm.ids import within
from postlake.llm.words import Lookup, hash_ranges, lower_ascii, map_texts, mix, slices, split_tokens, text_bytes
from postlake.sources.scratch import cut_lineage

#: At most so many labelled texts are learned from, those with the least id hashes.
TRAIN_ROWS = 1_000_000
#: A token is looked up as a whole and by its first bytes; the longest known form counts.
PREFIXES = (6, 5, 4)
#: Dirichlet pseudo-counts behind every form.
PRIOR = 0.5
#: A form counts from this log-odds on, above or below zero, and from this z-score. The first keeps
#: out what large numbers make significant only, such as words of longer texts.
LEAST_ODDS, LEAST_Z = 3.0, 4.0
#: Toxic texts that a form is known from.
LEAST_TOXIC = 4
#: Score of a token without a known form.
NEUTRAL = -0.05
#: Segments from here up (in calibrated units) settle the scale of clean texts.
TAIL = 1.0
FOLDS = 5


@dataclass(frozen=True)
class ToxicityModel:
    """Forms and their log-odds, the extreme-value scale, and the final logistic curve."""

    forms: np.ndarray
    log_odds: np.ndarray
    rate: float
    scale: float
    intercept: float
    slope: float


def held_out(doc_id):
    """Rows never learned from: crc32 of the id as text divides by FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, n_tokens, segments.

    Learns from the texts of `labelled_docs` (`docs` if left out) whose doc_id has a 0/1
    `toxic` label and is not held out; equal texts count once. `segments` are all
    maximal-scoring token ranges with start, end and calibrated score. A text without
    tokens (NULL, empty) has none and gets the score of a text without findings.
    Conflicting labels of an id count as toxic; NULL labels and ids are left out of learning.
    Without a toxic or a clean example nothing is found and every score is the prior rate.
    Other columns are ignored; repeated rows give repeated results.

    1. Documents with each token form are counted per class; forms with high log-odds under a
       Dirichlet prior, and a high z-score, tell the classes apart. Other known forms are
       neutral, and keep a token from being judged by its first bytes.
    2. A linear scan finds every maximal segment of every text. Tokens without a
       known form cost a little, so segments end where toxic words thin out.
    3. The segments of clean texts give the rate and scale of the extreme-value law: in n
       tokens, a chance segment of at least s has expectation scale * n * exp(-rate * s).
       A text's finding is the sum of -ln of that expectation over its significant segments.
    4. A logistic curve over findings, fitted on the same rows, gives the score.
    """
    docs = _texts(docs)
    learn = _texts(labelled_docs) if labelled_docs is not None else docs
    labels = _training(learn, labels)
    forms, log_odds = _learn_forms(learn, labels)
    segments = cut_lineage(find_segments(docs, forms, log_odds), "segments")
    trained = segments if labelled_docs is None else cut_lineage(
        find_segments(learn.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi"), forms, log_odds), "segments")
    model = _calibrated(trained.join(F.broadcast(labels), "doc_id"), forms, log_odds)
    return with_scores(segments, model)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` less the rows whose text scores one half or more, learned from `docs` itself.

    The verdict is joined by doc_id; rows of one id go together if any of their texts is
    toxic, and rows without doc_id stay.
    """
    scored = score_toxicity(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(within(cut_lineage(scored, "toxic")), "doc_id", "left_anti").select(*docs.columns)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) to learn from, at most TRAIN_ROWS rows, one per different text."""
    id_ = F.col("doc_id").cast("long")
    known = labels.select(id_.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut_lineage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "labelled")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(known), "doc_id")
    once = hashed.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("m"))
    return cut_lineage(once.select("m.*").dropDuplicates(["doc_id"]), "learned")


def token_forms(column: pa.Array):
    """(first, forms): each row's range of tokens, and for each token its hashes, whole form
    first. A token is a run of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, first = split_tokens(data, offsets)
    forms = np.empty((len(starts), 1 + len(PREFIXES)), np.uint64)
    forms[:, 0] = hash_ranges(data, starts, ends)
    for k, size in enumerate(PREFIXES, 1):
        forms[:, k] = mix(hash_ranges(data, starts, np.minimum(starts + size, ends)) ^ np.uint64(size))
    return first, forms


def _learn_forms(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted form hashes and their log-odds: 0 for neutral ones, NaN for undecided ones."""
    totals = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return np.zeros(0, np.uint64), np.zeros(0)
    context = docs.sparkSession.sparkContext

    def counted(of: int, table) -> DataFrame:
        wanted = labels.where(F.col("toxic") == of).select("doc_id")
        held = context.broadcast(table) if table is not None else None

        def count(batches):
            lookup = Lookup(held.value) if held is not None else None
            for batch in slices(batches, "text"):
                first, forms = token_forms(batch.column("text"))
                row = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(first))
                if lookup is not None:
                    token, level = np.nonzero(lookup.places(forms) >= 0)
                    row, forms = row[token], forms[token, level]
                else:
                    row, forms = np.repeat(row, forms.shape[1]), forms.ravel()
                # One count per row and form.
                _, one = np.unique(mix(forms + row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
                form, n = np.unique(forms[one], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(form.view(np.int64)), pa.array(n)], names=["form", "n"])

        texts = docs.join(F.broadcast(wanted), "doc_id", "left_semi")
        return map_texts(texts, count, "form long, n long").groupBy("form").agg(F.sum("n").alias("n"))

    seen = _arrays(counted(1, None).where(F.col("n") >= LEAST_TOXIC))
    also = _arrays(counted(0, seen[0]))
    forms, in_toxic = seen
    in_clean = np.zeros(len(forms))
    in_clean[np.searchsorted(forms, also[0])] = also[1]
    # The prior's weight is shared between the classes as texts are.
    a, b = PRIOR * 2 * toxic / (toxic + clean), PRIOR * 2 * clean / (toxic + clean)
    odds = np.log((in_toxic + a) / (toxic - in_toxic + PRIOR)) - np.log((in_clean + b) / (clean - in_clean + PRIOR))
    z = odds / np.sqrt(1 / (in_toxic + a) + 1 / (in_clean + b))
    decided = (np.abs(z) >= LEAST_Z) & (np.abs(odds) >= LEAST_ODDS)
    # Neutral only on evidence from clean texts; a form never seen there is undecided (NaN)
    # and leaves the word to its shorter forms.
    return forms, np.where(decided, odds, np.where(in_clean > 0, 0.0, np.nan))


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted forms and counts. Their number is bounded by the training rows."""
    table = counts.toArrow()
    forms = table.column("form").to_numpy().view(np.uint64)
    order = np.argsort(forms)
    return forms[order], table.column("n").to_numpy()[order].astype(np.float64)


SEGMENTS = "array<struct<start:bigint,end:bigint,score:double>>"
_SEGMENT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_segments(docs: DataFrame, forms: np.ndarray, log_odds: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, raw): all maximal segments of every text, in token positions."""
    held = docs.sparkSession.sparkContext.broadcast((forms, log_odds))

    def find(batches):
        table, odds = held.value
        lookup = Lookup(table)
        for batch in slices(batches, "text"):
            first, hashes = token_forms(batch.column("text"))
            places = lookup.places(hashes)
            known = places >= 0
            known[known] = ~np.isnan(odds[places[known]])
            token = np.flatnonzero(known.any(axis=1))
            # The first known and decided form is the most specific one.
            score = odds[places[token, known[token].argmax(axis=1)]] if len(token) else np.zeros(0)
            token, score = token[score != 0], score[score != 0]
            cuts = np.searchsorted(token, first)
            found = []
            for row in range(batch.num_rows):
                a, b = cuts[row], cuts[row + 1]
                found.append(maximal_segments((token[a:b] - first[row]).tolist(), score[a:b].tolist()) if b > a else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(
                    [[{"start": s, "end": e, "score": v} for s, e, v in own] for own in found], _SEGMENT)],
                names=["doc_id", "n_tokens", "raw"])

    return map_texts(docs, find, f"doc_id long, n_tokens long, raw {SEGMENTS}")


def maximal_segments(at: list[int], scores: list[float], neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence that scores `scores` at
    the positions `at`, in order, and `neutral` elsewhere. Linear time.

    Kept segments carry the running total before and after them. A new one is joined with
    the nearest earlier segment that starts lower, if it also ends lower; and again.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, before, after, link
    total, done = 0.0, 0
    for place, score in zip(at, scores):
        total += neutral * (place - done)
        done = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        start, after = place, total
        link = len(stack) - 1
        while True:
            while link >= 0 and stack[link][2] >= before:
                link = stack[link][4]
            if link < 0 or stack[link][3] >= after:
                stack.append((start, done, before, after, link))
                break
            start, before, earlier = stack[link][0], stack[link][2], stack[link][4]
            del stack[link:]
            link = earlier
    return [(start, end, after - before) for start, end, before, after, _ in stack]


def _calibrated(trained: DataFrame, forms: np.ndarray, log_odds: np.ndarray) -> ToxicityModel:
    """Fit the extreme-value law on clean texts, then the logistic curve on all."""
    trained = trained.select("toxic", "n_tokens", "raw")
    counts = trained.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    base = (counts["toxic"] + 0.5) / (counts["rows"] + 1)
    flat = ToxicityModel(forms, log_odds, 1.0, 1.0, float(np.log(base / (1 - base))), 0.0)
    if not len(forms) or counts["toxic"] in (0, counts["rows"]):
        return flat
    # Beyond a chance segment's least score, excess is exponential with the law's rate.
    clean = trained.where("toxic = 0")
    tail = clean.select(F.explode("raw").alias("s")).select(F.col("s.score").alias("x")).where(F.col("x") > 0)
    seen = tail.agg(F.count("x").alias("n"), F.avg("x").alias("mean")).first()
    tokens = clean.agg(F.sum("n_tokens")).first()[0] or 0
    # One unit of pseudo-data at the rate that log-odds have under their own model.
    rate = min(1.0, (seen["n"] + 1) / (seen["n"] * (seen["mean"] or 0.0) + 1))
    above = tail.where(F.col("x") * rate >= TAIL).count()
    scale = (above + 1) / (max(tokens, 1) * float(np.exp(-TAIL)))
    half = ToxicityModel(forms, log_odds, float(rate), float(scale), 0.0, 1.0)
    bins = trained.select("toxic", F.least(F.round(_finding(half) * 4), F.lit(4000.0)).alias("x")).groupBy(
        "x").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).orderBy("x").collect()
    x = np.array([r["x"] for r in bins]) / 4
    intercept, slope = _logistic(np.minimum(x, 40.0), np.array([r["toxic"] for r in bins], float), np.array([r["n"] for r in bins], float))
    return ToxicityModel(forms, log_odds, float(rate), float(scale), intercept, slope)


def _logistic(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Newton steps for a logistic curve over binned counts, with a little ridge."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (toxic - n * p) - 0.01 * beta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def _finding(model: ToxicityModel):
    """Sum of -ln of the expected chance segments, over significant segments."""
    chance = F.log(F.lit(model.scale) * F.greatest(F.col("n_tokens"), F.lit(1)))
    return F.aggregate(
        "raw", F.lit(0.0), lambda s, g: s + F.greatest(F.lit(0.0), g["score"] * model.rate - chance))


def with_scores(segments: DataFrame, model: ToxicityModel) -> DataFrame:
    chance = F.log(F.lit(model.scale) * F.greatest(F.col("n_tokens"), F.lit(1)))
    linear = F.lit(model.intercept) + model.slope * F.least(_finding(model), F.lit(40.0))
    calibrated = F.transform("raw", lambda g: F.struct(
        g["start"].alias("start"), g["end"].alias("end"), (g["score"] * model.rate - chance).alias("score")))
    score = 1 / (1 + F.exp(-linear))
    return segments.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"), "n_tokens", calibrated.alias("segments"))
