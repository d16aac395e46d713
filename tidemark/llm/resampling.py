"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import column, hash_words, materialize, nonempty, settled, text_blocks, unit_noise

BUCKETS = 1 << 14
#: Target texts that the target model is fitted on, at most.
MOST_TARGETS = 20_000
FRACTION = 0.8
#: n-grams of raw text that smooth the target model.
PRIOR = 1000.0
BINS = 4096
#: Words whose n-grams are counted or scored at once; a text of any length is taken in such windows.
WORDS_AT_ONCE = 1 << 19


def bucket_ngrams(words: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and that of each word with the next one of its text (-1: it is the last)."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    single = ((words * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    pair = np.full(len(words), -1, dtype=np.int64)
    joined = words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pair[:-1] = ((joined * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    pair[last] = -1
    return single, pair


def _windows(block: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, buckets of words and pairs, where each text's words begin) of a block, window by window."""
    words, bounds = hash_words(block)
    for at in range(0, max(len(words), 1), WORDS_AT_ONCE):
        end = min(len(words), at + WORDS_AT_ONCE)
        single, pair = bucket_ngrams(words[at : end + 1], np.clip(bounds - at, 0, min(len(words), end + 1) - at), buckets)
        yield at, single[: end - at], pair[: end - at], bounds


def ngram_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: one row for each task and bucket is shuffled; buckets bounds what is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, block in text_blocks(column(batch, "text")):
                for _, single, pair, _ in _windows(block, buckets):
                    total += np.bincount(single, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(settled(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log of target's over raw's probability for each bucket; 0 for buckets that raw doesn't have.

    The target model is smoothed by `prior` n-grams drawn like the raw text, so where it knows nothing it says what raw says, and
    without targets every ratio is 0.
    """
    q = raw / max(raw.sum(), 1)
    p = (target + prior * q) / (target.sum() + prior)
    return np.where(raw > 0, np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(q, 1e-300)), 0.0)


def importance_scores(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_ngrams, score: a whole text's log importance weight, the sum of its n-grams' log ratios, and mean_score, that by n-gram.

    n-grams are words and pairs of neighbours. Texts without words score 0. Narrow.
    """
    buckets = len(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.append(ratio, 0.0)  # no pair is worth nothing
        for batch in nonempty(batches):
            counts, sums = [], []
            for _, block in text_blocks(column(batch, "text")):
                total, n = np.zeros(len(block)), np.zeros(len(block), dtype=np.int64)
                for at, single, pair, bounds in _windows(block, buckets):
                    low, high = np.clip(bounds[:-1] - at, 0, len(single)), np.clip(bounds[1:] - at, 0, len(single))
                    mine = np.flatnonzero(low < high)
                    for values, to in ((worth[single] + worth[pair], total), (1 + (pair >= 0), n)):
                        if len(mine):  # text by text, so that a text's sum doesn't depend on what stands beside it
                            to[mine] += np.add.reduceat(values, low[mine])
                counts.append(n)
                sums.append(total)
            n, total = np.concatenate(counts), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], ["id", "n_ngrams", "score", "mean_score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = source.mapInArrow(settled(score), f"id {source.schema['id'].dataType.simpleString()}, n_ngrams long, score double, mean_score double")
    return scored.withColumnRenamed("id", id_col)


def gumbel_top(scored: DataFrame, fraction: float = FRACTION, seed: int = 42, id_col: str = "doc_id", score_col: str = "score") -> DataFrame:
    """Adds gumbel_key and selected: the ceil(fraction * rows) rows of largest score_col plus Gumbel noise, ties by id.

    The noise is a hash of id, n_ngrams and seed, so reruns agree, and rows of one id, or of none, have noises of their own if they
    differ in length. The cut is found without a global sort: counts of BINS key ranges give the range that holds it, and
    only that range is ranked, again by ranges, until BINS rows or one key value are left; of equal keys those of smaller id are
    selected, and all rows of the last id.
    """
    noise = -F.log(-F.log(unit_noise(*[F.col(c) for c in (id_col, "n_ngrams") if c in scored.columns], seed=seed)))
    keyed = materialize(scored.withColumn("gumbel_key", F.col(score_col) + noise), "gumbel")
    n, low, high = keyed.agg(F.count(F.lit(1)), F.min("gumbel_key"), F.max("gumbel_key")).first()
    keep = int(np.ceil(fraction * n))
    if not n or keep <= 0:
        return keyed.withColumn("selected", F.lit(False))
    if keep >= n:
        return keyed.withColumn("selected", F.lit(True))
    inside, above = keyed, 0
    while n > BINS and low < high:
        width = (high - low) / BINS
        bins = inside.groupBy(F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(BINS - 1)).alias("bin"))
        parts = sorted(((r["bin"], r["n"], r["a"], r["b"]) for r in bins.agg(F.count(F.lit(1)).alias("n"), F.min("gumbel_key").alias("a"), F.max("gumbel_key").alias("b")).collect()), reverse=True)
        for _, count, a, b in parts:
            if above + count >= keep:
                break
            above += count
        n, low, high = count, a, b
        inside = keyed.where(F.col("gumbel_key").between(low, high))
    # Rows by key, largest first: BINS of them, or all of one key, whose ids are then counted.
    cut = inside.groupBy("gumbel_key", id_col).agg(F.count(F.lit(1)).alias("n"))
    if low < high:
        few = sorted(((-r[0], r[1] is None, r[1], r[2]) for r in cut.collect()), key=lambda x: x[:2] + ((x[2],) if x[2] is not None else ()))
        for key, missing, last, count in few:
            above += count
            if above >= keep:
                low = -key
                break
    else:
        place = F.sum("n").over(Window.partitionBy("gumbel_key").orderBy(F.col(id_col).asc_nulls_last()))
        at = cut.withColumn("place", place).where(F.col("place") >= keep - above).orderBy("place").first()
        missing, last = at[id_col] is None, at[id_col]
    tie = (F.col("gumbel_key") == low) & (F.lit(True) if missing else F.coalesce(F.col(id_col) <= F.lit(last), F.lit(False)))
    return keyed.withColumn("selected", (F.col("gumbel_key") > low) | tie)


def resample(
    docs: DataFrame, targets: DataFrame, fraction: float = FRACTION, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", most_targets: int = MOST_TARGETS, score_col: str = "score"
) -> DataFrame:
    """Scores every document by target over raw and selects a fraction of them like the target.

    targets: ids of documents of the target kind; the target model is fitted on the most_targets ids of least hash (their
    bound makes them fit to broadcast), the raw model on all documents. Returns id_col, n_ngrams, score, mean_score, gumbel_key
    and selected, a row for each row of docs. Keys are made of score, the log importance weight, or of mean_score, which length
    doesn't decide, if score_col says so. Null and empty texts score 0; without targets every score is near 0; repeated rows
    have equal keys and go or stay together. Other columns play no part.
    """
    ids = targets.select(F.col(id_col).alias("target_id_")).where("target_id_ IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("target_id_"), "target_id_").limit(most_targets)
    texts = docs.select(id_col, text_col)
    chosen = texts.join(F.broadcast(ids), F.col(id_col) == F.col("target_id_"), "left_semi")
    ratio = log_ratio(ngram_counts(chosen, text_col), ngram_counts(texts, text_col))
    return gumbel_top(importance_scores(texts, ratio, id_col, text_col), fraction, seed, id_col, score_col)
