"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all other training rows, whatever their label, is the
unlabelled set, which holds toxic texts at the rate of the class prior. The risk of a linear scorer g is
prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) with the logistic loss; where the second term would go
negative, the step is taken against it, so that the positives can't be memorised.

Features are the presence of words and of word beginnings (letters and digits, A-Z lower-cased), hashed into
2^20 buckets; the buckets that positives hold more often than unlabelled texts are kept. Scoring reads every
whole text once, in numpy over Arrow batches. Nothing but the text enters a score.

Without texts of confirmed positives, or without other texts, nothing can be learned and every score is 0.
Null and empty texts have no features and get the score of the bias. Repeated rows get equal scores;
duplicate labels count once; a document labelled both ways counts as toxic. Of documents with one id the one
whose text sorts first may be a training row, so a repeated id doesn't enlarge the sample. A text is read in
windows: a long one costs its words, not a multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import arrow_batches, give_back, released, stage, text_chunks
from chronofact.llm.shingles import words

BITS = 20
PREFIXES = (4, 5, 6)
#: Bounds of the training sample: confirmed toxic rows and unlabelled rows.
MOST_POSITIVE, MOST_UNLABELLED = 4000, 12_000

_SPLITS = np.ones(256, bool)
_SPLITS[48:58] = _SPLITS[65:91] = _SPLITS[97:123] = _SPLITS[128:] = False


@dataclass(frozen=True)
class Model:
    """weight of each bucket (zero where it isn't used) and the bias."""

    weight: np.ndarray
    bias: float


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)) == 0, F.lit(False))


def _presence(column, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for each distinct feature of each text of an Arrow column, sorted; only buckets of ``used`` if given."""
    found = [_features(raw, at, lo, used) for lo, _, raw, at in text_chunks(column)]
    pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _features(raw: np.ndarray, at: np.ndarray, first: int, used: np.ndarray | None) -> np.ndarray:
    """(text << BITS) | bucket, distinct and sorted; texts are numbered from first."""
    whole, counts, *starts = words(raw, at, _SPLITS, PREFIXES)
    doc = np.repeat(np.arange(first, first + len(counts)), counts)
    docs, buckets = [], []
    for h in (whole, *starts):
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        keep = h != 0 if used is None else (h != 0) & used[bucket]
        docs.append(doc[keep])
        buckets.append(bucket[keep])
    return np.unique((np.concatenate(docs) << BITS) | np.concatenate(buckets))


def _frequencies(batches: Iterator) -> Iterator:
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        positive = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        doc, bucket = _presence(batch.column(0))
        for side in (0, 1):
            seen[side] += np.bincount(bucket[positive[doc] == bool(side)], minlength=1 << BITS)
    at = np.flatnonzero(seen.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1][at]), pa.array(seen[0][at])], ["bucket", "p", "u"])


def _chosen(used: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            doc, bucket = _presence(batch.column(0), used)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["positive", "buckets"])

    return run


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, width: int, prior: float, *, epochs: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear scorer that minimises the non-negative risk, by Adam on full batches."""
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    n_p, n_u = positive.sum(), (~positive).sum()
    for t in range(1, epochs + 1):
        g = np.bincount(rows, w[cols], minlength=len(positive)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
        # logistic losses: log(1 + exp(-g)) against +1, log(1 + exp(g)) against -1
        negative_risk = np.logaddexp(0, g[~positive]).mean() - prior * np.logaddexp(0, g[positive]).mean()
        on_negative = np.where(positive, -prior * s / n_p, s / n_u)
        on_positive = np.where(positive, prior * (s - 1) / n_p, 0)
        slope = on_positive + on_negative if negative_risk >= 0 else -on_negative
        grad = np.append(np.bincount(cols, slope[rows], minlength=width), slope.sum())
        grad[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, features: int = 4096, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fits the scorer on rows that aren't held out. The prior is the labels' toxic rate there, if not given."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{toxic_col}`").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    none = Model(np.zeros(1 << BITS), float("-inf"))
    if not total or not toxic:
        return none
    prior = prior if prior is not None else toxic / total
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    # samples by hash: bounded whatever the tables' sizes
    draw = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30))
    chosen = known.where("toxic = 1").where(draw < int((1 << 30) * min(1.0, most_positive / toxic))).select("id", F.lit(True).alias("positive"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null").where(~held_out(F.col("id")))
    share = min(1.0, most_unlabelled / max(1, docs.count()))
    # the broadcast has most_positive ids
    positives = texts.join(F.broadcast(chosen), "id").select("id", "text", F.lit(True).alias("positive"))
    unlabelled = texts.where(F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1 << 30)) < int((1 << 30) * share)).select("id", "text", F.lit(False).alias("positive"))
    each = positives.unionByName(unlabelled).groupBy("id", "positive").agg(F.min("text").alias("text"))
    sample = stage(each.select("text", "positive"), "toxicity-sample", 8)  # bounded, so a few files
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return none
    counts = sample.mapInArrow(released(_frequencies), "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = (F.col("p") + 0.5) / (n[True] + 1), (F.col("u") + 0.5) / (n[False] + 1)
    # three standard errors above what unlabelled texts show: chance finds of a small sample stay out
    spread = F.sqrt(u * (1 - u) * (1 / n[True] + 1 / n[False]))
    telling = (p - u) * F.log(p / u)
    best = counts.where("p >= 3").where(p - u > 3 * spread).orderBy(F.desc(telling), "bucket").limit(features).select("bucket").toPandas()["bucket"].to_numpy()
    used = np.zeros(1 << BITS, bool)
    used[best] = True
    # at most features numbers a sampled row
    with arrow_batches(spark):
        got = sample.mapInArrow(released(_chosen(used)), "positive boolean, buckets array<int>").toArrow()
    lists = got.column("buckets").combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place = np.zeros(1 << BITS, np.int64)
    place[best] = np.arange(len(best))
    w, bias = fit_nnpu(rows, place[lists.values.to_numpy()], got.column("positive").to_numpy().astype(bool), max(1, len(best)), prior)
    weight = np.zeros(1 << BITS)
    weight[best] = w[: len(best)]
    return Model(weight, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, from 0 to 1. Other columns pass through untouched."""
    at = np.flatnonzero(model.weight)
    weights, bias = model.weight[at], model.bias

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << BITS)  # once a task
        table[at] = weights
        used = table != 0
        for text in texts:
            doc, bucket = _presence(text, used)
            g = np.bincount(doc, table[bucket], minlength=len(text)) + bias
            with np.errstate(over="ignore"):
                yield pa.array(1 / (1 + np.exp(-g)))
        give_back()

    # Arrow's own arrays: no Python string is made of a text
    return docs.withColumn(score_col, F.arrow_udf(of, "double")(F.col(f"`{text_col}`").cast("string")))
