"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; other documents, whatever they are,
are unlabelled. Features are hashed whole words and byte 5-grams. From bounded
samples (``positives``, ``unlabelled``) the features that differ most between the
two are chosen, and a linear model on their presence minimises the risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) (Kiryo et
al. 2017) with the logistic loss in numpy. The prior is the share of label 1
among the labels that may be used. The score is the sigmoid of bias + log(mean(exp(sum of
weights))) over the text's windows of ``WINDOW`` bytes, which start every half window
and together hold every n-gram: the odds that some one window is toxic. A sum over
the whole text, or its highest window, would rise with length alone. The model is fitted on
each sampled document's highest window, chosen again as the weights change, and
features count in the unlabelled once a window, so what a long text meets by chance
is not taken for toxic.

Samples are hash samples of whole documents of every length. Labels of the held-out fold are never read for learning, and a
document's labels, lang, source and id are no inputs of its score.

Defined cases: null and empty texts get the score of a text without features;
null labels and labels without a document are ignored, of repeated labels the
largest counts; without a positive label every score is 0; null ids belong to no
fold, and are scored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.grams import Scan, gram_buckets, text_of, word_buckets
from tidepanel.llm.shared import fold_of, modest_batches, rounds_of

BITS = 20
BUCKETS = 2 << BITS  # words, then 5-grams
HALF = 1_000
WINDOW = 2 * HALF


def features(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, byte in the text) of every word and 5-gram, with repetitions."""
    words = scan.words
    at, gram = gram_buckets(scan.data, scan.edge, 5, BITS)
    text = np.concatenate([words.text_of_words(), text_of(at, scan.edge)])
    return text, np.concatenate([word_buckets(words, BITS), gram + (1 << BITS)]), np.concatenate([words.begin, at]) - scan.edge[text]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positives, and in how many windows (side by side) of unlabelled
    documents, each bucket occurs in this task."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for part, texts in rounds_of(batch, "text", 750_000):
            positive = np.array(part.column(1).to_pylist(), bool)
            text, bucket, byte = features(Scan(texts))
            known = positive[text]
            for k, own in enumerate((~known, known)):
                cell = text[own] if k else text[own] + len(texts) * (byte[own] // WINDOW)
                pairs = np.unique(cell * BUCKETS + bucket[own])
                counts[k] += np.bincount(pairs % BUCKETS, minlength=BUCKETS).astype(np.int32)
    found = np.flatnonzero(counts[0] + counts[1])
    for lo in range(0, len(found), 100_000):
        at = found[lo : lo + 100_000]
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "u", "p"])


@dataclass
class Windows:
    """The windows of a batch of texts that hold chosen features: ``feature`` by
    window, ``of``: the window of each, ``text`` of each window, ``bare``: how many
    windows of each text hold none."""

    feature: np.ndarray
    of: np.ndarray
    text: np.ndarray
    bare: np.ndarray

    def level(self, weights: np.ndarray) -> np.ndarray:
        """Per text, the logarithm of the mean of exp(sum of weights) of its windows."""
        total = np.bincount(self.of, weights[self.feature], minlength=len(self.text))
        top = np.where(self.bare > 0, 0.0, -np.inf)
        np.maximum.at(top, self.text, total)
        mass = self.bare * np.exp(-top) + np.bincount(self.text, np.exp(total - top[self.text]), minlength=len(top))
        return top + np.log(mass / (self.bare + np.bincount(self.text, minlength=len(top))))


def _windows(slot: np.ndarray, scan: Scan) -> Windows:
    width, sizes = int(slot.max()) + 2, np.diff(scan.edge)
    number = np.maximum(-(-(sizes - WINDOW) // HALF), 0) + 1
    first = np.concatenate([[0], np.cumsum(number)])
    text, bucket, byte = features(scan)
    at = np.flatnonzero(slot[bucket] >= 0)
    text, feature, k = text[at], slot[bucket[at]].astype(np.int64), byte[at] // HALF
    # Every place lies in the windows that start in its half and in the one before.
    keys = [(first[text[ok]] + w[ok]) * width + feature[ok] for w in (k, k - 1) for ok in [(w >= 0) & (w < number[text])]]
    pairs = np.unique(np.concatenate(keys))
    window, of = np.unique(pairs // width, return_inverse=True)
    owner = np.searchsorted(first, window, "right") - 1
    return Windows(pairs % width, of, owner, number - np.bincount(owner, minlength=len(sizes)))


@dataclass
class ToxicModel:
    """``slot``: bucket to feature or -1; ``weights`` of the features; ``bias``."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        z = _windows(self.slot, Scan(texts)).level(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def choose_features(counts: DataFrame, n_u: int, n_p: int, prior: float, most: int) -> np.ndarray:
    """The buckets that differ most between positives and windows of the unlabelled
    (chi-square), of those where the prior-corrected share of toxic documents,
    prior * p / u, is a half or more even at the low end of p. ``counts``: bucket,
    u, p; at most ``most`` rows reach the driver."""
    p, u = F.col("p").cast("double"), F.col("u").cast("double")
    both = (u + p + 1) / (n_u + n_p + 2)
    diff = p / n_p - u / max(n_u, 1)
    chi = diff * diff / (both * (1 - F.least(both, F.lit(0.999))) * (1 / n_p + 1 / max(n_u, 1)))
    toxic_share = prior * (p - F.sqrt(p)) / n_p / (u + 0.5) * max(n_u, 1)
    rows = counts.filter((p >= 4 + n_p / 200) & (toxic_share >= 0.5)).select("bucket", chi.alias("chi")).filter("chi > 10")
    return np.array(sorted(r.bucket for r in rows.orderBy(F.desc("chi"), "bucket").limit(most).collect()), np.int64)


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk."""
    w, b = np.zeros(xp.shape[1]), -1.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, rounds + 1):
        # In the features' own precision: mixed products would copy them each time.
        own = w.astype(xp.dtype)
        zp, zu = (xp @ own).astype(np.float64) + b, (xu @ own).astype(np.float64) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu_minus = -sig(-zp) / len(zp), sig(zp) / len(zp), sig(zu) / len(zu)
        if negative >= 0:
            cp, cu = prior * gp_plus - prior * gp_minus, gu_minus
        else:  # the estimate of the negative risk overfits: step back from it
            cp, cu = prior * gp_minus, -gu_minus
        g = np.append(cp.astype(xp.dtype) @ xp + cu.astype(xu.dtype) @ xu + l2 * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, positives: int = 4000, unlabelled: int = 8000, most_features: int = 1500, seed: int = 17) -> ToxicModel:
    spark = docs.sparkSession
    modest_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    if not toxic:
        return ToxicModel(np.full(BUCKETS, -1, np.int16), np.zeros(0), -np.inf)
    prior = min(max(toxic / total, 1e-3), 0.999)
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # About that many ids whatever the number of labels: safe to send to every task.
    picked = known.filter(F.col("toxic") & (share < min(1.0, positives / toxic))).select("doc_id", F.lit(True).alias("positive"))
    pool = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    n_pool = docs.filter(F.col("doc_id").isNotNull()).count() * (folds - 1) / folds
    share_u = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    both = pool.join(F.broadcast(picked), "doc_id", "left").withColumn("in_u", share_u < min(1.0, unlabelled / max(n_pool, 1)))
    both = both.filter("positive or in_u").select("text", F.explode(F.filter(F.array(F.col("positive"), F.when(F.col("in_u"), F.lit(False))), lambda x: x.isNotNull())).alias("positive"))
    # Few tasks, dealt evenly: each gives one row per bucket it has seen.
    both = both.repartition(8).cache()
    n_p = both.filter("positive").count()
    n_u = both.filter("not positive").count()
    counts = both.mapInArrow(_presence, "bucket int, u int, p int").groupBy("bucket").agg(F.sum("u").alias("u"), F.sum("p").alias("p"))
    chosen = choose_features(counts, n_u, n_p, prior, most_features) if n_p else np.zeros(0, np.int64)
    slot = np.full(BUCKETS, -1, np.int16)
    slot[chosen] = np.arange(len(chosen))
    if not len(chosen):
        both.unpersist()
        return ToxicModel(slot, np.zeros(0), float(np.log(prior / (1 - prior))))
    sent = spark.sparkContext.broadcast(slot)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rounds_of(batch, "text", 750_000):
                w = _windows(sent.value, Scan(texts))
                cuts = np.searchsorted(w.of, np.arange(len(w.text) + 1))
                rows = [[] if not bare else [b""] for bare in w.bare]
                for text, lo, hi in zip(w.text.tolist(), cuts, cuts[1:]):
                    rows[text].append(w.feature[lo:hi].astype(np.int16).tobytes())
                yield pa.record_batch([part.column(1), pa.array([sorted(set(r)) for r in rows], pa.list_(pa.binary()))], names=["positive", "x"])

    coded = both.mapInArrow(encode, "positive boolean, x array<binary>").collect()
    both.unpersist()
    coded.sort(key=lambda r: (r.positive, r.x))  # the same sum order in every run
    y = np.array([r.positive for r in coded], bool)
    sets = [[np.frombuffer(w, np.int16).astype(np.int64) for w in r.x] for r in coded]
    weights = np.ones(len(chosen))
    for _ in range(5):
        x = np.zeros((len(sets), len(chosen)), np.float32)
        for i, windows in enumerate(sets):
            x[i, windows[0] if len(windows) == 1 else max(windows, key=lambda w: weights[w].sum())] = 1
        weights, bias = fit_nnpu(x[y], x[~y], prior)
    return ToxicModel(slot, weights, bias)


def score(docs: DataFrame, model: ToxicModel, folds: int = 5, held: int = 0) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rounds_of(batch, "text", 750_000):
                yield pa.record_batch([part.column(0), pa.array(sent.value.scores(texts))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    held_out = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rounds_of(batch, "text", 750_000):
                yield part.filter(pa.array(sent.value.scores(texts) < 0.5))

    assert at >= 0
    return docs.mapInArrow(run, docs.schema)
