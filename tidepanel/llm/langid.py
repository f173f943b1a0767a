"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
hashed byte 3- and 4-grams tells the languages with a 1 from those with a 0: its
weights are smoothed log ratios of n-gram frequencies, languages counting alike,
and its output is the mean weight over all n-grams of the text. Decoding adds up,
per language, the logistic losses of the bits against its codeword, each bit
weighted by its accuracy on the sample, and takes the least (loss-weighted
decoding); the score is the softmax share of the language, and a text is
``ambiguous`` when the two best are close.

Few languages get all distinct bits (an exhaustive code); more than seven get
random codewords with many bits, the best of several drawings by least distance.
The sample is a hash sample of about ``sample_docs`` whole documents of every
length, as many of each language, of which every language has some. Its n-grams
are counted and its classifiers tried out by tasks: the driver holds a count for
each language and bucket, and the outputs of each sampled document.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without any language in the sample everything is ``und``; a single learned
language is predicted for every text; null ids belong to no fold; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.grams import LETTER_TABLE, Scan, gram_buckets, text_of
from tidepanel.llm.shared import fold_of, forget, rounds_of, stored

BITS = 17
BUCKETS = 2 << BITS
GRAMS = (3, 4)


def codewords(languages: int, seed: int = 23) -> np.ndarray:
    """A matrix of -1 and 1: a row per language, no constant or repeated bits."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        bits = np.arange(1, 1 << (languages - 1))
        code = np.array([(bits >> (languages - 1 - k)) & 1 for k in range(languages)])
        return np.where(code, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(8 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (languages, width))
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        same = code @ code.T - 2 * width * np.eye(languages)
        if (width - same.max()) / 2 > apart:
            best, apart = code, (width - same.max()) / 2
    return best


def gram_counts(scan: Scan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, n in enumerate(GRAMS):
        at, bucket = gram_buckets(scan.data, scan.edge, n, BITS)
        yield text_of(at, scan.edge), bucket + (i << BITS)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket by bit
    trust: np.ndarray  # of each bit
    scale: float

    def outputs(self, scan: Scan) -> np.ndarray:
        total, count = np.zeros((scan.texts, self.weights.shape[1])), np.zeros(scan.texts)
        for text, bucket in gram_counts(scan):
            for lo in range(0, len(text), 1_000_000):
                t, b = text[lo : lo + 1_000_000], bucket[lo : lo + 1_000_000]
                first = np.flatnonzero(np.diff(t, prepend=-1))
                total[t[first]] += np.add.reduceat(self.weights[b], first, axis=0)
            count += np.bincount(text, minlength=scan.texts)
        return total / np.maximum(count, 1)[:, None]

    def losses(self, outputs: np.ndarray) -> np.ndarray:
        margin = outputs[:, None, :] * self.code[None, :, :] * self.scale
        return (np.logaddexp(0, -margin) * self.trust).sum(axis=2)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, and the lead over the second best."""
        loss = self.losses(self.outputs(Scan(texts, LETTER_TABLE)))
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        lead = order[:, -1] - (order[:, -2] if share.shape[1] > 1 else 0)
        return loss.argmin(axis=1), order[:, -1], lead


def weights_of(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The classifiers, bucket by bit, from n-gram counts of language by bucket."""
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    if len(counts) < 2:
        return np.zeros((counts.shape[1], code.shape[1]), np.float32)
    side = lambda rows: rows.T.astype(float) @ share / rows.sum(axis=0)[:, None]
    return np.ascontiguousarray((np.log(side(code > 0)) - np.log(side(code < 0))).T.astype(np.float32))


def calibrate(model: LanguageModel, out: np.ndarray, label: np.ndarray) -> None:
    """Set the trust of each bit and the scale from outputs of the sample."""
    code = model.code
    right = ((out > 0) == (code[label] > 0)).mean(axis=0)
    model.trust = np.maximum(right - 0.5, 0.05) / np.maximum(right - 0.5, 0.05).sum()
    best = np.inf
    for scale in (1, 2, 4, 8, 16, 32, 64):
        keep, model.scale = model.scale, float(scale)
        loss = model.losses(out) * code.shape[1]
        log = -loss - np.log(np.exp(-loss + loss.min(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + loss.min(axis=1, keepdims=True)
        now = -log[np.arange(len(label)), label].mean()
        if now >= best:
            model.scale = keep
            break
        best = now
    model.trust = model.trust * code.shape[1]


def _count(languages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((languages, BUCKETS), np.int64)
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                label = part.column(1).to_numpy(zero_copy_only=False)
                for text, bucket in gram_counts(Scan(texts, LETTER_TABLE)):
                    np.add.at(counts.reshape(-1), label[text].astype(np.int64) * BUCKETS + bucket, 1)
        for k in range(languages):
            found = np.flatnonzero(counts[k])
            if len(found):
                yield pa.record_batch([pa.array(np.full(len(found), k, np.int32)), pa.array(found.astype(np.int32)), pa.array(counts[k][found])], names=["label", "bucket", "n"])

    return run


def _try_out(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                out = sent.value.outputs(Scan(texts, LETTER_TABLE))
                yield pa.record_batch([part.column(1), pa.array([x.tobytes() for x in out], pa.binary())], names=["label", "out"])

    return run


def learn(docs: DataFrame, folds: int = 4, held: int = 2, sample_docs: int = 12_000, seed: int = 29) -> LanguageModel | None:
    """A model from documents with lang of the other folds; None without any."""
    spark = docs.sparkSession
    train = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    sizes = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    each = max(4, sample_docs // len(names))
    # At least some four documents of a rare language: all of it where it has fewer.
    known = spark.createDataFrame([(x, k, min(1.0, each / sizes[x])) for k, x in enumerate(names)], "lang string, label int, rate double")
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = train.select("text", F.col("lang").cast("string").alias("lang"), share.alias("share")).join(F.broadcast(known), "lang").filter("share < rate").select("text", "label")
    # Few tasks, dealt evenly: each gives one row per language and bucket it has seen.
    sample = stored(sample.repartition(8), "language-sample")
    counts = np.zeros((len(names), BUCKETS))
    table = sample.mapInArrow(_count(len(names)), "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[table["label"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    code = codewords(len(names))
    model = LanguageModel(names, code, weights_of(counts, code), np.ones(code.shape[1]), 1.0)
    sent = spark.sparkContext.broadcast(model)
    tried = sorted((r.label, bytes(r.out)) for r in sample.mapInArrow(_try_out(sent), "label int, out binary").collect())
    forget(sample)
    if tried:
        calibrate(model, np.stack([np.frombuffer(x) for _, x in tried]), np.array([k for k, _ in tried]))
    return model


def identify(docs: DataFrame, model: LanguageModel | None, folds: int = 4, held: int = 2) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score, ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part, texts in rounds_of(batch, "text"):
                letters = np.array(part.column(2).to_pylist(), bool)
                names, scores, lead = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts))
                if m is not None and letters.any():
                    k, s, gap = m.predict(texts)
                    names[letters] = np.array(m.languages, object)[k[letters]]
                    scores[letters], lead[letters] = s[letters], gap[letters]
                yield pa.record_batch([part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(lead < 0.2)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select("doc_id", "text", letters.alias("letters")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
    held_out = F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
