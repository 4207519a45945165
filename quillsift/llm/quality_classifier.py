"""Quality scores from random-indexing word vectors and a small network.

Random indexing (Kanerva et al., 2000): every word has a sparse random index
vector, drawn from its hash; its context vector is the sum of the index
vectors of its neighbours over the whole corpus.  A document pools the context
vectors of its words; a two-layer network on that, trained with numpy on
labelled documents, gives a score whose probabilities are calibrated by a
temperature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.shared import as_bytes, remember_only

#: Hash buckets of the vocabulary, so that the word table has a fixed size whatever the corpus: WORDS * DIM floats, 4 MB.
WORDS = 1 << 14
DIM = 64
#: Neighbours on each side, and non-zero entries of an index vector.
NEAR = 2
NONZERO = 2
#: Labelled documents that training uses at most (the first by a hash of the id); their pooled vectors are collected.
TRAINING_ROWS = 20_000
HIDDEN = 32
#: Words remembered by a worker; it forgets all of them beyond that.
REMEMBERED = 500_000
_UPPER = bytes(range(65, 91))


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the index vectors' non-zero entries, (WORDS, NONZERO) each."""
    rng = np.random.default_rng(20)
    return rng.integers(0, DIM, (WORDS, NONZERO)), rng.choice((-1.0, 1.0), (WORDS, NONZERO))


class Buckets(dict):
    """Hash bucket of a word.

    Words whose shape is telling share buckets by shape (capitals throughout,
    trailing symbols, no letters), so that rare ones are known too.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        letters = word.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if not letters:
            kind = b"\1" + word[:1]
        elif len(word) - len(letters) >= 2:
            kind = b"\2" + word[-2:]
        elif len(letters) > 1 and len(letters.translate(None, _UPPER)) == 0:
            kind = b"\3"
        else:
            kind = letters.lower()
        self[word] = found = zlib.crc32(kind) % (WORDS - 1) + 1
        return found


_buckets = Buckets()


def remember_words() -> None:
    """For the beginning of a task: the worker's memory is for words only (a task's own function would bring a copy of ``_buckets``)."""
    remember_only(_buckets)


def word_buckets(text: bytes) -> np.ndarray:
    """Buckets of a text's words; 0 for a word that equals the one before."""
    words = text.split()
    found = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    if len(words) > 1:
        same = found[1:] == found[:-1]
        found[1:][same] = 0
    return found


def context_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """The word table, (WORDS, DIM): context vectors over all documents, each of unit length.

    Every task sums over its own documents and hands on one row per bucket
    that it saw; the buckets are summed by Spark.  The driver gets the table,
    of fixed size.
    """
    place, sign = _index_vectors()

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(WORDS * DIM)
        seen = np.zeros(WORDS, bool)
        remember_words()
        for batch in batches:
            for text in batch["text"]:
                b = word_buckets(text)
                seen[b] = True
                for off in range(1, NEAR + 1):
                    for center, near in ((b[off:], b[:-off]), (b[:-off], b[off:])):
                        for k in range(NONZERO):
                            np.add.at(table, center * DIM + place[near, k], sign[near, k])
        at = np.flatnonzero(seen)
        rows = table.reshape(WORDS, DIM)[at]
        for k in range(0, len(at), 1024):
            yield pd.DataFrame({"bucket": at[k : k + 1024], "v": list(rows[k : k + 1024].astype(np.float32))})

    partial = docs.select(as_bytes(F.col(text_col)).alias("text")).mapInPandas(count, "bucket int, v array<float>")
    total = partial.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[k].cast("double")) for k in range(DIM)]).alias("v"))
    # Arrow keeps the table as numbers on its way: a row per bucket at most.
    found = total.toArrow()
    table = np.zeros((WORDS, DIM))
    table[found["bucket"].to_numpy()] = found["v"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(text: bytes, table: np.ndarray) -> np.ndarray:
    """A document's vector: mean and spread of its words' vectors, share of repeated words, log of the length."""
    b = word_buckets(text)
    if not len(b):
        return np.zeros(2 * DIM + 3, np.float32)
    counts = np.bincount(b, minlength=WORDS) if len(b) > 4 * WORDS else None
    if counts is None:
        kinds, n = np.unique(b, return_counts=True)
    else:
        kinds = np.flatnonzero(counts)
        n = counts[kinds]
    share = (n / len(b)).astype(np.float32)
    rows = table[kinds]
    mean = share @ rows
    spread = np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))
    repeated = share[0] if kinds[0] == 0 else 0.0
    return np.concatenate((mean, spread, [repeated, float((share * share).sum()) ** 0.5, np.log1p(len(b)) / 10])).astype(np.float32)


@dataclass
class Network:
    """Two layers, and the temperature that its logit is divided by."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logit(x) / self.temperature, -60, 60)
        return 1 / (1 + np.exp(-z))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.003, decay: float = 1e-4) -> Network:
    """Fit by Adam on four fifths of the rows; the temperature on the last fifth.

    Without rows of both classes, the network's scores are the (smoothed) share of label 1.
    """
    rng = np.random.default_rng(6)
    order = rng.permutation(len(x))
    shift, scale = x.mean(axis=0) if len(x) else np.zeros(2 * DIM + 3), x.std(axis=0) + 1e-3 if len(x) else np.ones(2 * DIM + 3)
    net = Network(shift, scale, rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), 0.0)
    if len(set(y.tolist())) < 2:
        net.w2[:] = 0
        net.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    held = order[: max(1, len(x) // 5)] if len(x) >= 50 else order
    fit = order[len(held) :] if len(x) >= 50 else order
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - shift) / scale
    for _ in range(min(200, max(epochs, 50_000 // max(1, len(fit))))):  # more rounds over few rows
        rng.shuffle(fit)
        for k in range(0, len(fit), batch):
            rows = fit[k : k + batch]
            a = z[rows] @ params[0] + params[1]
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            g = (p - y[rows]) / len(rows)
            gh = np.outer(g, params[2]) * (a > 0)
            grads = [z[rows].T @ gh + decay * params[0], gh.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            t += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logit(x[held])
    loss = lambda s: np.mean(np.logaddexp(0, logits / s) - y[held] * logits / s)
    net.temperature = float(min(np.geomspace(0.1, 20, 120), key=loss))
    return net


def score(docs: DataFrame, labels: DataFrame, training: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1, the higher the likelier label 1; every whole text gets one.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; others and null are
    left out), ``training`` is an SQL condition on ``doc_id`` that says which
    of them may be learned from; TRAINING_ROWS of these at most are.  Null and
    empty texts score as a document without words.  Labels of a document that
    agree count once, contrary ones not at all; of rows that repeat a labelled
    id, the least text is learned from.  A column called ``score`` is replaced.
    The model sees texts only.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(context_vectors(docs, text_col))
    known = labels.filter(F.col("quality").isin(0, 1)).filter(training).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other"))
    chosen = known.filter("quality = other and doc_id is not null").select("doc_id", "quality", F.xxhash64("doc_id").alias("o")).orderBy("o", "doc_id").limit(TRAINING_ROWS)
    texts = docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))

    @F.pandas_udf("binary")
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remember_words()
        for batch in batches:
            yield pd.Series([pooled(t, table.value).tobytes() for t in batch], dtype=object)

    # One text for each label, so no more rows than labels come to the driver.
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "o").agg(F.min("text").alias("text"))
    rows = once.select(pool("text").alias("x"), "quality", "o", "doc_id").toPandas().sort_values(["o", "doc_id"], kind="stable")
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, 2 * DIM + 3)
    net = spark.sparkContext.broadcast(train(x.astype(float), rows["quality"].to_numpy(float)))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remember_words()
        for batch in batches:
            yield pd.Series(net.value.score(np.stack([pooled(t, table.value) for t in batch]).astype(float)) if len(batch) else np.empty(0))

    return docs.withColumn("score", judge(as_bytes(F.col(text_col))))
