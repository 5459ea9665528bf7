"""Quality scores by supervised subword embeddings, trained by stochastic gradient descent in numpy.

A text is its words (runs without white space, case kept).  Its features are hashed: each word, the byte n-grams (3 to 5) of each word between
two marks, and each pair of neighbouring words; a word that follows itself makes a pair of its own kind, whatever the word, so repetition is a feature
of unseen words too.  Every feature has a learned vector of ``DIM`` numbers; a document is the mean of its features' vectors, and a
softmax layer over the two labels scores it.  Training visits one document at a time with a rate that falls to zero, first through the mean
to the vectors of all its features, then the layer.

Scoring.  The layer is linear, so a trained model is three tables with one number a feature: half a megabyte for each, of fixed size
and broadcast.  A task hashes the distinct words of a few hundred kilobytes of text once, and sums their numbers per document.

Training sees labelled rows only, at most ``FIT_ROWS`` of them and ``FIT_BYTES`` of whole texts (those with the smallest hash of their id and
text), in one task; the driver holds the three tables alone.

Defined cases: null and empty texts have no feature and the score of the layer's bias; repeated rows each score, and texts of one id all
teach; labels that are null or without a document are left out; with one kind of label all scores are the share of label 1 (0 without labels); an
empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import buffers, byte_ngrams, mix, pair, pieces, span_hashes, words
from .common import crc_mod5, give_back, read

BUCKETS, DIM = 1 << 16, 10
GRAMS = (3, 5)
FIT_ROWS, FIT_BYTES = 3_200, 24 << 20
ROUNDS, STEPS, RATE, SPREAD = 4, 6_000, 4.0, 0.1
LEAST_SCORE = 0.3
PIECE = 1 << 19


class Features:
    """The features of some texts: words over a list of distinct ones, their n-grams, pairs of neighbours."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = words(data, offsets)
        hashes = span_hashes(data, starts, ends - starts)
        uniq, at, index = np.unique(hashes, return_index=True, return_inverse=True)
        self.first, self.index = first, index
        self.word = (uniq % np.uint64(BUCKETS)).astype(np.int32)
        grams, self.gram_n = byte_ngrams(data, starts[at], ends[at] - starts[at], *GRAMS)
        self.gram = (grams % np.uint32(BUCKETS)).astype(np.int32)
        self.gram_at = np.cumsum(self.gram_n) - self.gram_n
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        beside = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        again = hashes[beside] == hashes[beside - 1]
        both = np.where(again, mix(np.zeros(1, np.uint64)), pair(hashes[beside - 1], hashes[beside]))
        self.pair_doc, self.pair = self.doc[beside], (both % np.uint64(BUCKETS)).astype(np.int32)
        n = len(offsets) - 1
        self.size = np.bincount(self.doc, 1 + self.gram_n[index], n) + np.bincount(self.pair_doc, minlength=n)

    def sums(self, tables: np.ndarray) -> np.ndarray:
        """Per document, the mean over its features of one number each (0 without any)."""
        own = tables[0][self.word].astype(np.float64)
        if len(self.gram):
            own += np.add.reduceat(tables[1][self.gram], self.gram_at) * (self.gram_n > 0)
        total = np.bincount(self.doc, own[self.index], len(self.size)) + np.bincount(self.pair_doc, tables[2][self.pair], len(self.size))
        return total / np.maximum(self.size, 1)

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Features of one document, numbered through the three tables, and their shares."""
        kinds, counts = np.unique(self.index[self.first[d] : self.first[d + 1]], return_counts=True)
        n = self.gram_n[kinds]
        at = np.repeat(self.gram_at[kinds] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        lo, hi = np.searchsorted(self.pair_doc, [d, d + 1])
        ids = np.concatenate([self.word[kinds], BUCKETS + self.gram[at], 2 * BUCKETS + self.pair[lo:hi]])
        weight = np.concatenate([counts, np.repeat(counts, n), np.ones(hi - lo)]) / max(1.0, self.size[d])
        uniq, where = np.unique(ids, return_inverse=True)
        return uniq, np.bincount(where, weight, len(uniq)).astype(np.float32)


class Model:
    """Vectors of all features and a softmax layer; ``tables`` and ``bias`` are what scoring needs."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.standard_normal((3 * BUCKETS, DIM)) * SPREAD).astype(np.float32)
        self.layer, self.offset = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)

    def step(self, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
        own = self.vectors[ids]
        hidden = share @ own
        logits = self.layer @ hidden + self.offset
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        back = p @ self.layer
        self.layer -= rate * p[:, None] * hidden
        self.offset -= 0.1 * rate * p
        self.vectors[ids] = own - rate * share[:, None] * back

    def scorer(self) -> tuple[np.ndarray, float]:
        tables = (self.vectors @ (self.layer[1] - self.layer[0])).reshape(3, BUCKETS)
        return tables.astype(np.float32), float(self.offset[1] - self.offset[0])


def train(features: Features, y: np.ndarray, rounds: int | None = None, rate: float = RATE, seed: int = 3) -> tuple[np.ndarray, float]:
    """(tables, bias) fitted to labels 0 and 1; ``ROUNDS`` rounds over the documents, more over few of them."""
    rounds = rounds or max(ROUNDS, -(-STEPS // len(y)))
    model, rng = Model(seed), np.random.default_rng(seed)
    done, steps = 0, rounds * len(y)
    for _ in range(rounds):
        for d in rng.permutation(len(y)):
            model.step(*features.of(d), int(y[d]), rate * (1 - done / steps))
            done += 1
    return model.scorer()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[np.ndarray, float] | float:
    """A scorer from the labelled rows outside the held-out fifth, or the share of label 1 if one kind is missing."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_mod5() != 0) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").withColumn("_sign", F.xxhash64("text"))  # bounded by fit_rows
    sizes = own.select("doc_id", "_sign", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id", "_sign").limit(fit_rows).collect()
    rows = max(1, int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), fit_bytes, "right")))
    keys = docs.sparkSession.createDataFrame([(r["doc_id"], r["_sign"]) for r in dict.fromkeys(sizes[:rows])], T.StructType([docs.schema["doc_id"], T.StructField("_sign", T.LongType())]))
    sample = own.join(F.broadcast(keys.distinct()), ["doc_id", "_sign"]).dropDuplicates(["doc_id", "_sign"]).select("text", "_y", "doc_id", "_sign")
    made = sample.repartition(1).mapInArrow(_fit, "model binary").collect()  # one task, of bounded rows and bytes
    return pickle.loads(made[0]["model"]) if made else 0.0


def _fit(batches):
    """The pickled scorer of a sample; nothing without rows."""
    table = pa.Table.from_batches(rows) if (rows := list(batches)) else None
    if table is not None and len(table):
        table = table.sort_by([("doc_id", "ascending"), ("_sign", "ascending")])
        y = table.column("_y").to_numpy()
        model = float(y.mean()) if y.min() == y.max() else train(Features(*buffers(table.column("text"))), y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
    del table
    give_back()


def score_texts(column: pa.Array, model) -> np.ndarray:
    """Score of each text of an Arrow column."""
    if isinstance(model, float):
        return np.full(len(column), model)
    (data, offsets), (tables, bias), out = buffers(column), model, [np.zeros(0)]
    for i, j in pieces(offsets, PIECE):
        found = Features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.append(1 / (1 + np.exp(-(found.sums(tables) + bias))))
    return np.concatenate(out)


def _score(batches, model):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(batch.column("text"), model.value), pa.float64())], ["doc_id", "score"])
    give_back()


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))  # of fixed size
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = rows.mapInArrow(partial(_score, model=model), "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op12_quality(spark, sf_dir: str) -> DataFrame:
    """Every whole document, scored."""
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
