"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is its runs of letters and digits, lower-cased.  A word enters with two inputs: a hashed word vector, and the sum
of the hashed vectors of its byte n-grams (3 to 5) over the root of their number, so words never seen still have a shape.  Windows of ``WINDOW`` words,
``STRIDE`` (half a window) apart, cover the whole text, so any 13 words in a row lie in one of them; each runs through a GRU in both directions, attention pools the states, and
a logistic unit scores the window.  A document's score is that of its highest window, calibrated on training documents.

Training sees labelled rows only, at most ``FIT_ROWS`` of them and ``FIT_BYTES`` of whole texts (those with the smallest hash of their
id and text), in one task, so the driver holds the model alone.
Only documents carry labels, so a toxic document teaches through its most telling window: at first the one whose
words have the highest summed log-odds, later the one that the network itself scores highest.

Defined cases: null and empty texts have one window of padding and the score that follows from it; repeated rows each
score, and texts of one id all teach; labels that are null or without a document are left out; with no label of one kind all scores are the share of
toxic labels (0 without labels); an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import ALNUM, LOWER, buffers, pieces, span_hashes, words
from .common import crc_mod5, give_back, read

WINDOW, STRIDE = 24, 12
WORDS, GRAMS, DIM, HIDDEN = 8192, 16384, 8, 8
FIT_ROWS, FIT_BYTES = 3_200, 24 << 20
PIECE = 1 << 19


PART = 1 << 15


def _word_grams(low: np.ndarray, s: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of 3 to 5 bytes of each word between two marks, word by word, and how many each word has."""
    length = length + 2
    chars = np.full(int(length.sum()), 1, np.uint32)
    head = np.cumsum(length) - length
    own = np.repeat(np.arange(len(s)), length - 2)
    place = np.arange(len(own)) - np.repeat(np.cumsum(length - 2) - (length - 2), length - 2)
    chars[head[own] + 1 + place] = low[s[own] + place]
    whose = np.repeat(np.arange(len(s)), length)
    left = np.repeat(head + length, length) - np.arange(len(chars))  # bytes from here to the end of the word
    code, found = chars.copy(), []
    for n in range(2, 6):
        code = code * np.uint32(65599) + np.concatenate([chars[n - 1 :], np.zeros(n - 1, np.uint32)])
        if n > 2:
            at_n = np.flatnonzero(left >= n)
            found.append((whose[at_n], ((code[at_n] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32) % GRAMS))
    whose, grams = (np.concatenate(x) for x in zip(*found, strict=True))
    return grams[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(s))


class Texts:
    """Windows of some texts over their distinct words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        starts, ends, first = words(low, offsets, ALNUM)
        uniq, at, index = np.unique(span_hashes(low, starts, ends - starts), return_index=True, return_inverse=True)
        self.hashes, self.index, self.first = uniq, index.astype(np.int32), first
        self.word_ids = (uniq % np.uint64(WORDS)).astype(np.int32)
        s, length = starts[at], ends[at] - starts[at]
        parts = [_word_grams(low, s[i : i + PART], length[i : i + PART]) for i in range(0, len(uniq), PART)]
        self.grams = np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)])
        self.gram_n = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
        self.gram_at = np.cumsum(self.gram_n) - self.gram_n
        n = np.diff(first)
        self.per_doc = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
        self.doc_first = np.cumsum(self.per_doc) - self.per_doc
        doc = np.repeat(np.arange(len(n)), self.per_doc)
        k = np.arange(len(doc)) - self.doc_first[doc]
        self.start = first[:-1][doc] + k * STRIDE
        self.length = np.clip(first[1:][doc] - self.start, 0, WINDOW)

    def window(self, lo: int, hi: int) -> np.ndarray:
        """Numbers of the words in windows lo to hi; padding has the number after the last word."""
        return self.pick(np.arange(lo, hi))

    def pick(self, which: np.ndarray) -> np.ndarray:
        step = np.arange(WINDOW)
        at = self.start[which][:, None] + step
        inside = step < self.length[which][:, None]
        if not len(self.index):
            return np.zeros((len(which), WINDOW), np.int32)
        return np.where(inside, self.index[np.minimum(at, len(self.index) - 1)], len(self.hashes))


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"words": f(WORDS, DIM, scale=0.1), "grams": f(GRAMS, DIM, scale=0.1), "att": f(2 * HIDDEN, HIDDEN), "att_v": f(HIDDEN),
                  "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(2 * DIM, 3 * HIDDEN), f"h{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.a, self.b = 1.0, 0.0

    def inputs(self, texts: Texts) -> np.ndarray:
        """One vector for each distinct word: its own part, and that of its n-grams."""
        out = [np.zeros((0, 2 * DIM), np.float32)]
        for i in range(0, len(texts.word_ids), PART):
            own, n, at = texts.word_ids[i : i + PART], texts.gram_n[i : i + PART], texts.gram_at[i : i + PART]
            g = self.p["grams"][texts.grams[at[0] : at[-1] + n[-1]]]
            out.append(np.concatenate([self.p["words"][own], np.add.reduceat(g, at - at[0], axis=0) / np.sqrt(n)[:, None]], axis=1).astype(np.float32))
        return np.concatenate(out)

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (numbers of rows of ``x``; len(x) is padding)."""
        B, n = len(at), len(x)
        mask = (at < n).astype(np.float32)
        states, trace = np.empty((WINDOW, B, 2 * HIDDEN), np.float32), {"f": [], "b": []}
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            gates = np.concatenate([x @ self.p[f"x{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) + self.p[f"b{d}"]
            h, wh = np.zeros((B, HIDDEN), np.float32), self.p[f"h{d}"]
            for t in order:
                gx, m = gates[at[:, t]], mask[:, t, None]
                gh = h @ wh
                zr = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                new = h + m * z * (c - h)
                if keep:
                    trace[d].append((t, h, z, r, c, gh[:, 2 * HIDDEN :], m))
                h = new
                states[t, :, : HIDDEN] = h if d == "f" else states[t, :, :HIDDEN]
                if d == "b":
                    states[t, :, HIDDEN:] = h
        u = np.tanh(states @ self.p["att"])
        e = u @ self.p["att_v"] + (mask.T - 1) * 30
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, (states, u, w, pooled, trace)) if keep else logit

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray):
        logit, (states, u, w, pooled, trace) = self.forward(x, at, True)
        dl = ((sigmoid(logit) - y) * weight).astype(np.float32) / len(y)
        g = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
        dp = dl[:, None] * self.p["out"]
        dw = (states * dp).sum(2)
        de = w * (dw - (w * dw).sum(0))
        du = (de[:, :, None] * self.p["att_v"]) * (1 - u * u)
        g["att_v"] = np.einsum("tb,tbk->k", de, u)
        g["att"] = np.einsum("tbi,tbk->ik", states, du)
        ds = w[:, :, None] * dp + du @ self.p["att"].T
        dx = np.zeros((len(x) + 1, 2 * DIM), np.float32)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            wh, wx = self.p[f"h{d}"], self.p[f"x{d}"]
            dh, gh_, gx_, gb = np.zeros((len(at), HIDDEN), np.float32), np.zeros_like(wh), np.zeros((len(x) + 1, 3 * HIDDEN), np.float32), np.zeros(3 * HIDDEN, np.float32)
            for t, h, z, r, c, hc, m in reversed(trace[d]):
                dh = dh + ds[t, :, part]
                dz, dc = dh * m * (c - h) * z * (1 - z), dh * m * z * (1 - c * c)
                dr = dc * hc * r * (1 - r)
                pre = np.concatenate([dz, dr, dc], axis=1)
                rec = np.concatenate([dz, dr, dc * r], axis=1)
                gh_ += h.T @ rec
                gb += pre.sum(0)
                np.add.at(gx_, at[:, t], pre)
                dh = dh * (1 - m * z) + rec @ wh.T
            g[f"h{d}"], g[f"b{d}"], g[f"x{d}"] = gh_, gb, x.T @ gx_[:-1]
            dx += gx_ @ wx.T
        return g, dx[:-1]

    def window_logits(self, texts: Texts, block: int = 2048) -> np.ndarray:
        x = self.inputs(texts)
        return np.concatenate([self.forward(x, texts.window(i, min(i + block, len(texts.start)))) for i in range(0, len(texts.start), block)])

    def scores(self, texts: Texts) -> np.ndarray:
        return sigmoid(self.a * np.maximum.reduceat(self.window_logits(texts), texts.doc_first) + self.b)


def train(texts: Texts, y: np.ndarray, rounds: int = 7, batch: int = 128, rate: float = 0.01, drop: float = 0.15, seed: int = 5) -> Network:
    """Fits the network to document labels."""
    net, rng = Network(seed), np.random.default_rng(seed)
    docs = len(y)
    doc_of_word = np.repeat(np.arange(docs), np.diff(texts.first))
    seen = np.unique(doc_of_word.astype(np.int64) * (len(texts.hashes) + 1) + texts.index) if len(texts.index) else np.zeros(0, np.int64)
    w_of, d_of = seen % (len(texts.hashes) + 1), seen // (len(texts.hashes) + 1)
    pos = np.bincount(w_of, y[d_of], minlength=len(texts.hashes))
    neg = np.bincount(w_of, 1 - y[d_of], minlength=len(texts.hashes))
    odds = np.append(np.log((pos + 0.1) / (y.sum() + 0.2)) - np.log((neg + 0.1) / (docs - y.sum() + 0.2)), 0.0)
    odds[:-1][pos < 3] = np.minimum(odds[:-1][pos < 3], 0.0)
    telling = np.empty(len(texts.start))
    for i in range(0, len(telling), 8192):
        telling[i : i + 8192] = np.maximum(odds[texts.window(i, min(i + 8192, len(telling)))], 0).max(1)
    cuts = np.append(texts.doc_first, len(telling))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    steps = 0
    for r in range(rounds):
        if r >= 3:
            telling = net.window_logits(texts)
        which, target = [], []
        for d in range(docs):
            lo, hi = cuts[d], cuts[d + 1]
            best = lo + int(np.argmax(telling[lo:hi]))
            which.append(best)
            target.append(y[d])
            if not y[d]:
                which.append(int(rng.integers(lo, hi)))
                target.append(0.0)
        which, target = np.array(which), np.array(target, np.float32)
        weight = np.where(target > 0, min(8.0, (target == 0).sum() / max(1, target.sum())) * 0.5, 1.0).astype(np.float32)
        order = rng.permutation(len(which))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at = texts.pick(which[some])
            at[rng.random(at.shape) < drop] = len(texts.hashes)
            used, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            real = used[used < len(texts.hashes)]
            grams_n = texts.gram_n[real]
            gram_ids = texts.grams[np.repeat(texts.gram_at[real], grams_n) + np.arange(grams_n.sum()) - np.repeat(np.cumsum(grams_n) - grams_n, grams_n)]
            chars = np.add.reduceat(net.p["grams"][gram_ids], np.cumsum(grams_n) - grams_n, axis=0) / np.sqrt(grams_n)[:, None] if len(real) else np.zeros((0, DIM))
            x = np.concatenate([net.p["words"][texts.word_ids[real]], chars], axis=1).astype(np.float32)
            g, dx = net.gradients(x, local, target[some], weight[some])
            for name, ids, part in (("words", texts.word_ids[real], dx[:, :DIM]), ("grams", gram_ids, np.repeat(dx[:, DIM:] / np.sqrt(grams_n)[:, None], grams_n, axis=0))):
                g[name] = np.zeros_like(net.p[name])
                np.add.at(g[name], ids, part)
            steps += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-7)
    top = np.maximum.reduceat(net.window_logits(texts), texts.doc_first).astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic fit with a small ridge
        p = sigmoid(a * top + b)
        v = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * top).sum() + 0.01 * (a - 1), (p - y).sum()])
        hess = np.array([[(v * top * top).sum() + 0.01, (v * top).sum()], [(v * top).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    net.a, net.b = max(a, 1e-3), b
    return net


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Network | float:
    """A network from the labelled rows outside the held-out fifth, or the share of toxic labels if one kind is missing."""
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod5() != 0) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").withColumn("_sign", F.xxhash64("text"))  # bounded by fit_rows
    sizes = own.select("doc_id", "_sign", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id", "_sign").limit(fit_rows).collect()
    rows = max(1, int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), fit_bytes, "right")))
    keys = docs.sparkSession.createDataFrame([(r["doc_id"], r["_sign"]) for r in dict.fromkeys(sizes[:rows])], T.StructType([docs.schema["doc_id"], T.StructField("_sign", T.LongType())]))
    sample = own.join(F.broadcast(keys.distinct()), ["doc_id", "_sign"]).dropDuplicates(["doc_id", "_sign"]).select("text", "_toxic", "doc_id", "_sign")
    made = sample.repartition(1).mapInArrow(_fit, "model binary").collect()  # one task, of bounded rows and bytes
    return pickle.loads(made[0]["model"]) if made else 0.0


def _fit(batches):
    """The pickled model of a sample; nothing without rows."""
    table = pa.Table.from_batches(rows) if (rows := list(batches)) else None
    if table is not None and len(table):
        table = table.sort_by([("doc_id", "ascending"), ("_sign", "ascending")])
        y = table.column("_toxic").to_numpy()
        model = float(y.mean()) if y.min() == y.max() else train(Texts(*buffers(table.column("text"))), y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
    del table
    give_back()


def _score(batches, model):
    net = model.value
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        out = [np.zeros(0)]
        for i, j in pieces(offsets, PIECE):
            if isinstance(net, float):
                out.append(np.full(j - i, net))
            else:
                out.append(net.scores(Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])).astype(np.float64))
        cols = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(out), pa.float64())], [*(c for c in batch.schema.names if c != "text"), "score"])
    give_back()


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))  # of fixed size
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = rows.mapInArrow(partial(_score, model=model), "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not scored toxic, in their own columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    def run(batches):
        for batch in batches:
            got = next(_score([batch.select(["text"])], model)).column("score").to_numpy()
            yield batch.filter(pa.array(got < 0.5))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole document, scored."""
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
