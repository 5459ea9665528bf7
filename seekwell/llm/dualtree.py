"""Ranked lexical search by dual trees: hierarchies over items and documents, pruned exactly in pairs of nodes.

An item is a vector over terms, its number of a term times the term's weight; a document is a vector of saturated term frequencies.  The score is their
product, in integers.  A node of either hierarchy holds the largest value of each coordinate below it, so the product of two nodes
bounds every score between them; a pair whose bound lies below the weakest k-th score of the node's items goes with all below it.

Jobs.  (1) Tasks count the terms of whole documents, and the frequencies of those that the items of a block (``BLOCK_ITEMS`` items) ask for.  (2) Sums over
all documents give the weights.  (3) Documents are sorted by their heaviest asked terms, by ranges, so that neighbours are alike and
nodes are tight; the document's id ends the key, so copies are dealt over ranges.  (4) A first pass scores, of each tree of
``TREE`` neighbouring documents, the leaves with the highest bound for each item; the k-th best score over all tasks is a lower bound of the item's
last one.  (5) The search starts from these and tightens them in each task.  Tasks give out k documents an item at most.  What is broadcast is a
block of items, of bounded number; blocks follow each other, each against all documents.

Defined cases: null and empty texts have no term and are neither counted nor found; an item without terms that any document holds has no row;
repeated rows are documents of their own; equal scores go to the smaller id, null ids last (2^63 - 1 counts as null); rows of one item_id and
text are one item; empty tables give an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import ALNUM, LOWER, buffers, pieces, span_hashes, words
from .common import give_back, read, stage

K, BLOCK_ITEMS = 10, 1024
ITEM_LEAF, ITEM_FAN = 4, 4
TREE, LEAF, FAN = 4096, 4, 4
NO_ID = (1 << 63) - 1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each term (runs of letters, digits and non-ASCII bytes, A-Z lowered), and each text's first term (n + 1)."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets, ALNUM)
    return span_hashes(low, starts, ends - starts), span_hashes(low, starts, ends - starts, 1), first


class Vocabulary:
    """The distinct terms of some items, numbered, and the items' counts of them."""

    def __init__(self, texts: list[str | None]):
        h, check, first = terms(*buffers(pa.array(texts, pa.string())))
        self.hashes, at, index = np.unique(h, return_index=True, return_inverse=True)
        self.checks = check[at]
        self.items = [np.unique(index[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]

    def find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of terms, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where((self.hashes[at] == h) & (self.checks[at] == check), at, -1)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def _count(batches, vocabulary):
    """``doc_id, n, terms, tfs`` of each text."""
    known = vocabulary.value
    width = max(1, len(known.hashes))
    for batch in batches:
        (data, offsets), ids = buffers(batch.column("text")), batch.column("doc_id")
        for i, j in pieces(offsets, 1 << 20):
            h, check, first = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            found = known.find(h, check)
            asked = np.flatnonzero(found >= 0)
            doc = np.searchsorted(first, asked, "right") - 1
            pairs, tf = np.unique(doc * width + found[asked], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(j - i + 1) * width)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.diff(first), pa.int64()), _lists(pairs % width, cuts), _lists(tf, cuts)], ["doc_id", "n", "terms", "tfs"])
    give_back()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and cuts (n + 1, from 0) of a list column."""
    cuts = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0]


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _weigh(batches, weights, documents: int, length: int):
    """``doc, terms, values, k1, k2, k3``: saturated frequencies of the terms that have a weight, and the three that weigh most."""
    w = weights.value
    for batch in batches:
        n = batch.column("n").to_numpy()
        (term, cuts), (tf, _) = _flat(batch.column("terms")), _flat(batch.column("tfs"))
        row = np.repeat(np.arange(len(n)), np.diff(cuts))
        value = saturated(tf.astype(np.int64), (25 + (75 * n * documents) // max(1, length))[row])
        weight = value * w[term]
        order = np.lexsort((term, -weight, row))
        rank = np.arange(len(row)) - cuts[:-1][row]
        top = np.full((len(n), 3), -1, np.int32)
        at = np.flatnonzero(rank < 3)
        top[row[at], rank[at]] = term[order[at]]
        keep = weight > 0
        kept = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), _lists(term[keep], kept), _lists(value[keep], kept), *(pa.array(top[:, i]) for i in range(3))], ["doc", "terms", "values", "k1", "k2", "k3"])


class Items:
    """Items (term numbers, integer weights) in a hierarchy of coordinate maxima, leaves of items in the order of their heaviest terms."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], width: int):
        heavy = [tuple(-t[np.lexsort((t, -v))][:3]) if len(t) else () for t, v in items]
        order = sorted(range(len(items)), key=lambda i: heavy[i])
        self.items, self.width = items, width
        level = [(np.array(order[i : i + ITEM_LEAF]), *self._most([items[j] for j in order[i : i + ITEM_LEAF]])) for i in range(0, len(order), ITEM_LEAF)]
        nodes = [(*n, None) for n in level]  # (items below, terms, maxima, children)
        while len(nodes) > 1:
            nodes = [(np.concatenate([n[0] for n in g]), *self._most([(n[1], n[2]) for n in g]), g) for g in (nodes[i : i + ITEM_FAN] for i in range(0, len(nodes), ITEM_FAN))]
        self.root = nodes[0] if nodes else None

    @staticmethod
    def _most(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        t, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        uniq, inverse = np.unique(t, return_inverse=True)
        out = np.zeros(len(uniq), v.dtype)
        np.maximum.at(out, inverse, v)
        return uniq, out


class Documents:
    """A tree of neighbouring documents: ``levels[0]`` are the leaves' coordinate maxima, each level above the maxima of ``FAN`` nodes."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, value: np.ndarray, cuts: np.ndarray, width: int):
        self.ids, self.term, self.value, self.cuts = ids, term.astype(np.int64), value.astype(np.int64), cuts
        leaf = np.repeat(np.arange(len(ids)) // LEAF, np.diff(cuts))
        most = np.zeros((-(-len(ids) // LEAF), width), np.float32)  # values are integers up to 10^6
        np.maximum.at(most.reshape(-1), leaf * width + self.term, value.astype(np.float32))
        self.levels = [most]
        while len(most) > 1:
            most = np.maximum.reduceat(most, np.arange(0, len(most), FAN), axis=0)
            self.levels.append(most)

    def scores(self, leaves: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of the leaves' documents against an item that is laid out densely."""
        docs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(self.ids)]
        size = self.cuts[docs + 1] - self.cuts[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.cuts[docs] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        total = np.concatenate([[0], np.cumsum(dense[self.term[at]] * self.value[at])])
        return docs, total[ends] - total[ends - size]


class Best:
    """The k best documents of each item so far, and the score that another one must reach."""

    def __init__(self, items: int, least: np.ndarray | None, k: int = K):
        self.k, self.least = k, np.zeros(items, np.int64) if least is None else least.copy()
        self.docs, self.scores = [np.zeros(0, np.int64)] * items, [np.zeros(0, np.int64)] * items
        self.scored = 0

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        self.scored += len(docs)
        good = (scores > 0) & (scores >= self.least[item])
        if not good.any():
            return
        docs, scores = np.concatenate([self.docs[item], docs[good]]), np.concatenate([self.scores[item], scores[good]])
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs[item], self.scores[item] = docs[order], scores[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])


def search(items: Items, docs: Documents, best: Best, first_only: bool = False, step: int = 8) -> None:
    """Adds what a tree of documents has for each item; ``first_only``: only the leaves of the highest bound."""
    if items.root is None or not len(docs.ids):
        return
    dense = np.zeros(items.width, np.int64)
    top = len(docs.levels) - 1
    stack = [(items.root, top, np.arange(len(docs.levels[top])))]
    while stack:
        node, at, alive = stack.pop()
        below, term, most, children = node
        bound = docs.levels[at][alive[:, None], term].astype(np.float64) @ most.astype(np.float64) * (1 + 1e-9)
        alive = alive[(bound > 0) & (bound >= best.least[below].min())]
        if not len(alive):
            continue
        if at:
            alive = (alive[:, None] * FAN + np.arange(FAN)).ravel()
            alive = alive[alive < len(docs.levels[at - 1])]
        if children is not None:
            stack += [(c, max(0, at - 1), alive) for c in children]
        elif at:
            stack.append((node, at - 1, alive))
        else:
            for i in below:
                t, v = items.items[i]
                own = docs.levels[0][alive[:, None], t].astype(np.float64) @ v.astype(np.float64) * (1 + 1e-9)
                order = np.argsort(-own, kind="stable")
                dense[t] = v
                for j in range(0, 2 if first_only else len(order), 2 if first_only else step):
                    some = order[j : j + (2 if first_only else step)]
                    some = some[(own[some] > 0) & (own[some] >= best.least[i])]
                    if not len(some):
                        break
                    found, scores = docs.scores(alive[some], dense)
                    best.add(i, docs.ids[found], scores)
                dense[t] = 0


def _search(batches, items, least, first_only: bool, k: int):
    tree = items.value
    best = Best(len(tree.items), None if least is None else least.value, k)
    for batch in batches:
        for i in range(0, len(batch), TREE):
            part = batch.slice(i, TREE)
            (term, cuts), (value, _) = _flat(part.column("terms")), _flat(part.column("values"))
            search(tree, Documents(part.column("doc").to_numpy(), term, value, cuts, tree.width), best, first_only)
    n = np.array([len(x) for x in best.docs], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n), pa.int64()), pa.array(np.concatenate([*best.docs, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64())], ["item", "doc", "score"])
    give_back()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(items: list, item_kind: str, docs: DataFrame, k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of a bounded number of items."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    known = Vocabulary([r["text"] for r in items])
    kind = dict(docs.dtypes)["doc_id"]
    counted = stage(docs.select("doc_id", "text").mapInArrow(partial(_count, vocabulary=share(known)), f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>"))
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(known.hashes), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # terms of the block's items at most
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    held = counted.where(F.size("terms") > 0).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), "n", "terms", "tfs")
    keyed = held.mapInArrow(partial(_weigh, weights=share(weights), documents=whole["n"], length=whole["length"]), "doc bigint, terms array<int>, values array<int>, k1 int, k2 int, k3 int")
    keys = ["k1", "k2", "k3", "doc"]
    laid = stage(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc", "terms", "values"))
    own = [(t[weights[t] > 0], (q * weights[t])[weights[t] > 0]) for t, q in known.items]
    tree = share(Items(own, max(1, len(df))))
    out = "item bigint, doc bigint, score bigint"
    begun = laid.mapInArrow(partial(_search, items=tree, least=None, first_only=True, k=k), out)
    least = np.zeros(len(items), np.int64)
    for r in _ranked(begun, k).where(F.col("rank") == k).collect():  # a row an item
        least[r["item"]] = r["score"]
    found = laid.mapInArrow(partial(_search, items=tree, least=share(least), first_only=False, k=k), out)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"_i bigint, item_id {item_kind}")
    return _ranked(found, k).join(F.broadcast(names), F.col("item") == F.col("_i")).select("item_id", "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item (``item_id, text``), in blocks of about ``BLOCK_ITEMS`` items."""
    items = stage(items.select("item_id", "text").distinct())
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        own = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        found = _block(own, dict(items.dtypes)["item_id"], docs, k)
        out = found if out is None else out.unionByName(found)
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return rank_documents(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))
