"""Exact nearest items over several vectors per item, and the embedding seam."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import put
from .lexical import top_k

SLICE_ROWS, QUERY_ROWS, PIVOTS = 20_000, 256, 256
SMALL_QUERIES, SMALL_VALUES = 1_000, 1_000_000


def check_vectors(rows: DataFrame) -> int:
    """Common width of all vectors; refuses tables of mixed widths (0 for an empty table)."""
    found = rows.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if found["a"] != found["b"]:
        raise ValueError(f"vectors of {found['a']} to {found['b']} dimensions in one table")
    return found["a"] or 0


def unit(vec: Column) -> Column:
    """The vector in doubles, of length one; a zero vector stays zero."""
    v = vec.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(length), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only; others take no part in a search."""
    return rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def check_widths(query_vectors: DataFrame, rows: DataFrame) -> tuple[int, int, int]:
    """(queries, rows, width); refuses query vectors of another width than the rows', and mixed widths on either side."""
    ask = lambda df: df.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    q, r = ask(query_vectors), ask(rows)
    for what, x in (("query vectors", q), ("rows", r)):
        if x["a"] != x["b"]:
            raise ValueError(f"{what} of {x['a']} to {x['b']} dimensions")
    if q["n"] and r["n"] and q["a"] != r["a"]:
        raise ValueError(f"query vectors of {q['a']} dimensions, rows of {r['a']}")
    return q["n"], r["n"], r["a"] or 0


def _slices(rows: DataFrame) -> int:
    """So many that each holds at most ``SLICE_ROWS`` rows, and one for each core at least."""
    return max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SLICE_ROWS))


def _stack(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()) if len(vecs) else np.empty((0, 0))


def _best(q: np.ndarray, v: np.ndarray, items: pd.Series, limit: int, digits: int) -> tuple[np.ndarray, pd.Series, np.ndarray]:
    """(row of ``q``, item, score) of the ``limit`` best items of each row, an item by its best row of ``v``; ties to the smaller item."""
    code, _ = pd.factorize(items, sort=True)  # null is -1, the first
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-2))
    v, least_at, out = v[order].T, max(0, len(first) - limit), []
    for at in range(0, len(q), QUERY_ROWS):
        best = np.round(np.maximum.reduceat(q[at : at + QUERY_ROWS] @ v, first, axis=1), digits) + 0.0
        r, c = np.nonzero(best >= np.partition(best, least_at, axis=1)[:, [least_at]])
        s = best[r, c]
        by = np.lexsort((c, -s, r))
        r, c, s = r[by], c[by], s[by]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < limit
        out.append((r[keep] + at, c[keep], s[keep]))
    rows, at, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    return rows, items.iloc[order[first[at]]], scores


def _found(names: pd.Series, q: np.ndarray, v: np.ndarray, items: pd.Series, limit: int, digits: int) -> pd.DataFrame:
    rows, best, scores = _best(q, v, items, limit, digits)
    return pd.DataFrame({"query_id": names.iloc[rows].to_numpy(), "item_id": best.to_numpy(), "score": scores})


def _merged(found: DataFrame, limit: int) -> DataFrame:
    """The best items of each query from the best of each part of the rows."""
    return top_k(found.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), limit)


def _kinds(query_vectors: DataFrame, rows: DataFrame) -> tuple[str, str]:
    return f"query_id {dict(query_vectors.dtypes)['query_id']}", f"item_id {dict(rows.dtypes)['item_id']}"


def knn_items(query_vectors: DataFrame, rows: DataFrame, limit: int, digits: int = 9) -> DataFrame:
    """``query_id, item_id, score, rank``: items by the best cosine of their rows to each query vector, exactly.

    A table of at most ``SMALL_QUERIES`` queries and ``SMALL_VALUES`` numbers is sent to the rows, and each task's best rows leave it; others go by cells of
    pivots (:func:`knn_cells`).
    """
    query_vectors, rows = usable(query_vectors), usable(rows)
    queries, _, width = check_widths(query_vectors, rows)
    if queries > SMALL_QUERIES or queries * width > SMALL_VALUES:
        return knn_cells(query_vectors, rows, limit, digits)[0]
    sent = query_vectors.select("query_id", unit(F.col("vec")).alias("q")).toPandas()  # of checked size
    names, q = sent["query_id"], _stack(sent["q"])

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part) and len(q):
                yield _found(names, q, _stack(part["v"]), part["item_id"], limit, digits)

    return _merged(rows.select("item_id", unit(F.col("vec")).alias("v")).mapInPandas(meet, ", ".join((*_kinds(query_vectors, rows), "score double"))), limit)


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))


def knn_cells(query_vectors: DataFrame, rows: DataFrame, limit: int, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """(nearest items as :func:`knn_items` gives them, the best items of each query in each slice of a cell), by triangle inequalities between angles.

    Rows are filed under the nearest of at most ``PIVOTS`` pivots (rows with the smallest hash), each cell with the least and the largest angle to its
    pivot.  A query scores its nearest cells first; its ``limit``-th item so far is an angle that the rest must come under, which
    excludes cells by their intervals and rows by their own angle.  Large cells are divided into slices, so a crowd of near copies is dealt over tasks; equal
    rows of an item are one, and queries meet a slice in parts of like size.  What a query meets in a slice is scored by matrix products, and
    only its best items leave the task.  The second table tells in ``pairs`` how many pairs a query's block had scored there, a query's share of them.
    """
    count, queries = rows.count(), query_vectors.count()
    chosen = rows.orderBy(F.xxhash64("item_id", "vec")).limit(max(1, min(PIVOTS, math.isqrt(count)))).select(unit(F.col("vec")).alias("v")).distinct().toPandas()  # of bounded size
    pivots = _stack(chosen["v"])
    query_kind, item_kind = _kinds(query_vectors, rows)

    def file(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                angles = _angles(_stack(part["v"]), pivots)
                yield part.assign(a=angles.min(axis=1), cell=angles.argmin(axis=1).astype("int32"))

    own = put(rows.select("item_id", unit(F.col("vec")).alias("v")).distinct().mapInPandas(file, f"{item_kind}, v array<double>, a double, cell int"), "filed")
    cells = put(own.groupBy("cell").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("n"), F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices")), "cells")
    told = cells.orderBy("cell").toPandas()  # a row a pivot
    cell, lo, hi, n = (told[x].to_numpy() for x in ("cell", "lo", "hi", "n"))

    def aim(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part) and len(cell):
                qa = _angles(_stack(part["q"]), pivots)[:, cell]
                bound = np.maximum(0.0, np.maximum(qa - hi, lo - qa))
                order = np.lexsort((np.broadcast_to(cell, qa.shape), qa, bound), axis=1)
                early = np.empty(qa.shape, dtype=bool)
                np.put_along_axis(early, order, np.cumsum(n[order], axis=1) - n[order] < 4 * limit, axis=1)
                yield part.assign(cell=[cell.astype("int32")] * len(part), qa=list(qa), bound=list(bound), early=list(early))

    asked = query_vectors.select("query_id", unit(F.col("vec")).alias("q")).mapInPandas(aim, f"{query_kind}, q array<double>, cell array<int>, qa array<double>, bound array<double>, early array<boolean>")
    asked = put(asked, "asked")
    few = -(-queries // SLICE_ROWS) or 1
    slices = F.broadcast(cells.select("cell", "slices"))
    filed = own.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("item_id", "v"), F.col("slices")).cast("int")).select("cell", "slice", F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("part"), "item_id", "v", "a")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": left["query_id"][:0], "item_id": right["item_id"][:0], "score": [], "pairs": []})]
        if len(left) and len(right):
            left = left.sort_values("qa")
            q, v, a = _stack(left["q"]), _stack(right["v"]), right["a"].to_numpy()
            for at in range(0, len(left), QUERY_ROWS):
                block = left.iloc[at : at + QUERY_ROWS]
                near = (a >= (block["qa"] - block["reach"]).min()) & (a <= (block["qa"] + block["reach"]).max())
                if near.any():
                    out.append(_found(block["query_id"], q[at : at + QUERY_ROWS], v[near], right["item_id"][near], limit, digits).assign(pairs=int(near.sum())))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]

    def meet(met: DataFrame) -> DataFrame:
        met = met.join(slices, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("query_id"), F.lit(few)).cast("int").alias("part"), "query_id", "q", "qa", "reach")
        keys = ["cell", "slice", "part"]
        return met.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInPandas(lambda x, y: score(x, y), f"{query_kind}, {item_kind}, score double, pairs bigint")

    def dealt(table: DataFrame) -> DataFrame:
        each = F.explode(F.arrays_zip("cell", "qa", "bound", "early")).alias("c")
        return table.select("query_id", "q", "reach", each).select("query_id", "q", "reach", "c.*")

    everywhere = F.lit(math.pi + 1)
    first = put(meet(dealt(asked.withColumn("reach", everywhere)).where("early")), "scored")
    least = _merged(first, limit).where(F.col("rank") == limit).select("query_id", (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("score") - 10.0**-digits))) + 1e-6).alias("reach"))
    later = dealt(asked.join(least, "query_id", "left").withColumn("reach", F.coalesce("reach", everywhere))).where("not early and bound <= reach")
    scored = put(first.unionByName(meet(later)), "scored")
    return _merged(scored, limit), scored


def knn_blocks(query_vectors: DataFrame, rows: DataFrame, limit: int, slices: int | None = None) -> DataFrame:
    """The same through matrix products: queries and rows meet in slices, each slice gives out its best items per query."""
    query_vectors, rows = usable(query_vectors), usable(rows)
    check_widths(query_vectors, rows)
    slices = slices or _slices(rows)
    q = query_vectors.select("query_id", unit(F.col("vec")).alias("q")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    r = rows.select("item_id", unit(F.col("vec")).alias("v")).withColumn("_s", F.pmod(F.xxhash64("item_id", "v"), F.lit(slices)).cast("int"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "item_id": right["item_id"][:0], "score": []})
        return _found(left["query_id"], _stack(left["q"]), _stack(right["v"]), right["item_id"], limit, 9)

    found = q.groupBy("_s").cogroup(r.groupBy("_s")).applyInPandas(lambda a, b: meet(a, b), ", ".join((*_kinds(query_vectors, rows), "score double")))
    return _merged(found, limit)


def hash_embedder(dims: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedding of words by hash, for tests and dry runs."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vec = [0.0] * dims
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                vec[int.from_bytes(h[:4], "little") % dims] += 1.0 if h[4] & 1 else -1.0
            out.append(vec)
        return out

    return embed


def embed(worklist: DataFrame, function: Callable[[list[str]], list[list[float]]], purpose: str = "document", prefixes: dict[str, str] | None = None, batch: int = 64) -> DataFrame:
    """Adds ``vec`` to rows with ``text``: a user's function over batches of texts, with the prefix of the purpose."""
    prefix = (prefixes or {}).get(purpose, "")

    def run(parts):
        for part in parts:
            texts = [prefix + t for t in part["text"]]
            vecs = [v for i in range(0, len(texts), batch) for v in function(texts[i : i + batch])]
            yield part.assign(vec=vecs)

    kinds = ", ".join(f"{n} {t}" for n, t in worklist.dtypes if n != "vec")
    return worklist.drop("vec").mapInPandas(run, f"{kinds}, vec array<float>")
