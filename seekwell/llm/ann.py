"""Approximate nearest neighbours: inverted file, product-quantised residuals, asymmetric tables, exact reranking.

Index.  Coarse centroids and the codebooks of the residuals are fitted on a documented sample (``FIT_ROWS`` rows with
the smallest hash of their id; the only bound in the operator); every row is then encoded and filed under its nearest
centroid.  Search.  A query looks at its ``probes`` nearest lists.  In a cell it scores all codes by table look-ups
and reranks the best of them by exact cosine on the original vectors, in double precision, and after these every other row
that its code does not exclude (a row is no nearer than its code less its quantisation error), so a cell's answer is exact;
the best of all cells are merged per query.  A long list is dealt over several cells by a hash of the row's id, and its queries over several
blocks that each meet every cell, so that a list with a third of all rows and queries (copies of one vector, say) is no single task.  Within a cell, equal codes stand in the order of ids, so copies
of one vector yield their smallest ids.

Defined cases: rows with a null id, a null, empty or zero vector, or one with null or non-finite components, or of another
width than most, take no part; repeated rows are one row if id and vector are equal, and rows of one id with
different vectors are rows (and queries, each with its own ranks) of their own; an empty table gives an empty result;
extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stage

FIT_ROWS = 20_000
CELL_ROWS, BLOCK_QUERIES = 4_000, 1_000
SLACK = 1e-6  # above the rounding of distances


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin(distances(x, c), axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
        empty = np.flatnonzero(size == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances but for the part that depends on x alone."""
    return (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


class Index:
    """Coarse centroids, and one codebook for each part of the residual."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int = 256):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.dims = unit.shape[1]
        self.parts = max(p for p in range(1, parts + 1) if self.dims % p == 0)
        self.coarse = kmeans(unit, lists)
        residual = unit - self.coarse[np.argmin(distances(unit, self.coarse), axis=1)]
        w = self.dims // self.parts
        self.books = [kmeans(residual[:, p * w : (p + 1) * w], codes, 8, p) for p in range(self.parts)]

    def probes_for(self, sample: np.ndarray, k: int, aim: float = 0.985, most: int = 500) -> int:
        """Lists to look at so that ``aim`` of the sample's own neighbours are in them.

        Neighbours within a sample are farther away than those among all rows, so this errs on the safe side.
        """
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        home, some = np.argmin(distances(unit, self.coarse), axis=1), unit[:most]
        near = some @ unit.T
        near[np.arange(len(some)), np.arange(len(some))] = -np.inf
        k = min(k, len(unit) - 1)
        if k < 1:
            return 1
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(distances(some, self.coarse), axis=1), axis=1)
        return int(np.quantile(np.take_along_axis(place, home[best], axis=1), aim, method="higher")) + 1

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.argmin(distances(unit, self.coarse), axis=1)
        residual, w = unit - self.coarse[near], self.dims // self.parts
        codes = [np.argmin(distances(residual[:, p * w : (p + 1) * w], b), axis=1) for p, b in enumerate(self.books)]
        return near, np.stack(codes, axis=1).astype(np.uint8)

    def errors(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of rows of one list from what their codes say."""
        left, w = unit - self.coarse[cell], self.dims // self.parts
        for p, b in enumerate(self.books):
            left[:, p * w : (p + 1) * w] -= b[codes[:, p]]
        return np.sqrt((left * left).sum(1))

    def tables(self, unit: np.ndarray, cell: int) -> np.ndarray:
        """Asymmetric distances of queries to each code of each part, within one list."""
        residual, w = unit - self.coarse[cell], self.dims // self.parts
        width = max(len(b) for b in self.books)
        out = np.full((len(unit), self.parts, width), np.inf)
        for p, b in enumerate(self.books):
            out[:, p, : len(b)] = distances(residual[:, p * w : (p + 1) * w], b)
        return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` (doubles) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & good)
    return v


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           lists: int | None = None, probes: int | None = None, parts: int = 16, rerank: int = 400) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows for which ``is_query(id)`` holds, their k nearest other rows by cosine."""
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors, id_col, vec_col)
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("vec") == width["w"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").toPandas()
    n = width["count"]
    lists = lists or int(np.clip(np.sqrt(n) / 2, 1, 1024))
    drawn = np.stack(sample["vec"].to_numpy())
    fitted = Index(drawn, lists, parts)
    probes = probes or fitted.probes_for(drawn, k)
    index = spark.sparkContext.broadcast(fitted)  # bounded: centroids and codebooks

    def file(batches):
        ix = index.value
        for b in batches:
            if not len(b):
                continue
            vec = np.stack(b["vec"].to_numpy())
            unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
            near, codes = ix.encode(unit)
            yield pd.DataFrame({"list": near, "id": b["id"], "codes": [c.tobytes() for c in codes], "vec": [v.tobytes() for v in vec]})

    filed = stage(rows.mapInPandas(file, "list int, id bigint, codes binary, vec binary").dropDuplicates(["list", "id", "vec"]))
    sizes = filed.groupBy("list").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cells"))  # as many rows as lists

    def aim(batches):
        ix = index.value
        for b in batches:
            if not len(b):
                continue
            vec = np.stack([np.frombuffer(v) for v in b["vec"]])
            unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
            m = min(probes, len(ix.coarse))
            near = np.argsort(distances(unit, ix.coarse), axis=1, kind="stable")[:, :m]
            yield pd.DataFrame({"list": near.ravel(), "query_id": np.repeat(b["id"].to_numpy(), m), "query_row": np.repeat(b["row"].to_numpy(), m), "qvec": np.repeat(b["vec"].to_numpy(), m)})

    row = F.xxhash64("id", "vec")
    asked = stage(filed.where(is_query(F.col("id"))).select("id", row.alias("row"), "vec").mapInPandas(aim, "list int, query_id bigint, query_row bigint, qvec binary"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    sizes = stage(sizes.join(F.broadcast(blocks), "list"))  # lists that nothing asks for go
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = filed.join(F.broadcast(sizes), "list").withColumn("block", upto("blocks")).select(
        "list", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell"), "block", "id", row.alias("row"), "codes", "vec")
    asked = asked.join(F.broadcast(sizes), "list").withColumn("block", F.pmod("query_row", F.col("blocks")).cast("int")).withColumn("cell", upto("cells")).drop("cells", "blocks")

    def look(key, own, queries):
        if not len(own) or not len(queries):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []})
        ix, own = index.value, own.sort_values("id", kind="stable")
        ids, rows_ = own["id"].to_numpy(), own["row"].to_numpy()
        codes = np.stack([np.frombuffer(c, np.uint8) for c in own["codes"]])
        vec = np.stack([np.frombuffer(v) for v in own["vec"]])
        norm = np.sqrt((vec * vec).sum(1))
        error = ix.errors(vec / norm[:, None], key[0], codes)
        found = []
        for at in range(0, len(queries), 256):
            q_ids, q_rows = (queries[c].to_numpy()[at : at + 256] for c in ("query_id", "query_row"))
            q = np.stack([np.frombuffer(v) for v in queries["qvec"].iloc[at : at + 256]])
            q_norm = np.sqrt((q * q).sum(1))
            unit = q / q_norm[:, None]
            tables, base = ix.tables(unit, key[0]), ((unit - ix.coarse[key[0]]) ** 2).sum(1)
            for i in range(len(q)):
                near = tables[i][np.arange(ix.parts)[None, :], codes].sum(1)
                near[(ids == q_ids[i]) & (rows_ == q_rows[i])] = np.inf
                order = np.argsort(near, kind="stable")  # ties in the order of ids
                order = order[np.isfinite(near[order])]
                best, rest = order[: max(rerank, k)], order[max(rerank, k) :]
                score = (vec[best] * q[i]).sum(1) / (norm[best] * q_norm[i])
                if len(rest):
                    reach = np.sqrt(max(0.0, 2 - 2 * np.partition(score, len(score) - k)[len(score) - k]))  # distance of the k-th so far
                    rest = rest[np.sqrt(np.maximum(near[rest] + base[i], 0)) - error[rest] <= reach + SLACK]
                    score = np.append(score, (vec[rest] * q[i]).sum(1) / (norm[rest] * q_norm[i]))
                    best = np.append(best, rest)
                top = np.lexsort((ids[best], -score))[:k]
                found.append(pd.DataFrame({"query_id": q_ids[i], "query_row": q_rows[i], "vec_id": ids[best][top], "score": score[top]}))
        return pd.concat(found)

    by = ("list", "cell", "block")
    hits = cells.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(look, "query_id bigint, query_row bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th vector, among all."""
    return search(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
