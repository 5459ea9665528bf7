"""Field-weighted BM25 over tables, and the dictionary of known names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem, terms, tokenize
from ..sources.shared import put

BLOCK_ITEMS, SEED_ITEMS = 128, 8
SMALL_QUERIES, SMALL_PAIRS, CELLS = 1_000, 200_000, 1_000_000
NAME_FIELDS = ("Title", "OriginalTitle", "People")


@dataclass
class Bm25Tables:
    """``postings(term, item_id, tf, block, part)``, ``blocks(term, block, top)``, ``lengths(item_id, len)``, ``frequencies(term, df, top)`` and ``corpus(n, avg_len)`` of one row.

    A part is what a posting adds to a score but for the term's weight.  A block is a set of items of like length; ``top`` is the highest part of a
    term in a block, or in all.
    """

    postings: DataFrame
    blocks: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    corpus: DataFrame


TABLES = ("postings", "blocks", "lengths", "frequencies", "corpus")


def lengths_of(sections: DataFrame) -> DataFrame:
    """``item_id, len``: weighted number of terms of every item, those without terms too."""
    return sections.groupBy("item_id").agg(F.sum(F.col("weight") * F.size(terms(F.col("text")))).cast("double").alias("len"))


def with_parts(postings: DataFrame, lengths: DataFrame, corpus: DataFrame, k1: float, b: float) -> DataFrame:
    """Adds ``block, part``.  Items whose lengths lie within an eighth of a doubling share a bin; a bin is dealt into blocks by the items' hash."""
    tf, scale = F.col("tf"), F.broadcast(corpus)
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    deal = F.ceil(F.col("n") / (32 * BLOCK_ITEMS)).cast("long")
    block = F.floor(8 * F.log2(F.col("len") + 1)) * (1 << 32) + F.pmod(F.xxhash64("item_id"), deal)
    return postings.join(lengths, "item_id").crossJoin(scale).select("term", "item_id", "tf", block.alias("block"), part.alias("part"))


def _tables(postings: DataFrame, lengths: DataFrame, corpus: DataFrame) -> Bm25Tables:
    blocks = postings.groupBy("term", "block").agg(F.max("part").alias("top"))
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("top"))
    return Bm25Tables(postings, blocks, lengths, frequencies, corpus)


def build_bm25(sections: DataFrame, k1: float = 1.2, b: float = 0.75) -> Bm25Tables:
    """Index of sections (``item_id, weight, text``): a term counts its field's weight each time it stands there."""
    each = sections.select("item_id", "weight", F.explode(terms(F.col("text"))).alias("term"))
    postings, lengths = each.groupBy("item_id", "term").agg(F.sum("weight").alias("tf")), lengths_of(sections)
    corpus = lengths.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("len")).alias("avg_len"))
    return _tables(with_parts(postings, lengths, corpus, k1, b), lengths, corpus)


def save_bm25(tables: Bm25Tables, path: str) -> None:
    """Writes the tables; postings and blocks are laid out by term, so that a search reads few row groups."""
    tables.postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    postings = tables.postings.sparkSession.read.parquet(f"{path}/postings")
    saved = _tables(postings, tables.lengths, tables.corpus)
    saved.blocks.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    for name in TABLES[2:]:
        getattr(saved, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_bm25(spark, path: str) -> Bm25Tables:
    return Bm25Tables(*(spark.read.parquet(f"{path}/{n}") for n in TABLES))


def top_k(df: DataFrame, k: int, score: str = "score", by: str = "query_id", id: str = "item_id", rank: str = "rank") -> DataFrame:
    """The k best of each query, ties to the smaller id, with their ``rank`` (planned as a group limit before the shuffle)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(id))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term``: each query's distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def weigh_terms(queries: DataFrame, index: Bm25Tables) -> DataFrame:
    """``query_id, term, df, idf, most``: each query's terms that occur, and the most that each can add to a score."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return query_terms(queries).join(index.frequencies, "term").crossJoin(F.broadcast(index.corpus)).select("query_id", "term", "df", idf.alias("idf"), (idf * F.col("top") * (1 + 1e-9)).alias("most"))


def least_scores(asked: DataFrame, index: Bm25Tables, limit: int, digits: int = 9) -> DataFrame:
    """``query_id, least``: a score that each of the query's ``limit`` best items reaches; no row where its rarest terms hold too few items.

    The items that score best by a query's rarest terms are scored in full, and the ``limit``-th of these is the least score.
    """
    before = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    dealt = asked.withColumn("rare", F.coalesce(F.sum("df").over(before), F.lit(0)) < SEED_ITEMS * limit)
    gain = F.sum(F.col("idf") * F.col("part"))
    partial = dealt.where("rare").join(index.postings, "term").groupBy("query_id", "item_id").agg(gain.alias("score"))
    seeds = put(top_k(partial, 4 * limit).select("query_id", "item_id", "score"), "seeds")
    more = seeds.select("query_id", "item_id").join(dealt.where("not rare"), "query_id").join(index.postings, ["term", "item_id"]).groupBy("query_id", "item_id").agg(gain.alias("score"))
    whole = seeds.unionByName(more).groupBy("query_id", "item_id").agg(F.sum("score").alias("score"))
    return top_k(whole, limit).where(F.col("rank") == limit).select("query_id", (F.col("score") * (1 - 1e-9) - 2 * 10.0**-digits).alias("least"))


def divide_terms(asked: DataFrame, least: DataFrame) -> DataFrame:
    """Adds ``least, essential, rest``: the weakest terms, which together cannot lift an item to ``least``, make no candidates; ``rest`` is the most they add."""
    running = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    each = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("essential", F.sum("most").over(running) >= F.col("least"))
    return each.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))).over(Window.partitionBy("query_id")), F.lit(0.0)))


def candidates(divided: DataFrame, index: Bm25Tables) -> DataFrame:
    """``query_id, item_id, got``: what the essential terms add to items that may still reach the query's least score.

    First by the most that the other terms add anywhere, then by the most that they add in the item's block.
    """
    gain = F.sum(F.col("idf") * F.col("part")).alias("got")
    met = divided.where("essential").join(index.postings, "term").groupBy("query_id", "item_id", "block").agg(gain, F.first("rest").alias("rest"), F.first("least").alias("least")).where("got + rest >= least")
    met = put(met.drop("rest"), "candidates")
    others = divided.where("not essential").select("query_id", "term", "idf")
    tops = met.select("query_id", "block").distinct().join(others, "query_id").join(index.blocks, ["term", "block"]).groupBy("query_id", "block").agg((F.sum(F.col("idf") * F.col("top")) * (1 + 1e-9)).alias("more"))
    return met.join(tops, ["query_id", "block"], "left").where("got + coalesce(more, 0.0) >= least").select("query_id", "item_id", "got")


def bm25_search(queries: DataFrame, index: Bm25Tables, limit: int, digits: int = 9) -> DataFrame:
    """``query_id, item_id, score, rank``: queries (``query_id, text``) against the index.

    A query's rarest terms give a least score; terms that cannot reach it together are only looked up for items that others have brought up
    (see :func:`candidates`).  The result is that of a search over all postings.  Scores are rounded to ``digits`` before ranking, so
    that the order of summation cannot turn ties.
    """
    asked = put(weigh_terms(queries, index), "asked")
    divided = put(divide_terms(asked, least_scores(asked, index, limit, digits)), "asked")
    found = put(candidates(divided, index), "candidates")
    looked = found.select("query_id", "item_id").join(divided.where("not essential").select("query_id", "term", "idf"), "query_id").join(index.postings, ["term", "item_id"])
    more = looked.select("query_id", "item_id", (F.col("idf") * F.col("part")).alias("got"))
    return top_k(found.unionByName(more).groupBy("query_id", "item_id").agg(F.round(F.sum("got"), digits).alias("score")), limit)


def build_for(queries: DataFrame, sections: DataFrame, k1: float = 1.2, b: float = 0.75) -> Bm25Tables:
    """Index of the terms that ``queries`` ask for, written to the shared folder: sections are tokenised once, and only asked terms are shuffled.

    The empty term stands for an item's length.
    """
    # Written first: its size is known then, so that tokens meet a small table where they stand and only asked ones are shuffled.
    asked = put(query_terms(queries).select("term").union(queries.sparkSession.createDataFrame([("",)], "term string")).distinct(), "asked")
    whole = sections.withColumn("t", terms(F.col("text"))).select("item_id", "weight", (F.col("weight") * F.size("t")).cast("double").alias("len"), F.explode(F.array_append("t", F.lit(""))).alias("term"))
    amount = F.when(F.col("term") == "", F.col("len")).otherwise(F.col("weight").cast("double"))
    all_of = put(whole.join(asked, "term", "left_semi").groupBy("item_id", "term").agg(F.sum(amount).alias("tf")), "postings")
    lengths = all_of.where("term = ''").select("item_id", F.col("tf").alias("len"))
    corpus = put(lengths.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("len")).alias("avg_len")), "corpus")
    return _tables(put(with_parts(all_of.where("term <> ''"), lengths, corpus, k1, b), "postings"), lengths, corpus)


def tally(pairs: pd.DataFrame, sections: DataFrame) -> tuple[DataFrame, list[str]]:
    """(``item_id, t, tf`` of the terms that ``pairs`` (``query_id, term``) ask for, those terms): ``t`` is a term's place in the list, 0 stands for an item's length."""
    names = ["", *pairs["term"].unique()]
    table = F.broadcast(sections.sparkSession.createDataFrame(list(enumerate(names)), "t int, term string"))  # of checked size
    whole = sections.withColumn("w", terms(F.col("text"))).select("item_id", "weight", (F.col("weight") * F.size("w")).cast("double").alias("len"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    amount = F.when(F.col("t") == 0, F.col("len")).otherwise(F.col("weight").cast("double"))
    return put(whole.join(table, "term").groupBy("item_id", "t").agg(F.sum(amount).alias("tf")), "tallies"), names


def _first_of_each(q: np.ndarray, at: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Places of each query's ``limit`` highest scores, ties to the smaller ``at``."""
    by = np.lexsort((at, -score, q))
    return by[np.arange(len(by)) - np.searchsorted(q[by], q[by]) < limit]


def bm25_once(queries: DataFrame, sections: DataFrame, limit: int, digits: int = 9, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The same for sections that are searched once.

    A table of queries of checked size is sent to the items: their tallies of asked terms are shuffled by item, and a task adds up the scores of its items, some
    at a time, and gives out each query's best.  More queries go through :func:`build_for`.
    """
    asked = put(query_terms(queries), "asked")
    size = asked.agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
    if size["pairs"] > SMALL_PAIRS or size["queries"] > SMALL_QUERIES:
        return bm25_search(queries, build_for(queries, sections, k1, b), limit, digits)
    pairs = asked.toPandas()
    tallies, names = tally(pairs, sections)
    corpus = tallies.where("t = 0").agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("tf")).alias("avg_len")).first()
    df = np.zeros(len(names))
    for r in tallies.where("t > 0").groupBy("t").count().collect():  # a row a term asked for
        df[r["t"]] = r["count"]
    idf, avg_len = np.log(1 + (corpus["n"] - df + 0.5) / (df + 0.5)), corpus["avg_len"]
    whose, who = pd.factorize(pairs["query_id"])
    term = pairs["term"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=int)
    whose = whose[np.argsort(term, kind="stable")]
    many = np.bincount(term, minlength=len(names))  # queries of a term, which lie beside each other in ``whose``
    start, wide = np.cumsum(many) - many, max(1, len(who))

    def added(code: np.ndarray, t: np.ndarray, tf: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of the best of some items."""
        length = np.zeros(items)
        length[code[t == 0]] = tf[t == 0]
        part = idf[t] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[code] / avg_len)))
        each = np.repeat(np.arange(len(t)), many[t])
        cell = code[each] * wide + whose[np.arange(len(each)) + np.repeat(start[t] - (np.cumsum(many[t]) - many[t]), many[t])]
        score = np.round(np.bincount(cell, part[each], items * wide), digits)
        score = np.where(np.bincount(cell, minlength=items * wide) > 0, score, -np.inf).reshape(items, wide).T
        least = max(0, items - limit)
        q, c = np.nonzero((score >= np.partition(score, least, axis=1)[:, [least]]) & (score > -np.inf))
        return q, c, score[q, c]

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, seen = [], 0, 0
        pool = [(np.empty(0, int), np.empty(0, int), np.empty(0), pd.Series([], dtype=object))]

        def settle(last: bool) -> None:
            nonlocal held, rows, seen
            table = pd.concat(held)
            code, _ = pd.factorize(table["item_id"], use_na_sentinel=False)  # in order, as the rows are
            whole = len(code) if last else int(np.searchsorted(code, code[-1]))  # the last item may go on
            held, rows = ([], 0) if last else ([table.iloc[whole:]], len(code) - whole)
            code, t, tf, ids = code[:whole], table["t"].to_numpy()[:whole], table["tf"].to_numpy()[:whole], table["item_id"].iloc[:whole]
            if not whole:
                return
            first = np.flatnonzero(np.diff(code, prepend=-1))
            load = np.cumsum(np.add.reduceat(many[t], first)) // CELLS + np.arange(len(first)) // max(1, CELLS // wide) * 2**32
            cuts = [*first[np.flatnonzero(np.diff(load, prepend=-1))], whole]
            for i, j in zip(cuts, cuts[1:], strict=False):
                low = code[i]
                q, c, s = added(code[i:j] - low, t[i:j], tf[i:j], code[j - 1] - low + 1)
                pool.append((q, c + low + seen, s, ids.iloc[first[c + low]]))
            seen += code[-1] + 1
            q, at, s = (np.concatenate([x[k] for x in pool]) for k in range(3))
            keep = _first_of_each(q, at, s, limit)
            pool[:] = [(q[keep], at[keep], s[keep], pd.concat([x[3] for x in pool if len(x[3])] or [pool[0][3]]).iloc[keep])]

        for part in parts:
            if len(part):
                held.append(part)
                rows += len(part)
                if rows >= CELLS:
                    settle(False)
        if held:
            settle(True)
        q, _, s, ids = pool[0]
        if len(q):
            yield pd.DataFrame({"query_id": who.take(q), "item_id": ids.to_numpy(), "score": s})

    kinds = dict(queries.dtypes)["query_id"], dict(sections.dtypes)["item_id"]
    found = tallies.repartition("item_id").sortWithinPartitions("item_id").mapInPandas(search, f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
    return put(top_k(put(found, "found"), limit), "found")  # few rows, often used twice


def name_tokens(sections: DataFrame) -> DataFrame:
    """``token``: distinct terms of names (titles, original titles, people)."""
    return sections.where(F.col("field").isin(*NAME_FIELDS)).select(F.explode(terms(F.col("text"))).alias("token")).distinct()


def looks_like_known_name(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id, known``: whether every token of a query is a name token, stemmed or as it is, or begins one.

    Names are exploded to their prefixes, so the test for beginnings is an equality join.
    """
    prefixes = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substring("token", F.lit(1), n))).alias("key")).distinct()
    raw = queries.select("query_id", F.explode_outer(tokenize(F.col("text"))).alias("raw"))
    each = raw.withColumn("stem", stem(F.col("raw")))
    by_prefix = prefixes.withColumn("p", F.lit(True))
    by_stem = names.select(F.col("token").alias("stem")).distinct().withColumn("s", F.lit(True))
    found = each.join(by_prefix, each["raw"] == by_prefix["key"], "left").join(by_stem, "stem", "left")
    return found.groupBy("query_id").agg(F.bool_and(F.coalesce("p", F.lit(False)) | F.coalesce("s", F.lit(False))).alias("known"))
