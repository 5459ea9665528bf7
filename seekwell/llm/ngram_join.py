"""N-gram Jaccard join with Bayesian pruning of candidates.

A text is its set of word five-grams (lower-cased, divided by white space; a shorter text is one gram of all its words).
Equal sets are one node with a multiplicity.  (1) MinHash values in ``BANDS`` bands: sets that agree in a band are tied to
the smallest of them, and connected components of these ties are candidate groups; a pair with Jaccard 0.8 shares no band with
probability 5e-7, one with 0.3 shares any with 0.03, so texts that are loosely alike do not chain.  (2) A group is cut into blocks of ``BLOCK`` sets, and each pair of blocks is one cell.  In a cell, ``SIGNATURE`` MinHash
values are compared ``STEP`` at a time; a pair goes when the posterior probability (uniform prior) that its Jaccard
coefficient reaches the threshold falls below ``TOLERANCE``; the rest is compared exactly, common grams by a matrix
product and rare ones by their lists.  (3) A cell gives out a count of links for each set and a spanning forest of its links, never
pairs; classes are the components of the forests.

Defined cases: null and blank texts have no gram, link to nothing and are classes of their own (``class_id`` is their id); a
null id takes part, and a class of null ids only has a null ``class_id``; repeated rows count as copies; an empty table gives an
empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import LOWER, buffers, mix, pair, pieces, span_hashes, words
from .common import give_back, pack, read, stage, unpack
from .graph import components

N, THRESHOLD = 5, 0.8
BANDS, ROWS, SIGNATURE = 48, 6, 96
STEP, TOLERANCE = 16, 1e-6
BLOCK, PACK = 1024, 4096


def grams(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row, and where each row begins (rows + 1); not yet distinct."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    h = span_hashes(low, starts, ends - starts)
    count = np.diff(first)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    rows = np.cumsum(per) - per
    row = np.repeat(np.arange(len(per)), per)
    at = first[:-1][row] + np.arange(len(row)) - rows[row]
    width = np.minimum(count, n)[row]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        live = width > k
        out[live] = pair(out[live], h[at[live] + k])
    return out, np.append(rows, len(row))


@lru_cache(maxsize=4)
def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minhash(h: np.ndarray, cuts: np.ndarray, k: int = SIGNATURE) -> np.ndarray:
    """MinHash values (rows, k) of non-empty rows; equal grams do not matter."""
    x, (a, b) = (h >> np.uint64(32)).astype(np.uint32) ^ h.astype(np.uint32), _multipliers(k)
    out = np.empty((len(cuts), k), np.uint32)
    for i in range(k):
        y = x * a[i] + b[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(2654435769)
        out[:, i] = np.minimum.reduceat(y, cuts)
    return out


def _sets(column, size: int = 1 << 21):
    """For pieces of a text column: (from, to, grams, row starts, which rows have grams)."""
    data, offsets = buffers(column)
    for i, j in pieces(offsets, size):
        h, at = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, h, at, np.flatnonzero(np.diff(at) > 0)


def set_id(distinct: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(distinct.tobytes(), digest_size=8).digest(), "little", signed=True)


def _describe(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, h, at, full in _sets(batch.column("text")):
            sid = np.zeros(j - i, np.int64)
            bands = [None] * (j - i)
            if len(full):
                keys = minhash(h, at[:-1][full], BANDS * ROWS).reshape(len(full), BANDS, ROWS).astype(np.uint64)
                key = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    key = pair(key, keys[:, :, r])
                for k, row in enumerate(full):
                    sid[row] = set_id(np.unique(h[at[row] : at[row + 1]]))
                    bands[row] = key[k].view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([None if b is None else s for s, b in zip(sid, bands, strict=True)], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "sid", "bands"])
    give_back()


def _contents(batches):
    """Grams and MinHash values of texts that are asked for by their set."""
    for batch in batches:
        names = ["sid", "comp", "cells", "copies"]
        for i, j, h, at, full in _sets(batch.column("text"), 1 << 20):
            if not len(full):
                continue
            part, sig = batch.slice(i, j - i), minhash(h, at[:-1][full])
            wanted = part.column("sid").to_numpy()
            keep, own, sigs = [], [], []
            for k, row in enumerate(full):
                u = np.unique(h[at[row] : at[row + 1]])
                if set_id(u) == wanted[row]:
                    keep.append(row)
                    own.append(u.tobytes())
                    sigs.append(sig[k].tobytes())
            if keep:
                part = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(own, pa.binary()), pa.array(sigs, pa.binary())], [*names, "grams", "sig"])
    give_back()


@lru_cache(maxsize=8)
def least_matches(threshold: float, k: int = SIGNATURE, step: int = STEP, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(compared, fewest matches for which the posterior reaches the tolerance): P(s >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, k + 1, step):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survivors(sig_a: np.ndarray, sig_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs keep a chance of reaching the threshold at every look.  A pair that a look drops stays out, whatever else is compared.

    Looks go over the whole block while most pairs live, then over the list of those that do.
    """
    matches, live = np.zeros((len(sig_a), len(sig_b)), np.uint8), np.ones((len(sig_a), len(sig_b)), bool)
    looks, done = least_matches(threshold), 0
    for at, (n, least) in enumerate(looks):
        if live.sum() * 8 < live.size:
            i, j = np.nonzero(live)
            m = matches[i, j]
            for upto, fewest in looks[at:]:
                for k in range(done, upto):
                    m += sig_a[i, k] == sig_b[j, k]
                keep, done = m >= fewest, upto
                i, j, m = i[keep], j[keep], m[keep]
            live[:] = False
            live[i, j] = True
            return live
        for k in range(done, n):
            matches += sig_a[:, k, None] == sig_b[None, :, k]
        live &= matches >= least
        done = n
    return live


def links(a: list[np.ndarray], sig_a: np.ndarray, b: list[np.ndarray], sig_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of the two lists of sets reach the threshold (a matrix)."""
    alive = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), 256):
        alive[at : at + 256] = survivors(sig_a[at : at + 256], sig_b, threshold)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    alive &= np.minimum(na[:, None], nb) >= threshold * np.maximum(na[:, None], nb) - 1e-9
    i, j = np.nonzero(alive)
    if len(i) <= 64:
        for x, y in zip(i, j, strict=True):
            both = len(np.intersect1d(a[x], b[y], assume_unique=True))
            alive[x, y] = both >= threshold * (na[x] + nb[y] - both) - 1e-9
        return alive
    common = overlaps(a, b)
    return alive & (common >= threshold * (na[:, None] + nb - common) - 1e-9)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: grams of many sets by a matrix product, others by their lists."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    uniq, inv = np.unique(np.concatenate([flat_a, flat_b]), return_inverse=True)
    col_a, col_b = inv[: len(flat_a)], inv[len(flat_a) :]
    df_a, df_b = np.bincount(col_a, minlength=len(uniq)), np.bincount(col_b, minlength=len(uniq))
    cost = df_a * df_b
    out = np.zeros((len(a), len(b)), np.float32)
    heavy = np.flatnonzero(cost > max(64, len(a) * len(b) // 128))
    place = np.full(len(uniq), -1)
    for at in range(0, len(heavy), 1024):
        cols = heavy[at : at + 1024]
        place[:] = -1
        place[cols] = np.arange(len(cols))
        x, y = np.zeros((len(a), len(cols)), np.float32), np.zeros((len(b), len(cols)), np.float32)
        k = place[col_a]
        x[row_a[k >= 0], k[k >= 0]] = 1
        k = place[col_b]
        y[row_b[k >= 0], k[k >= 0]] = 1
        out += x @ y.T
    light = (cost > 0) & (cost <= max(64, len(a) * len(b) // 128))
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    start_a, start_b = np.cumsum(df_a) - df_a, np.cumsum(df_b) - df_b
    cols, flat = np.flatnonzero(light), out.ravel()
    at = 0
    while at < len(cols):  # about a million meetings at a time
        upto = at + max(1, int(np.searchsorted(np.cumsum(cost[cols[at : at + 200_000]]), 1 << 20, "right")))
        c = cols[at:upto]
        which = np.repeat(c, cost[c])
        k = np.arange(len(which)) - np.repeat(np.cumsum(cost[c]) - cost[c], cost[c])
        x, y = row_a[order_a[start_a[which] + k // df_b[which]]], row_b[order_b[start_b[which] + k % df_b[which]]]
        flat += np.bincount(x * len(b) + y, minlength=len(flat)).astype(np.float32) if len(x) * 4 > len(flat) else 0
        if len(x) * 4 <= len(flat):
            np.add.at(flat, x * len(b) + y, 1)
        at = upto
    return out


def _forest(link: np.ndarray) -> np.ndarray:
    """For each of n nodes of a symmetric matrix, the smallest node that it reaches."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cell(threshold: float):
    def run(key, group):
        out = []
        for _, own in group.groupby("comp", sort=False):
            own = own.drop_duplicates(["sid", "side"])
            parts = [own[own["side"] == s] for s in (0, 1)]
            left, right = parts
            one = not len(right) and key[1] == key[2]
            if not len(left) or (not one and not len(right)):
                continue
            right = left if one else right
            sets = [[np.frombuffer(x, np.uint64) for x in p["grams"]] for p in (left, right)]
            sigs = [np.stack([np.frombuffer(x, np.uint32) for x in p["sig"]]) for p in (left, right)]
            link = links(sets[0], sigs[0], sets[1], sigs[1], threshold)
            ids = [p["sid"].to_numpy() for p in (left, right)]
            copies = [p["copies"].to_numpy().astype(np.float64) for p in (left, right)]
            if one:
                np.fill_diagonal(link, False)
                label = _forest(link)
                out.append(pd.DataFrame({"sid": ids[0], "other": ids[0][label], "links": (link @ copies[0]).astype(np.int64)}))
            else:
                n = len(ids[0])
                names = np.concatenate(ids)
                # Within two blocks: chains through the links between them.
                label = np.arange(n + len(ids[1]))
                while True:
                    new = label.copy()
                    new[:n] = np.minimum(new[:n], np.where(link, label[None, n:], len(label)).min(1))
                    new[n:] = np.minimum(new[n:], np.where(link, new[:n, None], len(label)).min(0))
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                out.append(pd.DataFrame({"sid": names, "other": names[label], "links": np.concatenate([link @ copies[1], link.T @ copies[0]]).astype(np.int64)}))
        give_back()
        return pd.concat(out) if out else pd.DataFrame({"sid": [], "other": [], "links": []}).astype("int64")

    return run


FOUND = "sid bigint, other bigint, links bigint"


def _forests(full: DataFrame, n_packs: int, threshold: float) -> DataFrame:
    """Links that span every class, for groups of any size, without counting all links.

    (1) Each block alone, so a set travels once.  (2) The smallest set of each class that this leaves in a group of several blocks stands for it, and these
    meet in blocks of their own until that joins nothing more: blocks of near copies of one text become one class.  (3) In what is left, sets of a group's
    largest class (``main``) and of others (``rest``) must still meet, and rest with rest; main never meets itself.
    """
    run = lambda placed: stage(placed.groupBy("pack", "i", "j").applyInPandas(_cell(threshold), FOUND))
    columns = ["comp", "sid", "copies", "grams", "sig"]
    small = run(full.where("cells = 1").select(F.pmod(F.xxhash64("comp"), F.lit(n_packs)).alias("pack"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), *columns))
    large = full.where("cells > 1")
    if not large.limit(1).count():
        return small
    block = F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int")
    found = run(large.select(F.col("comp").alias("pack"), block.alias("i"), block.alias("j"), F.lit(0).alias("side"), *columns))

    def classes() -> DataFrame:
        own = components(found.where("sid <> other").select(F.col("sid").alias("a"), F.col("other").alias("b")))
        return stage(large.select("comp", "sid").join(own.withColumnRenamed("id", "sid").withColumnRenamed("comp", "cls"), "sid", "left").select("comp", "sid", F.coalesce("cls", "sid").alias("cls")))

    now, before = classes(), None
    while True:
        heads = now.groupBy("comp", "cls").agg(F.min("sid").alias("sid"))
        sizes = heads.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1")
        left = sizes.agg(F.sum("n")).first()[0] or 0
        if not left or left == before:
            break
        before = left
        # Heads are dealt anew each time, so those that stay apart meet others.
        met = large.join(heads.join(sizes, "comp").select("sid", "n"), "sid").withColumn("i", F.pmod(F.xxhash64("sid", F.lit(left)), F.ceil(F.col("n") / BLOCK)).cast("int"))
        found = stage(found.unionByName(run(met.select(F.col("comp").alias("pack"), "i", F.col("i").alias("j"), F.lit(0).alias("side"), *columns))))
        now = classes()
    if not left:
        return small.unionByName(found)
    per_class = now.groupBy("comp", "cls").agg(F.count("*").alias("c"))
    per_group = per_class.groupBy("comp").agg(F.max(F.struct("c", "cls")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("n")).where("n > 1")
    per_group = per_group.select("comp", F.col("top.cls").alias("main"), F.ceil(F.col("top.c") / BLOCK).cast("int").alias("m"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("r"))
    rows = large.drop("cells").join(now.select("sid", "cls"), "sid").join(per_group, "comp").withColumn("is_main", F.col("cls") == F.col("main"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("sid"), F.when(F.col("is_main"), F.col("m")).otherwise(F.col("r"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    b, cell = F.col("b"), lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    rest = F.concat(F.transform(up_to(F.col("r")), lambda o: F.struct(F.least(b, o).alias("i"), F.greatest(b, o).alias("j"), F.when(b <= o, 0).otherwise(1).alias("side"))), F.transform(up_to(F.col("m")), lambda o: cell(b, -1 - o, 0)))
    places = F.when(F.col("is_main"), F.transform(up_to(F.col("r")), lambda o: cell(o, -1 - b, 1))).otherwise(rest)
    return small.unionByName(found).unionByName(run(rows.withColumn("p", F.explode(places)).select(F.col("comp").alias("pack"), "p.i", "p.j", "p.side", *columns)))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, counts: bool = True) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row of ``docs`` (``doc_id, text``), ``sid``, its set (null without grams), and ``first``:
    whether the row has the smallest (id, set) of its class, null ids last.  Without ``counts`` classes are the same, but ``n_links`` counts only links that were met."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = stage(rows.mapInArrow(_describe, "doc_id bigint, sid bigint, bands array<bigint>"))
    sets = stage(described.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    keys = sets.select("sid", F.posexplode("bands").alias("band", "h"))
    buckets = keys.groupBy("band", "h").agg(F.min("sid").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = keys.join(buckets, ["band", "h"]).where("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b"))
    comps = stage(components(ties))
    cells = comps.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cells"))
    wanted = sets.select("sid", "doc_id", "copies").join(comps.withColumnRenamed("id", "sid"), "sid").join(cells, "comp")
    asked = wanted.withColumnRenamed("doc_id", "_id")
    texts = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("_id"))).select("sid", "comp", "cells", "copies", "text")
    full = stage(texts.mapInArrow(_contents, "sid bigint, comp bigint, cells int, copies bigint, grams binary, sig binary"))
    block = F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int")
    n_packs = max(1, wanted.count() // PACK)
    if not counts:
        found = _forests(full, n_packs, threshold)
    else:  # groups of one block are packed together; of others, block i meets every block j >= i once
        spread = full.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        placed = spread.select(
            F.when(F.col("cells") == 1, F.pmod(F.xxhash64("comp"), F.lit(n_packs))).otherwise(F.col("comp")).alias("pack"),
            F.when(F.col("cells") == 1, -1).otherwise(F.least("b", "o")).alias("i"), F.when(F.col("cells") == 1, -1).otherwise(F.greatest("b", "o")).alias("j"),
            F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "comp", "sid", "copies", "grams", "sig")
        found = stage(placed.groupBy("pack", "i", "j").applyInPandas(_cell(threshold), FOUND))
    linked = found.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(found.where("sid <> other").select(F.col("sid").alias("a"), F.col("other").alias("b")))
    nodes = sets.select("sid", "doc_id", "copies").join(linked, "sid", "left").join(classes.select(F.col("id").alias("sid"), "comp"), "sid", "left")
    nodes = stage(nodes.select("sid", "doc_id", F.coalesce("comp", "sid").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = nodes.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sid")).alias("least"))
    by_set = nodes.join(named, "comp").select("sid", "class_id", "n_links", "least")
    first = (F.col("sid") == F.col("least.sid")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    return described.select("doc_id", "sid").join(by_set, "sid", "left").select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "sid",
        F.coalesce(first, F.lit(False)).alias("first"))


def _with_sid(batches):
    """Rows as they are, and their set."""
    for batch in batches:
        for i, j, h, at, full in _sets(batch.column("text")):
            sid = [None] * (j - i)
            for row in full:
                sid[row] = set_id(np.unique(h[at[row] : at[row + 1]]))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sid, pa.int64())], [*part.schema.names, "_sid"])


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class one row with the smallest id and set, null ids last; rows without words all stay."""
    groups = near_groups(docs, threshold, counts=False)
    names, docs = docs.columns, pack(docs, "doc_id", "text")
    stay = groups.where("first").select(F.col("doc_id").alias("_id"), F.col("sid").alias("_stay")).distinct()
    blank = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    known = docs.where(~blank).mapInArrow(_with_sid, T.StructType([*docs.schema.fields, T.StructField("_sid", T.LongType())]))
    kept = known.join(stay, (F.col("_sid") == F.col("_stay")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "_sid"])
    return unpack(kept.select(*docs.columns).unionByName(docs.where(blank)), names, "doc_id", "text")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and the number of documents that it is linked to."""
    return near_groups(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
