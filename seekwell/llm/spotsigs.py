"""Document fingerprints by spot signatures (DataFrame functions only).

A text is its lower-cased runs of letters and digits.  Each run of common words (of English, German, French and Spanish) is an
anchor, and so is the start of the text; the chain of the ``CHAIN`` content words that follow an anchor is one signature.
A text's fingerprint is its set of signatures, as the first eight hex digits of their MD5 in ascending order.  Likeness is
the Jaccard coefficient of two sets.  :func:`spotsig_pairs` joins near copies: sets are partitioned by their length so
that a set only meets its own and the next partition, a common rare signature makes a candidate, lengths bound the
Jaccard coefficient, and the rest is compared exactly.

Defined cases: null text counts as empty; a text without words has the empty fingerprint; one of common words only has
one signature, made of all its words; two empty sets have likeness 1, an empty and another one 0; after the last document comes
the first, so a sole document is its own successor; null ids come first; repeated ids stand in the order of their
texts' hashes; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stage

CHAIN = 3
# Common words of four languages.
COMMON = (
    "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it its "
    "just like me more my no not now of on only or other our out over she so some such than that the their them then there these they this those to too up was we were what "
    "when where which who will with would you your "
    "aber als am auch auf aus bei bin bis da das dass dem den der des die doch du ein eine einem einen einer eines er es für hat ich ihr im ist ja kann man mit nach nicht noch nur "
    "oder sein sich sie sind so über um und von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais mes mon ne nos notre nous on ont ou où par pas pour qu que qui sa se ses son sont sur "
    "ta te tu un une vous "
    "al como con del el ella entre era es esta este ha hasta hay las lo los más me mi muy o para pero por porque qué ser sin sobre su sus también tan tiene todo un una uno y ya "
).split()
MARK = "\u0002"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, chain: int = CHAIN, common=tuple(sorted(set(COMMON)))) -> Column:
    """Sorted distinct signatures of a text, eight hex digits each."""
    sign = lambda x: F.substring(F.md5(x), 1, 8)
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.concat(F.lit("\u0001 "), F.array_join(F.transform(words, lambda w: F.when(w.isin(*common), F.lit("\u0001")).otherwise(w)), " "), F.lit(" "))
    content = F.split(F.trim(F.regexp_replace(F.regexp_replace(marked, "(?:\u0001 )+", MARK), f" {MARK}$|^{MARK}$", "")), " ")
    spots = _let(F.filter(content, lambda w: w != ""), lambda m: F.filter(
        F.transform(m, lambda w, i: F.when(w.startswith(MARK), sign(F.translate(F.array_join(F.slice(m, i + 1, chain), " "), MARK, "")))), lambda x: x.isNotNull()))
    plain = F.lower(F.coalesce(text, F.lit("")))
    whole = F.when(plain.rlike(r"[\p{L}\p{N}]"), F.array(sign(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")))).otherwise(F.array().cast("array<string>"))
    return _let(F.array_sort(F.array_distinct(spots)), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))


def packed(sigs: Column) -> Column:
    """The set in four bytes a signature."""
    return F.unhex(F.array_join(sigs, ""))


def fingerprint(pack: Column) -> Column:
    """A packed set as text."""
    return F.lower(F.hex(pack))


def unpacked(pack: Column) -> Column:
    """The signatures of a packed set."""
    return F.regexp_extract_all(fingerprint(pack), F.lit(".{8}"), F.lit(0))


def likeness(a: Column, b: Column, at_least: float | None = None) -> Column:
    """Jaccard coefficient; with ``at_least``, null where the two lengths alone exclude it."""
    n, m = F.size(a), F.size(b)
    exact = _let(F.size(F.array_intersect(a, b)).cast("double"), lambda i: i / (n + m - i))
    value = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(exact)
    return value if at_least is None else F.when(F.least(n, m) >= at_least * F.greatest(n, m), value)


def in_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2_000, coarse: int = 64) -> DataFrame:
    """Adds ``_bucket``, which grows with (id, hash of the text) and holds about ``rows_per_bucket`` rows: equal widths within quantiles of ids.

    An id that stands at several quantiles, and null if it is frequent, have a bucket of their own that is divided by the hash.
    """
    stats = docs.agg(F.count("*").alias("n"), F.count_if(F.col(id_col).isNull()).alias("none"),
                     F.expr(f"percentile_approx({id_col}, array({', '.join(str(i / coarse) for i in range(coarse + 1))}), 10000)").alias("q")).first()
    found = [int(e) for e in stats["q"] or [0]]
    hot = {e for e in found if found.count(e) > 1}
    edges = sorted({*found, *(e + 1 for e in hot)})
    per = max(rows_per_bucket, math.isqrt(stats["n"]))
    split = max(1, math.ceil(stats["n"] / max(1, len(set(found)) - 1) / per), math.ceil(stats["none"] / per), *(math.ceil(found.count(e) / coarse * stats["n"] / per) for e in hot))
    lows = F.array(*[F.lit(e).cast("long") for e in edges])
    widths = F.array(*[F.lit(max(1, math.ceil((b - a) / split))).cast("long") for a, b in zip(edges, edges[1:] + [edges[-1] + 1], strict=True)])
    alone = F.array(*[F.lit(e in hot) for e in edges])
    i = F.col(id_col).cast("long")
    at = F.greatest(F.size(F.filter(lows, lambda e: e <= i)), F.lit(1))
    by_hash = F.floor((F.shiftright(F.xxhash64(text_col), 32) + (1 << 31)) * split / (1 << 32))
    by_id = F.least(F.greatest(F.floor((i - F.element_at(lows, at)) / F.element_at(widths, at)), F.lit(0)), F.lit(split - 1))
    inner = F.when(F.element_at(alone, at), by_hash).otherwise(by_id)
    return docs.withColumn("_bucket", F.when(i.isNull(), by_hash - split).otherwise(at.cast("long") * split + inner.cast("long")))


def with_next(docs: DataFrame, derived: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``derived`` columns, and ``next_<name>`` of them and of the text for the row that follows in ascending order of ids.

    After the last row comes the first.  Rows are dealt by bucket once; what follows a bucket's last row is looked up.
    """
    values = [text_col, *derived]
    sign = F.xxhash64(text_col)
    order = [F.col(id_col).asc_nulls_first(), sign]
    packed = F.struct(*values)
    w = Window.partitionBy("_bucket").orderBy(*order)
    placed = in_buckets(docs, id_col, text_col)
    here = placed.withColumns(derived).withColumn("_next", F.lead(packed).over(w))
    key = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), sign.alias("sign"))
    heads = stage(placed.groupBy("_bucket").agg(F.min(key).alias("k")))
    whole = Window.orderBy("_bucket")  # one row a bucket
    follow = heads.select(F.lag("_bucket").over(whole).alias("_before"), F.col("k.id").alias("_id"), F.col("k.sign").alias("_sign"))
    last = heads.agg(F.max("_bucket")).first()[0]
    follow = follow.withColumn("_before", F.coalesce("_before", F.lit(last)))
    first = docs.join(follow, F.col(id_col).eqNullSafe(F.col("_id")) & (sign == F.col("_sign")))
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("_before").orderBy(*order))).where("_k = 1")
    first = first.withColumns(derived).select("_before", packed.alias("_first"))
    joined = here.join(first, F.col("_bucket") == F.col("_before"), "left").withColumn("_next", F.coalesce("_next", "_first"))
    return joined.select(*docs.columns, *derived, *[F.col(f"_next.{v}").alias(f"next_{v}") for v in values])


def spotsig_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, likeness`` of pairs of distinct fingerprints with at least ``threshold``; ``a`` and ``b`` are the smallest ids that have them.

    Copies share a fingerprint and are not expanded.
    """
    sets = docs.select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("sigs")).groupBy("sigs").agg(F.min("id").alias("id")).where(F.size("sigs") > 0)
    sets = stage(sets.withColumn("n", F.size("sigs")))
    df = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    by_df = sets.select("id", "n", F.explode("sigs").alias("sig")).join(df, "sig").groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("s"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1  # one of so many rarest signatures is shared by any partner
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")
    keys = by_df.select("id", "n", part.alias("part"), F.explode(F.transform(F.slice("s", F.lit(1), keep.cast("int")), lambda x: x["sig"])).alias("sig"))
    left = keys.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("p"), F.col("part").alias("pa"))
    right = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", F.col("part").alias("p"))
    longer = (F.col("pa") < F.col("p")) | (F.col("a") < F.col("b"))
    found = left.join(right, ["sig", "p"]).where((F.col("a") != F.col("b")) & longer & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = found.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)


def op2_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and that of its text with the last quarter taken from the next document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs, {"sigs": packed(signatures(F.col("text")))})
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q)))
    both = both.withColumns({"_own": unpacked(F.col("sigs")), "_next": unpacked(F.col("next_sigs")), "_es": signatures(F.col("_edited"))})
    return both.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
                       F.array_join("_es", "").alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_es")).alias("near_edited"),
                       likeness(F.col("_own"), F.col("_next")).alias("near_next"))
