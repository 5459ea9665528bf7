"""Rendering of catalog rows: sections, embedding text, hashes, vector rows, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from .text import blank, distinct_folded

# Weights of the fields, and words for decades.
WEIGHTS = {"Title": 4.0, "OriginalTitle": 3.0, "People": 2.0, "Categorical": 1.5, "Era": 1.5, "Overview": 1.0, "Enrichment": 1.0}
DECADES = {
    1920: "20s twenties",
    1930: "30s thirties",
    1940: "40s forties",
    1950: "50s fifties",
    1960: "60s sixties",
    1970: "70s seventies",
    1980: "80s eighties",
    1990: "90s nineties",
    2000: "00s noughties aughts",
    2010: "10s twenty tens",
    2020: "20s twenties",
}


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def project_people(people: Column, most: int = 12) -> Column:
    """The first names, each once."""
    return distinct_folded(people, most)


def runtime_minutes(ticks: Column) -> Column:
    """Ticks of 100 ns as whole minutes; none for no runtime."""
    return F.when(ticks > 0, F.floor(ticks / F.lit(600_000_000)).cast("int"))


def decade(year: Column) -> Column:
    """``1990s``; empty outside 1880 to 2200."""
    return F.when(year.between(1880, 2200), F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))).otherwise("")


def era_tokens(year: Column) -> Column:
    """The year and the ways in which people name its decade; empty outside 1880 to 2200."""
    names = F.create_map(*[F.lit(x) for pair in DECADES.items() for x in pair])
    own = names[(F.floor(year / 10) * 10).cast("int")]
    return F.when(year.between(1880, 2200), F.concat_ws(" ", year.cast("string"), decade(year), own)).otherwise("")


def full_title(series: Column, season: Column, episode: Column, title: Column) -> Column:
    """Title, or series, number (if known in full) and title."""
    number = F.when(season.isNotNull() & episode.isNotNull(), F.concat(F.lit(" S"), season.cast("string"), F.lit("E"), episode.cast("string"))).otherwise("")
    return F.when(blank(series), title).otherwise(F.concat(series, number, F.lit(" — "), title))


def enrichment_text(e: Column) -> Column:
    """What was generated about an item, for the index."""
    parts = F.concat(F.array(_text(e["premise"])), _list(e["themes"]), _list(e["moments"]), _list(e["asks"]))
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), ". ")


def render_sections(items: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``item_id, field, weight, text``: an item as weighted fields, blank ones left out."""
    w = {**WEIGHTS, **(weights or {})}
    c = F.col
    original = F.when(~blank(c("original_title")) & (F.lower(c("original_title")) != F.lower(_text(c("title")))), c("original_title"))
    kinds = F.concat(_list(c("genres")), _list(c("tags")), _list(c("studios")), F.array(_text(c("official_rating")), _text(c("kind"))))
    fields = [("Title", c("title")), ("Title", c("series_name")), ("OriginalTitle", original), ("People", F.array_join(_list(c("people")), " ")),
              ("Categorical", F.array_join(kinds, " ")), ("Era", era_tokens(c("year"))), ("Overview", c("overview")), ("Enrichment", enrichment_text(c("enrichment")))]
    rows = F.array(*[F.struct(F.lit(name).alias("field"), F.lit(w[name]).alias("weight"), F.trim(_text(value)).alias("text")) for name, value in fields])
    return items.select("item_id", F.explode(F.filter(rows, lambda s: s["text"] != "")).alias("s")).select("item_id", "s.*")


def _labelled(label: str, values: Column) -> Column:
    return F.when(F.size(_list(values)) > 0, F.concat(F.lit(f" {label}: "), F.array_join(values, ", "), F.lit("."))).otherwise("")


def embedding_text(c=F.col) -> Column:
    """An item as one text for the embedding model."""
    e = c("enrichment")
    return F.concat(
        _text(c("title")), F.coalesce(F.concat(F.lit(" ("), c("year").cast("string"), F.lit(")")), F.lit("")), F.lit(". "), _text(c("kind")), F.lit("."),
        _labelled("Genres", c("genres")), _labelled("Tags", c("tags")), _labelled("Themes", e["themes"]), _labelled("Featuring", F.slice(_list(c("people")), 1, 8)),
        F.when(~blank(c("overview")), F.concat(F.lit(" "), F.trim(c("overview")))).otherwise(""),
        F.when(~blank(e["premise"]), F.concat(F.lit(" "), F.trim(e["premise"]))).otherwise(""),
        F.when(F.size(_list(e["moments"])) > 0, F.concat(F.lit(" "), F.array_join(e["moments"], ". "))).otherwise(""))


def source_text(c=F.col) -> Column:
    """The eleven lines on which generated text depends; series fields are not among them."""
    lists = [F.array_join(_list(c(x)), ",") for x in ("genres", "tags", "studios", "people")]
    lines = [_text(c("kind")), _text(c("title")), _text(c("original_title")), _text(c("year").cast("string")), *lists,
             _text(c("official_rating")), _text(c("runtime_minutes").cast("string")), _text(c("overview"))]
    return F.concat_ws("\n", *lines)


def hash_of(text: Column) -> Column:
    """32 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def source_hash(c=F.col) -> Column:
    return hash_of(source_text(c))


def vibe_text(c=F.col) -> Column:
    """A short description of kind, genres, decade and themes that are not genres."""
    genres, themes = _list(c("genres")), _list(c("enrichment")["themes"])
    low = F.transform(genres, F.lower)
    new = distinct_folded(F.filter(themes, lambda t: ~F.array_contains(low, F.lower(t))))
    kind = F.when(F.lower(c("kind")).isin("series", "episode"), "television").otherwise("a film")
    return F.concat(
        kind, F.when(F.size(genres) > 0, F.concat(F.lit(" "), F.lower(F.array_join(genres, ", ")))).otherwise(""),
        F.when(decade(c("year")) != "", F.concat(F.lit(" from the "), decade(c("year")))).otherwise(""),
        F.when(F.size(new) > 0, F.concat(F.lit(". It is about "), F.array_join(new, ", "), F.lit("."))).otherwise(""))


def plan_vector_rows(items: DataFrame, max_asks: int) -> DataFrame:
    """``item_id, kind, ord, text``: what of an item is embedded: the item, its vibe if it has themes, its first asks."""
    e = F.col("enrichment")
    row = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    vibe = F.when(F.size(_list(e["themes"])) > 0, F.array(row("Vibe", vibe_text())))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    asks = F.transform(F.slice(_list(e["asks"]), 1, max(0, max_asks)), lambda a: row("Ask", a))
    rows = F.filter(F.concat(F.array(row("Document", embedding_text())), F.coalesce(vibe, none), asks), lambda r: ~blank(r["text"]))
    return items.select("item_id", F.posexplode(rows).alias("ord", "r")).select("item_id", "r.kind", "ord", "r.text")


def _collapse(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    return F.substring(flat, 1, most)


def render_enrichment_requests(batches: DataFrame) -> DataFrame:
    """``batch, request``: one text for each batch of items (``batch, pos`` and item columns), in order."""
    c = F.col
    title = F.concat(full_title(c("series_name"), c("season"), c("episode"), c("title")), F.coalesce(F.concat(F.lit(" ("), c("year").cast("string"), F.lit(")")), F.lit("")))
    genres = F.when(F.size(_list(c("genres"))) > 0, F.concat(F.lit(" — "), F.array_join(c("genres"), ", "))).otherwise("")
    about = F.when(~blank(c("overview")), F.concat(F.lit("\n   "), _collapse(c("overview"), 600))).otherwise("")
    line = F.concat(c("pos").cast("string"), F.lit(". "), title, F.lit(" ["), _text(c("kind")), F.lit("]"), genres, about)
    lines = batches.select("batch", "pos", line.alias("line"))
    return lines.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l")).select(
        "batch", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("request"))


def render_rerank_requests(shortlist: DataFrame, items: DataFrame) -> DataFrame:
    """``query_id, request``: the candidates of each query (``query_id, pos, item_id``) as a numbered list."""
    c = F.col
    e = c("enrichment")
    themes = F.slice(_list(e["themes"]), 1, 6)
    premise = F.concat(F.lit("\n   "), _collapse(e["premise"], 170), F.when(F.size(themes) > 0, F.concat(F.lit(" ["), F.array_join(themes, ", "), F.lit("]"))).otherwise(""))
    about = F.when(~blank(e["premise"]), premise).when(~blank(c("overview")), F.concat(F.lit("\n   "), _collapse(c("overview"), 220))).otherwise("")
    year = F.coalesce(F.concat(F.lit(" ("), c("year").cast("string"), F.lit(")")), F.lit(""))
    genres = F.when(F.size(_list(c("genres"))) > 0, F.concat(F.lit(" — "), F.array_join(c("genres"), ", "))).otherwise("")
    line = F.concat(c("pos").cast("string"), F.lit(". "), _text(c("title")), year, F.lit(" ["), _text(c("kind")), F.lit("]"), genres, about)
    lines = shortlist.join(items, "item_id").select("query_id", "pos", line.alias("line"))
    return lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l")).select(
        "query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("request"))


def plan_batches(df: DataFrame, size: int, group_col: str, order_col: str) -> DataFrame:
    """Adds ``batch, pos``: rows of a group in chunks of ``size``, in the order of ``order_col``; batches are numbered across groups.

    Rows are range-sorted and written once; a row's number is its place in its partition and what earlier partitions hold of its group, so
    a group with very many rows is dealt over tasks.
    """
    keys = [F.col(group_col).asc_nulls_first(), F.col(order_col).asc_nulls_first()]
    path = new_folder(df.sparkSession, "batches")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_p", F.shiftright("_n", 33))
    parts = rows.groupBy(F.col(group_col).alias("_g"), F.col("_p").alias("_q")).agg(F.min("_n").alias("_low"), F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = parts.groupBy("_g").agg(F.ceil(F.sum("_c") / size).alias("_b"))
    first = F.coalesce(F.sum("_b").over(Window.orderBy(F.col("_g").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a group
    groups = groups.select(F.col("_g").alias("_h"), first.alias("_first"))
    parts = parts.withColumn("_before", before).join(groups, F.col("_g").eqNullSafe(F.col("_h")))
    at = (F.col("_n") - F.col("_low") + F.col("_before")).alias("_at")
    own = rows.join(parts, F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))).select(*df.columns, "_first", at)
    return own.select(*df.columns, (F.col("_first") + F.floor(F.col("_at") / size)).cast("long").alias("batch"), (F.col("_at") % size).cast("int").alias("pos"))


def allows_enrichment(spent: Column, cap: Column, estimate: Column) -> Column:
    """Whether a build may be paid: no cap, or enough left of it."""
    return (cap <= 0) | (spent + estimate <= cap)
