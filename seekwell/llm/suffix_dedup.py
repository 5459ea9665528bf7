"""Removal of repeated passages with a sparse enhanced suffix array.

A byte goes if it lies in a string of ``least`` bytes that also starts anywhere else, in the same text or another.  Suffixes
are taken at anchors only: the anchor of a string is the least hash among its first ``span`` positions, so equal strings
have their anchor at the same place, and share the ``least - span`` bytes from it on.  :class:`Rule` holds these lengths; what stands
around an anchor is looked at for ``reach`` bytes, so longer strings can be told from shorter ones in the same pass.

(1) Tasks find the anchors of whole texts and send, for each distinct one of a chunk, the hash of those bytes (the
prefix) and that of all the bytes that strings with this anchor can cover (the context), with its count.  (2) Shards sort them by prefix
and context: a prefix that occurs once settles its anchor, equal contexts settle theirs (everything is repeated), and
only where contexts of one prefix differ is text needed, one copy of each.  (3) Those contexts are sorted by the bytes
to the right of the anchor: a suffix array with its common prefixes.  A stack scan gives the intervals of common
prefixes; within each, suffixes are ordered by what stands to the left of the anchor, and where left extensions differ the
interval is a maximal repeat with all its occurrences, of which each one's longest left extension follows.  Right and left
extension together say which strings at this anchor are repeated.

A frequent passage is counted per chunk before it is shuffled, and its contexts are sent once; the contexts of one prefix, if
very many, are dealt by the strings themselves (``MOST_CONTEXTS``), an exact way for such a group.

How many anchors each way settles is told by :func:`settled_by`.

Defined cases: null text counts as empty; texts shorter than ``least`` bytes lose nothing; repeated rows are occurrences of
each other; removal may split a character, so kept bytes need not be UTF-8 (:func:`drop_repeats` cuts at the nearest
characters inside what stays); an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import M1, M2, buffers, mix, pair, pieces, span_hashes
from .common import give_back, pack, read, stage, unpack

GRAM = 16


class Rule(NamedTuple):
    """Bytes of the shortest strings that are found, of the positions that an anchor is drawn from, and looked at from an anchor on."""

    least: int
    span: int
    reach: int


#: A passage of over 50 words has 240 bytes at least in the languages at hand; ``LENGTH`` is the rule for removal by bytes alone.
LENGTH, PASSAGE, WORDS = 400, 240, 50
BOTH, SHORT = Rule(PASSAGE, 112, LENGTH), Rule(PASSAGE, 112, PASSAGE)
CHUNK_BYTES, SEGMENT = 8 << 20, 1 << 20
SHARD_ENTRIES = 600_000
PACK, MOST_CONTEXTS = 20_000, 50_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours (len(x) - width + 1 values): running minima from both ends of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, rule: Rule = BOTH) -> np.ndarray:
    """Anchor places (in ``data``, ascending) of all strings of ``least`` bytes of the texts that lie in it one after the other."""
    starts = len(data) - rule.least + 1
    if starts <= 0:
        return np.zeros(0, np.int64)
    own = np.zeros(len(data) + GRAM + 8, np.uint8)
    own[: len(data)] = data
    eight = np.ndarray((len(own) - 7,), "<u8", own, strides=(1,))
    m = starts + rule.span - 1
    key = eight[:m] * M1
    key ^= key >> np.uint64(29)
    key += eight[8 : m + 8] * M2
    key ^= key >> np.uint64(32)
    key *= M1
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(m, dtype=np.uint64)
    least = sliding_least(key, rule.span)
    # Strings that would run over the end of their text do not count.
    ends = np.zeros(starts + 1, np.int32)
    for_text = offsets[1:] - rule.least + 1  # first start that does not fit
    np.add.at(ends, np.clip(for_text, np.minimum(offsets[:-1], starts), starts), 1)
    np.add.at(ends, np.minimum(offsets[1:], starts), -1)
    place = (least & np.uint64(0xFFFFFFFF))[np.cumsum(ends[:-1]) == 0].astype(np.int64)
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place  # places never go back


def hashes(data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Prefix and context hash of each anchor; its text lies from ``begin`` to ``end``."""
    prefix = span_hashes(data, at, np.minimum(rule.least - rule.span, end - at))
    left, right = np.minimum(at - begin, rule.span - 1), np.minimum(rule.reach, end - at)
    context = pair(span_hashes(data, at - left, left + right), left.astype(np.uint64) * np.uint64(1024) + right.astype(np.uint64))
    return prefix, context


CHUNK = "chunk long, doc_ids array<bigint>, sizes array<bigint>, shas array<string>, per_doc binary, places binary, which binary, prefix binary, context binary, count binary"


def _chunks(batches, rule: Rule):
    part, number = TaskContext.get().partitionId(), 0
    ids, sizes, shas, places, pre, con, held = [], [], [], [], [], [], 0

    def flush():
        nonlocal number, ids, sizes, shas, places, pre, con, held
        prefix, context = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (pre, con))
        order = np.lexsort((context, prefix))
        p, c = prefix[order], context[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        which = np.empty(len(p), "<u4")
        which[order] = np.cumsum(new) - 1
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        row = pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([shas], pa.list_(pa.string())),
             raw(np.array([len(x) for x in places], "<u4")), raw(np.concatenate([np.zeros(0), *places]).astype("<u4")), raw(which), raw(p[first]), raw(c[first]),
             raw(np.diff(np.append(first, len(p))).astype("<u4"))],
            [x.split()[0] for x in CHUNK.split(", ")])
        number, ids, sizes, shas, places, pre, con, held = number + 1, [], [], [], [], [], [], 0
        return row

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        names = batch.column("doc_id").to_pylist()
        for i, j in pieces(offsets, SEGMENT):
            part_of, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            at = anchors(part_of, cuts, rule)
            first = np.searchsorted(at, cuts)
            row = np.repeat(np.arange(j - i), np.diff(first))
            p, c = hashes(part_of, at, cuts[row], cuts[row + 1], rule)
            ids += names[i:j]
            sizes += np.diff(cuts).tolist()
            shas += [hashlib.sha256(part_of[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            places += np.split(at - cuts[row], first[1:-1])
            pre.append(p)
            con.append(c)
            held += len(part_of) + 64 * (j - i)
            if held >= CHUNK_BYTES:
                yield flush()
    if ids:
        yield flush()
    give_back()


def _shard(prefix: np.ndarray, shards: int) -> np.ndarray:
    return (mix(prefix + np.uint64(5)) % np.uint64(shards)).astype(np.int64)


def _asks(batches, shards: int):
    for batch in batches:
        for row in batch.to_pylist():
            p, c, n = np.frombuffer(row["prefix"], np.uint64), np.frombuffer(row["context"], np.uint64), np.frombuffer(row["count"], "<u4")
            s = _shard(p, shards)
            order = np.argsort(s, kind="stable")
            edges = np.searchsorted(s[order], np.arange(shards + 1))
            out = [(k, row["chunk"], p[at].tobytes(), c[at].tobytes(), n[at].tobytes()) for k in range(shards) if len(at := order[edges[k] : edges[k + 1]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)],
                                                 ["shard", "chunk", "prefix", "context", "count"])
    give_back()


ALONE, REPEATED, UNKNOWN, MODEL = 0, 1, 2, 3  # once; all repeated; text needed; all repeated, and this copy's text is needed


def _answers(group):
    """One shard: what is known of each (prefix, context) of each chunk."""
    sizes = [len(x) // 8 for x in group["prefix"]]
    p, c = (np.concatenate([np.frombuffer(x, np.uint64) for x in group[k]]) for k in ("prefix", "context"))
    n = np.concatenate([np.frombuffer(x, "<u4") for x in group["count"]]).astype(np.int64)
    order = np.lexsort((c, p))
    ps, cs, ns = p[order], c[order], n[order]
    new_p = np.append(True, ps[1:] != ps[:-1])
    new_c = new_p | np.append(True, cs[1:] != cs[:-1])
    f_no, g_no = np.cumsum(new_c) - 1, np.cumsum(new_p) - 1
    total_c = np.bincount(f_no, ns)[f_no]
    kinds = np.bincount(g_no[new_c])[g_no]  # distinct contexts of the prefix
    code = np.where(total_c > 1, np.where((kinds > 1) & new_c, MODEL, REPEATED), np.where(kinds > 1, UNKNOWN, ALONE)).astype(np.uint8)
    back = np.empty(len(code), np.uint8)
    back[order] = code
    del order, ps, cs, ns, p, c, n, f_no, g_no, total_c, kinds, code, new_p, new_c
    give_back()
    return pd.DataFrame({"chunk": group["chunk"], "shard": group["shard"], "code": [x.tobytes() for x in np.split(back, np.cumsum(sizes)[:-1])]})


HIT = "doc_id bigint, n_bytes bigint, sha string, places array<int>, codes binary, prefixes array<bigint>, models array<int>"


def _hits(shards: int):
    """Per document of a chunk: its anchors that are repeated or not yet settled."""

    def run(chunk, answers):
        row = chunk.iloc[0]
        prefix = np.frombuffer(row["prefix"], np.uint64)
        code, s = np.zeros(len(prefix), np.uint8), _shard(prefix, shards)
        order = np.argsort(s, kind="stable")
        edges = np.searchsorted(s[order], np.arange(shards + 1))
        for k, got in zip(answers["shard"], answers["code"], strict=True):
            code[order[edges[k] : edges[k + 1]]] = np.frombuffer(got, np.uint8)
        which, places, per = np.frombuffer(row["which"], "<u4"), np.frombuffer(row["places"], "<u4"), np.frombuffer(row["per_doc"], "<u4")
        own = code[which]
        cuts = np.append(0, np.cumsum(per)).astype(np.int64)
        out = []
        model_taken = np.zeros(len(prefix), bool)  # only one occurrence gives the text
        for d in range(len(per)):
            lo, hi = cuts[d], cuts[d + 1]
            keep = lo + np.flatnonzero(own[lo:hi] != ALONE)
            codes, models = own[keep].copy(), []
            for k in np.flatnonzero(codes == MODEL):
                w = which[keep[k]]
                if not model_taken[w]:
                    models.append(int(places[keep[k]]))
                model_taken[w] = True
            codes[codes == MODEL] = REPEATED
            out.append((places[keep].astype(np.int32), codes.tobytes(), prefix[which[keep]].view(np.int64), models))
        return pd.DataFrame({"doc_id": pd.array(list(row["doc_ids"]), "Int64"), "n_bytes": row["sizes"], "sha": row["shas"], "places": [o[0] for o in out], "codes": [o[1] for o in out], "prefixes": [o[2] for o in out], "models": [o[3] for o in out]})

    return run


CONTEXT = "prefix bigint, doc_id bigint, sha string, place int, model boolean, to_left binary, to_right binary"


def _contexts(batches, rule: Rule):
    for batch in batches:
        for row in batch.select(["doc_id", "sha", "text", "places", "codes", "prefixes", "models"]).to_pylist():
            model = np.isin(row["places"], row["models"])
            asked = np.flatnonzero((np.frombuffer(row["codes"], np.uint8) == UNKNOWN) | model)
            if not len(asked):
                continue
            raw = (row["text"] or "").encode("utf-8")
            at = [row["places"][k] for k in asked]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["prefixes"][k] for k in asked], pa.int64()), pa.array([row["doc_id"]] * len(at), pa.int64()), pa.array([row["sha"]] * len(at)), pa.array(at, pa.int32()),
                 pa.array(model[asked]), pa.array([raw[max(0, a - rule.span + 1) : a][::-1] for a in at], pa.binary()), pa.array([raw[a : a + rule.reach] for a in at], pa.binary())],
                [x.split()[0] for x in CONTEXT.split(", ")])


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(strings), width), np.uint8)
    size = np.array([len(s) for s in strings])
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s, np.uint8)
    return out, size


def _adjacent(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row and the one before it (the first has 0)."""
    same = x[1:] == x[:-1]
    first = np.where(same.all(1), x.shape[1], same.argmin(1))
    return np.append(0, np.minimum(first, np.minimum(size[1:], size[:-1])))


def intervals(lcp: np.ndarray, least: int):
    """Intervals (common prefix, from, to) of a suffix array, inner ones first, by a stack scan of its common prefixes."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = (int(lcp[i]) if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            if depth >= least:
                yield depth, left, i
        if not stack or stack[-1][0] < now:
            stack.append((now, left))


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def maximal_repeats(to_left: list[bytes], to_right: list[bytes], rule: Rule = BOTH, group=None):
    """(right extension, left extension of each member, members) of the maximal repeats of suffixes at anchors; those of other groups never meet.

    ``to_left`` is read outwards from the anchor.  An interval whose members all have the longest left extension that is looked at
    is no maximal repeat of its own: the interval around it adds nothing either, and is left out.
    """
    n = len(to_right)
    group = np.zeros(n, np.int64) if group is None else group
    own = group.tolist()
    order = np.array(sorted(range(n), key=lambda i: (own[i], to_right[i])))
    right, right_n = _matrix(to_right, rule.reach)
    lcp = _adjacent(right[order], right_n[order])
    lcp[np.append(True, group[order][1:] != group[order][:-1])] = 0
    left, left_n = _matrix(to_left, rule.span - 1)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=to_left.__getitem__)] = np.arange(n)
    settled = np.full(n, -1, np.int64)  # longest left extension found so far
    for depth, lo, hi in intervals(lcp, max(1, rule.least - rule.span + 1)):
        members = order[lo:hi]
        if hi - lo == 2:
            i, j = members.tolist()
            near = _shared(to_left[i], to_left[j])
            more = [k for k in (i, j) if near > settled[k]]
            if more:
                settled[more] = near
                yield depth, np.full(len(more), near), np.array(more)
            continue
        if (settled[members] >= rule.span - 1).all():
            continue
        members = members[np.argsort(rank[members], kind="stable")]
        near = _adjacent(left[members], left_n[members])
        longest = np.maximum(near, np.append(near[1:], 0))
        more = longest > settled[members]
        if more.any():
            settled[members] = np.maximum(settled[members], longest)
            yield depth, longest[more], members[more]


FOUND = "doc_id bigint, sha string, start int, stop int"


def _tree(group, rule: Rule):
    """Strings of one pack of prefixes that are repeated, as (start, stop) in their texts."""
    wanted, place = ~group["model"].to_numpy(), group["place"].to_numpy()
    who, start, stop = [], [], []
    for depth, longest, members in maximal_repeats(group["to_left"].tolist(), group["to_right"].tolist(), rule=rule, group=group["prefix"].to_numpy()):
        good = wanted[members] & (longest + depth >= rule.least)
        m = members[good]
        who.append(m)
        start.append(place[m] - longest[good])
        stop.append(place[m] + depth)
    give_back()
    who = np.concatenate([np.zeros(0, np.int64), *who])
    return pd.DataFrame({"doc_id": group["doc_id"].to_numpy()[who], "sha": group["sha"].to_numpy()[who].astype(object), "start": np.concatenate([np.zeros(0), *start]).astype(np.int32),
                         "stop": np.concatenate([np.zeros(0), *stop]).astype(np.int32)})


def _strings(batches, length: int):
    """The exact way for a prefix with very many contexts: every string at its anchor, by hash."""
    for batch in batches:
        for row in batch.to_pylist():
            whole = np.frombuffer(row["to_left"][::-1] + row["to_right"], np.uint8)
            n = len(whole) - length + 1
            if n > 0:
                h = span_hashes(whole, np.arange(n), np.full(n, length)).view(np.int64)
                start = row["place"] - len(row["to_left"]) + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * n, pa.int64()), pa.array([row["sha"]] * n), pa.array(start.astype(np.int32)), pa.array(h)], ["doc_id", "sha", "start", "h"])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _spans(row, n: int, rule: Rule, length: int) -> list[tuple[int, int]]:
    """Maximal runs of a text of n bytes that strings of ``length`` bytes cover which stand anywhere else."""
    codes = np.frombuffer(row["codes"], np.uint8)
    spans = [(max(0, a - rule.span + 1), min(n, a + rule.reach)) for a, c in zip(row["places"], codes, strict=True) if c == REPEATED]
    return _union([s for s in spans + [(x["start"], x["stop"]) for x in row["found"] or []] if s[1] - s[0] >= length])


def _finish(batches, rule: Rule, length: int):
    for batch in batches:
        out = []
        for row in batch.select(["doc_id", "text", "places", "codes", "found"]).to_pylist():
            raw = (row["text"] or "").encode("utf-8")
            spans, kept, at = _spans(row, len(raw), rule, length), hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            passages = sum(b - a for a, b in _spans(row, len(raw), rule, rule.least) if is_passage(raw[a:b]))
            out.append((row["doc_id"], len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), passages))
        if out:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])
    give_back()


def is_passage(run: bytes) -> bool:
    """Whether a repeated run is a passage: ``WORDS`` whole words or more, or ``LENGTH`` bytes."""
    return len(run) >= LENGTH or len(run.split()) >= WORDS


def _chunked(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows; their chunks; what is known of each chunk's entries; number of shards."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = stage(rows.mapInArrow(partial(_chunks, rule=rule), CHUNK))
    entries = chunks.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    shards = max(4, int(entries // SHARD_ENTRIES) + 1)
    asks = chunks.select("chunk", "prefix", "context", "count").mapInArrow(partial(_asks, shards=shards), "shard int, chunk bigint, prefix binary, context binary, count binary")
    answers = asks.repartition(2 * shards, "shard").groupBy("shard").applyInPandas(_answers, "chunk bigint, shard int, code binary")
    return rows, chunks, answers, shards


def settled_by(docs: DataFrame, rule: Rule = BOTH) -> DataFrame:
    """``way, anchors``: how many anchors of texts occur once, have equal surroundings elsewhere, and are left to the suffix array."""
    _, chunks, answers, shards = _chunked(docs, rule)
    hits = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_hits(shards), HIT)

    def count(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(x or b"" for x in batch.column("codes").to_pylist()), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(["equal surroundings", "suffix array"]), pa.array([int((codes == REPEATED).sum()), int((codes == UNKNOWN).sum())], pa.int64())], ["way", "anchors"])

    total = chunks.select(F.lit("all").alias("way"), (F.length("which") / 4).cast("long").alias("anchors"))
    return hits.mapInArrow(count, "way string, anchors bigint").union(total).groupBy("way").agg(F.sum("anchors").alias("anchors"))


def find_repeats(docs: DataFrame, rule: Rule = BOTH) -> tuple[DataFrame, DataFrame]:
    """(settled, open): documents without a repeat, as ``doc_id, n_bytes, sha``; and the others with text and what is repeated."""
    rows, chunks, answers, shards = _chunked(docs, rule)
    hits = stage(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_hits(shards), HIT))
    settled = hits.where(F.size("places") == 0)
    # Repeated rows have the same anchors, but each may have been asked for other texts.
    some = hits.where(F.size("places") > 0).groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(
        F.first("n_bytes").alias("n_bytes"), F.first("places").alias("places"), F.first("codes").alias("codes"), F.first("prefixes").alias("prefixes"), F.flatten(F.collect_list("models")).alias("models"))
    full = rows.withColumn("sha", F.sha2("text", 256)).join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))).drop("_id", "_sha")
    full = stage(full)
    contexts = stage(full.dropDuplicates(["doc_id", "sha"]).mapInArrow(partial(_contexts, rule=rule), CONTEXT))
    many = contexts.groupBy("prefix").count().where(F.col("count") > MOST_CONTEXTS).select("prefix")
    packs = max(1, contexts.count() // PACK)
    few = contexts.join(many, "prefix", "left_anti") if many.limit(1).count() else contexts
    found = few.withColumn("pack", F.pmod("prefix", F.lit(packs))).groupBy("pack").applyInPandas(lambda group: _tree(group, rule), FOUND)
    if few is not contexts:
        for length in sorted({rule.least, rule.reach}):
            each = contexts.join(many, "prefix", "left_semi").mapInArrow(partial(_strings, length=length), "doc_id bigint, sha string, start int, h bigint").distinct()  # two anchors may give one string
            again = each.groupBy("h").count().where("count > 1").select("h")
            found = found.union(each.join(again, "h", "left_semi").select("doc_id", "sha", "start", (F.col("start") + length).alias("stop")))
    lists = found.groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "stop")).alias("found")).withColumnRenamed("doc_id", "_id").withColumnRenamed("sha", "_sha")
    opened = full.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").drop("_id", "_sha")
    return settled.select("doc_id", "n_bytes", "sha"), opened


def removal_report(docs: DataFrame, rule: Rule = BOTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row, by strings of ``reach`` bytes; ``n_passage``: bytes in repeated runs
    of strings of ``least`` bytes that are passages (:func:`is_passage`)."""
    settled, opened = find_repeats(docs, rule)
    done = opened.select("doc_id", "text", "places", "codes", "found").mapInArrow(
        partial(_finish, rule=rule, length=rule.reach), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage bigint")
    none = F.lit(0).cast("long")
    return settled.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), none.alias("n_passage")).union(done)


def drop_repeats(docs: DataFrame, rule: Rule = SHORT) -> DataFrame:
    """``docs`` with repeated passages (:func:`is_passage`) cut from ``text``, whole characters only; ``n_chars`` follows where there is one.

    Rows that lose nothing stay as they are; a text that is repeated in whole becomes empty, and its row stays.
    """
    _, opened = find_repeats(docs, rule)
    columns, schema, docs = docs.columns, docs.schema, pack(docs, "doc_id", "text")
    names = docs.columns
    spans = opened.select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"), "places", "codes", "found").dropDuplicates(["_id", "_sha"])
    joined = docs.join(spans, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("_sha")), "left")

    def cut(batches):
        for batch in batches:
            texts = []
            for text, places, codes, found in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "codes", "found")), strict=True):
                if places is None:
                    texts.append(text)
                    continue
                raw, at, kept = text.encode("utf-8"), 0, []
                for a, b in _spans({"places": places, "codes": codes, "found": found}, len(raw), rule, rule.least):
                    if is_passage(raw[a:b]):
                        kept.append(raw[at:a])
                        at = b
                kept.append(raw[at:])
                texts.append("".join(k.decode("utf-8", "ignore") for k in kept))
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    out = joined.select(*names, "places", "codes", "found").mapInArrow(cut, docs.schema)
    out = unpack(out, columns, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that stand anywhere else, and its bytes in repeated passages of over 50 words."""
    return removal_report(read(spark, sf_dir, "documents"))
