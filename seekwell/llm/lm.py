"""Language-model scoring with an Elias-Fano n-gram trie that is spread over shards.

Model.  Unigrams have add-half probabilities; bigrams are smoothed by absolute discounting with interpolation,
max(c(a b) - DISCOUNT, 0) / c(a) + DISCOUNT * successors(a) / c(a) * p(b).  A text is its lower-cased words and one end token; before the
first word stands a start context.  Tries, one a shard, hold the discounted probabilities and the back-off weights: a
monotone Elias-Fano level of contexts, a monotone level of pointers, and a level of successors that are made monotone by
adding the number of their context (so a search stays within one context's range), with log probabilities and weights
quantised to 8 bits in steps of ``STEP`` decades.  A search finds the bucket of equal high bits by two selections and goes on in there.
A shard writes its levels to one file of its task and queries them through a memory map.

Jobs.  (1) Tasks scan whole texts into chunks of about a million tokens: word numbers for each token and the chunk's
distinct words.  (2) Each chunk asks for its distinct words and bigrams, once each, and brings its own training
counts along; shards (by word, or by context) add up the counts, build tries, and answer.  A context with more than 1 / ``HOT`` of all
tokens (so of at most ``HOT`` such words) is spread over many shards by slices of its successors: each holds probabilities
within its slice and the slice's total.  (3) Answers meet their chunk, which sums log probabilities per document.  What is
shuffled grows with the distinct n-grams of chunks, nothing but the hot words is broadcast, and the driver sees totals and hot words.

Defined cases: null text counts as empty (one end token); a null doc_id trains; repeated rows each count; with no
training rows all scores come from the add-half formula with N = V = 0; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import LOWER, buffers, mix, pieces, span_hashes, words
from .common import crc_mod5, read, stage

DISCOUNT, STEP = 0.75, 0.04
CHUNK_TOKENS = 1 << 20
HOT = 4096
END, START = np.uint64(0x1), np.uint64(0x2)
SHARD_BYTES = 24_000_000


# ------------------------------------------------------------------ Elias-Fano

#: For each 16 bits: how many are set, and the place of the k-th that is.
_BITS = np.unpackbits(np.arange(1 << 16, dtype="<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
_POP = _BITS.sum(1).astype(np.uint8)
_NTH = np.zeros((1 << 16, 16), np.uint8)
_row, _bit = np.nonzero(_BITS)
_NTH[_row, np.cumsum(_BITS, axis=1)[_row, _bit] - 1] = _bit


class Bits:
    """A bit vector in words of 16 with a rank directory; ``select`` gives the place of the i-th set bit."""

    def __init__(self, raw: np.ndarray, sums: np.ndarray):
        self.raw, self.sums, self.zeros = raw, sums, None

    @staticmethod
    def of(packed: np.ndarray) -> Bits:
        raw = np.zeros(-(-len(packed) // 2) * 2, np.uint8)
        raw[: len(packed)] = packed
        raw = raw.view("<u2")
        return Bits(raw, np.concatenate([[0], np.cumsum(_POP[raw])]).astype(np.uint32))

    def select(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.sums, i.astype(np.uint32), "right") - 1
        return word * 16 + _NTH[self.raw[word], i - self.sums[word]]

    def select_zero(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th bit that is not set."""
        if self.zeros is None:
            self.zeros = (np.arange(len(self.sums), dtype=np.int64) * 16 - self.sums).astype(np.uint32)
        word = np.searchsorted(self.zeros, i.astype(np.uint32), "right") - 1
        return word * 16 + _NTH[~self.raw[word], i - self.zeros[word]]


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, ones: Bits):
        self.n, self.low_bits, self.low, self.ones = n, low_bits, low, ones

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = min(56, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        # high parts stay below 4 n + 256 bits; where the universe is wide for few values, more low bits are not needed
        if bits:
            cells = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits]
            low = np.packbits(cells.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        low = np.concatenate([low, np.zeros(8, np.uint8)])
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 2 if n else 0, np.uint8)  # ends with a bit that is not set
        unary[high] = 1
        return EliasFano(n, bits, low, Bits.of(np.packbits(unary, bitorder="little")))

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        high = (self.ones.select(i) - i).astype(np.uint64)
        if not self.low_bits:
            return high
        at = i * self.low_bits
        window = np.ndarray((len(self.low) - 7,), "<u8", np.ascontiguousarray(self.low), strides=(1,))[at >> 3]
        mask = np.uint64((1 << self.low_bits) - 1)
        return (high << np.uint64(self.low_bits)) | ((window >> (at & 7).astype(np.uint64)) & mask)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) with a value of at least x (hi if none), for many queries at once.

        Values with fewer high bits than x end where a zero of the unary part says; only those with equal high bits are compared.
        """
        lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
        if not self.n:
            return hi
        last = int(self.ones.select(np.array([self.n - 1]))[0]) - (self.n - 1)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        known = np.minimum(high, last)
        first = np.where(known > 0, self.ones.select_zero(np.maximum(known - 1, 0)) - np.maximum(known - 1, 0), 0)
        after = np.where(high > last, self.n, self.ones.select_zero(known) - known)
        lo, hi = np.minimum(np.maximum(lo, np.where(high > last, self.n, first)), hi), np.minimum(hi, np.maximum(lo, after))
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < x[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of positive numbers up to 1, by their logarithm; 0 for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.round(-np.log10(p) / STEP), 0, 254), 0).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-STEP * (codes.astype(np.float64) - 1)), 0.0)


class Trie:
    """Contexts -> pointers -> successors with quantised probabilities, in Elias-Fano levels of one file; contexts have a back-off weight and a total."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, probabilities: np.ndarray, weights: np.ndarray, totals: np.ndarray):
        self.contexts, self.pointers, self.successors = contexts, pointers, successors
        self.probabilities, self.weights, self.totals = probabilities, weights, totals

    @staticmethod
    def of(ctx: np.ndarray, succ: np.ndarray, counts: np.ndarray) -> Trie:
        """From training bigrams in any order, equal ones added up; successors are 32-bit."""
        order = np.lexsort((succ, ctx))
        ctx, succ, counts = ctx[order], succ[order], counts[order]
        new = np.ones(len(ctx), bool)
        new[1:] = (ctx[1:] != ctx[:-1]) | (succ[1:] != succ[:-1])
        first = np.flatnonzero(new)
        counts = np.add.reduceat(counts, first) if len(first) else counts
        ctx, succ = ctx[first], succ[first]
        start = np.ones(len(ctx), bool)
        start[1:] = ctx[1:] != ctx[:-1]
        heads = np.flatnonzero(start)
        number = (np.cumsum(start) - 1).astype(np.int64)
        totals = np.add.reduceat(counts, heads).astype(np.float64) if len(heads) else np.zeros(0)
        fan = np.diff(np.append(heads, len(ctx)))
        return Trie(
            EliasFano.of(ctx[heads], 1 << 64), EliasFano.of(np.concatenate([heads, [len(ctx)]]), len(ctx) + 1),
            EliasFano.of((number.astype(np.uint64) << np.uint64(32)) | succ, max(1, len(heads)) << 32),
            quantise((counts - DISCOUNT) / totals[number]), quantise(DISCOUNT * fan / totals), totals)

    def mapped(self, file) -> Trie:
        """The same trie with its levels in ``file``, read through a memory map."""
        levels, parts, at = (self.contexts, self.pointers, self.successors), [], 0
        arrays = [a for e in levels for a in (e.low, e.ones.raw, e.ones.sums)] + [self.probabilities, self.weights, self.totals]
        for a in arrays:
            raw = a.tobytes()
            file.write(raw + b"\0" * (-len(raw) % 8))
            parts.append((at, a.dtype, len(a)))
            at += len(raw) + -len(raw) % 8
        file.write(b"\0" * 8)
        file.flush()
        whole = np.memmap(file.name, np.uint8, "r").view(np.ndarray)
        views = [whole[o : o + n * np.dtype(t).itemsize].view(t) for o, t, n in parts]
        made = [EliasFano(e.n, e.low_bits, views[3 * i], Bits(views[3 * i + 1], views[3 * i + 2])) for i, e in enumerate(levels)]
        return Trie(*made, *views[9:])

    def look_up(self, ctx: np.ndarray, sizes: np.ndarray, succ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of each asked bigram, weight code and total of each context), 0 if never seen; ``ctx[i]`` is asked for ``sizes[i]`` successors in turn."""
        n = self.contexts.n
        if not n or not len(ctx):
            return np.zeros(len(succ), np.uint8), np.zeros(len(ctx), np.uint8), np.zeros(len(ctx))
        at = self.contexts.successor(ctx, np.zeros(len(ctx), np.int64), np.full(len(ctx), n))
        safe = np.minimum(at, n - 1)
        known = (at < n) & (self.contexts.get(safe) == ctx)
        lo, hi = self.pointers.get(safe).astype(np.int64), self.pointers.get(safe + 1).astype(np.int64)
        hi = np.where(known, hi, lo)
        lo, hi, key = np.repeat(lo, sizes), np.repeat(hi, sizes), (np.repeat(safe, sizes).astype(np.uint64) << np.uint64(32)) | succ
        found = self.successors.successor(key, lo, hi)
        hit = np.flatnonzero(found < hi)
        hit = hit[self.successors.get(found[hit]) == key[hit]]
        out = np.zeros(len(succ), np.uint8)
        out[hit] = self.probabilities[found[hit]]
        return out, np.where(known, self.weights[safe], 0).astype(np.uint8), np.where(known, self.totals[safe], 0.0)


# ------------------------------------------------------------------ chunks

CHUNK = "chunk long, doc_ids array<bigint>, held_out array<boolean>, n_tokens array<bigint>, words binary, tokens binary, hot array<struct<word:bigint,n:bigint>>"


def _chunks(batches, chunk_tokens: int):
    """Arrow batches of (doc_id, text, held_out) to chunk rows."""
    part, number = TaskContext.get().partitionId(), 0
    ids, held, counts, hashes, total = [], [], [], [], 0

    def flush():
        nonlocal number, ids, held, counts, hashes, total
        uniq, idx = np.unique(np.concatenate(hashes), return_inverse=True)
        often = np.bincount(idx)
        names, often = np.append(uniq, START), np.append(often, sum(map(len, counts)))  # a start context for each text
        top = np.flatnonzero(often * HOT > len(idx))
        row = pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | number], pa.int64()), pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([sum(held, [])], pa.list_(pa.bool_())),
             pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([uniq.tobytes()], pa.binary()), pa.array([idx.astype("<u4").tobytes()], pa.binary()),
             pa.array([[{"word": w, "n": n} for w, n in zip(names[top].view(np.int64).tolist(), often[top].tolist(), strict=True)]], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())])))],
            ["chunk", "doc_ids", "held_out", "n_tokens", "words", "tokens", "hot"])
        number, ids, held, counts, hashes, total = number + 1, [], [], [], [], 0
        return row

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in pieces(offsets, 1 << 21):
            own = LOWER[data[offsets[i] : offsets[j]]]
            starts, ends, first = words(own, offsets[i : j + 1] - offsets[i])
            n = np.diff(first)
            h = np.empty(len(starts) + len(n), np.uint64)
            is_end = np.zeros(len(h), bool)
            is_end[np.cumsum(n + 1) - 1] = True
            h[is_end] = END
            h[~is_end] = span_hashes(own, starts, ends - starts) | np.uint64(4)  # never END or START
            ids.append(batch.column("doc_id").slice(i, j - i).to_pylist())
            held.append(batch.column("held_out").slice(i, j - i).to_pylist())
            counts.append(n + 1)
            hashes.append(h)
            total += len(h)
            if total >= chunk_tokens:
                yield flush()
    if total:
        yield flush()


def _bigrams(row) -> dict:
    """What a chunk asks: its words, its distinct bigrams in the order (context, slice, successor), and counts in training."""
    uniq = np.frombuffer(row["words"], np.uint64)
    tok = np.frombuffer(row["tokens"], "<u4").astype(np.int64)
    n = np.asarray(row["n_tokens"], np.int64)
    train = np.repeat(~np.asarray(row["held_out"], bool), n)
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[np.cumsum(n) - n] = len(uniq)  # the start context
    keys, inverse = np.unique(prev * len(uniq) + tok, return_inverse=True)
    count = np.bincount(inverse[train], minlength=len(keys))
    ctx, succ = keys // len(uniq), keys % len(uniq)
    return {"uniq": uniq, "tok": tok, "n": n, "inverse": inverse, "ctx": ctx, "succ": succ, "count": count,
            "word_count": np.bincount(tok[train], minlength=len(uniq))}


def _shard(names: np.ndarray, slices: np.ndarray, shards: int) -> np.ndarray:
    return (mix(names + slices.astype(np.uint64) * np.uint64(0x9E37)) % np.uint64(shards)).astype(np.int64)


def _routes(b: dict, shards: int, hot: dict[int, int]):
    """Of a chunk: order of its bigrams by shard, context and successor; its heads (shard, context, number of bigrams) in that order, with all
    shards of a hot context; order of its words by shard."""
    names = np.append(b["uniq"], START)
    of = np.ones(len(names), np.uint64)  # slices of each context
    table = np.array(sorted(hot), np.int64).view(np.uint64)
    table.sort()
    if len(table):
        at = np.minimum(np.searchsorted(table, names), len(table) - 1)
        is_hot = table[at] == names
        of[is_hot] = [hot[int(w)] for w in names[is_hot].view(np.int64)]
    shard = _shard(names[b["ctx"]], mix(b["uniq"] + np.uint64(9))[b["succ"]] % of[b["ctx"]], shards)
    order = np.lexsort((b["succ"], b["ctx"], shard))
    key = shard * len(names) + b["ctx"]
    wide = np.flatnonzero(of > 1)
    wide = wide[np.isin(wide, b["ctx"])]
    every, at = np.repeat(wide, of[wide].astype(np.int64)), np.concatenate([np.zeros(0, np.int64), *[np.arange(int(of[c])) for c in wide]])
    heads = np.unique(np.concatenate([key, _shard(names[every], at, shards) * len(names) + every]))
    sizes = np.bincount(np.searchsorted(heads, key), minlength=len(heads))
    word_shard = (mix(b["uniq"] + np.uint64(3)) % np.uint64(shards)).astype(np.int64)
    return names, order, heads // len(names), heads % len(names), sizes, np.argsort(word_shard, kind="stable"), np.sort(word_shard)


ASK = "kind string, shard int, chunk long, n_heads long, n_keys long, ctx binary, sizes binary, keys binary, counts binary"


def _packed(x: np.ndarray) -> bytes:
    """Small numbers by planes of their bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def _asks(batches, shards: int, hot: dict[int, int]):
    for batch in batches:
        for row in batch.to_pylist():
            b = _bigrams(row)
            names, order, head_shard, head_ctx, sizes, words_by, word_shard = _routes(b, shards, hot)
            out = []
            for s, (lo, hi) in enumerate(_cuts(word_shard, shards)):
                at = words_by[lo:hi]
                if len(at):
                    out.append(("w", s, row["chunk"], 0, len(at), b"", b"", b["uniq"][at].tobytes(), _packed(b["word_count"][at].astype("<u4"))))
            ends = np.append(0, np.cumsum(sizes))
            for s, (lo, hi) in enumerate(_cuts(head_shard, shards)):
                if hi > lo:
                    at = order[ends[lo] : ends[hi]]
                    succ = (b["uniq"][b["succ"][at]] >> np.uint64(32)).astype("<u4")
                    out.append(("b", s, row["chunk"], hi - lo, len(at), names[head_ctx[lo:hi]].tobytes(), _packed(sizes[lo:hi].astype("<u4")), succ.tobytes(), _packed(b["count"][at].astype("<u4"))))
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in ASK.split(", ")])


def _cuts(sorted_shard: np.ndarray, shards: int):
    edges = np.searchsorted(sorted_shard, np.arange(shards + 1))
    return zip(edges[:-1], edges[1:], strict=True)


ANSWER = "chunk long, kind string, shard int, answer binary, weights binary, totals binary, distinct long"


def _answers(group):
    """One shard: adds up counts, builds its table or trie, answers each chunk."""
    import pandas as pd

    kind, shard = group["kind"].iloc[0], group["shard"].iloc[0]
    counts = [_unpacked(x, n, "<u4") for x, n in zip(group["counts"], group["n_keys"], strict=True)]
    weights = totals = [b""] * len(group)
    if kind == "w":
        keys = [np.frombuffer(x, np.uint64) for x in group["keys"]]
        uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inv, np.concatenate(counts))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = [_packed(sums[x].astype("<u8")) for x in np.split(inv, cuts)]
        distinct = int((sums > 0).sum())
    else:
        ctx = [np.frombuffer(x, np.uint64) for x in group["ctx"]]
        sizes = [_unpacked(x, n, "<u4") for x, n in zip(group["sizes"], group["n_heads"], strict=True)]
        succ = [np.frombuffer(x, "<u4").astype(np.uint64) for x in group["keys"]]
        kept = [c > 0 for c in counts]
        trie = Trie.of(np.concatenate([np.repeat(a, n)[k] for a, n, k in zip(ctx, sizes, kept, strict=True)]),
                       np.concatenate([s[k] for s, k in zip(succ, kept, strict=True)]),
                       np.concatenate([c[k] for c, k in zip(counts, kept, strict=True)]).astype(np.int64))
        with tempfile.NamedTemporaryFile() as f:
            trie = trie.mapped(f)
            found = [trie.look_up(a, n, s) for a, n, s in zip(ctx, sizes, succ, strict=True)]
            del trie
        answers, weights, totals = [_packed(x) for x, _, _ in found], [_packed(x) for _, x, _ in found], [_packed(x.astype("<u8")) for _, _, x in found]
        distinct = 0
    return pd.DataFrame({"chunk": group["chunk"], "kind": kind, "shard": shard, "answer": answers, "weights": weights, "totals": totals, "distinct": [distinct] + [0] * (len(group) - 1)})


SCORE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(shards: int, hot: dict[int, int], total: int, distinct: int):
    def run(chunk, answers):
        import pandas as pd

        if not len(chunk):  # cannot be: every answer was asked for
            return pd.DataFrame(columns=[c.split()[0] for c in SCORE.split(", ")])
        row = chunk.iloc[0].to_dict()
        b = _bigrams(row)
        names, order, head_shard, head_ctx, sizes, words_by, word_shard = _routes(b, shards, hot)
        got = {(k, s): x for k, s, *x in zip(*(answers[c] for c in ("kind", "shard", "answer", "weights", "totals")), strict=True)}
        c = np.zeros(len(b["uniq"]), np.int64)
        for s, (lo, hi) in enumerate(_cuts(word_shard, shards)):
            if hi > lo:
                c[words_by[lo:hi]] = _unpacked(got["w", s][0], hi - lo, "<u8")
        own, weight, part, ends = np.zeros(len(order)), np.zeros(len(sizes)), np.zeros(len(sizes)), np.append(0, np.cumsum(sizes))
        for s, (lo, hi) in enumerate(_cuts(head_shard, shards)):
            if hi > lo:
                answer, w, t = got["b", s]
                own[ends[lo] : ends[hi]] = dequantise(_unpacked(answer, int(ends[hi] - ends[lo]), "u1"))
                weight[lo:hi], part[lo:hi] = dequantise(_unpacked(w, hi - lo, "u1")), _unpacked(t, hi - lo, "<u8")
        # Slices of a context count by their share of its total; a context that was never seen leaves all to the unigram.
        whole = np.bincount(head_ctx, part, minlength=len(names))
        share = np.divide(part, whole[head_ctx], out=np.zeros(len(part)), where=part > 0)
        back_off = np.where(whole > 0, np.bincount(head_ctx, weight * share, minlength=len(names)), 1.0)
        p1 = (c + 0.5) / (total + 0.5 * (distinct + 1))
        p2 = np.empty(len(order))
        p2[order] = own * np.repeat(share, sizes)
        p2 += back_off[b["ctx"]] * p1[b["succ"]]
        cuts = np.cumsum(b["n"]) - b["n"]
        add = lambda x: np.add.reduceat(x, cuts)
        return pd.DataFrame({
            "doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": list(row["held_out"]), "n_tokens": b["n"],
            "n_known": add((c[b["tok"]] > 0).astype(np.int64)), "train_tokens": total,
            "base_score": add(np.log10(p1)[b["tok"]]), "score": add(np.log10(p2)[b["inverse"]])})

    return run


def score_documents(docs: DataFrame, held_out, chunk_tokens: int = CHUNK_TOKENS, shards: int | None = None) -> DataFrame:
    """Scores of all rows of ``docs`` (``doc_id, text``), learned from those where the column ``held_out`` is false."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    chunks = stage(rows.mapInArrow(lambda it: _chunks(it, chunk_tokens), CHUNK))
    sums = chunks.select(
        F.aggregate(F.arrays_zip("n_tokens", "held_out"), F.lit(0).cast("long"), lambda a, x: a + F.when(~x["held_out"], x["n_tokens"]).otherwise(0)).alias("t"),
        F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
    ).agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not sums["n"]:
        return spark.createDataFrame([], SCORE)
    count = shards or max(4, int(sums["n"] * 6 // SHARD_BYTES))
    # Words with more than 1 / HOT of all tokens (fewer than HOT of them) and the slices of their successors: about as many as the shards that they would fill.
    often = chunks.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.n").alias("n")).where(F.col("n") * HOT > sums["n"]).collect()
    hot = {r["word"]: s for r in often if (s := -(-r["n"] * 2 * count // sums["n"])) > 1}
    some = chunks.select("chunk", "doc_ids", "held_out", "n_tokens", "words", "tokens")
    asks = some.mapInArrow(lambda it: _asks(it, count, hot), ASK)
    answers = stage(asks.repartition(2 * count, "kind", "shard").groupBy("kind", "shard").applyInPandas(_answers, ANSWER))
    distinct = answers.agg(F.sum("distinct").alias("v")).first()["v"] or 0
    return some.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scores(count, hot, sums["t"] or 0, distinct), SCORE)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every whole document, scored by the model learned from four fifths of the rows."""
    return score_documents(read(spark, sf_dir, "documents"), crc_mod5() == 1)
