"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation's roles should read ``(s?(ua)+)?``.  Turns are kept (0), given another role (3) or deleted (4), empty turns inserted (3); a
truncated turn that stays costs 3 more.  The machine has four states (start, after system, user, assistant), and the cost to go
from a line is a vector of four numbers; a line is a min-plus matrix.

Search.  Chunks run backwards from speculative vectors (zeros; the last chunk of a conversation from the true costs of ending).  In fix-up
passes a chunk whose successor begins with another vector runs again from that one, and stops where its new vector differs from the old one
by a constant only, since all before is the same then but for that constant.  Passes end when no chunk's vector changes.  Chunks exist twice:
lanes of ``LANE`` lines, which a task runs side by side in numpy, and cells of ``CELL`` lines of the sorted table, dealt over tasks.  Cells
whose vectors still change after ``PASSES`` passes (roles can alternate for ever) are settled by products of their matrices, in doubling steps.
Tracing takes the least letter of those whose cost plus the stitched cost to go is least: deletions before insertions, keeps and
new roles.  A cell maps its state at entry to one at exit; the maps are composed by doubling, so no conversation passes one task.

Lines.  Rows equal in conversation, turn, role and text are one line with a number; only a text's MD5 travels.  A conversation's
first line of a role and text is found by an aggregate and joined back on whole lines, so a text that fills a conversation is no hot key.  Texts
are shuffled once, at the end, to meet the decisions about their lines.

Defined cases: a null role or text is one space; null turns come first; rows of one turn are taken by role, then MD5 of the text; a null
conv_id is a conversation of its own; exact repeats are duplicates; a conversation without rows has zeros and the empty string's
hash; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stage

LANE, CELL_BITS, PASSES = 4, 12, 6
SPACES = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BIG, ENDLESS = 1 << 24, 1 << 44
#: State after one more turn of the only role that may follow, and that role.
FOLLOW, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, role) -> state; roles: system, user, assistant, other
#: What may be done at a line, in the order of its letters.
MOVES = ("D", "IIK", "IIR", "IK", "IR", "K", "R")
#: Insertions that end a conversation, by state.
ENDING = ("", "II", "I", "")
ACCEPT = tuple(INSERT * len(x) for x in ENDING)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of each (code, state, move).  Codes: 2 * role + truncated; 8 + role for lines that must go."""
    cost, to = np.full((12, 4, len(MOVES)), BIG, np.int32), np.zeros((12, 4, len(MOVES)), np.int8)
    for code in range(12):
        for state in range(4):
            cost[code, state, 0], to[code, state, 0] = DELETE, state
            if code >= 8:
                continue
            for k, move in enumerate(MOVES[1:], 1):
                at = state
                for _ in move[:-1]:
                    at = FOLLOW[at]
                after = KEEP.get((at, code // 2)) if move[-1] == "K" else FOLLOW[at]
                if after is not None:
                    cost[code, state, k] = INSERT * (len(move) - 1) + RETYPE * (move[-1] == "R") + TRUNCATED * (code % 2)
                    to[code, state, k] = after
    return cost, to


COST, TO = _tables()
#: Cheapest way of each code from one state to another.
MATRIX = np.full((12, 4, 4), BIG, np.int32)
for _c in range(12):
    for _x in range(4):
        for _k in range(len(MOVES)):
            MATRIX[_c, _x, TO[_c, _x, _k]] = min(MATRIX[_c, _x, TO[_c, _x, _k]], COST[_c, _x, _k])


def level(v: np.ndarray) -> np.ndarray:
    """Vectors less their least element: equal if they differ by a constant."""
    return v - v.min(-1, keepdims=True)


def vectors(codes: np.ndarray, first: np.ndarray, ends: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, int]:
    """Costs to go before each line, up to a constant, and the number of fix-up passes.

    ``first`` has the number of the first line of each chunk (chunks + 1), ``ends`` the costs to go at its end.
    """
    vec = np.zeros((len(codes), 4), np.int32)
    size = np.diff(first)
    lanes = -(-size // lane)
    own = np.repeat(np.arange(len(size)), lanes)
    a = first[:-1][own] + lane * (np.arange(len(own)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    b = np.minimum(a + lane, first[1:][own])
    last = b == first[1:][own]
    used = np.where(last[:, None], level(ends[own]), 0).astype(np.int32)

    def run(which: np.ndarray, fresh: bool) -> None:
        now, live = used[which].copy(), np.arange(len(which))
        for t in range(lane - 1, -1, -1):
            live_t = live[a[which[live]] + t < b[which[live]]]
            at = a[which[live_t]] + t
            new = level((MATRIX[codes[at]] + now[live_t][:, None, :]).min(2))
            now[live_t] = new
            same = (vec[at] == new).all(1) if not fresh else np.zeros(len(at), bool)
            vec[at] = new
            if same.any():  # what stands before is the same but for a constant
                live = np.setdiff1d(live, live_t[same], assume_unique=True)

    run(np.arange(len(a)), True)
    passes, inner = 0, np.flatnonzero(~last)
    while True:
        want = vec[a[inner + 1]]
        which = inner[(want != used[inner]).any(1)]
        if not len(which):
            return vec, passes
        used[which] = vec[a[which + 1]]
        run(which, False)
        passes += 1


def matrices(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Min-plus product of each chunk's lines (chunks, 4, 4)."""
    out = np.where(np.eye(4, dtype=bool), 0, BIG).astype(np.int64)[None].repeat(len(first) - 1, 0)
    size = np.diff(first)
    for t in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > t)
        out[live] = np.minimum((out[live][:, :, :, None] + MATRIX[codes[first[:-1][live] + t]][:, None, :, :]).min(2), BIG)
    return np.where(out < BIG, out, ENDLESS)


def moves(codes: np.ndarray, first: np.ndarray, vec: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least move of each (line, state), and where it leads."""
    after = np.empty_like(vec)
    after[:-1] = vec[1:]
    full = np.flatnonzero(np.diff(first))
    after[first[1:][full] - 1] = ends[full]
    to = TO[codes]
    total = COST[codes] + np.take_along_axis(after[:, None, :], to.astype(np.int64), 2)
    best = total.argmin(2)  # the first of equal ones
    return best, np.take_along_axis(to, best[:, :, None], 2)[:, :, 0]


def follow(first: np.ndarray, to: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before each line and at the end of each chunk, from the states at entry."""
    state, now, size = np.zeros(len(to), np.int8), entry.astype(np.int8).copy(), np.diff(first)
    order = np.argsort(-size, kind="stable")
    for t in range(int(size.max(initial=0))):
        live = order[: np.searchsorted(-size[order], -t, "left")]
        at = first[:-1][live] + t
        state[at] = now[live]
        now[live] = to[at, now[live]]
    return state, now


def _chunks(batch: pa.RecordBatch, most: int = 1 << 17):
    """Rows of a batch in slices of about ``most`` lines: (slice, codes, first)."""
    size = np.array([len(x) for x in batch.column("codes").to_pylist()], np.int64)
    cuts, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + most, "right")) - 1)
        part = batch.slice(i, j - i)
        codes = np.frombuffer("".join(part.column("codes").to_pylist()).encode(), np.uint8).astype(np.int64) - 97
        yield part, codes, cuts[i : j + 1] - cuts[i]
        i = j


def _ends(part: pa.RecordBatch) -> np.ndarray:
    return np.array(part.column("e").to_pylist(), np.int32).reshape(-1, 4)


def _with(part: pa.RecordBatch, drop: tuple[str, ...], **new: pa.Array) -> pa.RecordBatch:
    names = [n for n in part.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new.values()], [*names, *new])


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(values.reshape(len(values), -1).tolist(), pa.list_(pa.int32()))


def _starts(batches):
    """Adds ``s``: the vector before each cell."""
    for batch in batches:
        for part, codes, first in _chunks(batch):
            vec, _ = vectors(codes, first, _ends(part))
            yield _with(part, ("codes",), s=_lists(vec[first[:-1]]))


def _products(batches):
    for batch in batches:
        for part, codes, first in _chunks(batch):
            yield _with(part, ("codes",), p=pa.array(matrices(codes, first).reshape(len(part), 16).tolist(), pa.list_(pa.int64())))


def _maps(batches):
    """Adds ``p``: the state at exit for each state at entry."""
    for batch in batches:
        for part, codes, first in _chunks(batch):
            ends = _ends(part)
            _, to = moves(codes, first, vectors(codes, first, ends)[0], ends)
            out = np.stack([follow(first, to, np.full(len(part), x))[1] for x in range(4)], 1)
            yield _with(part, ("codes", "e"), p=_lists(out))


def _solve(batches):
    """Audit, cost, illegal pairs and the lines that stay (64 * line + 8 * state + move) of each cell."""
    for batch in batches:
        for part, codes, first in _chunks(batch):
            ends, entry = _ends(part), part.column("x").to_numpy(zero_copy_only=False)
            best, to = moves(codes, first, vectors(codes, first, ends)[0], ends)
            state, leave = follow(first, to, entry)
            line = np.arange(len(codes))
            k = best[line, state]
            spent = COST[codes, state, k].astype(np.int64)
            copies = np.concatenate([np.asarray(c, np.int64) if c is not None else np.ones(n, np.int64) for c, n in zip(part.column("copies").to_pylist(), np.diff(first), strict=True)] or [np.zeros(0, np.int64)])
            spent += DELETE * (copies - 1)
            role = np.where(codes >= 8, codes - 8, codes // 2)
            before = np.empty_like(role)
            before[1:] = role[:-1]
            before[first[:-1]] = part.column("left").to_numpy(zero_copy_only=False)
            allowed = (before == 4) | ((role == 1) & ((before == 0) | (before == 2))) | ((role == 2) & (before == 1))
            broken = (~allowed).astype(np.int64) + copies - 1  # equal rows of one role beside each other never fit
            letters = np.array(MOVES, object)[k]
            many = np.flatnonzero(copies > 1)
            letters[many] = [x + "D" * int(c - 1) for x, c in zip(letters[many], copies[many], strict=True)]
            ending = np.array(ENDING, object)[np.where(part.column("last").to_numpy(zero_copy_only=False), leave, 0)]
            n0 = part.column("n0").to_numpy()
            stays = (k > 0)
            picks = (n0.repeat(np.diff(first)) + line - np.repeat(first[:-1], np.diff(first))) * 64 + state * 8 + k
            span = [slice(*x) for x in zip(first[:-1], first[1:], strict=True)]
            yield _with(part.select(["conv_id", "cell"]), (), **{
                "audit": pa.array(["".join(letters[s]) + e for s, e in zip(span, ending, strict=True)], pa.string()),
                "cost": pa.array([int(spent[s].sum()) + INSERT * len(e) for s, e in zip(span, ending, strict=True)], pa.int64()),
                "illegal": pa.array([int(broken[s].sum()) for s in span], pa.int64()),
                "picks": pa.array([picks[s][stays[s]].tolist() for s in span], pa.list_(pa.int64())),
                "ending": pa.array(ending, pa.string())})


# ------------------------------------------------------------------ tables

def _meet(left: DataFrame, right: DataFrame, keys: dict[str, Column], take: dict[str, Column], how: str = "left") -> DataFrame:
    """``left`` with columns of ``right``, joined on equal keys (null equals null)."""
    own = [f"_k{i}" for i in range(len(keys))]
    other = right.select(*[c.alias(n) for n, c in zip(own, keys.values(), strict=True)], *[c.alias(n) for n, c in take.items()])
    return left.join(other, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, own, strict=True)]), how).drop(*own)


def _beside(own: DataFrame, right: DataFrame, step: int, how: str = "left", **take: str) -> DataFrame:
    """``own`` with columns of the cell that lies ``step`` cells on in the same conversation, null where there is none."""
    return _meet(own, right, {"conv_id": F.col("conv_id"), "cell": F.col("cell") - step}, {k: F.col(v) for k, v in take.items()}, how)


def _min_plus(a: Column, b: Column) -> Column:
    """Product of two matrices of four by four, kept flat."""
    cell = lambda i: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(a, F.lit(4) * F.floor(i / 4).cast("int") + k) + F.get(b, F.lit(4) * k + i % 4)))
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(15)), cell), lambda v: F.least(v, F.lit(ENDLESS)))


def lines_of(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, sign, kind, m, n, forced``: the distinct rows, numbered in the order of conversations and turns.

    kind: 0 blank, 1 truncated, 2 sound; forced: blank, or seen earlier.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    kind = F.when(body == "", 0).when(F.substring(body, -1, 1).isin(".", "!", "?"), 2).otherwise(1)
    lines = stage(rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("sign"), kind.alias("kind")).groupBy("conv_id", "turn", "role", "sign", "kind").agg(F.count("*").alias("m")))
    seen = lines.where("kind > 0").groupBy("conv_id", "role", "sign").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("f")).select("conv_id", "role", "sign", "f.turn")
    marked = _meet(lines, seen, {k: F.col(k) for k in ("conv_id", "turn", "role", "sign")}, {"_f": F.lit(True)}).withColumn("forced", F.col("_f").isNull()).drop("_f")
    order = ["conv_id", "turn", "role", "sign"]
    laid = stage(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    parts = laid.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    parts = parts.select(F.col("_p").alias("_q"), (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))  # one row a partition
    return laid.join(F.broadcast(parts), part == F.col("_q")).withColumn("n", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_q", "_before")


def cells_of(lines: DataFrame) -> DataFrame:
    """One row for each conversation and cell: ``conv_id, cell, n0, codes, copies, first, last`` (whether it begins or ends the conversation)."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("forced"), role + 8).otherwise(2 * role + (F.col("kind") == 1).cast("int"))
    own = lines.select("conv_id", F.shiftright("n", CELL_BITS).alias("cell"), F.struct("n", F.char(code + 97).alias("c"), "m").alias("r"))
    cells = own.groupBy("conv_id", "cell").agg(F.array_sort(F.collect_list("r")).alias("r"))
    cells = cells.select("conv_id", "cell", F.get("r", F.lit(0))["n"].alias("n0"), F.array_join(F.transform("r", lambda x: x["c"]), "").alias("codes"),
                         F.when(F.exists("r", lambda x: x["m"] > 1), F.transform("r", lambda x: x["m"])).alias("copies"))
    cells = stage(cells)
    ends = cells.groupBy("conv_id").agg(F.min("cell").alias("_lo"), F.max("cell").alias("_hi"))
    return stage(_meet(cells, ends, {"conv_id": F.col("conv_id")}, {"_lo": F.col("_lo"), "_hi": F.col("_hi")}, "inner").select(*cells.columns, (F.col("cell") == F.col("_lo")).alias("first"), (F.col("cell") == F.col("_hi")).alias("last"), (F.col("_hi") - F.col("_lo")).alias("span")))


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def settle(cells: DataFrame, passes: int = PASSES) -> DataFrame:
    """``conv_id, cell, e, x``: costs to go at the end of each cell of conversations with several, up to a constant, and the state at its beginning."""
    kind = cells.schema["conv_id"].dataType.simpleString()
    many = cells.where("span > 0")
    key = f"conv_id {kind}, cell bigint"
    codes = many.select("conv_id", "cell", "codes")
    now = many.select("conv_id", "cell", "codes", F.when(F.col("last"), _ints(ACCEPT)).otherwise(_ints([0] * 4)).alias("e"))
    now = stage(now.mapInArrow(_starts, f"{key}, e array<int>, s array<int>"))
    for _ in range(passes):
        beside = stage(_beside(now, now, 1, want="s").withColumn("again", F.col("want").isNotNull() & (F.col("want") != F.col("e"))))
        if not beside.where("again").limit(1).count():
            break
        rerun = _beside(beside.where("again").select("conv_id", "cell", F.col("want").alias("e")), codes, 0, "inner", codes="codes").select("conv_id", "cell", "codes", "e")
        now = stage(beside.where(~F.col("again")).select("conv_id", "cell", "e", "s").unionByName(rerun.mapInArrow(_starts, f"{key}, e array<int>, s array<int>")))
    else:  # vectors that keep changing: products of all matrices up to the end of the conversation
        steps = max(1, int(many.agg(F.max("span")).first()[0] or 0).bit_length())
        own = stage(codes.mapInArrow(_products, f"{key}, p array<bigint>"))
        for i in range(steps):
            own = stage(_beside(own, own, 1 << i, q="p").withColumn("p", F.when(F.col("q").isNull(), F.col("p")).otherwise(_min_plus(F.col("p"), F.col("q")))).drop("q"))
        row = lambda x: F.array_min(F.zip_with(F.slice("p", 4 * x + 1, 4), _ints(ACCEPT), lambda a, b: a + b))
        begun = own.select("conv_id", "cell", F.array(*[row(x) for x in range(4)]).alias("_s")).select("conv_id", "cell", F.transform("_s", lambda v: (v - F.array_min("_s")).cast("int")).alias("s"))
        now = stage(_beside(many.select("conv_id", "cell"), begun, 1, e="s").withColumn("e", F.coalesce("e", _ints(ACCEPT))))
    known = now.select("conv_id", "cell", "e")
    maps = stage(_beside(codes, known, 0, "inner", e="e").mapInArrow(_maps, f"{key}, p array<int>"))
    whole = maps
    for i in range(int(many.agg(F.max("span")).first()[0] or 0).bit_length()):
        whole = stage(_beside(whole, whole, -(1 << i), q="p").withColumn("p", F.when(F.col("q").isNull(), F.col("p")).otherwise(F.transform("q", lambda v: F.get("p", v)))).drop("q"))
    return _beside(known, whole, -1, before="p").select("conv_id", "cell", "e", F.coalesce(F.get("before", F.lit(0)), F.lit(0)).alias("x"))


def decide(lines: DataFrame) -> DataFrame:
    """``conv_id, cell, audit, cost, illegal, picks, ending`` of each cell."""
    cells = cells_of(lines)
    kind = cells.schema["conv_id"].dataType.simpleString()
    last_role = F.ascii(F.substring("codes", -1, 1)) - 97
    last_role = F.when(last_role >= 8, last_role - 8).otherwise(F.floor(last_role / 2).cast("int"))
    alone = cells.where("span = 0").select("conv_id", "cell", "n0", "codes", "copies", "last", _ints(ACCEPT).alias("e"), F.lit(0).alias("x"), F.lit(4).alias("left"))
    many = cells.where("span > 0")
    known = settle(cells)
    linked = _beside(many, many.withColumn("_r", last_role), -1, left="_r")
    linked = _beside(linked, known, 0, "inner", e="e", x="x")
    ready = alone.unionByName(linked.select("conv_id", "cell", "n0", "codes", "copies", "last", "e", "x", F.coalesce("left", F.lit(4)).alias("left")))
    return stage(ready.mapInArrow(_solve, f"conv_id {kind}, cell bigint, audit string, cost bigint, illegal bigint, picks array<bigint>, ending string"))


def _decisions(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Lines that stay, as ``conv_id, tail, turn, role, sign, n, pre, as, edit``: roles to insert before, the new role (null: kept).  Tails only insert."""
    pre, new = [""] * 64, [""] * 64
    for state in range(4):
        for k, move in enumerate(MOVES[1:], 1):
            at, roles = state, []
            for _ in move[:-1]:
                at = FOLLOW[at]
                roles.append(ROLE[at])
            pre[state * 8 + k], new[state * 8 + k] = ",".join(roles), ROLE[FOLLOW[at]] if move[-1] == "R" else ""
    picks = decided.select(F.explode("picks").alias("p")).select(F.shiftright("p", 6).alias("_n"), F.col("p").bitwiseAND(63).cast("int").alias("w"))
    table = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("w"))
    own = lines.join(picks, F.col("n") == F.col("_n")).select("conv_id", F.lit(0).alias("tail"), "turn", "role", "sign", "n", table(pre).alias("pre"), F.nullif(table(new), F.lit("")).alias("as"))
    tails = decided.where("ending <> ''").select(
        "conv_id", F.lit(1).alias("tail"), F.lit(None).cast(lines.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("sign"),
        F.lit(None).cast("bigint").alias("n"), F.when(F.col("ending") == "II", "user,assistant").otherwise("assistant").alias("pre"), F.lit(None).cast("string").alias("as"))
    return own.unionByName(tails)


def _met(rows: DataFrame, decisions: DataFrame, whole: bool) -> DataFrame:
    """Decisions and the texts of their lines, each decision right before its text; ``whole``: a conversation in one partition, else dealt by ranges."""
    order = ["conv_id", "tail", "turn", "role", "sign"]
    texts = rows.select("conv_id", F.lit(0).alias("tail"), "turn", "role", F.unhex(F.md5("text")).alias("sign"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("pre"), F.lit(None).cast("string").alias("as"), "text")
    both = texts.unionByName(decisions.drop("n").withColumn("kind", F.lit(0)).withColumn("text", F.lit(None).cast("string")))
    dealt = both.repartition("conv_id") if whole else both.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order, "kind").select("conv_id", "tail", "turn", "role", "kind", "pre", "as", "text")


def _walk(batches):
    """(conv_id, turn, role, text, edit) of repaired turns, in order."""
    waiting = None
    for batch in batches:
        for conv, tail, turn, role, kind, pre, new, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "tail", "turn", "role", "kind", "pre", "as", "text")), strict=True):
            if kind == 0:
                for name in pre.split(",") if pre else ():
                    yield conv, None, name, "", "insert"
                waiting = (new,) if not tail else None
            elif waiting:
                yield conv, turn, waiting[0] or role, text, "rerole" if waiting[0] else "keep"
                waiting = None


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, ord, turn, role, text, edit`` of the repaired conversations of ``rows`` (``conv_id, turn, role, text``); ``ord`` rises within a conversation."""
    rows = plain(rows)
    lines = lines_of(rows)
    met = _met(rows, _decisions(lines, decide(lines)), False)
    like = {n: met.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}

    def run(batches):
        like, out, names = None, [], ["conv_id", "turn", "role", "text", "edit"]

        def seen():
            nonlocal like
            for batch in batches:
                like = [batch.schema.field(n).type for n in names[:2]] + [pa.string()] * 3
                yield batch

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), like, strict=True)], names)

        for row in _walk(seen()):
            out.append(row)
            if len(out) == 4096:
                yield table()
                out = []
        if out:
            yield table()

    found = met.mapInArrow(run, f"conv_id {like['conv_id']}, turn {like['turn']}, role string, text string, edit string")
    return stage(found.withColumn("ord", F.monotonically_increasing_id())).select("conv_id", "ord", "turn", "role", "text", "edit")


def _digest(batches):
    def told(name, hasher):
        return pa.RecordBatch.from_arrays([pa.array([name], like), pa.array([hasher.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    like, now, name = None, None, None

    def seen():
        nonlocal like
        for batch in batches:
            like = batch.schema.field("conv_id").type
            yield batch

    for conv, _, role, text, _ in _walk(seen()):
        if now is None or conv != name:
            if now is not None:
                yield told(name, now)
            now, name = hashlib.sha256(), conv
        else:
            now.update(b"\n")
        now.update(f"{role}:{text}".encode())
    if now is not None:
        yield told(name, now)


def plain(rows: DataFrame) -> DataFrame:
    """The four columns, null roles and texts as one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation of ``rows``, and of those of
    ``conversations`` (``conv_id``) that have none.  A conversation's hash is taken in one task, which holds no more than a batch of its turns."""
    kind = dict(rows.dtypes)["conv_id"]
    rows = plain(rows)
    lines = lines_of(rows)
    decided = decide(lines)
    hashes = _met(rows, _decisions(lines, decided), True).mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")
    blank, free = F.col("kind") == 0, ~F.col("forced")
    counts = lines.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"), F.sum(F.when(blank, F.col("m")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(F.col("m") - free.cast("long"))).alias("duplicate"), F.sum((free & (F.col("kind") == 1)).cast("long")).alias("truncated"))
    traced = decided.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    parts = [counts, traced, hashes] + ([conversations.select("conv_id").distinct()] if conversations is not None else [])
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256().hexdigest()
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 takes closing marks out, 3 repeats, 4 makes a user of the role."""
    rows = plain(rows)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("_times"))
    return once.withColumn("_k", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_k")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    rows = read(spark, sf_dir, "conversations")
    return repair_report(damage(rows), rows)
