"""Conversation repair, quality and ranked search against brute force, and on odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seekwell.llm import dualtree, quality, turns
from seekwell.llm.bytescan import buffers
from seekwell.llm.common import read

AFTER = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAMES = {2: "user", 3: "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying edits in the order of cost, then letters."""
    fault, heap, done = faults(rows), [(0, "", 0, 0, ())], {}
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = cost, audit, out
        heapq.heappush(heap, (cost + 3, audit + "I", i, AFTER[state], (*out, (NAMES[AFTER[state]], ""))))
        if i < len(rows):
            role, text = rows[i]
            more = 3 * (fault[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault[i] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, AFTER[state], (*out, (NAMES[AFTER[state]], text))))
                if (state, role[:1]) in KEPT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEPT[state, role[:1]], (*out, (role, text))))
    return min(done[len(rows), s] for s in (0, 3) if (len(rows), s) in done)


def expected(numbered):
    """A report of rows (turn, role, text) in their order."""
    rows, numbers = [(r, t) for _, r, t in numbered], [n for n, *_ in numbered if n is not None]
    cost, audit, out = cheapest(rows)
    fault = faults(rows)
    return {"gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, **{k: fault.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}


def talk(n, seed, roles=("system", "user", "assistant", "tool", "")):
    rng = random.Random(seed)
    return [(rng.choice(roles), rng.choice(["Yes.", "No", " ", "", "Why?", f"word {rng.randrange(9)}", f"all {rng.randrange(9)}!\n"])) for _ in range(n)]


@pytest.mark.parametrize("bits,passes", [(12, 6), (2, 6), (2, 0), (0, 1)])
def test_op11_brute_force(spark, monkeypatch, bits, passes):
    """Short conversations and long ones that span many cells, by fix-up passes and by products."""
    monkeypatch.setattr(turns, "CELL_BITS", bits)
    monkeypatch.setattr(turns.settle, "__defaults__", (passes,))
    talks = {c: talk(n, c) for c, n in enumerate([0, 1, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 12, 40, 130])} | {90: [("tool", f"t{i}.") for i in range(37)], 91: [("user", f"u{i}") for i in range(20)]}
    rows = [(c, i, r, t) for c, rows in talks.items() for i, (r, t) in enumerate(rows)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    every = spark.createDataFrame([(c,) for c in talks], "conv_id bigint")
    got = {r["conv_id"]: r.asDict() for r in turns.repair_report(table, every).collect()}
    assert got == {c: {"conv_id": c, **expected([(i, r, t) for i, (r, t) in enumerate(rows)])} for c, rows in talks.items()}


def test_op11_query(spark, sf):
    by = {}
    for r in sorted(read(spark, sf, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        own, fault = by.setdefault(r["conv_id"], []), zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", r["text"]) if fault == 2 else r["text"]
        own += [(r["turn"], "user" if fault == 4 else r["role"], text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in turns.op11_conversation_repair(spark, sf).collect()}
    assert got == {c: {"conv_id": c, **expected(rows)} for c, rows in by.items()}


def test_op11_fix_up_passes():
    """Lanes of any length end in the vectors of one run over the whole; speculation is wrong for some of them."""
    rng = np.random.default_rng(3)
    codes, first = rng.integers(0, 12, 3000), np.array([0, 1, 2, 900, 901, 2000, 3000])
    ends = np.tile(np.array(turns.ACCEPT), (6, 1))
    whole, none = turns.vectors(codes, first, ends, 10**6)
    assert none == 0
    for lane in (1, 3, 4, 64):
        vec, passes = turns.vectors(codes, first, ends, lane)
        assert (vec == whole).all()
        assert passes > 0


def test_op11_passes_on_the_table(spark, sf):
    lines = turns.lines_of(turns.plain(turns.damage(read(spark, sf, "conversations"))))
    used = 0
    for r in turns.cells_of(lines).collect():
        codes = np.frombuffer(r["codes"].encode(), np.uint8).astype(np.int64) - 97
        used += turns.vectors(codes, np.array([0, len(codes)]), np.array([turns.ACCEPT]))[1]
    assert used > 0


def test_op11_repaired_turns(spark):
    talks = {c: talk(n, c + 50) for c, n in enumerate([1, 3, 8, 30])}
    rows = [(c, i, r, t, "x", 0) for c, own in talks.items() for i, (r, t) in enumerate(own)]
    got = {}
    for r in sorted(turns.repaired_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, edit string, n int")).collect(), key=lambda r: r["ord"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {c: list(cheapest(own)[2]) for c, own in talks.items() if cheapest(own)[2]}


def test_op11_odd(spark):
    """Nulls in every column, long texts, ties, repeated rows, clashing names and empty tables."""
    schema = "conv_id bigint, turn bigint, role string, text string, n int, sign string, kind string, audit string, _k0 string, cell string"
    long = "word " * 50_000 + "."
    rows = [(1, None, "user", "a."), (1, None, "user", "a."), (1, 0, "assistant", long), (None, 3, None, None), (None, 3, "user", "b."), (2, 1, "user", "x."), (2, 1, "assistant", "y."), (3, 0, None, "z.")]
    table = spark.createDataFrame([(*r, 1, *"xxxxx") for r in rows], schema)
    got = {r["conv_id"]: r.asDict() for r in turns.repair_report(table).collect()}
    order = lambda rows: sorted(((t, r or " ", x or " ") for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    assert got == {c: {"conv_id": c, **expected(order([r for r in rows if r[0] == c]))} for c in (1, 2, 3, None)}
    assert turns.repair_report(table.limit(0)).count() == 0
    assert turns.repaired_turns(table.limit(0)).count() == 0
    assert {r["conv_id"] for r in turns.repair_report(turns.damage(table), table).collect()} == {1, 2, 3, None}


# ------------------------------------------------------------------ quality

def labelled(spark, n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        own, good = [rng.choice(words) for _ in range(rng.randrange(20, 80))], i % 4 != 0
        if not good:
            own = [w.upper() + "!!" for w in own] if i % 8 else [w for w in own[:8] for _ in range(9)]
        docs.append((i, " ".join(own)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_op12_learns(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert {i for i, r in got.items() if r["held_out"]} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_op12_query(spark, sf):
    """Held-out labels of the given tables are told apart, and two runs give the same scores."""
    got = {r["doc_id"]: r for r in quality.op12_quality(spark, sf).collect()}
    known = [(got[r["doc_id"]]["score"], r["quality"]) for r in read(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    ones, zeros = [s for s, q in known if q], [s for s, q in known if not q]
    assert np.mean([(a > b) for a in ones for b in zeros] or [1]) >= 0.95
    assert len(got) == read(spark, sf, "documents").count()


def test_op12_features_by_hand():
    text = "Aa b Aa Aaé b b"
    found = quality.Features(*buffers(pa.array([text, None, "x"])))
    words = text.encode().split()
    grams = [len(w) + 2 - n + 1 for w in words for n in (3, 4, 5) if len(w) + 2 >= n]
    assert found.size.tolist() == [len(words) + sum(grams) + len(words) - 1, 0, 2]
    ids, share = found.of(0)
    assert math.isclose(share.sum(), 1, rel_tol=1e-6)
    tables = np.random.default_rng(1).standard_normal((3, quality.BUCKETS)).astype(np.float32)
    assert math.isclose(found.sums(tables)[0], float(share @ tables.reshape(-1)[ids]), rel_tol=1e-5)
    again = quality.Features(*buffers(pa.array(["zz zz", "q q"])))
    assert again.pair[0] == again.pair[1] and again.pair[0] in found.pair


def test_op12_gradient():
    """A step moves vectors and layer against the numerical gradient of the loss."""
    rng = np.random.default_rng(2)
    model = quality.Model(1)
    model.layer = rng.standard_normal((2, quality.DIM)).astype(np.float32)
    ids, share = np.array([5, 9, quality.BUCKETS + 3]), np.array([0.5, 0.25, 0.25], np.float32)

    def loss():
        z = model.layer.astype(float) @ (share @ model.vectors[ids].astype(float)) + model.offset
        return float(np.log(np.exp(z).sum()) - z[1])

    base, eps = loss(), 1e-2
    model.vectors[9, 4] += eps
    slope = (loss() - base) / eps
    model.vectors[9, 4] -= eps
    before = model.vectors.copy()
    model.step(ids, share, 1, 0.01)
    moved = np.flatnonzero((model.vectors != before).any(1))
    assert set(moved) <= set(ids.tolist())
    assert math.isclose((model.vectors[9, 4] - before[9, 4]) / -0.01, slope, rel_tol=0.05, abs_tol=1e-3)
    assert loss() < base


def test_op12_odd(spark):
    docs, labels = labelled(spark, 60)
    odd = spark.createDataFrame([(None, "x", "s", 1), (1000, None, "s", 1), (1001, "", "s", 1), (1002, "w " * 60_000, "s", 1), (3, "twice", "s", 1), (3, "twice", "s", 1)], "doc_id bigint, text string, score string, _y int")
    got = quality.score_documents(odd, labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema))).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    both = quality.score_documents(docs.unionByName(odd.select("doc_id", "text")), labels).collect()
    assert len(both) == 66 and len({r["score"] for r in both if r["doc_id"] in (1000, 1001)}) == 1
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


# ------------------------------------------------------------------ ranked search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def ranked(items, docs, k=10):
    counts = [(i, terms(t)) for i, t in docs]
    counts = [(i, w, {x: w.count(x) for x in set(w)}) for i, w in counts if w]
    n, length = len(counts), sum(len(w) for _, w, _ in counts)
    df = {}
    for _, _, tf in counts:
        for x in tf:
            df[x] = df.get(x, 0) + 1
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for x, d in df.items()}
    out = []
    for item, text in items:
        asked = [x for x in terms(text) if x in weight]
        scored = []
        for i, w, tf in counts:
            m = 25 + (75 * len(w) * n) // length
            s = sum(weight[x] * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in asked if x in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,tree", [(1024, 4096), (3, 16)])
def test_op13_brute_force(spark, monkeypatch, block, tree):
    """Several blocks of items, many small trees, copies that tie, and ten places for hundreds of equal documents."""
    monkeypatch.setattr(dualtree, "BLOCK_ITEMS", block)
    monkeypatch.setattr(dualtree, "TREE", tree)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ÉTÉ", "x1y"]
    say = lambda n: " ".join(rng.choice(words[: rng.randrange(3, 63)]) for _ in range(n))
    docs = [(i, say(rng.randrange(1, 60))) for i in range(300)] + [(400 + i, "w1 w2 w1, W59!") for i in range(200)]
    items = [(i, say(rng.randrange(1, 12))) for i in range(9)] + [(20, "w59 w2 w2"), (21, "unheard"), (22, "")]
    got = dualtree.rank_documents(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5))
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(items, docs)


def test_op13_odd(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (5, "alpha " * 30_000), (6, "gamma"), (7, "delta")]
    items = [(1, "alpha Alpha"), (1, "alpha Alpha"), (2, None), (None, "beta"), (3, "gamma delta")]
    table = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id bigint, text string, n string, item int, score string")
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, rank string")
    got = dualtree.rank_documents(asked, table)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(sorted(set(items), key=str), docs)
    assert dualtree.rank_documents(asked, table.limit(0)).count() == dualtree.rank_documents(asked.limit(0), table).count() == 0


def test_op13_prunes():
    """Whole nodes go: of items and documents on different subjects few pairs are scored, and none that counts is lost."""
    rng = np.random.default_rng(5)
    width, docs = 400, []
    for d in range(2048):
        subject = d // 128
        docs.append(np.unique(np.concatenate([rng.integers(subject * 25, subject * 25 + 25, 8), rng.integers(0, width, 2)])))
    values = [rng.integers(1, 1000, len(t)) for t in docs]
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in docs])])
    items = [(np.arange(s * 25, s * 25 + 25, 3), np.arange(1, 10)) for s in range(16)]
    best = dualtree.Best(16, None)
    dualtree.search(dualtree.Items(items, width), dualtree.Documents(np.arange(2048), np.concatenate(docs), np.concatenate(values), cuts, width), best)
    assert best.scored < 0.3 * 16 * 2048
    for i, (t, v) in enumerate(items):
        w = dict(zip(t.tolist(), v.tolist()))
        scores = sorted(((-sum(w.get(int(x), 0) * int(y) for x, y in zip(d, y)), k) for k, (d, y) in enumerate(zip(docs, values))))[:10]
        assert [(-s, k) for s, k in scores] == list(zip(best.scores[i].tolist(), best.docs[i].tolist()))
