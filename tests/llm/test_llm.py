"""The training-data operators against brute force on small tables, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekwell.llm import ann, bpe, html, licenses, lm, mixing, ngram_join, queries, spotsigs, suffix_dedup, toxicity
from seekwell.llm.bytescan import buffers
from seekwell.llm.common import crc_mod5, read

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid string, _id string, size string, places string, comp string, score string"


def odd(spark, *texts):
    """Documents with nulls, empty and long texts, repeated rows, and extra columns named like those the operators use."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    rows += [(None, "a null id stands here with some words", None, None, None, *["x"] * 6), rows[1], rows[1]]
    return spark.createDataFrame(rows, SCHEMA)


LONG = " ".join(f"w{i * i % 997} and" for i in range(20_000))
TEXTS = ("", "one two three four five six seven", None, " \n\t ", "é", LONG, "one two three four five six seven", "The the THE.", "\x1c\x85 \xa0")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted((r["doc_id"], r["text"] or "", r["source"]) for r in documents.collect())


def words(text, lower=True):
    raw = text.encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.lower() if lower and raw.isascii() else raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def test_every_number_once():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, sf, name):
    """The queries that have SQL give its rows."""
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    df, found = queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(found.columns) == cols
    at = [list(found.columns).index(c) for c in cols]
    tidy = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted((tidy(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tidy(r[i] for i in at) for r in found.fetchall()), key=str)


# ------------------------------------------------------------------ 1

def jaccard_links(docs, n=5, t=0.8):
    sets = {}
    for k, (_, text) in enumerate(docs):
        w = words(text)
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    links, root = collections.Counter(), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return links, [find(k) for k in range(len(docs))]


def test_op1(spark, sf, rows):
    got = {r["doc_id"]: r for r in ngram_join.op1_ngram_join(spark, sf).collect()}
    links, root = jaccard_links([(i, t) for i, t, _ in rows])
    low = collections.defaultdict(lambda: 1 << 60)
    for (i, _, _), r in zip(rows, root):
        low[r] = min(low[r], i)
    assert [(got[i]["class_id"], got[i]["n_links"]) for i, _, _ in rows] == [(low[root[k]], links[k]) for k, (i, _, _) in enumerate(rows)]


def test_op1_large_groups(spark, monkeypatch):
    """Groups over several blocks give the same links as within one."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        docs.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x for x in ngram_join.near_groups(df).collect()}
    links, root = jaccard_links(docs)
    assert [got[k]["n_links"] for k, _ in docs] == [links[k] for k, _ in docs]
    assert len({got[k]["class_id"] for k, _ in docs}) == len(set(root))


def test_op1_classes_without_counts(spark, monkeypatch):
    """Groups over several blocks fall into the same classes if not all links are counted, outliers and loose chains too."""
    r = random.Random(2)
    base, docs = [f"w{i}" for i in range(120)], []
    for k in range(260):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 6, 7])):
            w[r.randrange(len(w))] = f"x{r.randrange(300)}"
        docs.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {x["doc_id"]: x["class_id"] for x in ngram_join.near_groups(df).collect()}
    assert whole == {x["doc_id"]: x["class_id"] for x in ngram_join.near_groups(df, counts=False).collect()}
    assert 1 < len(set(whole.values())) < 260
    assert sorted(x["doc_id"] for x in ngram_join.keep_one(df).collect()) == sorted(set(whole.values()))


def test_op1_pairs_go_for_themselves():
    """What a look decides on a pair does not depend on the others in its block, and a dropped pair never comes back."""
    r = np.random.default_rng(4)
    a, b = (r.integers(0, 1 << 32, (200, ngram_join.SIGNATURE), dtype=np.uint32) for _ in range(2))
    for k in range(200):
        same = r.random(ngram_join.SIGNATURE) < r.choice([0.3, 0.6, 0.8, 0.95])
        a[k, same] = b[k, same]
    a[0] = b[0]
    a[0, : ngram_join.STEP] += np.uint32(1)  # nothing equal at the first look, all after it
    dense = np.concatenate([b, b[:40]]), np.concatenate([b, b[40:80]])
    for left, right in ((a, b), dense):
        whole = ngram_join.survivors(left, right, 0.8)
        for k in range(0, len(left), 7):
            assert (ngram_join.survivors(left[k : k + 1], right[k : k + 1], 0.8) == whole[k, k]).all()
            assert (ngram_join.survivors(left[k : k + 1], right, 0.8) == whole[k]).all()
    assert not ngram_join.survivors(a, b, 0.8)[0, 0]
    looks = ngram_join.least_matches(0.8)
    assert all(ngram_join.survivors(a, b, 0.8)[k, k] == all((a[k, :n] == b[k, :n]).sum() >= m for n, m in looks) for k in range(200))


def test_op1_odd(spark):
    df = odd(spark, *TEXTS)
    out = ngram_join.near_groups(df)
    assert out.count() == df.count() and out.where("n_links = 3").count() == 4
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and kept.where("text like 'one two%'").count() == 1 and kept.where("doc_id is null").count() == 1
    assert kept.where("trim(coalesce(text,'')) = ''").count() >= 2
    assert ngram_join.near_groups(df.limit(0)).count() == 0
    assert ngram_join.least_matches(0.8)[0][0] == 16 and all(m <= n for n, m in ngram_join.least_matches(0.8))


def test_op1_keeps_one_of_each_class(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near_copy = text(1) + " tail"
    rows = [(1, text(1)), (None, near_copy), (None, text(2)), (None, text(2)), (None, text(3)), (2, text(4)), (2, text(5)), (3, near_copy), (3, text(6)), (4, text(4) + " end"), (None, ""), (5, None)]
    got = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (2, text(4)), (2, text(5)), (3, text(6)), (None, ""), (5, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ 2

def spots(text, chain=3):
    common, found, content, at, prev = set(spotsigs.COMMON), set(), [], [], True
    w = re.findall(r"[^\W_]+", text.lower())
    for x in w:
        if x in common:
            prev = True
        else:
            if prev:
                at.append(len(content))
            content.append(x)
            prev = False
    found = {" ".join(content[i : i + chain]) for i in at}
    return found or ({" ".join(w)} if w else set())


def near(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_op2(spark, sf, rows):
    got = {r["doc_id"]: r for r in spotsigs.op2_spotsigs(spark, sf).collect()}
    for k, (i, t, _) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(spots(t), spots(e))) and r["near_next"] == pytest.approx(near(spots(t), spots(nxt)))


def test_op2_odd_and_pairs(spark, documents, rows):
    df = odd(spark, *TEXTS).select("doc_id", "text")
    got = spotsigs.with_next(df.fillna("", ["text"]), {"s": spotsigs.signatures(F.col("text"))}).orderBy("doc_id").collect()
    assert len(got) == df.count() and got[0]["next_text"] == "" and got[-1]["next_text"].startswith("a null id")
    assert spotsigs.with_next(df.where("doc_id = 4"), {}).first()["next_text"] == "é"
    assert spotsigs.with_next(df.limit(0), {}).count() == 0
    by = collections.defaultdict(list)
    for i, t, _ in rows:
        if spots(t):
            by[frozenset(spots(t))].append(i)
    sets = list(by)
    want = sorted(tuple(sorted((min(by[a]), min(by[b])))) for k, a in enumerate(sets) for b in sets[:k] if near(a, b) >= 0.8)
    assert sorted((r["a"], r["b"]) for r in spotsigs.spotsig_pairs(documents).collect()) == want


def test_op2_hot_ids(spark):
    """Ids that a third of all rows have, null among them, are dealt over buckets by their texts' hashes, and every row has one successor."""
    rows_ = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k}") for k in range(600)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    placed = spotsigs.in_buckets(df, rows_per_bucket=20)
    assert placed.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 100
    by = placed.groupBy("_bucket").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("a"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("b")).orderBy("_bucket").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(by, by[1:]))
    order = [r["text"] for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    got = {r["text"]: r["next_text"] for r in spotsigs.with_next(df, {}).collect()}
    assert got == dict(zip(order, [*order[1:], order[0]]))


# ------------------------------------------------------------------ 3

def test_op3(spark, sf, rows):
    temps, want = licenses.template_bigrams(), []
    for i, t, _ in rows:
        t = re.sub("\r\n?", "\n", t)
        units = [("line", k, u) for k, u in enumerate(t.split("\n"))]
        units += [("paragraph", k, u) for k, u in enumerate(re.split("\n[ \t]*(?:\n[ \t]*)+", t)) if "\n" in u]
        units += [("text", 0, t)] if re.search("\n[ \t]*\n", t) else []
        for kind, k, u in units:
            w = re.findall(r"[^\W_]+", u.lower())
            b = {f"{x} {y}" for x, y in zip(w, w[1:])}
            scores = [(2 * len(b & set(g)) / (len(b) + len(g)), name) for name, g in temps] if b else [(0, "")]
            top = max(s for s, _ in scores)
            if top >= 0.8:
                want.append((i, kind, k, min(n for s, n in scores if s == top), top))
    got = sorted(tuple(r)[:5] for r in licenses.op3_licenses(spark, sf).collect())
    assert got == sorted(want)


def test_op3_templates_and_odd(spark):
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    df = odd(spark, *TEXTS, *texts)
    got = {r["id"]: r["license"] for r in licenses.scan(df).where("dice = 1.0").collect()}
    names = [n for n, ts in licenses.TEMPLATES.items() for _ in ts]
    assert [got[len(TEXTS) + k] for k in range(len(texts))] == names
    assert licenses.scan(df.limit(0)).count() == 0
    changed = odd(spark, "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without a fee is granted, provided that the above copyright notice and this permission notice appear in all copies")
    assert licenses.scan(changed).where("doc_id is not null or true").first()["license"] == "ISC"


def test_op3_windows(spark):
    mit, apache = licenses.TEMPLATES["MIT"][-1], licenses.TEMPLATES["Apache-2.0"][-1]
    three = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    other = " ".join(f"word{i}" for i in range(150))
    assert three.count("\n\n") == 2
    texts = [f"{other}\n\n{three}\n\n{other}", "Unless otherwise noted this page is Released under the MIT License. Contact us by mail.",
             f"{other}\n\n" + apache.replace("LICENSE-2.0 Unless", "LICENSE-2.0\n\nUnless") + f"\n\n{other}", f"{other}\nReleased under the\nMIT License.\n{other}",
             f"{other} Released under the MIT License. {other} Licensed under CC BY 4.0. {other} Released under the MIT License.", "Released under the MIT License.", other]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id", "unit_no").collect():
        got[r["id"]].append((r["unit"], r["unit_no"], r["license"]))
        assert r["dice"] > 0.95
    assert got == {0: [("window", 150, "MIT")], 1: [("window", 6, "MIT")], 2: [("window", 150, "Apache-2.0")], 3: [("window", 150, "MIT")],
                   4: [("window", 150, "MIT"), ("window", 305, "CC-BY-4.0"), ("window", 461, "MIT")], 5: [("line", 0, "MIT")]}


# ------------------------------------------------------------------ 4

def test_op4_learns(spark):
    """Held-out accuracy on made documents: a few marked words among many."""
    r = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        toxic = r.random() < 0.25
        w = ["".join(r.choice(("an", "er", "th", "on", "re")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120))]
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(("Zurk", "blapp", "grudd!")))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(d, lab).where("held_out").collect()
    truth = dict(labels)
    right = sum((r["predicted"] == 1) == (truth[r["doc_id"]] == 1) for r in got)
    assert len(got) > 100 and right / len(got) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_op4_gradients():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((6, 2 * toxicity.DIM))
    at = rng.integers(0, 7, (3, toxicity.WINDOW))
    y, w = np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        p = toxicity.sigmoid(net.forward(x, at).astype(np.float64))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g, dx = net.gradients(x.astype(np.float32), at, y, w)
    for name in ("hf", "xb", "att", "out", "bb"):
        i = tuple(0 for _ in net.p[name].shape)
        old = net.p[name][i]
        net.p[name][i] = old + 1e-2
        up = loss()
        net.p[name][i] = old - 1e-2
        down = loss()
        net.p[name][i] = old
        assert g[name][i] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=2e-4)


def test_op4_odd(spark):
    df = odd(spark, *TEXTS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score_documents(df, none).collect()] == [0.0] * df.count()
    some = spark.createDataFrame([(i, int(i == 5)) for i in range(9)] + [(None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, some).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(df, none)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert toxicity.score_documents(df.limit(0), some).count() == 0


def test_op4_windows_cover_all():
    data, offsets = toxicity.buffers(pa.array([LONG, "", "a b", None], pa.large_string()))
    t = toxicity.Texts(data, offsets)
    seen = np.zeros(len(t.index), bool)
    for s, n in zip(t.start, t.length):
        seen[s : s + n] = True
    assert seen.all() and list(t.per_doc[1:]) == [1, 1, 1]


def test_op4_forward_by_hand():
    """A window's logit by plain loops over its words."""
    texts = toxicity.Texts(*buffers(pa.array(["a bad day for the old town and its river, said nobody", "", " ".join(f"word{i}" for i in range(40)), "x"])))
    net = toxicity.Network(3)
    x, at, n = net.inputs(texts), texts.window(0, len(texts.start)), toxicity.HIDDEN
    got = net.forward(x, at)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(d, words_):
        h, out = np.zeros(n), []
        for v in words_:
            g, gh = v @ net.p[f"x{d}"] + net.p[f"b{d}"], h @ net.p[f"h{d}"]
            z, r = sig(g[:n] + gh[:n]), sig(g[n : 2 * n] + gh[n : 2 * n])
            h = h + z * (np.tanh(g[2 * n :] + r * gh[2 * n :]) - h)
            out.append(h)
        return out

    for row, logit in zip(at, got, strict=True):
        words_ = [x[k].astype(float) for k in row if k < len(x)]
        both = [np.concatenate(p) for p in zip(states("f", words_), states("b", words_[::-1])[::-1], strict=True)]
        e = np.array([np.tanh(s @ net.p["att"]) @ net.p["att_v"] for s in both])
        w = np.exp(e) / np.exp(e).sum() if len(e) else e
        pooled = sum((a * s for a, s in zip(w, both, strict=True)), np.zeros(2 * n))
        assert logit == pytest.approx(float(pooled @ net.p["out"] + net.p["bias"][0]), abs=1e-4)
    per = np.maximum.reduceat(got, texts.doc_first)
    assert net.scores(texts) == pytest.approx(sig(net.a * per + net.b), abs=1e-5)


def test_op4_query(spark, sf, rows):
    """Every document, the held-out fifth by its id, the same in a second run."""
    once, again = ({r["doc_id"]: tuple(r) for r in toxicity.op4_toxicity(spark, sf).collect()} for _ in range(2))
    assert once == again and set(once) == {i for i, _, _ in rows}
    assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.5) for i, held, score, predicted in once.values())


# ------------------------------------------------------------------ 5

def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        over = {s for s in left if budget * w[s] / sum(w[x] for x in left) > most * sizes[s]}
        if not over:
            out |= {s: budget * w[s] / sum(w[x] for x in left) for s in left}
            break
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
        left -= over
    return out


def test_op5(spark, sf, rows):
    got = mixing.op5_mix_sources(spark, sf).collect()
    again = mixing.op5_mix_sources(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    size = {i: len(words(t, False)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    per = collections.Counter()
    taken = collections.Counter()
    for i in size:
        per[source[i]] += size[i]
    want = targets_by_hand(per)
    for r in got:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], per[source[i]]) and r["target"] == pytest.approx(want[source[i]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1.5 for s in want)


def test_op5_odd(spark):
    df = odd(spark, *TEXTS)
    out = mixing.mix(df.withColumn("z", F.lit(1)), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
    assert out.where("copy = 1").count() == df.count()
    kept = mixing.mix_documents(df)
    assert kept.columns == df.columns and kept.where("doc_id = 0").count() == 1
    assert mixing.mix_documents(df.limit(0)).count() == 0
    blank = odd(spark, "", None).where("coalesce(text,'') = ''")
    assert mixing.mix_documents(blank).count() == 4


# ------------------------------------------------------------------ 6

def test_op6(spark, sf):
    e = read(spark, sf, "embeddings").toPandas().sort_values("vec_id")
    x, ids = np.stack(e["embedding"].to_numpy()).astype(float), e["vec_id"].to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.op6_ann(spark, sf).orderBy("query_id", "rank").toPandas()
    hit = 0
    queries_ = np.flatnonzero(ids % 50 == 0)
    for i in queries_:
        s = unit @ unit[i]
        s[i] = -9
        mine = got[got["query_id"] == ids[i]]
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        hit += len(set(mine["vec_id"]) & set(ids[np.argsort(-s)[:5]]))
        for v, score in zip(mine["vec_id"], mine["score"]):
            assert score == pytest.approx(unit[np.searchsorted(ids, v)] @ unit[i], abs=1e-12)
    assert hit / (5 * len(queries_)) >= 0.9


def test_op6_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, []), (10, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    got = ann.search(df, lambda i: i % 50 == 0)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 1.0), (3, 7, 0.0)]
    assert ann.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_op6_copies_over_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(100, 300)] + [(i, rng.standard_normal(4).tolist()) for i in range(300, 400)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0).where("query_id = 200").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [100, 101, 102, 103, 104]


def test_op6_cells_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal(61) + 1e-3 * rng.standard_normal((3500, 61))).astype(np.float32).astype(float)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0, lists=1, probes=1).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 3500, 100):
        far = ((unit - unit[i]) ** 2).sum(1)
        far[i] = 9
        hit += len(set(got[got["query_id"] == i]["vec_id"]) & set(np.argsort(far)[:5]))
    assert hit == 5 * 35  # 61 numbers make one part of 256 codes


# ------------------------------------------------------------------ 7

def test_op7(spark, sf, rows):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r["doc_id"]: r for r in bpe.op7_bpe(spark, sf).collect()}
    for i, t, _ in rows:
        ids = ref.encode(t, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i])[1:] == want


def test_op7_odd(spark):
    from tokenizers import Tokenizer

    ref, t = Tokenizer.from_file(bpe.tokenizer_path()), bpe.transducer(bpe.tokenizer_path())
    texts = [*(x or "" for x in TEXTS), "İΣΑΣ ς 'S I'LL <|endoftext|>x<|startoftext|>", "ab" * 9000, "é́ ½ ² 😀👩‍👧 ﬁ ẞ", "日本語" * 900, "\x00\x1c a​b"]
    for x in texts:
        ids = ref.encode(x, add_special_tokens=False).ids
        for size in (1, 50, bpe.PIECE):
            coded = b"".join(t.encode(x, size))
            assert np.frombuffer(coded, "<u4").tolist() == ids and "".join(t.decode(coded, 7)) == ref.decode(ids, skip_special_tokens=False)
    df = odd(spark, *TEXTS)
    coded = bpe.encode_documents(df, with_ids=True)
    assert coded.count() == df.count() and bpe.decode_documents(coded).where("doc_id = 1").first()["text"] == ref.decode(ref.encode(TEXTS[1], add_special_tokens=False).ids)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_op7_streams_in_bounded_memory():
    """A stream gives the tokens of the whole, for random merge lists and the smallest blocks."""
    r = random.Random(5)
    for _ in range(60):
        merges, known = [], ["a", "b", "c"]
        while len(merges) < 25:
            u, v = r.choice(known), r.choice(known)
            if (u, v) not in merges and len(u + v) < 9:
                merges.append((u, v))
                known.append(u + v) if u + v not in known else None
        t = bpe.Transducer.__new__(bpe.Transducer)
        t.rank = {p: i for i, p in reversed(list(enumerate(merges)))}
        t.suffix, t.lookahead = "", bpe.sufficient_lookahead(merges)
        symbols = [r.choice("abc") for _ in range(300)]
        assert list(t.stream([x] for x in symbols)) == t.merged(symbols)
    assert bpe.transducer(bpe.tokenizer_path()).lookahead < bpe.BLOCK


def test_op7_every_word_goes_through_the_stream(documents, monkeypatch):
    """Tokens come from the transducer for all words; of a long one it never holds more than its lookahead, a block and a token."""
    t, seen, held = bpe.Transducer(bpe.tokenizer_path()), [], []
    stream, merged = bpe.Transducer.stream, bpe.Transducer.merged
    monkeypatch.setattr(bpe.Transducer, "stream", lambda self, blocks: (seen.append(1), stream(self, blocks))[1])
    blocks = bpe.Transducer.symbols
    monkeypatch.setattr(bpe.Transducer, "symbols", lambda self, word: blocks(self, word, 64))
    monkeypatch.setattr(bpe.Transducer, "merged", lambda self, symbols: (held.append(len(symbols)), merged(self, symbols))[1])
    text = documents.where("length(text) > 2000").first()["text"] + " " + "lorem" * 4000
    from tokenizers import Tokenizer

    ids = b"".join(t.encode(text))
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(bpe.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert len(seen) >= len(set(t.split.findall(text.lower()))) / 2 and t.lookahead < max(held) <= t.lookahead + 64 + 32  # an unstable token waits


# ------------------------------------------------------------------ 8

PAGE = """<html><head><title>T</title></head><body><header>Site</header><nav><a>Home</a></nav><div class="cookie-notice">We use<div>cookies</div></div>
<article><header><h1>Head  line</h1></header><p>One &amp; two<br>three <b>four</b><script>x("</p>")</script><aside>side</aside><p>Five<div class="comments"><p>reader</p></div></article><form>f</form><footer>&copy;</footer>"""


def test_op8(spark):
    assert html.main_text(*html.lines_of(PAGE), None) == "Head line\n\nOne & two three four\n\nFive"
    bare = lambda *lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [(1, "http://h.x/en/10", bare("Top menu", "Alpha is first", "Bottom")), (2, "http://h.x/en/11", bare("Top menu", "Beta is second", "More beta", "Bottom")), (3, "http://other.x/en/12", bare("Top menu", "Gamma", "Bottom")),
            (4, None, PAGE), (5, "not a url", None), (6, "http://h.x/en/10", ""), (7, "http://c.x/1", bare("Same", "all", "here")), (8, "http://c.x/2", bare("Same", "all", "here"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host", F.lit("x")).withColumn("text", F.lit("y")).coalesce(1)
    got = {r["page_id"]: r["text"] for r in html.extract(df).coalesce(1).collect()}
    assert got[2] == "Beta is second\n\nMore beta" and got[3] == "Top menu\n\nGamma\n\nBottom" and got[7] == "Same\n\nall\n\nhere"
    assert got[4] == "Head line\n\nOne & two three four\n\nFive" and got[5] == "" and got[6] == ""
    assert html.extract(df.limit(0)).count() == 0 and html.extract(df.union(df)).count() == 16


def test_op8_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in read(spark, sf, "pages").collect()}
    for r in html.op8_html(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|table|tr|td|ul|li|div)\b[^>]*>", inner))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_op8_beside_articles_and_templates(spark):
    page = lambda *parts: "<body>" + "".join(parts) + "</body>"
    div, art = (lambda *x: "".join(f"<div>{t}</div>" for t in x)), (lambda *x: "<article>" + "".join(f"<p>{t}</p>" for t in x) + "</article>")
    menu = [f"Menu {i}" for i in range(9)]
    rows = [(1, "http://a.x/1", page(div("Top", "Lead one"), art("Text one"), div("Bottom"))), (2, "http://a.x/2", page(div("Top", "Lead two"), art("Text two"), div("Bottom"))),
            (3, "http://b.x/1", page(div(*menu, "Own one"))), (4, "http://b.x/2", page(div(*menu, "Own two"))),
            (5, "http://c.x/1", page(div("Top", "Lead"), art("Same"), div("Bottom"))), (6, "http://c.x/2", page(div("Top", "Lead"), art("Same"), div("Bottom")))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Lead one\n\nText one", 2: "Lead two\n\nText two", 3: "Own one", 4: "Own two", 5: "Top\n\nLead\n\nSame\n\nBottom", 6: "Top\n\nLead\n\nSame\n\nBottom"}


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_op8_edges_of_ranges(spark, ranges):
    rows = [(i, f"http://a.x/{i:02d}", f"<div>Top</div><div>Own {i}</div><div>Bottom</div>" if i % 5 else None) for i in range(40)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), ranges).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, f"Own {i}" if i % 5 else "") for i in range(40)]


def test_common_lines():
    r = random.Random(7)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html.common_lines(a, b)) == best[-1][-1]


# ------------------------------------------------------------------ 9

def runs_by_hand(texts, n):
    count = collections.Counter(t[s : s + n] for t in texts for s in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - n + 1):
            if count[t[s : s + n]] > 1:
                gone[s : s + n] = True
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def removed_by_hand(texts, n=400):
    out = []
    for t, runs in zip(texts, runs_by_hand(texts, n), strict=True):
        kept = bytearray(t)
        for a, b in reversed(runs):
            del kept[a:b]
        out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def test_op9(spark, sf, rows):
    texts = [t.encode() for _, t, _ in rows]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op9_suffix_dedup(spark, sf).collect()}
    assert [got[i][:4] for i, _, _ in rows] == removed_by_hand(texts)
    assert [got[i][4] for i, _, _ in rows] == [sum(b - a for a, b in runs if b - a >= 400 or len(t[a:b].split()) >= 50) for t, runs in zip(texts, runs_by_hand(texts, 240), strict=True)]


def test_op9_tree_decides_some(documents):
    """All three ways take part on the given tables, the suffix array among them."""
    ways = {r["way"]: r["anchors"] for r in suffix_dedup.settled_by(documents).collect()}
    assert ways["suffix array"] > 0 and ways["equal surroundings"] > 0 and ways["all"] > ways["suffix array"] + ways["equal surroundings"]


def test_op9_short_passages(spark):
    """A passage of over 50 short words goes from all places, a shorter one stays."""
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 6))) for _ in range(n))
    passage, line = say(54), say(30)
    assert len(passage) < 400
    texts = [say(40) + " " + passage + " " + say(40), say(3) + " " + passage, line + " " + say(60), say(60) + " " + line]
    cut = {x["doc_id"]: x["text"] for x in suffix_dedup.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(passage[20:-20] not in cut[i] and len(cut[i]) >= len(texts[i]) - len(passage) - 12 for i in (0, 1)) and cut[2] == texts[2] and cut[3] == texts[3]


@pytest.mark.parametrize("many", [10**9, 1])
def test_op9_passages(spark, monkeypatch, many):
    """Passages of all lengths about the limit, overlapping, in runs of one letter, and in the same text twice."""
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", many)
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = noise(1500)
    texts = [noise(r.randint(0, 300)) + shared[a : a + n] + noise(r.randint(0, 300)) for a, n in [(0, 399), (0, 400), (0, 401), (100, 450), (300, 900), (600, 520), (1000, 500), (1099, 401), (500, 399)]]
    texts += ["x" * 900, "x" * 400, "é" * 500, noise(50) + shared[200:700] + noise(9) + shared[200:640], "", "short", texts[3], texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("found", F.lit("x"))
    got = {x["doc_id"]: tuple(x)[1:5] for x in suffix_dedup.removal_report(df).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_hand([t.encode() for t in texts])


def test_op9_odd(spark):
    df = odd(spark, *TEXTS)
    out = suffix_dedup.removal_report(df)
    assert out.count() == df.count() and suffix_dedup.removal_report(df.limit(0)).count() == 0
    twice = odd(spark, LONG, "x" + LONG, "short")
    cut = suffix_dedup.drop_repeats(twice)
    assert cut.columns == twice.columns and cut.count() == twice.count()
    assert {r["doc_id"]: r["n_chars"] for r in cut.collect() if r["doc_id"] in (0, 1)} == {0: 0, 1: 0} and cut.where("doc_id = 2").first()["text"] == "short"


def test_maximal_repeats_brute_force():
    r = random.Random(8)
    for _ in range(40):
        left = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))).encode() for _ in range(12)]
        right = ["".join(r.choice("ab") for _ in range(r.randint(1, 6))).encode() for _ in range(12)]
        common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        want = [set() for _ in left]
        for i in range(12):
            for j in range(12):
                if i != j:
                    for rr in range(1, common(right[i], right[j]) + 1):
                        want[i].add((rr, common(left[i], left[j])))
        found = [set() for _ in left]
        for depth, longest, members in suffix_dedup.maximal_repeats(left, right, suffix_dedup.Rule(112, 112, 400)):
            for m, e in zip(members, longest):
                found[m].add((depth, int(e)))
        for i in range(12):  # each pair lies under one that was found, and each found one is real
            assert all(any(a >= c and b >= d for a, b in found[i]) for c, d in want[i])
            assert all(any(c >= a and d >= b for c, d in want[i]) for a, b in found[i])


# ------------------------------------------------------------------ 10

def test_op10(spark, documents, rows):
    got = {r["doc_id"]: r for r in lm.score_documents(documents, crc_mod5() == 1, chunk_tokens=7000, shards=5).collect()}
    toks = {i: [*words(t), None] for i, t, _ in rows}
    uni, bi = collections.Counter(), collections.Counter()
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
    total, distinct = sum(uni.values()), len(uni)
    after, fan = collections.Counter(), collections.Counter()
    for (a, _), c in bi.items():
        after[a] += c
        fan[a] += 1
    p = lambda w: (uni[w] + 0.5) / (total + 0.5 * (distinct + 1))
    smooth = lambda a, w: max(bi[a, w] - 0.75, 0) / after[a] + 0.75 * fan[a] / after[a] * p(w) if after[a] else p(w)
    errors = []
    for i, t in toks.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(uni[w] > 0 for w in t), total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10(p(w)) for w in t))
        want = sum(math.log10(smooth(a, w)) for a, w in zip(["<s>", *t], t))
        assert abs(r["score"] - want) <= (lm.STEP / 2 + 1e-6) * len(t)  # quantised to half a step
        errors.append((r["score"] - want) / len(t))
    assert abs(np.mean(errors)) < lm.STEP / 8


def test_op10_hot_contexts_are_sliced(spark, documents):
    """Scores do not depend on how contexts are dealt, beyond the steps of the codes."""
    one, many = ({r["doc_id"]: r for r in lm.score_documents(documents, crc_mod5() == 1, chunk_tokens=50_000, shards=n).collect()} for n in (1, 60))
    assert all(abs(one[i]["score"] - many[i]["score"]) <= lm.STEP * one[i]["n_tokens"] and one[i]["base_score"] == pytest.approx(many[i]["base_score"]) for i in one)


def test_op10_tells_documents_that_occur_twice(spark, documents):
    """A text that the model has seen twice scores clearly above one that it has seen once, and that above one never seen."""
    base = documents.where("length(text) between 1500 and 6000").select("doc_id", "text").limit(60).collect()
    rows_ = [(r["doc_id"], r["text"], k % 3) for k, r in enumerate(base)]
    rows_ += [(10**6 + i, t, 0) for i, t, k in rows_ if k == 0]
    df = spark.createDataFrame(rows_, "doc_id long, text string, k int")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score_documents(df, F.col("k") == 2).collect()}
    mean = [np.mean([got[i] for i, _, k in rows_ if k == want]) for want in (0, 1, 2)]
    assert mean[0] > mean[1] + 0.15 and mean[1] > mean[2] + 0.15


def test_op10_odd(spark):
    df = odd(spark, *TEXTS)
    got = lm.score_documents(df, crc_mod5() == 1)
    assert got.count() == df.count() and got.where("score > 0 or base_score > 0").count() == 0
    assert lm.score_documents(df.limit(0), crc_mod5() == 1).count() == 0
    held = lm.score_documents(df, F.lit(True)).first()
    assert held["train_tokens"] == 0 and held["n_known"] == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1 << 63), (300, 50), (5000, 1 << 40)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = lm.EliasFano.of(v, top)
        if n:
            assert (e.get(np.arange(n)) == v).all()
            x = rng.integers(0, top, 200, dtype=np.uint64)
            assert (e.successor(x, np.zeros(200, np.int64), np.full(200, n)) == np.searchsorted(v, x, "left")).all()
    p = 10.0 ** -rng.uniform(0, 10, 1000)
    assert (np.abs(np.log10(lm.dequantise(lm.quantise(p)) / p)) <= lm.STEP / 2 + 1e-9).all() and lm.dequantise(lm.quantise(np.zeros(1)))[0] == 0


# ------------------------------------------------------------------ the pipeline

def test_pipeline_odd(spark, sf):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names, and an empty table pass all stages."""
    import corpus_pipeline as cp

    df = odd(spark, *TEXTS)
    for docs in (df, df.limit(0)):
        for _, f in cp.STAGES[:-1]:
            rows_ = f(spark, docs, sf).collect()
            docs = spark.createDataFrame(rows_, docs.schema)
            assert docs.columns == df.columns
        got = cp.STAGES[-1][1](spark, docs, sf).collect()
        assert len(got) == docs.count()
    one, many = spark.createDataFrame([r for r in df.collect() if r["doc_id"] == 1], df.schema), [r for r in TEXTS if r and r.startswith("one")]
    assert cp.near_duplicates(spark, one, sf).count() == 1 and len(many) == 2


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mix", "bpe"]
    docs = read(spark, sf, "documents")
    cols, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, f in cp.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == cols
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.6 * len(ids), name
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.tokenizer_path())
    want = sorted((r["doc_id"], len(ref.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in cp.STAGES[-1][1](spark, docs, sf).collect()) == want
