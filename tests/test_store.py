"""Commits, merged tables, published generations and retention."""

import threading

import pytest

from seekwell.sources import commits, logs, merged, store


def test_commit_once(spark, tmp_path):
    path, won, lost = f"{tmp_path}/c", [], []

    def race(k):
        try:
            commits.commit(spark, path, 1, {"by": k})
            won.append(k)
        except commits.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=race, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5
    assert commits.latest(spark, path) == (1, {"by": won[0]})
    assert commits.latest(spark, f"{tmp_path}/none") == (0, {})


def rows(spark, *r):
    return spark.createDataFrame(list(r), "item_id string, v int, x string")


def read(spark, path):
    return sorted(tuple(r) for r in merged.read_table(spark, path).select("item_id", "v", "x").collect())


def test_merged_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    merged.write_batch(rows(spark, ("a", 1, "old"), ("b", 1, "old"), ("c", 1, "old"), (None, 1, "null")), path, version="v", batch=0, buckets=4)
    merged.write_batch(rows(spark, ("a", 2, "p"), ("a", 2, "q"), ("b", 0, "lower")), path, version="v", batch=1)
    want = [("a", 2, "q"), ("b", 1, "old"), ("c", 1, "old")]
    assert [r for r in read_safe(spark, path) if r[0]] == want
    number = merged.write_batch(rows(spark, ("z", 9, "again")), path, version="v", batch=1)  # a batch run again
    assert number == 2 and [r for r in read_safe(spark, path) if r[0]] == want
    before = set(commits.names(spark, f"{path}/data"))
    merged.write_batch(rows(spark, ("c", 5, "new")), path, version="v", batch=2)
    assert len(set(commits.names(spark, f"{path}/data")) - before) == 1  # a batch writes its delta and nothing else
    merged.compact(spark, path)
    merged.write_batch(rows(spark, ("c", 6, "newer")), path, version="v", batch=3)
    bases = commits.latest(spark, f"{path}/manifests")[1]["bases"]
    touched = merged.compact(spark, path)
    after = commits.latest(spark, f"{path}/manifests")[1]
    assert len(touched) == 1 and not after["deltas"] and sum(bases[b] != n for b, n in after["bases"].items()) == 1
    merged.write_batch(rows(spark, ("b", 9, "")), path, version="v", batch=4, gone=True)
    assert [r for r in read_safe(spark, path) if r[0]] == [("a", 2, "q"), ("c", 6, "newer")]
    assert merged.expire(spark, path) > 0
    assert len(commits.names(spark, f"{path}/manifests")) == 1
    assert [r for r in read_safe(spark, path) if r[0]] == [("a", 2, "q"), ("c", 6, "newer")]


def read_safe(spark, path):
    return sorted((tuple(r) for r in merged.read_table(spark, path).select("item_id", "v", "x").collect()), key=str)


def test_readers_see_whole_states(spark, tmp_path):
    """A reader keeps its state while batches and a compaction are committed."""
    path = f"{tmp_path}/t"
    merged.write_batch(rows(spark, ("a", 1, "x")), path, version="v")
    held = merged.read_table(spark, path)
    merged.write_batch(rows(spark, ("a", 2, "y"), ("b", 1, "y")), path, version="v")
    merged.compact(spark, path)
    assert [tuple(r) for r in held.select("item_id", "v", "x").collect()] == [("a", 1, "x")]
    assert read(spark, path) == [("a", 2, "y"), ("b", 1, "y")]


def test_two_writers_both_count(spark, tmp_path, monkeypatch):
    """A batch that is committed between another's reading and its commit is not lost."""
    path = f"{tmp_path}/t"
    merged.write_batch(rows(spark, ("a", 1, "x")), path, version="v", batch="first")
    real, once = merged.commit, []

    def slow(spark_, folder, number, state):
        if not once:
            once.append(1)
            merged.write_batch(rows(spark, ("c", 1, "z")), path, version="v", batch="fast")
        return real(spark_, folder, number, state)

    monkeypatch.setattr(merged, "commit", slow)
    merged.write_batch(rows(spark, ("b", 1, "y")), path, version="v", batch="slow")
    assert read(spark, path) == [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")]


def test_generation_is_published_once(spark, tmp_path, monkeypatch):
    state = spark.createDataFrame([("m",)], "model string")
    vecs = spark.createDataFrame([("a", [1.0, 2.0])], "item_id string, vec array<float>")
    path, real = f"{tmp_path}/g", store.commit
    items = lambda x: spark.createDataFrame([(x,)], "item_id string")

    def slow(spark_, folder, number, what):
        monkeypatch.setattr(store, "commit", real)
        store.publish_generation(state, items("fast"), vecs, path)
        return real(spark_, folder, number, what)

    monkeypatch.setattr(store, "commit", slow)
    with pytest.raises(store.GenerationTaken, match="generation 1 "):
        store.publish_generation(state, items("slow"), vecs, path)
    assert [r["item_id"] for r in store.read_generation(spark, path)[1].collect()] == ["fast"]
    assert len([n for n in commits.names(spark, path) if n.startswith("gen=")]) == 1
    assert store.publish_generation(state, items("next"), vecs, path) == 2
    with pytest.raises(ValueError, match="2 to 3"):
        store.publish_generation(state, items("x"), vecs.unionByName(spark.createDataFrame([("b", [1.0, 2.0, 3.0])], vecs.schema)), path)


def test_upsert_has_one_row_a_key(spark):
    got = store.upsert(rows(spark, ("a", 1, "s"), ("b", 1, "s")), rows(spark, ("a", 1, "p"), ("a", 1, "q"), ("c", 3, "n")))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "q"), ("b", 1, "s"), ("c", 3, "n")]


def test_months_go_with_their_files(spark, tmp_path):
    path = f"{tmp_path}/log"
    spark.createDataFrame([(k, f"2024-0{k}") for k in range(1, 6)], "id int, month string").write.partitionBy("month").json(path)
    assert logs.drop_months(spark, path, 2) == ["2024-01", "2024-02", "2024-03"]
    assert [n for n in commits.names(spark, path) if n.startswith("month=")] == ["month=2024-04", "month=2024-05"]
    assert logs.drop_months(spark, path, 2) == [] and sorted(r["id"] for r in spark.read.json(path).collect()) == [4, 5]
