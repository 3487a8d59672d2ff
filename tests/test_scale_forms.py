"""Forms for large inputs: ranged ranks, near-duplicate groups, landed keys, partition replacement, hashed keys."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calibra.operators import bank as B
from calibra.operators import inference as INF
from calibra.operators import neardup as ND
from calibra.operators import ops as OPS
from calibra.operators.ranges import quantiles
from calibra.sources import sinks
from calibra.streaming import monitors as STM

from tests.conftest import SF01


# ---- I2 over range partitions ----

def test_ranged_spearman_equals_pandas_and_the_window_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000).round(2)  # many ties
    y = x + rng.normal(size=4000)
    key = rng.choice(["a", "b", "c"], 4000, p=[0.8, 0.15, 0.05])
    rows = [(k, float(a), float(b)) for k, a, b in zip(key, x, y)] + [("a", None, 1.0), ("a", 1.0, None), ("d", 1.0, 2.0), (None, 1.0, 1.0), (None, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "model_id string, x double, y double").repartition(6)
    got = {r.model_id: (r.n, r.spearman_rho) for r in INF.spearman_ranged(df, x="x", y="y").collect()}
    for k in "abc":
        own = pd.DataFrame({"x": x[key == k], "y": y[key == k]})
        assert got[k] == (len(own), pytest.approx(own.x.rank().corr(own.y.rank()), rel=1e-9))
    assert got["d"] == (1, None) and got[None] == (2, pytest.approx(1.0))
    window = {r.model_id: (r.n, r.spearman_rho) for r in INF.spearman(df, x="x", y="y").collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in window.items()}
    assert INF.spearman_ranged(df.limit(0), x="x", y="y").count() == 0


def test_midranks_average_ties_across_partitions(spark):
    vals = [(float(v), float(w)) for v, w in zip(range(500), [3, 1, 2, 4, 1] * 100)]
    df = spark.createDataFrame([("k", v, w) for v, w in vals], "k string, v double, w double").repartition(9)
    got = {r.v: r["rank"] for r in INF.midranks(df, ["k"], "v").collect()}
    flat = pd.Series(np.repeat([v for v, _ in vals], [int(w) for _, w in vals])).rank()
    want = dict(zip(np.repeat([v for v, _ in vals], [int(w) for _, w in vals]), flat))
    assert got == want


# ---- D2 as groups ----

def _groups_of_pairs(ids, pairs):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_groups_equal_those_of_all_pairs(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, bases = [], [[word() for _ in range(60)] for _ in range(25)]
    for k in range(500):  # near copies, chains of them, and texts that share half
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 2, 3, 30])):
            w[r.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    rows += [(1000, None), (1001, " . "), (1002, rows[0][1]), (1003, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in ND.near_duplicate_groups(docs).collect()}
    pairs = [(x.doc_a, x.doc_b) for x in ND.near_duplicates(docs).collect()]
    sets = {}
    for d, t in rows:
        s = frozenset(w for w in (t or "").lower().replace(".", " ").split())
        if s:
            sets.setdefault(s, []).append(d)
    copies = [(v[0], x) for v in sets.values() for x in v[1:]]
    ids = [d for v in sets.values() for d in v]
    want = _groups_of_pairs(ids, [*pairs, *copies])
    assert set(got) == set(ids)
    assert {d: x.group_id for d, x in got.items()} == want
    sizes = pd.Series(list(want.values())).value_counts()
    assert all(x.group_size == sizes[x.group_id] for x in got.values())


@pytest.mark.parametrize("few", [64, 2])
def test_recall_against_the_exact_pairs_of_real_documents(spark, few):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    group = {x.doc_id: x.group_id for x in ND.near_duplicate_groups(docs, few=few).collect()}
    pairs = [(x.doc_a, x.doc_b) for x in ND.near_duplicates(docs).collect()]
    found = sum(group[a] == group[b] for a, b in pairs)
    assert pairs and found >= (1.0 if few == 64 else 0.9) * len(pairs)


def test_a_large_cluster_of_distinct_near_copies_gives_linear_output(spark):
    n = 5000
    base = " ".join(f"w{k}" for k in range(80))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " x"), F.col("id").cast("string")).alias("text"))
    got = ND.near_duplicate_groups(docs)
    assert got.agg(F.count("*"), F.countDistinct("group_id"), F.min("group_size")).first() == (n, 1, n)
    sigs = ND.signatures(ND.distinct_sets(docs, "doc_id", "text").select("set_id", F.explode("tokens").alias("token")))
    assert ND.head_links(ND.buckets(sigs).withColumn("root", F.col("set_id")), (1, 2, 3)).count() < 40 * n  # all pairs would be 12.5 million


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{k:04d}", f"{k + 1:04d}") for k in range(200)] + [("a", "b")], "a string, b string")
    got = {r.node: r.root for r in ND.connected(links, "a", "b").collect()}
    assert got == {f"{k:04d}": "0000" for k in range(201)} | {"a": "a", "b": "a"}


# ---- ST1 for good ----

def test_a_row_that_comes_again_after_the_watermark_is_not_written_again(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda day, ids: spark.createDataFrame([(f"q{i}", m, 0, f"2024-{day}", i) for i in ids for m in ("a", "b")],
                                                  "question_id string, model_id string, trial_index int, day string, v int")
    for k, (day, ids) in enumerate([("01-01", range(5)), ("06-01", range(5, 8)), ("12-01", [0, 3, 8, 8])]):
        rows(day, ids).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows("", []).schema).parquet(source)
        assert STM.start_landing(stream, out, f"land{k}", str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 18 and got.select("question_id", "model_id").distinct().count() == 18
    assert got.where("question_id = 'q3'").select("day").distinct().collect()[0].day == "2024-01-01"
    STM.land_new(rows("12-01", [0, 3, 8]), out)  # a batch that runs again
    assert spark.read.parquet(out).count() == 18


def test_landing_reads_only_the_partitions_of_the_batch_and_takes_null_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "question_id string, model_id string, trial_index int, v int"
    STM.land_new(spark.createDataFrame([("q", "a", 0, 1), ("q", "b", 0, 1), (None, "a", None, 1)], schema), out)
    STM.land_new(spark.createDataFrame([(None, "a", None, 2), ("q", "a", 1, 2), ("q", None, 0, 2)], schema), out)
    STM.land_new(spark.createDataFrame([("q", None, 0, 3)], schema), out)
    got = sorted(map(tuple, spark.read.parquet(out).select("question_id", "model_id", "trial_index", "v").collect()), key=str)
    assert got == sorted([("q", "a", 0, 1), ("q", "b", 0, 1), (None, "a", None, 1), ("q", "a", 1, 2), ("q", None, 0, 2)], key=str)


# ---- P17 ----

def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_one_models_rows_are_replaced_and_others_files_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(m, k) for m in ("a", "b", "c/d") for k in range(10)], "model_id string, v int")
    sinks.write_table(df, path, partition_by="model_id")
    before = _files(path)
    new = spark.createDataFrame([("b", 100)], "model_id string, v int")
    for _ in range(2):  # a repeated run gives the same table
        sinks.replace_partitions(new, path)
        got = spark.read.parquet(path)
        assert got.count() == 21 and [r.v for r in got.where("model_id = 'b'").collect()] == [100]
        after = _files(path)
        assert all(after.get(f) == t for f, t in before.items() if "model_id=b" not in f)
    assert sinks.remove_partition(spark, path, "c/d") and not sinks.remove_partition(spark, path, "c/d")
    assert {r.model_id for r in spark.read.parquet(path).select("model_id").distinct().collect()} == {"a", "b"}


# ---- J2 / J7 by hashed key ----

def test_disjoint_pool_moves_no_text_of_unmatched_rows(spark):
    pool = spark.createDataFrame([(i, "s", f"question {i % 40}") for i in range(100)], "doc_id long, subject string, question string")
    old = spark.createDataFrame([("s", f"question {i}") for i in range(0, 40, 7)] + [("t", "question 1")], "subject string, question string")
    got = B.content_disjoint(pool, old)
    assert {r.doc_id for r in got.collect()} == {i for i in range(100) if i % 40 % 7}
    assert got.columns == [*pool.columns, "content_key"] or set(got.columns) == {*pool.columns, "content_key"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    first = plan[:plan.index("LeftSemi")]  # the branch of rows whose hash the bank lacks
    assert "BroadcastHashJoin" in first and "LeftAnti" in first
    assert {(r.content_key, r.n_a, r.n_b) for r in B.overlap_keys(old, pool).collect()} == {
        (k, 1, sum(i % 40 == q for i in range(100))) for q in range(0, 40, 7)
        for k in [B.with_content_key(old.where(F.col("question") == f"question {q}")).where("subject = 's'").first().content_key]}


def test_equal_hashes_of_other_texts_stay_in_the_pool(spark, monkeypatch):
    monkeypatch.setattr(B, "_hashed", lambda df: B.with_content_key(df).withColumn(B.KEY_HASH, F.lit(1).cast("bigint")))
    pool = spark.createDataFrame([(1, "s", "a"), (2, "s", "b")], "doc_id long, subject string, question string")
    old = spark.createDataFrame([("s", "b")], "subject string, question string")
    assert [r.doc_id for r in B.content_disjoint(pool, old).collect()] == [1]
    assert B.overlap_keys(pool, old).count() == 1


# ---- running sums and quantiles over range partitions (W1, D4) ----

def test_running_sums_equal_a_window_for_one_hot_instant(spark):
    rng = np.random.default_rng(6)
    rows = [(("hot" if i % 3 else f"r{i % 4}") if i % 50 else None, "2024-01-01 10:00:00", i, float(rng.integers(0, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, t string, call_id long, cost_usd double") \
        .withColumn("ts", F.col("t").cast("timestamp")).repartition(8)
    got = {r.call_id: r.run_cost_usd for r in OPS.running_spend(df).collect()}
    pdf = pd.DataFrame(rows, columns=["run", "t", "id", "c"]).sort_values("id")
    want = pdf.groupby("run", dropna=False).c.cumsum()
    assert got == {int(i): pytest.approx(w) for i, w in zip(pdf.id, want)}
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be joined
    try:
        spread = sums_by_part(df)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert max(spread.values()) < 0.6 * len(rows)  # the hot run's one instant is not one task's


def sums_by_part(df):
    placed = df.orderBy("run_id", "ts", "call_id").withColumn("p", F.spark_partition_id())
    return {r.p: r["count"] for r in placed.groupBy("p").count().collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 40, n) / 8
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "a double").repartition(5)
    got = quantiles(df, "a", [0.0, 1 / 3, 0.5, 2 / 3, 1.0])
    assert got == [None] * 5 if not n else got == pytest.approx(np.quantile(v, [0.0, 1 / 3, 0.5, 2 / 3, 1.0]).tolist())


def test_candidates_lose_no_pair_and_are_hardly_more(spark):
    r = random.Random(3)
    bases = [[f"w{r.randrange(400)}" for _ in range(50)] for _ in range(12)]
    texts = []
    for _ in range(150):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 2, 8])):
            w[r.randrange(len(w))] = f"w{r.randrange(400)}"
        texts.append(frozenset(w))
    docs = spark.createDataFrame([(None if k % 9 == 0 else k % 40, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    toks = ND.written_sets(docs, "doc_id", "text")
    sets = {x.row: frozenset(x.tokens) for x in toks.join(ND.one_a_set(toks), "row", "left_semi").collect()}
    assert set(sets.values()) == set(texts)
    got = {(x.ra, x.rb) for x in ND.candidates(ND.prefixes(toks, 0.9), 0.9).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    assert want and want <= {(a, b) for a, b in got if a in sets and b in sets}
    assert ND.near_duplicates(docs).count() == len(want)
    near = sum(a in sets and b in sets for a, b in got)
    assert near < len(sets) ** 2 / 20


def _near_pairs(texts, t=0.9):
    sets = sorted({frozenset(x.split()) for x in texts.values() if x}, key=sorted)
    return {(a, b) for a in sets for b in sets if sorted(a) < sorted(b) and len(a & b) >= t * len(a | b)}


def test_sets_that_share_only_their_rarest_token_are_no_candidates(spark):
    texts = [" ".join([f"rare{k // 2}", *(f"w{k}x{i}" if k % 2 else f"v{k}x{i}" for i in range(size))]) for size in (60, 1500) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")  # twice: no token is met once only
    toks = ND.written_sets(docs, "doc_id", "text")
    one = ND.one_a_set(toks).select("row")
    assert ND.candidates(ND.prefixes(toks, 0.9).join(one, "row", "left_semi"), 0.9).count() == 0
    assert ND.near_duplicates(docs).count() == 0


def test_pairs_of_small_and_large_sets_equal_brute_force(spark):
    r = random.Random(11)
    texts, k = {}, 0
    for size in (3, 12, 90, 1015, 1030, 2400):  # about the size from which sets have more parities, too
        for _ in range(2):
            base = [f"b{r.randrange(10 ** 6)}" for _ in range(size)]
            for _ in range(9):
                w = list(base)
                for _ in range(r.choice([0, 1, size // 40, size // 18, size // 9])):
                    w[r.randrange(size)] = f"n{r.randrange(10 ** 6)}"
                texts[k], k = " ".join(w[:size - r.choice([0, 0, size // 30])]), k + 1
    docs = spark.createDataFrame([*texts.items(), (k, None), (k + 1, " - ")], "doc_id long, text string").repartition(4)
    least = {}
    for d, x in texts.items():
        least.setdefault(frozenset(x.split()), d)
    want = {(*sorted((least[a], least[b])), len(a & b), len(a | b)) for a, b in _near_pairs(texts)}
    assert len(want) > 100
    assert {(x.doc_a, x.doc_b, x.inter, x.union_size) for x in ND.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("tile", [ND.TILE, 2000])
def test_a_set_travels_once_a_tile_and_not_once_a_candidate(spark, tile):
    n, size = 300, 80
    base = " ".join(f"w{k}" for k in range(size - 1))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " x"), F.col("id").cast("string")).alias("text"))
    toks = ND.written_sets(docs, "doc_id", "text")
    pairs = ND.candidates(ND.prefixes(toks, 0.9), 0.9)
    placed = ND.tiles(pairs, tile).cache()
    assert placed.select("ra", "rb").distinct().count() == placed.count() == n * (n - 1) // 2
    copies = placed.select("home", "lo", "hi", F.explode(F.array("ra", "rb")).alias("row")).distinct().groupBy("home", "lo", "hi").count().toPandas()["count"]
    tiles = -(-n * size // tile)
    assert copies.sum() <= n * tiles and copies.max() <= max(2 * 2 * tile // size, n if tiles == 1 else 0)
    got = ND.overlaps(placed, toks).toPandas()
    assert len(got) == n * (n - 1) // 2 and set(got.inter) == {size - 1} and set(got.la) == set(got.lb) == {size}


def test_minima_agree_as_often_as_sets_overlap(spark):
    docs = spark.createDataFrame([(0, " ".join(f"a{k}" for k in range(900))), (1, " ".join(f"a{k}" for k in range(100, 1000)))], "doc_id long, text string")
    one, two = (r.sig for r in ND.minima(ND.written_sets(docs, "doc_id", "text")).collect())
    assert len(one) == ND.BANDS * ND.ROWS and 0.6 < sum(a == b for a, b in zip(one, two)) / len(one) < 0.98  # 0.8 in the mean


def test_pairs_of_many_short_near_copies_are_dealt_over_tiles(spark):
    n = 3 * ND.TILE_SETS
    pairs = spark.range(1, n).select(F.lit(0).cast("long").alias("ra"), F.col("id").alias("rb"), F.lit(9).alias("la"), F.lit(9).alias("lb"))
    placed = ND.tiles(pairs.unionByName(pairs.where("rb > 1").withColumn("ra", F.lit(1).cast("long")))).toPandas()
    assert len(placed) == 2 * n - 3 and set(placed.home) == {0}
    assert len(placed.groupby(["lo", "hi"])) > 2 and placed.groupby(["lo", "hi"]).size().max() < len(placed) / 2 + ND.TILE_SETS
