"""Bank building: dimension priorities, sampling invariance, anti-join, ids, coverage."""
from pyspark.sql import functions as F

from calibra.operators import bank as B
from calibra.schemas import subject_dim


def test_subject_dim_priorities(spark):
    d = {r.subject: r for r in subject_dim(spark).collect()}
    assert len(d) == 38
    assert d["econometrics"].domain == "Social_Science" and d["econometrics"].difficulty == "hard"
    assert d["sociology"].difficulty == "easy" and d["formal_logic"].domain == "Humanities"
    assert d["astronomy"].domain_ord == 1 and d["astronomy"].difficulty_ord == 2


def test_classify_drops_unmapped(spark):
    pool = spark.createDataFrame([("anatomy", "q1"), ("sociology", "q2")], "subject string, question string")
    out = B.classify_pool(pool).collect()
    assert [(r.subject, r.domain, r.difficulty) for r in out] == [("sociology", "Social_Science", "easy")]


def _pool(spark, n=300):
    subs = ["sociology", "astronomy", "formal_logic", "econometrics", "prehistory", "college_physics"]
    rows = [(i, subs[i % len(subs)], f"  question {i % 250} \n", ["a", "b", "c", "d"], i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, subject string, question string, choices array<string>, answer int")


def test_stratified_sample_partition_invariant(spark):
    p = B.classify_pool(_pool(spark))
    a = {r.doc_id for r in B.stratified_sample(p, ["domain", "difficulty"], 7, 43, "doc_id").collect()}
    b = {r.doc_id for r in B.stratified_sample(p.repartition(16), ["domain", "difficulty"], 7, 43, "doc_id").collect()}
    c = {r.doc_id for r in B.stratified_sample(p.coalesce(1), ["domain", "difficulty"], 7, 43, "doc_id").collect()}
    assert a == b == c
    per = B.stratified_sample(p, ["domain", "difficulty"], 7, 43, "doc_id").groupBy("domain", "difficulty").count()
    assert all(r["count"] <= 7 for r in per.collect())


def test_content_key_strips_and_anti_join(spark):
    pool = _pool(spark)
    orig = spark.createDataFrame([("sociology", "question 0"), ("astronomy", "question 1 ")],
                                 "subject string, question string")
    kept = B.content_disjoint(pool, orig)
    removed = pool.count() - kept.count()
    # keys: sociology||question 0 matches docs with i%250==0 and subject sociology (i%6==0)
    expect = sum(1 for i in range(300) if (i % 250 == 0 and i % 6 == 0) or (i % 250 == 1 and i % 6 == 1))
    assert removed == expect
    assert B.overlap_keys(kept, orig).count() == 0


def test_supplement_ids_and_union(spark):
    pool = _pool(spark)
    orig = spark.createDataFrame([("q000000", "sociology", "Social_Science", "easy", "x", "a", "b", "c", "d", 0, "A")],
                                 "question_id string, subject string, domain string, difficulty string, "
                                 "question string, choice_A string, choice_B string, choice_C string, "
                                 "choice_D string, answer_index int, answer_letter string")
    supp = B.build_supplement(pool, orig, per_cell=5, seed=43)
    ids = sorted(r.question_id for r in supp.collect())
    assert ids == [f"s{i:04d}" for i in range(len(ids))]
    full = B.full_bank(orig, supp)
    srcs = {r.bank_source for r in full.collect()}
    assert srcs == {"original_180", "supplement_v2"}
    cov = B.bank_coverage(full, ["original_180", "supplement_v2"]).collect()
    assert len(cov) == 18 and sum(r.n for r in cov) == full.count()


def test_flatten_choices_json_text(spark):
    df = spark.createDataFrame([('["w","x","y","z"]', 2), ('["only"]', 0)], "choices string, answer int")
    r = B.flatten_choices(df).collect()
    assert (r[0].choice_C, r[0].answer_letter) == ("y", "C")
    assert r[1].choice_B is None and r[1].answer_letter == "A"


def test_independent_items_keeps_smallest_id(spark):
    df = spark.createDataFrame([("k1", "q3"), ("k1", "q1"), ("k2", "q2")], "content_key string, question_id string")
    got = sorted((r.content_key, r.question_id) for r in B.independent_items(df, "question_id").collect())
    assert got == [("k1", "q1"), ("k2", "q2")]


def test_pick_first_per_tier_prefers_stem(spark):
    bank = spark.createDataFrame(
        [("q1", "Humanities", "easy"), ("q2", "STEM", "hard"), ("q3", "STEM", "easy"), ("q4", "STEM", "medium"),
         ("q0", "STEM", "easy")], "question_id string, domain string, difficulty string")
    got = sorted((r.difficulty, r.question_id) for r in B.pick_first_per_tier(bank).collect())
    assert got == [("easy", "q0"), ("hard", "q2"), ("medium", "q4")]


def test_require_columns_lists_missing(spark):
    import pytest
    df = spark.createDataFrame([("q", "s")], "question string, subject string")
    B.require_columns(df, ["question", "subject"])
    with pytest.raises(ValueError, match=r"missing columns: \['answer', 'choices'\]"):
        B.require_columns(df, ["question", "subject", "choices", "answer"])


def test_subject_dim_from_custom_maps(spark):
    dims = {r.subject: (r.domain, r.difficulty) for r in subject_dim(
        spark, {"D1": ["a", "b"], "D2": ["b", "c"]}, {"easy": ["a", "b"], "hard": ["b"], "medium": ["c"]}).collect()}
    assert dims == {"a": ("D1", "easy"), "b": ("D1", "hard"), "c": ("D2", "medium")}
