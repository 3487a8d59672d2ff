"""Question-bank operators.

A bank is built from a pool by a lookup join to the subject dimension, an
anti-join against an existing bank on content keys, a seeded stratified
sample and sequential ids.  Sampling is hash-based: the order within a
stratum is ``md5(seed | key)``, so the sample is a pure function of the data
and the seed, independent of partitioning and re-runnable after an executor
loss.  Spark plans ``row_number() <= k`` as a WindowGroupLimit, so each task
keeps at most k rows per stratum before the shuffle, whatever the stratum
size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.functions import parsing
from calibra.operators.ranges import quantiles
from calibra.schemas import (CONSTRAINED_PROMPT, DIFFICULTY_ORDER, DOMAIN_ORDER, FREEFORM_PROMPT,
                             LETTERS, REPAIR_SUFFIX, subject_dim)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Fail with the missing and present columns listed."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}. Got: {df.columns}")


def classify_pool(pool: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Subject -> domain, difficulty; rows with an unmapped subject drop out.

    The subject dimension has a fixed size (tens of rows), so it is broadcast.
    """
    spark = spark or pool.sparkSession
    dim = subject_dim(spark).filter(F.col("domain").isNotNull() & F.col("difficulty").isNotNull())
    return pool.join(F.broadcast(dim), "subject", "inner")


def flatten_choices(df: DataFrame, choices_col: str = "choices", answer_col: str = "answer") -> DataFrame:
    """Choices (array or JSON array text) -> choice_A..D; answer index -> letter."""
    ch = _c(choices_col)
    if dict(df.dtypes).get(choices_col) == "string":
        ch = F.from_json(ch, "array<string>")
    out = df.withColumn("_ch", ch)
    cols = {f"choice_{L}": F.get(F.col("_ch"), i) for i, L in enumerate(LETTERS)}
    cols["answer_index"] = _c(answer_col).cast("int")
    cols["answer_letter"] = parsing.index_to_letter(_c(answer_col).cast("int"))
    return out.withColumns(cols).drop("_ch")


def with_content_key(df: DataFrame, subject_col: str = "subject",
                     question_col: str = "question") -> DataFrame:
    return df.withColumn("content_key", parsing.content_key(subject_col, question_col))


KEY_HASH = "_key_hash"
FEW_KEYS = 1_000_000  # 64-bit hashes that are broadcast at most (8 MB)


def _hashed(df: DataFrame) -> DataFrame:
    keyed = with_content_key(df)
    return keyed.withColumn(KEY_HASH, F.xxhash64("content_key"))


def _met_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hashes of content keys that both tables have: only 64-bit numbers are shuffled.

    The hashes are broadcast if a count shows that they are few, so that the
    rows themselves, texts and all, stay where they are; else Spark decides.
    """
    met = _hashed(a).select(KEY_HASH).distinct().join(_hashed(b).select(KEY_HASH).distinct(), KEY_HASH, "left_semi")
    return F.broadcast(met) if met.limit(FEW_KEYS + 1).count() <= FEW_KEYS else met


def content_disjoint(pool: DataFrame, bank: DataFrame) -> DataFrame:
    """Pool rows whose content key is not in the bank.

    Two phases: hashes of the keys first, over all rows; the keys themselves,
    whole texts, are compared only where a hash is met on both sides.
    """
    met = _met_hashes(pool, bank)
    rows = _hashed(pool)
    apart = rows.join(met, KEY_HASH, "left_anti")
    keys = _hashed(bank).join(met, KEY_HASH, "left_semi").select("content_key").distinct()
    close = rows.join(met, KEY_HASH, "left_semi").join(keys, "content_key", "left_anti")
    return apart.unionByName(close.select(*apart.columns)).drop(KEY_HASH)


def overlap_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Content keys present in both tables, with their multiplicities; texts of hashes met on both sides only."""
    met = _met_hashes(a, b)
    ka, kb = (_hashed(t).join(met, KEY_HASH, "left_semi").groupBy("content_key").agg(F.count(F.lit(1)).alias(n))
              for t, n in ((a, "n_a"), (b, "n_b")))
    return ka.join(kb, "content_key")


def assert_disjoint(a: DataFrame, b: DataFrame) -> None:
    """Raise when two banks share a content key (driver sees one number)."""
    n = overlap_keys(a, b).count()
    if n:
        raise RuntimeError(f"Overlap detected: {n} keys")


def sample_order(seed: int, key) -> Column:
    """Hash order of a seeded sample: md5(seed | key)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string")))


def stratified_sample(df: DataFrame, strata: list[str], k: int, seed: int, key: str) -> DataFrame:
    """K1: min(k, available) rows per stratum in seeded hash order.

    Adds ``sample_rank`` (1..k).  ``row_number() <= k`` becomes a
    WindowGroupLimit, so every task forwards at most k rows per stratum.
    """
    w = Window.partitionBy(*strata).orderBy(sample_order(seed, key), F.col(key))
    return df.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k)


def _ordinal(col: str, values: list[str]) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(F.col(col) == v, F.lit(i + 1)) if expr is None else expr.when(F.col(col) == v, F.lit(i + 1))
    return expr.otherwise(F.lit(len(values) + 1))


def assign_ids(sample: DataFrame, prefix: str, width: int = 4) -> DataFrame:
    """Sequential ids ``prefix%0{width}d`` in (domain, difficulty, rank) order.

    Runs on a sample bounded by k x strata rows, so one ordered window is fine.
    """
    order = [_ordinal("domain", DOMAIN_ORDER), _ordinal("difficulty", DIFFICULTY_ORDER),
             F.col("sample_rank")]
    rn = F.row_number().over(Window.orderBy(*order)) - 1
    return sample.withColumn("question_id", F.format_string(f"{prefix}%0{width}d", rn))


def build_supplement(pool: DataFrame, original: DataFrame, per_cell: int = 40, seed: int = 43,
                     key: str = "doc_id") -> DataFrame:
    """J1 -> J2 -> K1 -> P11 -> W3: a content-disjoint supplement bank."""
    classified = classify_pool(pool)
    disjoint = content_disjoint(classified, original)
    sample = stratified_sample(disjoint, ["domain", "difficulty"], per_cell, seed, key)
    flat = flatten_choices(sample)
    return assign_ids(flat, "s").withColumn("bank_source", F.lit("supplement_v2"))


BANK_COLS = ["question_id", "subject", "domain", "difficulty", "question", "choice_A", "choice_B",
             "choice_C", "choice_D", "answer_index", "answer_letter", "bank_source"]


def full_bank(original: DataFrame, supplement: DataFrame) -> DataFrame:
    """Original + supplement, with defaulted bank_source."""
    o = original.withColumn("bank_source", F.coalesce(
        F.col("bank_source") if "bank_source" in original.columns else F.lit(None).cast("string"),
        F.lit("original_180")))
    return o.select(*BANK_COLS).unionByName(supplement.select(*BANK_COLS))


def sampling_shortfall(pool: DataFrame, per_cell: int, spark: SparkSession | None = None) -> DataFrame:
    """K2: available, target, sampled, short-by per domain x difficulty (with empties)."""
    spark = spark or pool.sparkSession
    avail = pool.groupBy("domain", "difficulty").agg(F.count(F.lit(1)).alias("available"))
    spine = spark.createDataFrame([(d, t) for d in DOMAIN_ORDER for t in DIFFICULTY_ORDER],
                                  "domain string, difficulty string")
    a = F.coalesce(F.col("available"), F.lit(0).cast("bigint"))
    sampled = F.least(a, F.lit(per_cell).cast("bigint"))
    return spine.join(avail, ["domain", "difficulty"], "left").select(
        "domain", "difficulty", a.alias("available"), F.lit(per_cell).cast("bigint").alias("target"),
        sampled.alias("sampled"), (F.lit(per_cell) - sampled).cast("bigint").alias("short_by"),
        F.when(a == 0, F.lit("EMPTY")).when(a < per_cell, F.lit("SHORTFALL")).otherwise(F.lit("OK"))
        .alias("status"))


def diagnostic_sample(bank: DataFrame, per_tier: int = 2, n: int = 6, seed: int = 7,
                      key: str = "question_id") -> DataFrame:
    """K3: up to ``per_tier`` items per difficulty (seeded), then the first n."""
    s = stratified_sample(bank, ["difficulty"], per_tier, seed, key)
    return s.orderBy(_ordinal("difficulty", DIFFICULTY_ORDER), "sample_rank").limit(n)


def spot_check(bank: DataFrame, k: int = 3, seed: int = 7, key: str = "question_id") -> DataFrame:
    """K4: k items in seeded hash order (TakeOrderedAndProject)."""
    return bank.orderBy(sample_order(seed, key), F.col(key)).limit(k)


def limit_questions(bank: DataFrame, n: int) -> DataFrame:
    """K5: the first n items in question-id order (explicit order)."""
    return bank.orderBy("question_id").limit(n)


def pick_first_per_tier(bank: DataFrame, preferred_domain: str = "STEM") -> DataFrame:
    """First item (by question id) of each tier inside one domain.

    The domain is ``preferred_domain`` when present, else the domain of the
    first item; the choice is a one-row aggregate joined back.
    """
    first_dom = bank.agg(
        F.max((F.col("domain") == preferred_domain).cast("int")).alias("has_pref"),
        F.min_by("domain", "question_id").alias("first_domain"))
    chosen = first_dom.select(F.when(F.col("has_pref") == 1, F.lit(preferred_domain))
                              .otherwise(F.col("first_domain")).alias("domain"))
    sub = bank.join(F.broadcast(chosen), "domain")
    firsts = sub.groupBy("difficulty").agg(F.min("question_id").alias("question_id"))
    return sub.join(firsts, ["difficulty", "question_id"])


def duplicate_items(df: DataFrame, id_col: str, key_col: str = "content_key") -> DataFrame:
    """Ids and content keys occurring more than once.

    Reports count and the smallest / largest id of each duplicate group;
    the group's members are never collected (a key may be very hot).
    """
    ids = df.groupBy(F.col(id_col).cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).cast("string").alias("first_id"),
        F.max(id_col).cast("string").alias("last_id")).withColumn("kind", F.lit("id"))
    keys = df.groupBy(F.sha2(F.col(key_col), 256).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).cast("string").alias("first_id"),
        F.max(id_col).cast("string").alias("last_id")).withColumn("kind", F.lit("content_key"))
    cols = ["kind", "key", "n", "first_id", "last_id"]
    return ids.select(*cols).unionByName(keys.select(*cols)).filter(F.col("n") > 1)


def independent_items(df: DataFrame, id_col: str, key_col: str = "content_key") -> DataFrame:
    """D3: one row per content key, the one with the smallest id.

    ``min_by`` over a struct is a partial aggregate: each task reduces its
    rows of a key to one before the shuffle, so a hot key costs nothing extra.
    """
    cols = [c for c in df.columns if c != key_col]
    best = df.groupBy(key_col).agg(F.min_by(F.struct(*cols), F.col(id_col)).alias("_r"))
    return best.select(key_col, "_r.*")


def bank_coverage(bank: DataFrame, sources: list[str], spark: SparkSession | None = None) -> DataFrame:
    """Domain x difficulty x source counts with explicit zeros."""
    spark = spark or bank.sparkSession
    spine = spark.createDataFrame(
        [(d, t, s) for d in DOMAIN_ORDER for t in DIFFICULTY_ORDER for s in sources],
        "domain string, difficulty string, bank_source string")
    counts = bank.groupBy("domain", "difficulty", "bank_source").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, ["domain", "difficulty", "bank_source"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint")))


def bank_grid(bank: DataFrame) -> DataFrame:
    """Counts domain x difficulty as a grid, zeros filled."""
    g = bank.groupBy("domain").pivot("difficulty", DIFFICULTY_ORDER).agg(F.count(F.lit(1)))
    return g.fillna(0, subset=DIFFICULTY_ORDER)


def _template(template: str, question: Column, choices_block: Column) -> Column:
    before, rest = template.split("{question}")
    middle, after = rest.split("{choices}")
    return F.concat(F.lit(before), question, F.lit(middle), choices_block, F.lit(after))


def prompt_table(bank: DataFrame) -> DataFrame:
    """P10: constrained, free-form and repair prompts for every 4-choice item."""
    block = F.concat_ws("\n", *[F.concat(F.lit(f"{L}. "), F.col(f"choice_{L}")) for L in LETTERS])
    four = F.col("choice_A").isNotNull() & F.col("choice_B").isNotNull() & \
        F.col("choice_C").isNotNull() & F.col("choice_D").isNotNull()
    constrained = _template(CONSTRAINED_PROMPT, F.col("question"), block)
    return bank.filter(four).select(
        "question_id", constrained.alias("prompt_constrained"),
        _template(FREEFORM_PROMPT, F.col("question"), block).alias("prompt_freeform"),
        F.concat(constrained, F.lit(REPAIR_SUFFIX)).alias("prompt_repair"))


def empirical_difficulty(feat: DataFrame, item_col: str = "question_id") -> DataFrame:
    """Per-item accuracy and its tercile (low accuracy = hard).

    Cut points are exact quantiles of the per-item table, found by running
    sums over range partitions: no buffer holds all distinct accuracies.
    """
    items = feat.groupBy(item_col).agg(F.count(F.lit(1)).alias("n"),
                                       F.avg("correct").alias("accuracy"))
    q1, q2 = (F.lit(q).cast("double") for q in quantiles(items, "accuracy", [1.0 / 3.0, 2.0 / 3.0]))
    tier = (F.when(F.col("accuracy") <= q1, F.lit("hard"))
            .when(F.col("accuracy") <= q2, F.lit("medium")).otherwise(F.lit("easy")))
    return items.select(item_col, "n", "accuracy", tier.alias("empirical_difficulty"))
