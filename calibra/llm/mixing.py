"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are laid end to end in a shuffled order (by the md5
of the id) and cut into blocks of equal tokens.  A schedule of slots decides
which source gives the next block: slot i stands at the point frac(i / phi)
of the unit interval (the golden-ratio sequence), which the sources share in
proportion to their quotas of blocks.  A source's slots are ranked; rank r
takes block r modulo its number of blocks, so a source is repeated only after
all of it was taken.  Slots beyond a source's quota are void, the few that
the sequence is short of follow at the end, and the last one may take part of
its block, so a source's tokens equal its target to within a block's
rounding.

Targets: sources are ordered by code point, null last, and weigh
``weights``, repeating; together they share ``total`` times all tokens; a
target stops at ``repeat`` times its source, and the excess is shared again
by weight until none is above.

Nothing is gathered by source: running sums and ranks go through segments
(a range of hashes, a stretch of slots) whose sums are added up
first, so a source with a third of all rows is spread over many tasks.

Nulls and odd cases: a null text has size 0; documents of size 0 take
nothing; a null source is a source of its own; rows that repeat an id are
separate documents; an empty table, or one without tokens, gives targets and
takes of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import ASCII_SPACE, split_words, written

GOLDEN = 0.6180339887498949  # 1 / phi
BLOCK_TOKENS = 4096
LEAST_BLOCKS = 64  # per source, so that small sources are spread out too
SEGMENT_ROWS = 50_000


def size_of(text: Column) -> Column:
    return F.size(split_words(text, ASCII_SPACE)).cast("bigint")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5,
            repeat: int = 2) -> DataFrame:
    """source, source_size -> sid (0, 1, ... in order), source, source_size, target.

    One row per source goes in and out; the windows here see that table alone.
    Sources are filled in the order of cap / weight: those whose cap lies
    below their share of what is left are capped, which is a prefix of that
    order, and the others share the rest by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))) + 1)
    t = sizes.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double")) \
        .withColumn("cap", F.col("source_size").cast("double") * repeat)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    share = F.sum("source_size").over(everything) * F.lit(float(total))
    left = share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / rest)
    t = t.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(everything)["level"]
    return t.select("sid", "source", "source_size",
                    F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def _running(df: DataFrame, keys: list[str], segment: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key: those of earlier
    segments (summed first) and those before it in its own segment."""
    within = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, segment).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, segment, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    return df.join(sums, [*keys, segment]) \
        .withColumn(out, F.col("_ahead") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_ahead")


def schedule(plan: DataFrame, slots: int) -> DataFrame:
    """sid, rank, slot: every source's slots, in all its quota of them.

    ``plan`` has sid, quota (blocks wanted, as a double) and lo, hi (its part
    of the unit interval).  A point meets its source through cells of the
    interval, an equi-join.
    """
    spark = plan.sparkSession
    cells = max(64, 4 * plan.count())
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    parts = plan.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    i = F.col("id").cast("double")
    points = spark.range(slots).select(F.col("id").alias("slot"), (i * GOLDEN - F.floor(i * GOLDEN)).alias("u")) \
        .withColumn("cell", cell(F.col("u"))).withColumn("stretch", F.floor(F.col("slot") / SEGMENT_ROWS))
    owned = points.join(parts, "cell").where("u >= lo and u < hi").select("sid", "slot", "stretch", F.lit(1).alias("one"))
    ranked = _running(owned, ["sid"], "stretch", ["slot"], "one", "rank")
    need = F.ceil("quota")
    had = owned.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    short = plan.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where(F.col("had") < need)
    tail = short.select("sid", F.explode(F.sequence(F.col("had"), need - 1)).alias("rank")) \
        .select("sid", "rank", F.lit(slots).cast("bigint").alias("slot"))
    return ranked.join(plan.select("sid", "quota"), "sid").where(F.col("rank") < need) \
        .select("sid", F.col("rank").cast("bigint").alias("rank"), "slot").unionAll(tail)


def mix(documents: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, repeat: int = 2,
        block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(placed, segments).

    placed: doc_id, text_key, size, sid, source, source_size, target, start
    (of the document in its source's shuffled order).  segments: slot, rank,
    sid, doc_id, start, from_token, n_tokens: the mix, whose order is (slot,
    sid, rank, start); tokens from_token onwards of that document.
    """
    docs = written(documents.select("doc_id", "source", F.xxhash64("text").alias("text_key"),
                                    size_of(F.col("text")).alias("size")), "sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(sizes.drop("n_docs"), weights=weights, total=total, repeat=repeat)
    blocks = F.least("source_size", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / block_tokens)))
    plan = plan.withColumn("blocks", blocks.cast("bigint")) \
        .withColumn("quota", F.when(F.col("source_size") > 0, F.col("blocks") * F.col("target") / F.col("source_size")).otherwise(0.0))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    share = F.when(F.sum("quota").over(whole) > 0, F.sum("quota").over(upto) / F.sum("quota").over(whole)).otherwise(0.0)
    plan = plan.withColumn("hi", share).withColumn("lo", F.lag("hi", 1, 0.0).over(Window.orderBy("sid")))
    plan = written(plan, "plan")

    n = docs.count()
    classes = max(1, -(-n // SEGMENT_ROWS))
    shuffled = docs.join(plan.select(F.col("source").alias("_source"), "sid", "source_size", "target", "blocks"),
                         F.col("source").eqNullSafe(F.col("_source"))).drop("_source") \
        .withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))) \
        .withColumn("class", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32 * classes))
    placed = written(_running(shuffled, ["sid"], "class", ["h", "doc_id", "text_key", "size"], "size", "start")
                     .drop("h", "class"), "placed")

    slots = int(plan.agg(F.coalesce(F.ceil(F.sum("quota")), F.lit(0))).first()[0])
    order = schedule(plan.where("quota > 0").select("sid", "quota", "lo", "hi"), slots)
    order = order.join(plan.select("sid", "blocks", "source_size", "quota"), "sid") \
        .withColumn("block", F.pmod("rank", "blocks"))
    edge = lambda k: F.floor(k.cast("double") * F.col("source_size") / F.col("blocks"))
    part = F.least(F.lit(1.0), F.col("quota") - F.col("rank"))  # of the last block
    order = order.withColumn("b_from", edge(F.col("block"))) \
        .withColumn("b_to", F.col("b_from") + F.round(part * (edge(F.col("block") + 1) - F.col("b_from"))).cast("bigint")) \
        .select("sid", "block", "slot", "rank", "b_from", "b_to")

    def block_of(token: Column) -> Column:  # the block k with edge(k) <= token < edge(k + 1)
        k = F.floor(token.cast("double") * F.col("blocks") / F.col("source_size"))
        return k + F.when(edge(k + 1) <= token, 1).otherwise(0) - F.when(edge(k) > token, 1).otherwise(0)

    held = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))))
    begin, end = F.greatest("start", "b_from"), F.least(F.col("start") + F.col("size"), F.col("b_to"))
    segments = held.join(order, ["sid", "block"]).where(begin < end) \
        .select("slot", "rank", "sid", "doc_id", "start", (begin - F.col("start")).alias("from_token"),
                (end - begin).alias("n_tokens"))
    return placed, segments


def takes(documents: DataFrame, **how) -> DataFrame:
    """doc_id, text_key, size, source, source_size, target, taken of every row."""
    placed, segments = mix(documents, **how)
    # rows of a size stand alone at their start; those of size 0 take nothing
    taken = segments.groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum("n_tokens").alias("taken"))
    return placed.join(taken, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left") \
        .select("doc_id", "text_key", "size", "source", "source_size", "target",
                F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed(documents: DataFrame, **how) -> DataFrame:
    """The documents of the mix, all columns, each as often as the mix takes it.

    Takes are rounded to whole documents; only the document at the end of a
    source's target can be off, by half of it.  Documents that the mix takes
    nothing of are not in it.  Rows that repeat an id, text and source share
    their takes evenly.
    """
    key = ["doc_id", "text_key", "source"]
    copies = takes(documents, **how).where("size > 0").groupBy(*key) \
        .agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("_copies")).where("_copies > 0") \
        .select(*[F.col(c).alias(f"_{c}") for c in key], "_copies")
    keyed = documents.withColumn("_key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text_key")) \
        & keyed["source"].eqNullSafe(F.col("_source"))
    return keyed.join(copies, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*documents.columns)
