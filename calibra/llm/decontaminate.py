"""Benchmark decontamination by a prefix-filtered set join.

Every item of a benchmark is cut into windows of ``window`` consecutive words
(an item with fewer words is one window).  A document holds a window when all
the window's shingles (``shingle`` words each, fewer in a shorter window)
stand in the document at the window's distances.  The join runs in the order
of a prefix-filtered set join:

1. *occurrences*: document shingles that any window has.  This is the one
   pass over the corpus; everything after it works on its small result.
2. *rarity*: occurrences are counted over all documents.  Exact containment
   asks for every shingle, so the necessary prefix is a window's one rarest
   shingle, and a window with a shingle that no document has is out.
3. *candidates*: occurrences of prefix shingles, under the length bound (the
   document has as many words) and the positional bound (the window begins
   and ends inside the document).
4. *verification*: all shingles of the window at their own positions, by
   text, not by hash.

The benchmark's shingles are broadcast only after a count shows that they
are at most ``broadcast_rows``; beyond that Spark joins by shuffling.

Nulls and odd cases: a null or wordless text has no words and no hits; a
null item id or an item without words gives no windows; repeated items with
the same id count once; repeated documents each get their row; null document
ids are kept; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import lower_az, small_enough, split_words, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000


def item_words(text: Column) -> Column:
    return split_words(lower_az(text), SEPARATORS)


def _grams(words: str, pos: str, k: int) -> Column:
    """The k words from position ``pos`` (0-based), joined by a blank."""
    return F.concat_ws(" ", *[F.get(F.col(words), F.col(pos) + i) for i in range(k)])


def windows_of(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id (string), win (its text), win_len, k, words of each window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             item_words(F.col("text")).alias("w")) \
        .where("item_id is not null and size(w) > 0")
    length = F.least(F.size("w"), F.lit(window))
    cut = items.select("item_id", "w", length.alias("win_len"),
                       F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    words = F.slice("w", F.col("at") + 1, F.col("win_len"))
    return cut.select("item_id", F.array_join(words, " ").alias("win"), "win_len",
                      F.least("win_len", F.lit(shingle)).alias("k"), words.alias("words")).distinct()


def find_windows(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, shingle: int = 5,
                 broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(spans, items): where windows stand, and which items each window belongs to.

    spans: doc_id, text_key, win, start, win_len (0-based word positions);
    items: win, item_id.  ``text_key`` is a hash of the whole text, so rows
    that share an id but not the text stay apart.
    """
    wins = written(windows_of(benchmark, window, shingle), "windows")
    items = wins.select("win", "item_id").distinct()
    each = wins.select("win", "win_len", "k", "words").distinct()
    shingles = each.select(
        "win", "win_len", "k", "words",
        F.explode(F.sequence(F.lit(0), F.col("win_len") - F.col("k"))).alias("off")) \
        .select("win", "win_len", "k", "off", F.array_join(F.slice("words", F.col("off") + 1, F.col("k")), " ").alias("gram"))
    shingles = written(shingles, "shingles")
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())  # 1..shingle at most

    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), item_words(F.col("text")).alias("w"))
    docs = docs.withColumn("n", F.size("w"))
    at = docs.select("doc_id", "text_key", "n", "w", F.posexplode("w").alias("pos", "_first"))
    parts = [at.where(F.col("pos") <= F.col("n") - k)
             .select("doc_id", "text_key", "n", "pos", _grams("w", "pos", k).alias("gram")) for k in sizes]
    if not parts:  # no windows at all
        parts = [at.where("false").select("doc_id", "text_key", "n", "pos", F.col("_first").alias("gram"))]
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionAll(p)
    wanted = shingles.select("gram").distinct()
    if small_enough(wanted, broadcast_rows):
        wanted = F.broadcast(wanted)
    occurrences = written(grams.join(wanted, "gram", "left_semi").distinct(), "occurrences")

    rarity = occurrences.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = shingles.join(rarity, "gram", "left")
    prefix = ranked.groupBy("win", "win_len").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "off")).alias("rarest"),
        F.count(F.lit(1)).alias("n_grams")).where("rarest.df > 0") \
        .select("win", "win_len", "n_grams", F.col("rarest.gram").alias("gram"), F.col("rarest.off").alias("off"))

    start = F.col("pos") - F.col("off")
    candidates = occurrences.join(prefix, "gram").where((start >= 0) & (start + F.col("win_len") <= F.col("n"))) \
        .select("doc_id", "text_key", start.alias("start"), "win", "win_len", "n_grams")
    needed = candidates.join(shingles.select("win", "off", "gram"), "win") \
        .withColumn("pos", F.col("start") + F.col("off"))
    o = occurrences.select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key"),
                           F.col("pos").alias("o_pos"), F.col("gram").alias("o_gram"))
    there = needed.join(o, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_key") == F.col("o_key"))
                        & (F.col("pos") == F.col("o_pos")) & (F.col("gram") == F.col("o_gram")))
    spans = there.groupBy("doc_id", "text_key", "win", "start", "win_len", "n_grams") \
        .agg(F.count(F.lit(1)).alias("n_there")).where("n_there = n_grams") \
        .select("doc_id", "text_key", "win", "start", "win_len")
    return spans, items


def contamination(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, shingle: int = 5,
                  one_in: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items,
    items (sorted item ids), contaminated (some word is hit, and at least one
    in ``one_in`` of the words)."""
    spans, items = find_windows(documents, benchmark, window=window, shingle=shingle, broadcast_rows=broadcast_rows)
    spans = written(spans, "spans")
    key = ["doc_id", "text_key"]
    ends = spans.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("win_len")).alias("end"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = ends.select(*key, fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    found = spans.select(*key, "win").distinct().join(items, "win").groupBy(*key) \
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = hit.join(found, (hit.doc_id.eqNullSafe(found.doc_id)) & (hit.text_key == found.text_key)) \
        .select(hit.doc_id.alias("h_id"), hit.text_key.alias("h_key"), "n_hit", "items")
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"),
                            F.size(item_words(F.col("text"))).cast("bigint").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    none = F.array().cast("array<string>")
    return docs.join(both, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left") \
        .select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"),
                F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("bigint").alias("n_items"),
                F.coalesce("items", none).alias("items"),
                ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Rows are matched by id and whole text, so an id that several texts share
    loses the contaminated ones alone.
    """
    bad = contamination(documents, benchmark, **how).where("contaminated") \
        .select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(F.col("_bad_id"))
                          & (F.xxhash64(documents["text"]) == F.col("_bad_key")), "left_anti")
