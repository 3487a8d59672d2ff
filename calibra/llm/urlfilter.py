"""URL filter: ratio of two character language models, behind path rules.

Rules decide the URLs they fit; those URLs are also what the models learn
from: one smoothed variable-order Markov model of accepted and one of
rejected URLs (host and path, with a mark at either end).

*Model.*  Counts of all character strings of 1 to ``order`` + 1 characters,
by class.  Interpolated Witten-Bell smoothing: the probability of c after a
context is (count(context c) + d * p(c after the shorter context)) /
(count(context) + d), d being the number of different characters seen after
the context; below the empty context stands a uniform distribution.  Stored
per string as its log probability and, as a context, the log weight d /
(count + d) that its shorter context gets for an unseen character.

*Score.*  Each character takes the longest string the class has seen that
ends there, plus the weights of the longer contexts it was not seen after.  A
URL's score is the difference of the two log-likelihoods per character.

*Calibration.*  Labelled URLs fall into folds by host; each fold is scored by
models that have not learned from it, and the threshold is the score at which
the share of accepted URLs below plus that of rejected URLs above is least.

Repeated strings (URLs mostly differ, their parts do not) are counted once
per task before any shuffle; the models are broadcast only after a count
shows that they are at most ``broadcast_rows`` strings.

Nulls and odd cases: a null URL, or one without ``://``, has an empty host
and path, fits no rule and scores as the empty string; with no accepted or no
rejected URL to learn from, the model allows everything (score 0); rows that
repeat an id are judged each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import small_enough, written

START, END = "\x02", "\x03"
BROADCAST_ROWS = 1_000_000
ALPHABET = 256  # characters of the uniform distribution


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) that fits, else null.

    A rule fits its host and all subdomains of it, where the path begins as
    the rule's does.
    """
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the longest is asked last, so it wins
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _strings(rows: DataFrame, order: int) -> DataFrame:
    """gram, n and pos (its last character) of each string in ``s``."""
    at = rows.withColumn("_len", F.char_length("s")).withColumn("pos", F.explode(F.sequence(F.lit(2), F.col("_len"))))
    grams = at.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(order + 1), "pos"))))
    return grams.withColumn("gram", F.substring("s", F.col("pos") - F.col("n") + 1, F.col("n"))).drop("_len", "s")


def learn(labelled: DataFrame, *, order: int = 4) -> DataFrame:
    """s, cls -> cls, gram, gain (null if unseen), back (log weight as a context; null if it never was one)."""
    counts = _strings(labelled.select("cls", "s"), order).groupBy("cls", "gram").agg(F.count(F.lit(1)).alias("c"))
    counts = written(counts.withColumn("n", F.char_length("gram")).withColumn("context", F.expr("substring(gram, 1, n - 1)")), "counts")
    contexts = written(counts.groupBy("cls", "context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("d")), "contexts")
    full = counts.join(contexts, ["cls", "context"])
    level, levels = None, None
    for n in range(1, order + 2):
        here = full.where(F.col("n") == n).withColumn("shorter", F.expr("substring(gram, 2, n - 1)"))
        if level is None:
            here = here.withColumn("below", F.lit(1 / ALPHABET))
        else:
            here = here.join(level.select(F.col("cls").alias("_cls"), F.col("gram").alias("_gram"), F.col("p").alias("below")),
                             (F.col("cls") == F.col("_cls")) & (F.col("shorter") == F.col("_gram")))
        p = (F.col("c") + F.col("d") * F.col("below")) / (F.col("total") + F.col("d"))
        level = written(here.select("cls", "gram", p.alias("p"), F.log(p / F.col("below")).alias("gain")), f"level{n}")
        levels = level if levels is None else levels.unionAll(level)
    back = contexts.select(F.col("cls").alias("_cls"), F.col("context").alias("_gram"),
                           F.log(F.col("d") / (F.col("total") + F.col("d"))).alias("back"))
    return levels.join(back, (F.col("cls") == F.col("_cls")) & (F.col("gram") == F.col("_gram")), "full") \
        .select(F.coalesce("cls", "_cls").alias("cls"), F.coalesce("gram", "_gram").alias("gram"), "gain", "back")


def score(rows: DataFrame, model: DataFrame, *, order: int = 4, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key, s (both null-free) -> key, score: log-likelihood as accepted minus as rejected, per character."""
    side = lambda cls, v: F.max(F.when(F.col("cls") == cls, F.col(v)))
    both = written(model.groupBy("gram").agg(side(1, "gain").alias("gain1"), side(1, "back").alias("back1"),
                                             side(0, "gain").alias("gain0"), side(0, "back").alias("back0")), "model")
    known, contexts = both.select("gram", "gain1", "gain0"), both.select(F.col("gram").alias("context"), "back1", "back0")
    if small_enough(both, broadcast_rows):
        known, contexts = F.broadcast(known), F.broadcast(contexts)
    grams = _strings(rows.select("key", "s"), order).withColumn("context", F.expr("substring(gram, 1, n - 1)"))
    met = grams.join(known, "gram", "left").join(contexts, "context", "left")
    worth = F.coalesce("gain1", "back1", F.lit(0.0)) - F.coalesce("gain0", "back0", F.lit(0.0))  # an unseen context weighs 1
    return met.groupBy("key").agg((F.sum(worth) / F.sum((F.col("n") == 1).cast("int"))).alias("score"))


def _text(host: Column, path: Column) -> Column:
    return F.concat(F.lit(START), host, path, F.lit(END))


def _threshold(scored: DataFrame, bins: int = 2000) -> float:
    """The score that tells cls 1 from cls 0 with the least sum of the two error rates.

    Scores are counted in ``bins`` equal steps of their range, so the driver
    and the one window see at most that many rows.
    """
    lo, hi, n1, n0 = scored.agg(F.min("score"), F.max("score"), F.sum("cls"), F.sum(1 - F.col("cls"))).first()
    if not n1 or not n0:
        return -math.inf
    step = (hi - lo) / bins or 1.0
    per = scored.groupBy(F.least(F.floor((F.col("score") - lo) / step), F.lit(bins - 1)).alias("bin")) \
        .agg(F.sum("cls").alias("ones"), F.sum(1 - F.col("cls")).alias("zeros"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    errors = per.select("bin", (F.coalesce(F.sum("ones").over(below), F.lit(0)) / n1
                                + (n0 - F.coalesce(F.sum("zeros").over(below), F.lit(0))) / n0).alias("errors"))
    got = errors.collect()  # at most one row a bin
    least = min(r["errors"] for r in got)
    ties = sorted(r["bin"] for r in got if r["errors"] <= least + 1e-12)
    return lo + step * (ties[0] + ties[-1]) / 2


def judge(pages: DataFrame, rules: dict[str, str], *, order: int = 4, folds: int = 2,
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, score, threshold, verdict of every row.

    ``rules`` maps ``host/path`` to allow or block.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = written(pages.select("page_id", host.alias("host"), path.alias("path"))
                   .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
                   .withColumn("key", F.xxhash64("host", "path")), "urls")
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    rows = rows.withColumn("ruled", ruled)
    labelled = rows.where("ruled is not null").select(
        "key", _text(F.col("host"), F.col("path")).alias("s"), (F.col("ruled") == "allow").cast("int").alias("cls"),
        F.pmod(F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).alias("fold"))
    classes = {r.cls for r in labelled.select("cls").distinct().collect()}
    if classes != {0, 1}:
        return rows.select("page_id", "host", "path", "rule", F.lit(0.0).alias("score"), F.lit(float("-inf")).alias("threshold"),
                           F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    # equal URLs are one before they are dealt; exchanges of a stated width: what little they carry becomes many strings
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = None
    for k in range(folds):  # each fold is scored by what the others teach
        out = labelled.where(F.col("fold") == k).select("key", "cls", "s").distinct().repartition(width, "key")
        part = score(out, learn(labelled.where(F.col("fold") != k), order=order), order=order, broadcast_rows=broadcast_rows) \
            .join(out.select("key", "cls"), "key")
        held = part if held is None else held.unionAll(part)
    cut = _threshold(written(held, "held"))
    distinct = rows.select("key", _text(F.col("host"), F.col("path")).alias("s")).distinct().repartition(width, "key")
    scored = written(score(distinct, learn(labelled, order=order), order=order, broadcast_rows=broadcast_rows), "scores")
    return rows.join(scored, "key", "left").select(
        "page_id", "host", "path", "rule", "score", F.lit(cut).alias("threshold"),
        F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"))
