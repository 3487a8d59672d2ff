"""Quality rules: a learned decision list over text statistics.

*Statistics* of a whole text, one numeric column each (``STATISTICS``).

*Decision list.*  Sequential covering over a labelled sample: a rule is grown
on two thirds of the rows not yet covered, threshold by threshold, by
information gain (candidate thresholds are quantiles of each statistic),
pruned on the last third from its end while (right - wrong) / covered does
not fall, and kept while it is right for most of what it covers; the rows it
covers go, and the next rule is grown.  Rules name the rarer label; what no
rule covers has the other one.

*Use.*  The list is an ordered Spark conditional expression (``verdict``):
the first rule that holds decides.  ``describe`` prints it.

At most ``sample_rows`` labelled rows are learned from, those with the
smallest hashes of the id; everything else covers all rows.

Nulls and odd cases: a null or wordless text has zeros everywhere; a null
label is not learned from; of an id with several labels the largest counts,
of rows that repeat an id one is learned from; with one label, or none, the
list is empty and gives that label (1 if there is none); an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from calibra.llm.common import in_arrow

SAMPLE_ROWS = 20_000
THRESHOLDS = 48  # candidate quantiles a statistic
LEAST_COVER = 3  # rows of its label that a rule covers
WINDOW = 5  # words
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "letter_share", "digit_share",
          "upper_share", "distinct_share", "short_line_share", "stop_per_word", "longest_word"]
STATISTICS = COUNTS + SHARES
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    key = np.zeros(n, np.uint64)
    if len(number) ** window < 2**63:
        for k in range(window):
            key = key * np.uint64(len(number)) + ids[k:k + n]
    else:  # pairs are numbered again, so that equal keys are equal windows
        key = ids[:n]
        for k in range(1, window):
            key = np.unique(key * np.uint64(len(number)) + ids[k:k + n], return_inverse=True)[1].astype(np.uint64)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.nonzero(count[inverse] > 1)[0]
    hit = np.zeros(len(words) + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + window, -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    rep = repeated(words)
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    digits = sum(map(len, re.findall(r"\d+", text)))
    upper = sum(map(len, re.findall(r"[A-Z]+", text)))
    per = lambda a, b: a / b if b else 0.0
    stops = text.count(".") + text.count("!") + text.count("?")
    return [n, chars, symbols, dup, rep, per(chars, n), per(symbols, n), per(dup, len(lines)), per(rep, n),
            per(letters, chars), per(digits, chars), per(upper, chars), per(len(set(words)), n),
            per(sum(len(x) < 30 for x in lines), len(lines)), per(stops, n), max(map(len, words), default=0)]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row (counts as longs, shares as doubles)."""
    rows = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([statistics(t) for t in b["text"].to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            columns = [pa.array(got[:, k].astype(np.int64) if name in COUNTS else got[:, k]) for k, name in enumerate(STATISTICS)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], ["doc_id", *STATISTICS])

    schema = StructType([rows.schema["doc_id"]] + [StructField(c, LongType() if c in COUNTS else DoubleType()) for c in STATISTICS])
    return rows.transform(in_arrow, run, schema)


# ---- the list -----------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value >= cut, else value < cut
    cut: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v >= self.cut if self.above else v < self.cut

    def column(self) -> Column:
        return F.col(self.name) >= self.cut if self.above else F.col(self.name) < self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[Condition, ...], ...]
    label: int  # of the rules
    default: int

    def verdict(self) -> Column:
        out = F.when(F.lit(False), F.lit(self.default))
        for rule in self.rules:  # one list of branches, tried in order
            out = out.when(reduce(and_, [c.column() for c in rule]), F.lit(self.label))
        return out.otherwise(F.lit(self.default))

    def describe(self) -> str:
        return "\n".join([f"if {' and '.join(map(str, r))}: {self.label}" for r in self.rules] + [f"else: {self.default}"])


def _holds(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray]) -> list[Condition]:
    rule: list[Condition] = []
    here = np.ones(len(x), bool)
    while y[here].any() and not y[here].all():
        p, n = int(y[here].sum()), int((~y[here]).sum())
        before = math.log2(p / (p + n))
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            v, yes = x[here, k], y[here]
            order = np.argsort(v, kind="stable")
            v, yes = v[order], yes[order]
            pos = np.concatenate([[0], np.cumsum(yes)])
            at = np.searchsorted(v, cuts[k], "left")  # rows below each cut
            for above in (False, True):
                pp = pos[-1] - pos[at] if above else pos[at]
                cover = len(v) - at if above else at
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / cover) - before), -1.0)
                if len(g) and g.max() > gain:
                    gain, best = float(g.max()), Condition(name, above, float(cuts[k][g.argmax()]))
        if best is None:
            break
        rule.append(best)
        here &= best.holds(x, names)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        h = _holds(r, x, names)
        right, wrong = int((h & y).sum()), int((h & ~y).sum())
        return (right - wrong) / (right + wrong) if right + wrong else -1.0

    best, value = rule, worth(rule)
    for n in range(len(rule) - 1, 0, -1):
        if (w := worth(rule[:n])) >= value:
            best, value = rule[:n], w
    return best


def learn(x: np.ndarray, y: np.ndarray, names: list[str], *, seed: int = 0) -> DecisionList:
    """The list for rows ``x`` (a column a statistic) with labels ``y`` (0 or 1)."""
    y = np.asarray(y, int)
    if len(set(y.tolist())) < 2:
        only = int(y[0]) if len(y) else 1
        return DecisionList((), 1 - only, only)
    label = int(2 * y.sum() <= len(y))
    want = y == label
    cuts = []
    for k in range(x.shape[1]):  # halfway between neighbouring values
        v = np.unique(np.concatenate([np.quantile(x[:, k], np.linspace(0, 1, THRESHOLDS)),
                                      np.quantile(x[want, k], np.linspace(0, 1, THRESHOLDS))]))
        cuts.append((v[1:] + v[:-1]) / 2)
    left = np.ones(len(x), bool)
    rng = np.random.default_rng(seed)
    rules: list[tuple[Condition, ...]] = []
    while want[left].any():  # each rule takes LEAST_COVER rows or more
        own = rng.permutation(np.nonzero(left)[0])
        grow, prune = own[:len(own) * 2 // 3], own[len(own) * 2 // 3:]
        rule = _grow(x[grow], want[grow], names, cuts)
        if not rule:
            break
        rule = _prune(rule, x[prune], want[prune], names)
        h = _holds(rule, x, names)
        checked = h[prune]
        covered = h & left
        # kept if right for most of what it covers, also on the rows it was not grown on, which must have some;
        # the first rule that is not ends the covering
        if 2 * (covered & want).sum() <= covered.sum() or 2 * (checked & want[prune]).sum() <= checked.sum() or (covered & want).sum() < LEAST_COVER:
            break
        rules.append(tuple(rule))
        left &= ~h
    return DecisionList(tuple(rules), label, 1 - label)


def fit(stats: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from the statistics of at most ``sample_rows`` labelled rows."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()) \
        .groupBy("doc_id").agg(F.max(label).alias("_y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    joined = stats.select("doc_id", *STATISTICS).join(F.broadcast(ids), "doc_id") \
        .groupBy("doc_id").agg(F.max("_y").alias("_y"), F.max(F.struct(*STATISTICS)).alias("_row")).select("doc_id", "_y", "_row.*")
    got = joined.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return learn(got[STATISTICS].to_numpy(np.float64), got["_y"].to_numpy() > 0, STATISTICS)
