"""Toxicity: misspelling-tolerant lexicon hits, scored in their context.

*Lexicon.*  Learned from a sample of labelled texts: words and productive
word beginnings (stems) that toxic texts have far more often than others.
Texts that are copies of each other share one vote.

*Matching.*  The lexicon is a trie.  A word runs through the product of the
trie and the Levenshtein automaton of its terms: a state is the set of (trie
node, edits so far), and its transitions are worked out when first met.  A
term of five letters or more allows one edit, one of nine or more two, a
stem none; the words that made a stem are terms beside it, so that they are
found when the stem's own letters are misspelt.  A word that needs edits does not count if the sample's other
texts have it too, and so is a word of its own.

*Context.*  Each hit is read in a window of words: between quotation marks
that open and close on its line, however far away, or near a word of
reporting, it counts as quoted; near a word of address it
counts more.  A text's abuse and quotation sums go into a logistic
regression fitted on the sample.

The sample has at most ``sample_rows`` rows, those with the smallest hashes
of the id, and bounds the lexicon as well: a term has ``LEAST_SUPPORT`` of the
toxic votes or more, so that there are at most 1 / ``LEAST_SUPPORT`` times as
many as a sampled toxic text has words and beginnings on average; the words
that are not misspellings are words of the sample.  Every text is scored whole.

Nulls and odd cases: a null, empty or hitless text gets the score of no
hits; null ids or labels are not learned from; of an id with several labels
the largest counts; with no toxic, or no other, row in the sample there is no
lexicon and the score is 0; rows that repeat an id are scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from calibra.llm.common import in_arrow, written

SAMPLE_ROWS = 12_000
STEM_LETTERS = range(4, 8)
NEAR = 8  # words on either side of a hit
LEAST_ODDS = 1.5  # log of how much oftener a term is in toxic texts, two standard errors below its estimate
LEAST_SUPPORT = 0.005  # of the toxic votes
FEATURES = ["abuse", "quoted", "abuse_share"]
_CACHE = 500_000

_WORD = re.compile(r"[^\s.,;:!?\"'()\[\]{}|/<>«»„“”‘’…]+")
_MARKS = re.compile(r"[\n\"“”„«»‘]|(?<!\w)’|’(?!\w)")  # an apostrophe inside a word is no mark
_CLOSED_BY = {"”": "“", "»": "«", "“": "„", "’": "‘"}

# fixed values: words that report what another says, and words that address someone
REPORTING = frozenset("""
said says say saying called calls call word words term terms quote quoted quotes wrote writes meaning means
dit disait appelé mot mots terme citation écrit sagte sagt nannte wort wörter begriff zitat schrieb
dijo dice llamó palabra palabras término cita escribió
""".split())
ADDRESS = frozenset("""
you your you're yourself u ur are this these such he she they
tu toi vous ton votre ce cette es êtes du dich dein ihr euer dieser diese bist seid tú usted vosotros eres este esta
""".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Quotations:
    """Where a text's quotations are: from a mark to the one that closes it on the same line."""

    def __init__(self, text: str):
        spans, opened = [], {}
        for m in _MARKS.finditer(text):
            at, mark = m.start(), m.group()
            if mark == "\n":
                opened.clear()
                continue
            other = '"' if mark == '"' else _CLOSED_BY.get(mark)
            closes = opened.pop(other, None)
            if closes is not None:
                spans.append((closes, at))
            elif mark not in "”»’":  # a mark that closes opens nothing
                opened.setdefault(mark, at)
        spans.sort()
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))  # the furthest end so far

    def hold(self, start: int, stop: int) -> bool:
        k = bisect_left(self.starts, start)
        return k > 0 and self.ends[k - 1] >= stop


def _edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """Levenshtein automata of all terms, run over their trie at once."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], not_misspelt: frozenset[str] = frozenset()):
        self.terms, self.stems, self.own = terms, stems, not_misspelt
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, bool] | None] = [None]
        self.most: list[int] = [0]  # edits that any term below the node allows
        for term, stem in [*((t, False) for t in terms), *((t, True) for t in stems)]:
            at, allowed = 0, 0 if stem else _edits(term)
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.most.append(0)
                at = self.next[at][c]
                self.most[at] = max(self.most[at], allowed)
            self.ends[at] = (term, stem)
        self.steps: dict[tuple[frozenset, str], frozenset] = {}
        self.start = self._closure({0: 0})
        self.known: dict[str, tuple[str, int] | None] = {}

    def _closure(self, least: dict[int, int]) -> frozenset:
        """With the states that leaving out letters of a term reaches; the fewest edits a node."""
        todo = list(least.items())
        while todo:
            node, e = todo.pop()
            if least.get(node, 99) < e:
                continue
            for child in self.next[node].values():
                if e + 1 <= self.most[child] and e + 1 < least.get(child, 99):
                    least[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(least.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        least: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and e < least.get(node, 99):
                least[node] = e

        for node, e in state:
            child = self.next[node].get(c)
            if child is not None:
                reach(child, e)
            reach(node, e + 1)  # a letter too many
            for other in self.next[node].values():
                if other != child:
                    reach(other, e + 1)  # another letter
        return self._closure(least)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the term closest to the word, or None."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > _CACHE:
            self.known.clear()
            self.steps.clear()
        state, found = self.start, None
        for c in word:
            after = self.steps.get((state, c))
            if after is None:
                after = self.steps[(state, c)] = self._step(state, c)
            state = after
            if not state:
                break
            if self.stems and found is None:
                for node, e in state:
                    if e == 0 and self.ends[node] and self.ends[node][1]:
                        found = (self.ends[node][0], 0)
        near = [(e, self.ends[n][0]) for n, e in state if self.ends[n] and not self.ends[n][1] and e <= _edits(self.ends[n][0])]
        if near and (found is None or min(near)[0] == 0):
            e, term = min(near)
            found = (term, e) if e == 0 or word not in self.own else None
        self.known[word] = found
        return found

    def weight(self, term: str) -> float:
        return self.terms.get(term, 0.0) or self.stems.get(term, 0.0)

    def hits(self, text: str | None) -> list[dict]:
        """Each hit of a text: term, edits, at (word number), start, stop, quoted, address."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a letter whose lower case is two
            text = low
        words = _WORD.findall(low)
        found = {w: m for w in set(words) if (m := self.match(w))}
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        quotations, out = Quotations(low), []
        for i, w in enumerate(words):
            if w in found:
                a, b = spans[i]
                around = words[max(0, i - NEAR):i] + words[i + 1:i + 1 + NEAR]
                out.append({"term": found[w][0], "edits": found[w][1], "at": i, "start": a, "stop": b,
                            "quoted": quotations.hold(a, b) or any(x in REPORTING for x in around),
                            "address": any(x in ADDRESS for x in around)})
        return out

    def features(self, text: str | None) -> tuple[float, ...]:
        """Logs of the abuse sum, the quotation sum, and abuse per hundred words."""
        abuse = quoted = 0.0
        for h in self.hits(text):
            w = self.weight(h["term"]) * 0.8 ** h["edits"]
            if h["quoted"]:
                quoted += w
            else:
                abuse += w * (1.25 if h["address"] else 1.0)
        share = 100 * abuse / len(words_of(text)) if abuse else 0.0
        return math.log1p(abuse), math.log1p(quoted), math.log1p(share)


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    not_misspelt: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)  # of nothing, then of the features

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.stems, self.not_misspelt)

    def score(self, features: tuple[float, ...]) -> float:
        if not self.terms and not self.stems:
            return 0.0
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _vote_key(words: list[str]) -> int:
    """Equal for copies, and mostly for near copies: the least hash of five words in a row."""
    grams = [" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxhash.xxh64_intdigest(g) for g in grams) >> 1


def _sample(documents: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """y, text, vote (1 / number of sampled copies) of the sampled rows."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id") \
        .agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("y", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_vote_key(words_of(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"].cast(pa.int64()), b["text"], pa.array(keys, pa.int64())], ["y", "text", "key"])

    keyed = written(rows.transform(in_arrow, run, "y long, text string, key long"), "sample")
    votes = keyed.groupBy("key").agg((1 / F.count(F.lit(1))).alias("vote"))
    return written(keyed.join(votes, "key").select("y", "text", "vote"), "voted")


def _counts(sample: DataFrame, grams) -> DataFrame:
    """gram, toxic, other: votes of the texts that have it; ``grams`` maps a text to a set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t, v in zip(b["y"].to_pylist(), b["text"].to_pylist(), b["vote"].to_pylist()):
                own = sums[y > 0]
                for g in grams(t):
                    own[g] += v
            names = list(sums[1].keys() | sums[0].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string())] + [pa.array([float(s[g]) for g in names]) for s in (sums[1], sums[0])], ["gram", "toxic", "other"])

    return sample.transform(in_arrow, run, "gram string, toxic double, other double").groupBy("gram") \
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _word_and_stems(text: str) -> set[str]:
    words = {w for w in words_of(text) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in STEM_LETTERS if len(w) >= n}


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = _sample(documents, labels, label, sample_rows)
    n1, n0 = (float(v or 0) for v in sample.agg(F.sum(F.when(F.col("y") > 0, F.col("vote"))),
                                                F.sum(F.when(F.col("y") <= 0, F.col("vote")))).first())
    if not n1 or not n0:
        return Model()
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    often = _counts(sample, _word_and_stems).withColumn("odds", odds) \
        .where((F.col("toxic") >= LEAST_SUPPORT * n1) & (F.col("odds") - 2 * error >= LEAST_ODDS)) \
        .orderBy(F.desc("toxic"), "gram").collect()
    words = {r.gram: r for r in often if not r.gram.endswith("*")}
    stems: dict[str, float] = {}
    for r in sorted((r for r in often if r.gram.endswith("*")), key=lambda r: (len(r.gram), r.gram)):
        stem = r.gram[:-1]
        # productive: no one word stands behind it
        top = max((w.toxic for g, w in words.items() if g.startswith(stem)), default=0.0)
        if r.toxic >= 1.5 * top and not any(stem.startswith(s) for s in stems):
            stems[stem] = r.odds
    terms = {g: r.odds for g, r in words.items()}  # also those of a stem, which itself allows no edits
    if not terms and not stems:
        return Model()

    loose = Model(terms, stems)
    misspelt = _counts(sample, _Misspelt(loose)).where((F.col("other") / n0) * 3 > F.col("toxic") / n1)
    own = frozenset(r.gram for r in misspelt.select("gram").collect())
    model = Model(terms, stems, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            got = [m.features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"], b["vote"], *(pa.array([g[k] for g in got], pa.float64()) for k in range(len(FEATURES)))],
                                             ["y", "vote", *FEATURES])

    kinds = ", ".join(f"{c} double" for c in ("vote", *FEATURES))
    got = sample.transform(in_arrow, run, f"y long, {kinds}").orderBy(*FEATURES, "y", "vote").toPandas()
    model.weights = _logistic(got[FEATURES].to_numpy(), got["y"].to_numpy() > 0, got["vote"].to_numpy())
    return model


class _Misspelt:
    """The words of a text that match only with edits."""

    def __init__(self, model: Model):
        self.model, self.matcher = model, None

    def __getstate__(self):
        return {"model": self.model, "matcher": None}

    def __call__(self, text: str) -> set[str]:
        self.matcher = self.matcher or self.model.matcher()
        return {w for w in set(words_of(text)) if (m := self.matcher.match(w)) and m[1]}


def _logistic(x: np.ndarray, y: np.ndarray, vote: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Newton's method on the ridge-penalised log-likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.diag([0.01] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (vote * p * (1 - p))[:, None]) + keep, x.T @ (vote * (y - p)) - keep @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the features of every row."""
    rows = documents.select("doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.matcher()
        for b in batches:
            got = [m.features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([shared.value.score(g) for g in got], pa.float64()),
                 *(pa.array([g[k] for g in got], pa.float64()) for k in range(len(FEATURES)))], ["doc_id", "score", *FEATURES])

    return rows.transform(in_arrow, run, StructType([rows.schema["doc_id"]] + [StructField(c, DoubleType()) for c in ("score", *FEATURES)]))
