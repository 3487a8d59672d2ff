"""Language ID by string kernels and kernel ridge regression.

*Kernel.*  Two texts are compared by the character strings of 1 to ``orders``
letters that both have (presence, not counts; lower case, runs of other
characters are one boundary mark), over the root of the product of their
numbers of strings.  Strings are hashed into ``BUCKETS`` places.

*Fit.*  A sample of at most ``per_language`` rows a language, by hash of the
id, of the rows handed to ``fit``; the first ``landmarks`` a language are the
Nystroem landmarks.  With K the landmarks' own kernel matrix, a row's
features are its kernel values with the landmarks times K^(-1/2); one ridge
regression a language, against the rest, is solved on them.  Rows come to the
driver as bit fields of fixed size, so the fit's memory does not depend on
the texts' lengths or the corpus.

*Score.*  A text's kernel values with the landmarks are a product of its
presence vector with theirs, so landmarks, K^(-1/2) and the regression
multiply to one matrix of places by languages; a batch of texts is scored by
a batched product of its (sparse) presence vectors with that matrix.

Nulls and odd cases: a null text, or one without a letter, is ``und`` with
score 0; rows with a null id or language are never learned from (a null id is
not held out either); ties go to the language that sorts first; with no row
to learn from everything is ``und``; of rows that repeat an id at most one
is learned from, and each is predicted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from calibra.llm.common import in_arrow

UNKNOWN = "und"
ORDERS = 3
BUCKETS = 1 << 16
PER_LANGUAGE = 400
LANDMARKS = 60
RIDGE = 1e-2
_SLICE = 1 << 20
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """code point -> itself if a letter, else 0, for the first plane."""
    if not _TABLE:
        _TABLE.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], np.uint32))
    return _TABLE[0]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def places(text: str | None, orders: int = ORDERS) -> np.ndarray:
    """The places of the letter strings of a text, each once, in order."""
    there = np.zeros(BUCKETS, bool)
    low = (text or "").lower() + " "  # the boundary at the end
    carry = np.zeros(1, np.uint32)  # and the one at the start
    for at in range(0, len(low), _SLICE):
        c = np.frombuffer(low[at:at + _SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate([carry, np.where(c < 0x10000, _letters()[np.minimum(c, 0xFFFF)], c)])
        c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]  # a run of others is one 0
        h = np.zeros(len(c), np.uint32)
        for n in range(min(orders, len(c))):
            h = (h[:-1] if n else h) * _MIX[0] + (c[n:] + np.uint32(n + 1)) * _MIX[1]
            there[((h ^ (h >> np.uint32(15))) * _MIX[2]) >> np.uint32(16)] = True
        carry = c[1 - orders:] if orders > 1 else c[-1:]
    return np.nonzero(there)[0]


def _sample(rows: DataFrame, per_language: int) -> DataFrame:
    """doc_id, lang of at most ``per_language`` rows a language, those with the smallest hashes.

    Each language is first thinned, by the hash, to about twice that many
    rows, so that the ranking sees few rows however many there are.
    """
    ids = rows.where("doc_id is not null and lang is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # a row a language, like the model's columns: sent to the rows, so that these are thinned where they lie
    share = F.broadcast(ids.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count(F.lit(1))).alias("_share")))
    u = F.shiftrightunsigned("_h", 11) / 2.0**53
    w = Window.partitionBy("lang").orderBy("_h", "doc_id")
    return ids.join(share, "lang").where(u < F.col("_share")).withColumn("_r", F.row_number().over(w)) \
        .where(F.col("_r") <= per_language).select("doc_id", "lang")


class Model:
    """languages (sorted) and the matrix of places by languages."""

    def __init__(self, languages: list[str], matrix: np.ndarray):
        self.languages, self.matrix = languages, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        kept = [k for k, t in enumerate(texts) if self.languages and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for at in range(0, len(kept), 256):
            some = kept[at:at + 256]
            found = [places(texts[k]) for k in some]
            sizes = np.array([len(f) for f in found])
            rows = self.matrix[np.concatenate(found)]
            f = np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
            best = f.argmax(axis=1)
            share = np.maximum(f, 0)
            total = share.sum(axis=1)
            top = np.where(total > 0, share[np.arange(len(some)), best] / np.where(total > 0, total, 1), 1 / len(self.languages))
            for k, b, s in zip(some, best.tolist(), top.tolist()):
                names[k], scores[k] = self.languages[b], min(1.0, max(0.0, s))
        return names, scores


def fit(labelled: DataFrame, *, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from doc_id, text, lang of ``labelled``, a sample of it."""
    chosen = _sample(labelled, per_language)
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b["text"].to_pylist():
                there = np.zeros(BUCKETS, bool)
                there[places(t)] = True
                out.append(np.packbits(there).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.string()), b["lang"], pa.array(out, pa.binary())],
                                             ["doc_id", "lang", "bits"])

    texts = texts.where("text is not null")
    bits = texts.transform(in_arrow, run, "doc_id string, lang string, bits binary")
    # an id that many rows repeat is learned from once, whichever sorts first
    got = bits.groupBy("doc_id", "lang").agg(F.min("bits").alias("bits")).orderBy("lang", F.xxhash64("doc_id")).collect()
    got = [r for r in got if any(r.bits)]
    languages = sorted({r.lang for r in got})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    packed = np.stack([np.frombuffer(r.bits, np.uint8) for r in got])
    size = np.sqrt(np.bitwise_count(packed).sum(axis=1, dtype=np.float64))
    nth: dict[str, int] = {}
    marks = []
    for k, r in enumerate(got):
        nth[r.lang] = nth.get(r.lang, 0) + 1
        if nth[r.lang] <= landmarks:
            marks.append(k)
    # rows are unpacked a few at a time, and only where a landmark has something
    land = np.unpackbits(packed[marks], axis=1)
    used = np.nonzero(land.any(axis=0))[0]
    land = land[:, used].astype(np.float32)
    kernel = np.concatenate([np.unpackbits(packed[a:a + 64], axis=1)[:, used].astype(np.float32) @ land.T
                             for a in range(0, len(packed), 64)]).astype(np.float64)
    kernel /= size[:, None] * size[marks][None, :]
    value, vector = np.linalg.eigh(kernel[marks])
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    phi = kernel @ root
    y = np.array([[float(r.lang == name) for name in languages] for r in got])
    # one row's weight is one over its language's rows, so that none is drowned
    weight = (1 / y.sum(axis=0))[y.argmax(axis=1)]
    beta = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    matrix = np.zeros((BUCKETS, len(languages)))
    matrix[used] = land.T @ ((root @ beta) / size[marks][:, None])
    return Model(languages, matrix)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` with lang_pred and lang_score behind them
    (in place of columns of these names, if it has any).

    The model is of fixed size: BUCKETS times the languages.
    """
    documents = documents.drop("lang_pred", "lang_score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = StructType(documents.schema.fields + [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                names, scores = shared.value.predict(some["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 [*some.schema.names, "lang_pred", "lang_score"])

    return documents.transform(in_arrow, run, out)
