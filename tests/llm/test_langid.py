"""Language ID: held-out accuracy, the folded kernel against its definition, odd rows."""

import zlib

import numpy as np

from calibra.llm import langid
from calibra.llm.queries import QUERIES

from tests.conftest import SF01


def brute_places(text):
    """The strings themselves, before they are hashed to places."""
    marks, out = ["\0"], set()
    for c in text.lower():
        if c.isalpha():
            marks.append(c)
        elif marks[-1] != "\0":
            marks.append("\0")
    if marks[-1] != "\0" or len(marks) == 1:
        marks.append("\0")
    for n in (1, 2, 3):
        out |= {tuple(marks[i:i + n]) for i in range(len(marks) - n + 1)}
    return out


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()
    want = {r.doc_id: r.lang for r in rows}
    got = QUERIES["op2_language_id"](spark, SF01).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in want if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_places_are_the_distinct_strings():
    for text in ["Hello, wörld!  hello", "a", "", "...", "ÀÉ 12 xyz\nxyz"]:
        got, want = langid.places(text), brute_places(text)
        assert len(want) - 2 <= len(got) <= len(want)  # a hash may meet another
    assert (langid.places("ab cd" * 9) == langid.places("AB, CD" * 9 )).all()
    long = "wort und Satz " * 200_000
    assert set(langid.places(long)) == set(langid.places("wort und Satz " * 3))


def test_odd_rows(spark):
    rows = [(1, "die der das und", "de", 0.1), (2, "the of and with", "en", 0.1), (2, "the of and with", "en", 0.1),
            (3, None, "en", 0.1), (4, "123 ...", "de", 0.1), (5, "", None, 0.1), (None, "und der", "de", 0.1),
            (6, "the and", None, 0.1), (7, "der und " * 40000, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score double")
    model = langid.fit(docs)
    got = {(r.doc_id, r.text and r.text[:9]): r.lang_pred for r in langid.predict(docs, model).collect()}
    assert got == {(1, "die der d"): "de", (2, "the of an"): "en", (3, None): "und", (4, "123 ..."): "und", (5, ""): "und",
                   (None, "und der"): "de", (6, "the and"): "en", (7, "der und d"): "de"}
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0
