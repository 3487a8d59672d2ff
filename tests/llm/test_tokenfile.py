"""Token files: exact round trips, and the library's own encoding of whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from calibra.llm import tokenfile
from calibra.llm.common import in_arrow, shared_folder, split_ascii
from calibra.llm.queries import QUERIES, token_table

from tests.conftest import SF001

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("ids", [
    [], [7], [0] * 600, list(range(513)), [2**32 - 1, 0, 5], list(range(1000, 1512)) + [4_000_000_000],
    [3] * 500 + [70_000] * 12, np.random.default_rng(1).integers(0, 49_408, 5000).tolist(),
])
def test_payload_round_trip(ids):
    payload = tokenfile.pack(np.array(ids, np.uint32))
    assert tokenfile.read_ids(payload).tolist() == ids
    for a, b in ((0, 1), (511, 513), (3, 400), (len(ids) - 1, len(ids) + 9)):
        assert tokenfile.read_ids(payload, max(a, 0), b).tolist() == ids[max(a, 0):b]


def test_damage_is_noticed():
    payload = bytearray(tokenfile.pack(np.arange(100, dtype=np.uint32)))
    payload[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.read_ids(bytes(payload))


def test_words_give_what_whole_texts_give():
    texts = ["It's we'll DON'T", "a b c\x1cd", "É é é ́x", "<|endoftext|> x <|startoftext|>y", "ΑΣ ΑΣ. Σ",
             "12 345,6 ٠", "tab\tline\nfeed\x0b\x0c\r.", "\U0001f600\U0001f600 ok", "z" * 3000, "  ", "İstanbul",
             "end. end, END! can't. l’été, «oui». x' 's 'S don't; ªº ⅷ. ﬁne, ǅ ẞ. 한국어. 日本語, e\u0301te\u0301.", "<|ENDOFTEXT|> A <|endoftext|>, B",
             "A.", "a?!:;", "...", ".a", "a.b.", "ⓐ. \u00ad. a\u00adb,"]
    of = Tokenizer.from_file(PATH)
    want = [of.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(r, "<u4").tolist() for r in tokenfile.Encoder(PATH)([t.encode() for t in texts])]
    assert got == want


def test_every_letter_before_stops_gives_what_the_library_gives():
    of, encoder = Tokenizer.from_file(PATH), tokenfile.Encoder(PATH)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    words = [c + "." for c in letters] + ["a" + c + "," for c in letters] + ["k" + c for c in letters] + ["\u09b9\u09df,", "\u0130."]
    for at in range(0, len(words), 20_000):
        some = words[at:at + 20_000]
        want = [np.array(e.ids, "<u4").tobytes() for e in of.encode_batch(some, add_special_tokens=False)]
        got = encoder([w.encode() for w in some])
        assert [w for w, a, b in zip(some, want, got) if a != b] == []


def brute(docs):
    of, start, out = Tokenizer.from_file(PATH), 0, {}
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = of.encode(d.text or "", add_special_tokens=False).ids + [1]
        out[d.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_query_equals_whole_text_encoding(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_ids"](spark, SF001).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (2, "the end", "x"), (2, "the end", "x"), (None, "first", "x"), (9, "long " * 60000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens) for r in token_table(spark, docs).collect())
    assert got == [(-1, 0, 2), (1, 2, 1), (2, 3, 3), (2, 6, 3), (3, 9, 1), (9, 10, 60001)]
    assert token_table(spark, docs.where("false")).count() == 0


def test_small_segments_keep_order_and_index(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/small"
    tokenfile.write(docs, folder, PATH, end_id=1, segment_ids=2000, block=128)
    assert spark.read.parquet(folder).count() > 20
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read(spark, folder).collect()}
    assert got == brute(docs.collect())


def test_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    """A partition of 18 MB is not sent as one batch."""
    def bounded(df, run, schema):
        def small(batches):
            for b in batches:
                assert b.nbytes < 6 << 20
                yield b

        return in_arrow(df, lambda batches: run(small(batches)), schema)

    monkeypatch.setattr(tokenfile, "in_arrow", bounded)
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text")
    folder = f"{shared_folder(spark)}/batches"
    tokenfile.write(docs, folder, PATH, end_id=1)
    assert spark.read.parquet(folder).agg({"n_ids": "sum"}).first()[0] == 4000 * 801
    assert spark.conf.get(size) == before


def test_reading_drops_the_words_that_writing_kept(spark, monkeypatch):
    folder = f"{shared_folder(spark)}/kept"
    tokenfile.write(spark.createDataFrame([(1, "the end")], "doc_id long, text string"), folder, PATH, end_id=1)
    runs = []
    monkeypatch.setattr(tokenfile, "in_arrow", lambda df, run, schema: runs.append(run) or df)
    monkeypatch.setattr(tokenfile, "_ENCODERS", {})
    tokenfile.read(spark, folder)
    tokenfile.encoder(PATH)
    assert list(runs[0](iter([]))) == [] and not tokenfile._ENCODERS


def test_a_word_is_looked_up_once_however_often_it_stands():
    class Counting(dict):
        looked = 0

        def __contains__(self, w):
            Counting.looked += 1
            return super().__contains__(w)

        def __getitem__(self, w):
            Counting.looked += 1
            return super().__getitem__(w)

        def get(self, w, default=None):
            Counting.looked += 1
            return super().get(w, default)

    encode = tokenfile.Encoder(PATH)
    want = encode([b"the end. " * 500, None, b"end."])
    encode.known = Counting(encode.known)
    assert encode([b"the end. " * 500, None, b"end."]) == want
    assert Counting.looked < 20


def test_arrow_splits_as_bytes_do():
    texts = [b"", b" a  b ", b"a\x1cb\x85c\tq\x0b\x0cz\r\n", b"\xff\xfe x", "é x y".encode(), b"  ", b"x"]
    for some in (texts, texts[:1], []):
        for first in (0, 1):
            words, upto = split_ascii(pa.array(some, pa.binary()).slice(first))
            words = words.to_pylist()
            assert [words[a:b] for a, b in zip(upto, upto[1:])] == [t.split() for t in some[first:]]
