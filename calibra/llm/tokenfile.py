"""Token ids in patched frame-of-reference blocks.

*Tokens.*  The tokenizers library encodes each text; white space between
words carries no state in the tokenizers meant here, so a text is encoded
word by word (ASCII space only; other spaces are left to the library), each
different word of a batch once, and each worker keeps the ids of the words it
has met lately, up to twice ``_CACHE`` of them.

*File format.*  A folder of Parquet files, one row a segment, so that any
store Spark writes to will do and Spark's commit protocol leaves whole files
only.  A segment has whole documents, in ascending order of id, about
``SEGMENT_IDS`` ids:

    part, seq        place in the order
    first            ids before the segment in its part
    n_ids            ids in it
    doc_ids, counts  its documents and their numbers of ids
    payload          little-endian:
      4s  "PFR1", u32 ids a block, u32 ids, u32 blocks, u32 crc32 of the rest
      u32 x blocks   where each block starts in the body (the index)
      body           blocks: u32 minimum, u16 width, u16 exceptions,
                     residuals' low bits at that width, most significant first,
                     u16 x exceptions positions, u32 x exceptions residuals

A block subtracts its minimum and packs the residuals at the width that a
percentile of them needs; those that need more stand in the exception list in
full.  The index makes every block readable by itself (``read_ids``).

Nulls and odd cases: a null or empty text has the end id alone; rows that
repeat an id follow each other in order of their text's hash; null ids come
first; an empty table writes no segment and reads back empty.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from calibra.llm.common import give_back, in_arrow, small_batches, split_ascii

BLOCK = 512
PERCENTILE = 95
SEGMENT_IDS = 1 << 20
_CACHE = 400_000
_LONG_WORD = 64
_STRETCH = 1 << 18  # words whose ids are put in place together
_STOPS = ".,;:!?"
_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIIII")


# ---- blocks -------------------------------------------------------------

def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of residuals below 2**width as rows of bytes."""
    bits = np.unpackbits(low.astype(">u4").view(np.uint8).reshape(*low.shape, 4), axis=2)[:, :, 32 - width:]
    return np.packbits(bits.reshape(len(low), -1), axis=1)


def _unpacked(raw: np.ndarray, width: int, block: int) -> np.ndarray:
    bits = np.unpackbits(raw, axis=1)[:, :block * width].reshape(len(raw), block, width)
    wide = np.zeros((len(raw), block, 32), np.uint8)
    wide[:, :, 32 - width:] = bits
    return np.packbits(wide, axis=2).view(">u4")[:, :, 0].astype(np.uint32)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """The payload that holds these ids (unsigned 32 bits)."""
    n = len(ids)
    n_blocks = -(-n // block)
    rows = np.empty(n_blocks * block, np.uint32)
    rows[:n] = ids
    rows[n:] = ids[-1] if n else 0
    rows = rows.reshape(n_blocks, block)
    low = rows.min(axis=1) if n_blocks else np.empty(0, np.uint32)
    rest = rows - low[:, None]
    at = min(block - 1, -(-block * percentile // 100) - 1)
    pct = np.partition(rest, at, axis=1)[:, at].astype(np.float64) if n_blocks else np.empty(0)
    width = np.maximum(1, np.ceil(np.log2(pct + 1))).astype(np.int64)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        own = np.nonzero(width == w)[0]
        for some in np.array_split(own, -(-len(own) // 128)):
            raw = _packed(rest[some] & np.uint32((1 << w) - 1), w)
            for k, r in zip(some.tolist(), raw):
                packed[k] = r.tobytes()
    over = rest >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0
    over &= (width < 32)[:, None]
    body, starts, where = [], [], 0
    any_over = over.any(axis=1)
    for k in range(n_blocks):
        pos = np.nonzero(over[k])[0] if any_over[k] else ()
        piece = struct.pack("<IHH", int(low[k]), int(width[k]), len(pos)) + packed[k]
        if len(pos):
            piece += pos.astype("<u2").tobytes() + rest[k][pos].astype("<u4").tobytes()
        starts.append(where)
        body.append(piece)
        where += len(piece)
    rest_of = np.array(starts, "<u4").tobytes() + b"".join(body)
    return _HEAD.pack(_MAGIC, block, n, n_blocks, zlib.crc32(rest_of)) + rest_of


def read_ids(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids[start:stop] of a payload; reads the blocks that hold them, by the index."""
    magic, block, n, n_blocks, crc = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a payload of token ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    if (start, stop) == (0, n) and zlib.crc32(memoryview(payload)[_HEAD.size:]) != crc:
        raise ValueError("damaged payload of token ids")
    starts = np.frombuffer(payload, "<u4", n_blocks, _HEAD.size).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=_HEAD.size + 4 * n_blocks)
    lo, hi = start // block, -(-stop // block)
    at = starts[lo:hi]
    heads = body[at[:, None] + np.arange(8)]
    low = heads[:, :4].copy().view("<u4")[:, 0]
    width, n_over = (heads[:, a:a + 2].copy().view("<u2")[:, 0].astype(np.int64) for a in (4, 6))
    out = np.empty((hi - lo, block), np.uint32)
    for w in np.unique(width).tolist():
        own = np.nonzero(width == w)[0]
        for some in np.array_split(own, -(-len(own) // 128)):
            out[some] = _unpacked(body[(at[some] + 8)[:, None] + np.arange(block * w // 8)], w, block)
    for k in np.nonzero(n_over)[0].tolist():
        a = int(at[k] + 8 + block * width[k] // 8)
        m = int(n_over[k])
        out[k, body[a:a + 2 * m].view("<u2")] = body[a + 2 * m:a + 6 * m].view("<u4")
    out += low[:, None]
    return out.reshape(-1)[start - lo * block:stop - lo * block]


# ---- tokens -------------------------------------------------------------

class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes.

    New words are encoded many at a time: of letters alone they are one
    pre-token each, so where the tokenizer marks word ends the ids of many
    words in one text can be told apart.  Stops behind the letters are a
    pre-token of their own.  Other words are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer
        self.of = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        suffix = getattr(self.of.model, "end_of_word_suffix", None)
        vocabulary = self.of.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[k for t, k in vocabulary.items() if t.endswith(suffix)]] = True
        # whether "A" and "a" are one to the tokenizer
        self.lowers = self.of.normalizer is not None and self.of.normalizer.normalize_str("AZ") == "az"
        self.steady: set[str] = set()  # letters that the tokenizer's normal form leaves as letters

    def _letters(self, word: str) -> bool:
        """Whether a word is of letters alone, also in the tokenizer's normal form, and so one pre-token."""
        if not word.isalpha():
            return False
        if word.isascii() or self.steady.issuperset(word):
            return True
        form = self.of.normalizer.normalize_str if self.of.normalizer else str
        for c in set(word) - self.steady:  # some letters become a letter and a mark
            if not form(c).isalpha():
                return False
            self.steady.add(c)
        return True

    def _many(self, words: list[str]) -> list[bytes] | None:
        """ids of each word, told apart by the word ends; None if they can't be."""
        ids = np.array(self.of.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.nonzero(self.ends[ids])[0] + 1
        if len(at) != len(words) or at[-1] != len(ids):
            return None
        raw, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: set[bytes], have) -> dict[bytes, bytes]:
        """ids of new words; ``have`` gives those of a word met before, or None."""
        whole, others, composed = [], [], []
        for w in new:
            t = w.decode()
            if self._letters(t):
                whole.append(w)
                continue
            core = t.rstrip(_STOPS)
            if self._letters(core):  # two pre-tokens, each as it is alone
                core = core.encode()
                composed.append((w, core, w[len(core):]))
            else:
                others.append(w)
        for k, into in ((1, whole), (2, others)):
            into += {c[k] for c in composed} - new - {c[k] for c in composed if have(c[k])}
        out: dict[bytes, bytes] = {}
        for at in range(0, len(whole), 512):
            some = whole[at:at + 512]
            got = self._many([w.decode() for w in some]) if self.ends.any() else None
            if got is None:
                others += some
            else:
                out.update(zip(some, got))
        for at in range(0, len(others), 512):
            some = others[at:at + 512]
            for w, e in zip(some, self.of.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                out[w] = np.array(e.ids, "<u4").tobytes()
        for w, a, b in composed:
            out[w] = (out.get(a) or have(a)) + (out.get(b) or have(b))
        return out

    def __call__(self, texts: pa.Array | list[bytes | None]) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.binary()), b"").view(pa.string())
        if self.lowers:  # a special token in a text is told by its case
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words, upto = split_ascii(texts)
        words = words.dictionary_encode()  # a word is looked up once, however often it stands in the texts
        raw = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, start = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
        of, out = words.indices.to_numpy(), []
        for at in range(0, len(of), _STRETCH):
            some = of[at:at + _STRETCH]
            n = size[some]
            ends = np.cumsum(n)
            out.append(flat[np.arange(ends[-1]) + np.repeat(start[some] - ends + n, n)])
        data = memoryview(np.concatenate([flat[:0], *out])).cast("B")
        cuts = (4 * np.concatenate([[0], np.cumsum(size[of])])[upto]).tolist()
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """ids of each of some different words."""
        if len(self.known) > _CACHE:  # words not met since then go at the next turn
            self.known, self.older = {}, self.known
        known, older, once = self.known, self.older, {}
        raw = list(map(known.get, words))
        missing = [k for k, r in enumerate(raw) if r is None]
        new = set()
        for w in [words[k] for k in missing]:
            if w in older:
                known[w] = older[w]
            else:
                new.add(w)
        for w, r in self._learn(new, lambda w: known.get(w) or older.get(w)).items():
            (known if len(w) <= _LONG_WORD else once)[w] = r
        for k in missing:
            w = words[k]
            raw[k] = once[w] if w in once else known[w]
        return raw


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, kept from task to task until files are read."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop this worker's encoders and the words they keep."""
    _ENCODERS.clear()


def write(documents: DataFrame, folder: str, tokenizer: str, *, end_id: int, block: int = BLOCK,
          percentile: int = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode doc_id, text and write the segments to ``folder``."""
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_h")) \
        .repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, raw, size, kind = [], [], 0, None

        def segment() -> pa.RecordBatch:
            counts = [len(r) // 4 for r in raw]
            payload = pack(np.frombuffer(b"".join(raw), "<u4"), block, percentile)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([sum(counts)], pa.int64()), pa.array([ids], pa.list_(kind)),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "seq", "first", "n_ids", "doc_ids", "counts", "payload"])

        for b in batches:
            kind = b["doc_id"].type
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                for i, r in zip(some["doc_id"].to_pylist(), encode(some["text"])):
                    ids.append(i)
                    raw.append(r + end)
                    size += len(r) // 4 + 1
                    if size >= segment_ids:
                        yield segment()
                        seq, first, ids, raw, size = seq + 1, first + size, [], [], 0
                        give_back()
        if ids:
            yield segment()

    schema = StructType([
        StructField("part", IntegerType()), StructField("seq", IntegerType()), StructField("first", LongType()),
        StructField("n_ids", LongType()), StructField("doc_ids", ArrayType(rows.schema["doc_id"].dataType)),
        StructField("counts", ArrayType(LongType())), StructField("payload", BinaryType())])
    with small_batches(documents.sparkSession):
        rows.transform(in_arrow, run, schema).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and
    ids (little-endian unsigned 32 bits) of every document of the folder."""
    segments = spark.read.parquet(folder)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a part, and a part is a task of the writing job
    base = segments.groupBy("part").agg(F.sum("n_ids").alias("n")) \
        .select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    rows = segments.join(F.broadcast(base), F.col("part") == F.col("_part")) \
        .select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "counts", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the worker may be one that has written: its words are not needed here
        for b in batches:
            for k in range(b.num_rows):
                ids = read_ids(b["payload"][k].as_py()).astype("<u4")
                counts = b["counts"][k].values.to_numpy()
                ends = np.cumsum(counts)
                raw = [ids[e - c:e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_ids"][k].values, pa.array(b["start"][k].as_py() + ends - counts), pa.array(counts),
                     pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    schema = StructType([StructField("doc_id", segments.schema["doc_ids"].dataType.elementType)] +
                        [StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32")] +
                        [StructField("ids", BinaryType())])
    return rows.transform(in_arrow, run, schema)
