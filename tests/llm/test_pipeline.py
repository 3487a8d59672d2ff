"""The pipeline's stages against brute force, each on what the one before it kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from calibra.llm.common import written
from tests.conftest import SF001
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_tokenfile import brute as brute_tokens

SEP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in SEP.split(low) if w]


def contaminated(text, items):
    words = item_words(text)
    hit = set()
    for item in items:
        n = min(13, len(item))
        wins = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if item else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p:p + n]) in wins:
                hit |= set(range(p, p + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages(spark):
    raw = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = [(900_001, "1234 ... 77", "en", "src1", 11), (900_002, None, "de", "src2", 0), (900_003, "of the and that", None, None, 15)]
    docs = raw.unionAll(spark.createDataFrame(extra, raw.schema))
    columns = docs.columns
    kept = [written(docs, "input")]
    for name, stage in P.STAGES:
        kept.append(written(stage(spark, kept[-1], SF001), "stage"))
    rows = [k.collect() for k in kept]
    assert all(k.columns == columns for k in kept[:-1])

    by_id = {r.doc_id: r for r in rows[0]}
    assert {r.doc_id for r in rows[1]} == set(by_id) - {900_001, 900_002}
    assert all(r.text == by_id[r.doc_id].text and (r.lang == by_id[r.doc_id].lang or r.doc_id == 900_003) for r in rows[1])
    assert next(r.lang for r in rows[1] if r.doc_id == 900_003) == "en"

    groups = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows[1]])
    assert sorted(r.doc_id for r in rows[2]) == sorted(set(groups))

    items = [item_words(r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2] if not contaminated(r.text, items)}
    assert len(rows[3]) == len({r.doc_id for r in rows[3]})

    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    copies = Counter(r.doc_id for r in rows[4])
    assert set(copies) <= {r.doc_id for r in rows[3]} and max(copies.values()) <= 2
    have, got, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows[3]:
        have[r.source] += size(r)
        got[r.source] += size(r) * copies[r.doc_id]
        longest[r.source] = max(longest[r.source], size(r))
    names = sorted(have, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(have.values())
    while True:  # share again until none is above
        level = (total - sum(2 * have[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 2 * have[s]}
        if not more:
            break
        capped |= more
    for s in names:
        want = 2 * have[s] if s in capped else weight[s] * level
        assert abs(got[s] - want) <= longest[s] / 2 + 1

    tokens = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows[5]]
    one = brute_tokens(rows[3])
    assert Counter(t[0] for t in tokens) == copies
    start = 0
    for t in sorted(tokens, key=lambda t: t[1]):
        assert t[1] == start and t[2:] == one[t[0]][1:]
        start += t[2]
    assert [t[0] for t in sorted(tokens, key=lambda t: t[1])] == sorted(t[0] for t in tokens)


def test_other_columns_pass_whatever_their_names(spark):
    raw = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id % 10 = 0")
    others = ("lang_pred", "lang_score", "_key", "_copy", "_text_key", "fingerprint", "component_id", "size", "n_hit", "extra_5_")
    docs = written(raw.selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in others]), "wide")
    for name, stage in P.STAGES[:-1]:
        plain = written(stage(spark, docs.select(raw.columns), SF001), "plain")
        docs = written(stage(spark, docs, SF001), "wide")
        assert docs.columns == [*raw.columns, *others]
        rows = docs.collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in plain.collect()) and rows
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in others)


def test_run_on_an_empty_table(spark, tmp_path):
    raw = spark.read.parquet(f"{SF001}/documents.parquet")
    raw.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF001}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
