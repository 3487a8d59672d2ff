"""Registered queries of the operators: thin digests of what they return.

Each takes (spark, sf_dir), applies its operator with production parameters
to a whole table, and has DuckDB SQL in ``ORACLES`` where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import decontaminate, htmltext, langid, lmscore, merkle, mixing, prefixtrie, quality, setsketch, simhash, tokenfile, toxicity, urlfilter
from calibra.llm.common import fold, shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ITEM_WORDS = rf"coalesce(regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
i AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len, w[s:s+len-1] AS g
        FROM (SELECT item_id, w, least(len(w), 13) AS len,
                     unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
pos AS (SELECT doc_id, len, p, w[p:p+len-1] AS g
        FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS p
              FROM d, (SELECT DISTINCT len FROM win))),
m AS (SELECT doc_id, item_id, p, pos.len AS len FROM pos JOIN win ON pos.len = win.len AND pos.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT DISTINCT doc_id, unnest(range(p, p + len)) AS q FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
               string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3, seed=42)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

# what the schedule comes to: whole blocks of the source in md5 order, again from its start,
# and a part of the last block
OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS BIGINT) AS size
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM s),
w AS (SELECT *, CAST([5, 2, 1][sid % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap FROM n),
f AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER before, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level, cap / weight AS ratio
      FROM w WINDOW before AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap ELSE weight *
             (SELECT level FROM f WHERE cap > weight * level ORDER BY ratio, sid LIMIT 1) END AS target,
             least(source_size, greatest(64, CAST(ceil(source_size / 4096) AS BIGINT))) AS blocks FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN blocks * target / source_size ELSE 0 END AS quota FROM t),
e AS (SELECT *, CAST(floor(quota) AS BIGINT) AS full_blocks FROM q),
a AS (SELECT *, full_blocks // greatest(blocks, 1) AS rounds, full_blocks % greatest(blocks, 1) AS b FROM e),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE
             CAST(floor(CAST(b AS DOUBLE) * source_size / blocks) AS BIGINT)
             + CAST(round((quota - full_blocks) * (floor(CAST(b + 1 AS DOUBLE) * source_size / blocks)
                          - floor(CAST(b AS DOUBLE) * source_size / blocks))) AS BIGINT) END AS part FROM a),
p AS (SELECT doc_id, d.size, g.source_size, target, rounds, part,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || d.doc_id), d.doc_id) - d.size AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(start + size, part) - start) AS BIGINT) AS taken FROM p
"""


@query("op3_mix_sources", OP3_SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"), weights=(5, 2, 1), total=1.5, repeat=2) \
        .select("doc_id", "size", "source_size", "target", "taken")


# fixed values: the rules of this query
URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def _op6_sql(order: int = 4, bins: int = 2000) -> str:
    """The same models by counting strings, a level of smoothing at a time."""
    levels = "".join(f"""
p{n} AS (SELECT f.mdl, f.cls, f.gram, (c + d * q.p) / (total + d) AS p, ln((c + d * q.p) / (total + d) / q.p) AS gain
       FROM fullc f JOIN p{n - 1} q ON f.mdl = q.mdl AND f.cls = q.cls AND substr(f.gram, 2, {n - 1}) = q.gram WHERE n = {n}),"""
                     for n in range(2, order + 2))
    every = " UNION ALL ".join(f"SELECT mdl, cls, gram, gain FROM p{n}" for n in range(1, order + 2))
    rules = " ".join(f"""WHEN (host = '{r.partition("/")[0]}' OR host LIKE '%.{r.partition("/")[0]}')
      AND starts_with(path, '/{r.partition("/")[2]}') THEN '{r}'""" for r in sorted(URL_RULES, key=len, reverse=True))
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in URL_RULES.items())
    return rf"""
WITH u0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {AZ}) AS host,
              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u1 AS (SELECT *, CASE {rules} END AS rule FROM u0),
u AS (SELECT *, CASE rule {verdicts} END AS ruled, chr(2) || host || path || chr(3) AS s,
        CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % 2 AS fold FROM u1),
lab AS (SELECT s, CAST(ruled = 'allow' AS INTEGER) AS cls, fold FROM u WHERE ruled IS NOT NULL),
train AS (SELECT mdl, cls, s FROM lab, (VALUES (0), (1), (2)) m(mdl) WHERE mdl = 2 OR fold <> mdl),
cnt AS (SELECT mdl, cls, gram, len(gram) AS n, count(*) AS c FROM (
          SELECT mdl, cls, substr(s, CAST(p - k + 1 AS BIGINT), k) AS gram FROM (
            SELECT *, unnest(range(1, least({order + 1}, p) + 1)) AS k FROM (
              SELECT mdl, cls, s, unnest(range(2, len(s) + 1)) AS p FROM train))) GROUP BY mdl, cls, gram),
ctx AS (SELECT mdl, cls, substr(gram, 1, n - 1) AS context, sum(c) AS total, count(*) AS d FROM cnt GROUP BY ALL),
fullc AS (SELECT cnt.mdl, cnt.cls, gram, n, c, total, CAST(d AS DOUBLE) AS d
          FROM cnt JOIN ctx ON cnt.mdl = ctx.mdl AND cnt.cls = ctx.cls AND substr(gram, 1, n - 1) = context),
p1 AS (SELECT mdl, cls, gram, (c + d / 256) / (total + d) AS p, ln((c + d / 256) / (total + d) * 256) AS gain FROM fullc WHERE n = 1),{levels}
g AS ({every}),
b AS (SELECT mdl, cls, context, ln(d / (total + CAST(d AS DOUBLE))) AS back FROM ctx),
todo AS (SELECT DISTINCT fold AS mdl, s, cls FROM lab UNION ALL SELECT DISTINCT 2, s, NULL FROM u),
parts AS (SELECT DISTINCT mdl, s, p, k, substr(s, CAST(p - k + 1 AS BIGINT), k) AS gram FROM (
            SELECT *, unnest(range(1, least({order + 1}, p) + 1)) AS k FROM (SELECT mdl, s, unnest(range(2, len(s) + 1)) AS p FROM todo))),
sc AS (SELECT x.mdl, x.s, sum(coalesce(g1.gain, b1.back, 0) - coalesce(g0.gain, b0.back, 0)) / (len(x.s) - 1) AS score
       FROM parts x LEFT JOIN g g1 ON g1.mdl = x.mdl AND g1.cls = 1 AND g1.gram = x.gram
       LEFT JOIN g g0 ON g0.mdl = x.mdl AND g0.cls = 0 AND g0.gram = x.gram
       LEFT JOIN b b1 ON b1.mdl = x.mdl AND b1.cls = 1 AND b1.context = substr(x.gram, 1, k - 1)
       LEFT JOIN b b0 ON b0.mdl = x.mdl AND b0.cls = 0 AND b0.context = substr(x.gram, 1, k - 1)
       GROUP BY x.mdl, x.s),
held AS (SELECT score, cls FROM sc JOIN todo USING (mdl, s) WHERE mdl < 2),
lim AS (SELECT min(score) AS lo, CASE WHEN max(score) > min(score) THEN (max(score) - min(score)) / {bins} ELSE 1.0 END AS step,
               sum(cls) AS n1, sum(1 - cls) AS n0 FROM held),
bin AS (SELECT least(floor((score - lo) / step), {bins - 1}) AS bin, sum(cls) AS ones, sum(1 - cls) AS zeros FROM held, lim GROUP BY 1),
err AS (SELECT bin, coalesce(sum(ones) OVER w, 0) / n1 + (n0 - coalesce(sum(zeros) OVER w, 0)) / n0 AS e FROM bin, lim
        WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT lo + step * (min(bin) + max(bin)) / 2 AS cut FROM err, lim WHERE e <= (SELECT min(e) FROM err) + 1e-12 GROUP BY lo, step)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(score, 9) AS score
FROM u JOIN sc ON sc.s = u.s AND sc.mdl = 2, cut
"""


@query("op6_url_filter", _op6_sql())
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


def token_table(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Write the documents' ids and read them back."""
    folder = f"{shared_folder(spark)}/tokens"
    tokenfile.write(documents, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark, table(spark, sf_dir, "documents"))


def language_model(documents: DataFrame) -> langid.Model:
    return langid.fit(documents.where(fold(F.col("doc_id"), 3) != 1))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs.select("doc_id", "text"), language_model(docs)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.measured(table(spark, sf_dir, "documents")), "statistics")
    rules = quality.fit(stats, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("doc_id", *quality.COUNTS, failed.alias("base_failed"), (~failed & (rules.verdict() == 1)).alias("kept"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, vocabulary, stream = lmscore.learn(docs, fold(F.col("doc_id"), 10) != 0)
    return lmscore.score_streams(stream, model, vocabulary).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")


# crc32 of a number's decimal digits: the table of the reversed polynomial, then a step a digit
CRC_TABLE = """
crc_rounds AS (SELECT CAST(v AS BIGINT) AS v, CAST(v AS BIGINT) AS x, 0 AS k FROM range(256) r(v)
               UNION ALL SELECT v, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM crc_rounds WHERE k < 8),
crc AS (SELECT list(x ORDER BY v) AS tab FROM crc_rounds WHERE k = 8)"""


def _crc_sql(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


# nodes a level at a time: first the trees of the languages, then the tree of their roots
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
                CASE WHEN {_crc_sql("doc_id")} % 7 = 0 THEN {_leaf_sql("(CAST(n_chars AS HUGEINT) + 1)")} END AS changed FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY lang) AS n FROM docs),
tree AS (SELECT lang, 0 AS level, pos, n, leaf AS digest FROM leaves
         UNION ALL SELECT lang, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
                   FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2),
subs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
         FROM tree WHERE n = 1),
crown AS (SELECT 0 AS level, pos, n, subroot AS digest FROM subs
          UNION ALL SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
                    FROM crown WHERE n > 1 GROUP BY level, pos // 2),
steps AS (SELECT l.doc_id, l.leaf, t.level AS k, l.pos >> t.level AS slot, s.digest AS sibling
          FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = l.pos >> t.level AND t.n > 1
          LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.pos = xor(t.pos, 1)
          UNION ALL SELECT l.doc_id, l.leaf, 1000 + c.level, s.pos >> c.level, b.digest
          FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
          JOIN crown c ON c.pos = s.pos >> c.level AND c.n > 1
          LEFT JOIN crown b ON b.level = c.level AND b.pos = xor(c.pos, 1)),
paths AS (SELECT doc_id, leaf, list(coalesce(sibling, '') ORDER BY k) AS siblings, list(slot % 2 ORDER BY k) AS slots
          FROM steps GROUP BY doc_id, leaf),
fold AS (SELECT l.doc_id, l.leaf, 0 AS k, coalesce(l.changed, l.leaf) AS acc, coalesce(siblings, []) AS siblings, coalesce(slots, []) AS slots
         FROM leaves l LEFT JOIN paths p ON p.doc_id IS NOT DISTINCT FROM l.doc_id AND p.leaf = l.leaf
         UNION ALL SELECT doc_id, leaf, k + 1, CASE slots[k + 1] WHEN 0 THEN sha256(acc || siblings[k + 1]) ELSE sha256(siblings[k + 1] || acc) END,
                          siblings, slots FROM fold WHERE k < len(slots))
SELECT l.doc_id, l.leaf, subroot, r.digest AS root, sha256(array_to_string(siblings, '')) AS proof_sha256,
       acc AS folded_root, acc = r.digest AS verified
FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN fold f ON f.doc_id IS NOT DISTINCT FROM l.doc_id AND f.leaf = l.leaf AND f.k = len(f.slots), (SELECT digest FROM crown WHERE n = 1) r
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = merkle.leaf(*[one_more if k == 3 else c for k, c in enumerate(columns)])
    rows = docs.select("doc_id", "lang", merkle.leaf(*columns).alias("leaf"),
                       F.when(fold(F.col("doc_id"), 7) == 0, changed).alias("changed"))
    tree = merkle.manifest(rows).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return tree.withColumn("verified", F.col("folded_root") == F.col("root"))


# a node by the text of its whole sequence; a node's ancestors are its smallest member's prefixes
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
             ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS donor FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.donor, {_crc_sql("c.conv_id")} % 9 AS h, coalesce(o.n, 0) AS given
      FROM c LEFT JOIN c o ON o.conv_id = c.donor, crc),
r AS (SELECT k.conv_id, p, role, text FROM k JOIN t ON t.conv_id = k.donor AND p < h
      UNION ALL SELECT k.conv_id, p - h + least(h, given), role, text FROM k JOIN t ON t.conv_id = k.conv_id AND p >= h),
s AS (SELECT conv_id, p + 1 AS depth, strlen(text) AS bytes, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '')
             OVER (PARTITION BY conv_id ORDER BY p)) AS key FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM s GROUP BY key),
up AS (SELECT node.key AS below, a.key, a.depth = node.depth - 1 AS direct
       FROM node JOIN s a ON a.conv_id = node.conv_id AND a.depth <= node.depth),
kids AS (SELECT key, count(*) AS n_children FROM up WHERE direct GROUP BY key),
v AS (SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM node LEFT JOIN kids USING (key)),
total AS (SELECT up.key, sum(saved) AS saved_tokens, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves
          FROM up JOIN v ON v.key = up.below GROUP BY up.key),
ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, arg_max(key, depth) AS key FROM s GROUP BY conv_id) GROUP BY key)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, pv.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN total USING (key) LEFT JOIN ends USING (key)
LEFT JOIN up ON up.below = v.key AND up.direct LEFT JOIN v pv ON pv.key = up.key
"""


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of another: (turns, members) of the trie.

    Conversation c gets the first h turns of conversation c - c % 5, then its
    own after its first h, where h is the crc32 of c modulo 9.
    """
    n = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    n = written(n.withColumns({"donor": F.col("conv_id") - F.col("conv_id") % 5, "h": fold(F.col("conv_id"), 9)}), "lengths")
    given = n.select(F.col("conv_id").alias("donor"), F.col("n").alias("given"))
    n = written(n.join(given, "donor", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0)))), "shares")
    first = turns.where("pos < 8").select(F.col("conv_id").alias("donor"), "pos", "digest", "bytes")
    lent = n.select("conv_id", "donor", "taken").join(first, "donor").where("pos < taken").select("conv_id", "pos", "digest", "bytes")
    # a conversation's row once for every 1,024 of its turns, so that a long one is dealt to many tasks
    shares = n.select(F.col("conv_id").alias("_c"), "h", "taken", F.explode(F.expr("sequence(0L, (n - 1) div 1024)")).alias("_b"))
    own = turns.join(shares, (F.col("conv_id") == F.col("_c")) & (F.expr("pos div 1024") == F.col("_b"))).where("pos >= h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    members = n.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return written(lent.unionByName(own), "rebuilt"), members


@query("op12_conversation_trie", OP12_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = rebuilt(prefixtrie.ordered_turns(table(spark, sf_dir, "conversations")))
    return prefixtrie.prefix_trie(turns, members).withColumnRenamed("saved", "saved_tokens")


@query("op13_setsketch_near_dedup")
def op13_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = setsketch.near_duplicates(table(spark, sf_dir, "documents"), percent=80, shingle=4)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
