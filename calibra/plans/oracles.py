"""Independent DuckDB SQL for every registered query (correctness oracle).

Written from the operator semantics, not generated from the Spark plans.
The fixture views of ``calibra.sources.fixtures`` are re-stated here as CTEs
over the driver tables, so each string runs on the pre-registered views
alone.  Computed doubles are rounded to 9 digits on both sides.
"""

from __future__ import annotations

# fixed values: the ten bins' edges, as doubles (those of i / 10 that i * 0.1 misses are kept as they come)
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]

R = 9  # rounding digits of computed doubles

# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------

_F1_RAW = r"""
f1_join AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity,
         l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
         l.l_shipdate, p.p_brand,
         TRY_CAST(substr(p.p_brand, 7, 10) AS INTEGER) AS b,
         CAST(l.l_partkey % 4 AS INTEGER) AS ans
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
f1_letters AS (
  SELECT *,
    ['A','B','C','D'][(CASE WHEN l_linestatus = 'F' THEN ans
          ELSE CAST((l_partkey + 1 + l_suppkey % 3) % 4 AS INTEGER) END) + 1] AS letter,
    CAST(CAST(l_quantity * 2 AS INTEGER) AS VARCHAR) AS conf_s
  FROM f1_join
),
raw_responses AS (
  SELECT
    CASE WHEN l_tax = 0.08 AND l_linenumber = 7 THEN 'v1' ELSE 'v2' END AS config_version,
    CASE WHEN l_tax = 0.08 AND l_linenumber = 6 THEN NULL
         WHEN l_tax = 0.08 AND l_linenumber = 5 THEN 512 ELSE 1024 END::INTEGER AS max_output_tokens,
    0.3::DOUBLE AS temperature,
    CASE WHEN l_partkey % 3 = 0 THEN 'original_180' ELSE 'supplement_v2' END AS bank_source,
    'q' || CAST(l_partkey AS VARCHAR) AS question_id,
    p_brand AS subject,
    CASE b % 3 WHEN 0 THEN 'STEM' WHEN 1 THEN 'Social_Science' WHEN 2 THEN 'Humanities' END AS domain,
    CASE (b // 3) % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' END AS difficulty,
    l_returnflag AS model_id,
    CASE l_returnflag WHEN 'R' THEN 'anthropic' WHEN 'A' THEN 'openai' WHEN 'N' THEN 'gemini' END AS backend,
    CASE l_returnflag WHEN 'R' THEN 'claude-haiku' WHEN 'A' THEN 'gpt-4o-mini'
         WHEN 'N' THEN 'gemini-2.5-flash' END AS model_name,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_partkey, l_returnflag
         ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1
         AS INTEGER) AS trial_index,
    l_shipdate AS collection_timestamp,
    CASE
      WHEN l_linenumber = 2 THEN 'answer:' || lower(letter) || ' confidence:' || conf_s
      WHEN l_linenumber = 3 THEN 'Let me think this through step by step.' || chr(10) || chr(10)
           || 'ANSWER: ' || letter || chr(10) || 'CONFIDENCE: ' || conf_s || '%'
      WHEN l_tax < 0.015 AND l_linenumber = 5 THEN 'I am not able to answer this question.'
      WHEN l_tax < 0.015 AND l_linenumber = 6 THEN 'ANSWER: ' || letter || chr(10) || 'CONFIDENCE: 150'
      WHEN l_tax < 0.015 AND l_linenumber = 7 THEN 'ANSWER: ' || letter || chr(10) || 'CONFIDENCE: 1000'
      ELSE 'ANSWER: ' || letter || chr(10) || 'CONFIDENCE: ' || conf_s
    END AS raw_response,
    ['A','B','C','D'][ans + 1] AS correct_letter,
    ans AS answer_index,
    CASE WHEN l_returnflag = 'R' THEN l_discount * 10 END AS internal_prob_answer,
    CAST(300 + l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS INTEGER) AS input_tokens,
    CAST(20 + CAST(l_quantity AS INTEGER) * 2 AS INTEGER) AS output_tokens,
    CAST(NULL AS VARCHAR) AS error,
    l_linenumber, l_discount
  FROM f1_letters
)"""

_F1 = r"""
parsed AS (
  SELECT *,
    nullif(upper(regexp_extract(raw_response, '(?i)ANSWER:\s*([A-D])', 1)), '') AS predicted_letter,
    TRY_CAST(nullif(regexp_extract(raw_response, '(?i)CONFIDENCE:\s*(\d{1,3})', 1), '') AS INTEGER) AS conf_raw
  FROM raw_responses
),
responses AS (
  SELECT config_version, max_output_tokens, temperature, bank_source, question_id, subject,
         domain, difficulty, model_id, backend, model_name, trial_index, collection_timestamp,
         raw_response, correct_letter, answer_index, internal_prob_answer, input_tokens,
         output_tokens, error, predicted_letter,
         CASE WHEN conf_raw <= 100 THEN conf_raw END AS confidence,
         coalesce(predicted_letter IS NOT NULL AND conf_raw <= 100, false) AS parse_ok,
         coalesce(list_position(['A','B','C','D'], predicted_letter) - 1 = answer_index, false) AS is_correct
  FROM parsed
),
feat AS (
  SELECT *,
    confidence / 100.0 AS confidence_norm,
    CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 END AS difficulty_numeric,
    CAST(is_correct AS DOUBLE) AS correct,
    confidence / 100.0 - CAST(is_correct AS DOUBLE) AS overconfidence_gap_row
  FROM responses
  WHERE parse_ok AND confidence IS NOT NULL
)"""

CTES = {"f1_raw": _F1_RAW, "f1": _F1}
ORDER = ["f1_raw", "f1"]
DEPS = {"f1": ["f1_raw"]}


def with_ctes(body: str, *names: str) -> str:
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        for d in DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    parts = [CTES[n].strip() for n in ORDER if n in need]
    head = "WITH " + ",\n".join(parts)
    rest = body.lstrip()
    if rest.startswith(","):
        # the body continues the WITH list with its own CTEs
        return head + rest
    return head + "\n" + body


# ---------------------------------------------------------------------------
# SQL fragments for calibration metrics
# ---------------------------------------------------------------------------

def edge_list() -> str:
    return "[" + ", ".join(repr(e) + "::DOUBLE" for e in EDGES) + "]"


def bin_case(score: str) -> str:
    e = EDGES
    n = len(e) - 1
    parts = [f"WHEN {score} >= {e[i]!r} AND {score} < {e[i + 1]!r} THEN {i}" for i in range(n - 1)]
    parts.append(f"WHEN {score} >= {e[n - 1]!r} AND {score} <= {e[n]!r} THEN {n - 1}")
    return "(CASE " + " ".join(parts) + " END)"


def ece_sql(score: str = "confidence_norm", correct: str = "correct", weight: str | None = None) -> str:
    """The definition: the sum over bins of n_b / N * |accuracy_b - confidence_b|.

    Weighted rows (resamples, which are many) take the sums without the means.
    """
    b = bin_case(score)
    if weight is not None:
        terms = [f"abs(coalesce(sum(CASE WHEN {b} = {i} THEN {weight} * ({correct} - {score}) END), 0.0))" for i in range(len(EDGES) - 1)]
        return f"coalesce(({' + '.join(terms)}) / nullif(sum({weight}), 0), 0.0)"
    terms = []
    for i in range(len(EDGES) - 1):
        here = f"FILTER (WHERE {b} = {i} AND {correct} IS NOT NULL)"
        terms.append(f"coalesce(CAST(count(*) {here} AS DOUBLE) / count(*) * abs(avg({correct}) {here} - avg({score}) {here}), 0.0)")
    return "(" + " + ".join(terms) + ")"


def rnd(expr: str, digits: int = R) -> str:
    return f"round({expr}, {digits})"

_FREEFORM = r"""
freeform AS (
  SELECT model_id, question_id, trial_index, difficulty, correct_letter, answer_index, raw_response,
    CASE
      WHEN l_linenumber = 1 THEN 'Reasoning about option ' || x || '.' || chr(10) || 'FINAL_ANSWER: ' || x
      WHEN l_linenumber = 2 THEN 'final_answer: ' || lower(x)
      WHEN l_linenumber = 3 THEN 'I think it is a tough one; my pick is ' || x || '.'
      WHEN l_linenumber = 4 THEN 'It is a hard question.'
      WHEN l_linenumber = 5 THEN 'No idea.'
      WHEN l_linenumber = 6 THEN 'FINAL_ANSWER: ' || x || chr(10) || 'Actually maybe B'
      ELSE 'FINAL_ANSWER:' || lower(x)
    END AS freeform_reply
  FROM (SELECT *, coalesce(nullif(upper(regexp_extract(raw_response, '(?i)ANSWER:\s*([A-D])', 1)), ''), 'B') AS x
        FROM raw_responses)
)"""

CTES["freeform"] = _FREEFORM
ORDER.append("freeform")
DEPS["freeform"] = ["f1_raw"]

FINAL_LETTER_SQL = (r"coalesce(nullif(upper(regexp_extract({t}, 'FINAL_ANSWER:\s*([A-Da-d])', 1)), ''), "
                    r"list_extract(regexp_extract_all(upper({t}), '\b([A-D])\b', 1), -1))")


# pool and original bank from documents --------------------------------

def _f4_sql() -> str:
    from calibra.schemas import DOMAIN_SUBJECTS, TIER_SUBJECTS
    from calibra.sources.fixtures import POOL_SUBJECTS
    subj_list = "[" + ", ".join(f"'{s}'" for s in POOL_SUBJECTS) + "]"
    dom_vals = ", ".join(f"('{s}', '{d}', {i})" for i, (d, subs) in enumerate(DOMAIN_SUBJECTS.items())
                         for s in subs)
    tier_vals = ", ".join(f"('{s}', '{t}', {i})" for i, (t, subs) in enumerate(TIER_SUBJECTS.items())
                          for s in subs)
    n = len(POOL_SUBJECTS)
    return rf"""
dom_map AS (SELECT * FROM (VALUES {dom_vals}) t(subject, domain, prio)),
tier_map AS (SELECT * FROM (VALUES {tier_vals}) t(subject, difficulty, prio)),
subject_dim AS (
  SELECT d.subject, d.domain, t.difficulty
  FROM (SELECT subject, arg_min(domain, prio) AS domain FROM dom_map GROUP BY subject) d
  JOIN (SELECT subject, arg_max(difficulty, prio) AS difficulty FROM tier_map GROUP BY subject) t USING (subject)),
pool_base AS (
  SELECT doc_id, source, lang, n_chars, text AS question,
    list_extract({subj_list}, CAST(n_chars % {n} AS INTEGER) + 1) AS subject,
    ['lang:' || lang, 'source:' || source, 'chars:' || CAST(n_chars AS VARCHAR), 'id:' || CAST(doc_id AS VARCHAR)] AS choices,
    CAST(doc_id % 4 AS INTEGER) AS answer
  FROM documents),
pool_keyed AS (
  SELECT *, subject || '||' || regexp_replace(question, '^\s+|\s+$', '', 'g') AS content_key FROM pool_base),
pool AS (SELECT * FROM pool_keyed WHERE source <> 'src0'),
classified_pool AS (SELECT p.*, d.domain, d.difficulty FROM pool p JOIN subject_dim d USING (subject)),
original AS (
  SELECT printf('q%06d', doc_id) AS question_id, subject, domain, difficulty, question,
    choices[1] AS choice_A, choices[2] AS choice_B, choices[3] AS choice_C, choices[4] AS choice_D,
    answer AS answer_index, ['A','B','C','D'][answer + 1] AS answer_letter, 'original_180' AS bank_source,
    doc_id, content_key
  FROM pool_keyed JOIN subject_dim USING (subject) WHERE source = 'src0'),
disjoint_pool AS (
  SELECT * FROM classified_pool WHERE content_key NOT IN (SELECT content_key FROM original)),
supp_sample AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY domain, difficulty ORDER BY md5('43|' || CAST(doc_id AS VARCHAR)), doc_id)
      AS sample_rank FROM disjoint_pool) s WHERE sample_rank <= 40),
supplement AS (
  SELECT printf('s%04d', row_number() OVER (ORDER BY
      CASE domain WHEN 'STEM' THEN 1 WHEN 'Social_Science' THEN 2 WHEN 'Humanities' THEN 3 ELSE 4 END,
      CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END, sample_rank) - 1)
      AS question_id,
    subject, domain, difficulty, question,
    choices[1] AS choice_A, choices[2] AS choice_B, choices[3] AS choice_C, choices[4] AS choice_D,
    answer AS answer_index, ['A','B','C','D'][answer + 1] AS answer_letter, 'supplement_v2' AS bank_source,
    doc_id, sample_rank
  FROM supp_sample),
full_bank AS (
  SELECT question_id, subject, domain, difficulty, question, choice_A, choice_B, choice_C, choice_D,
         answer_index, answer_letter, bank_source FROM original
  UNION ALL
  SELECT question_id, subject, domain, difficulty, question, choice_A, choice_B, choice_C, choice_D,
         answer_index, answer_letter, bank_source FROM supplement)"""


CTES["f4"] = _f4_sql()
ORDER.append("f4")


def _pricing_values() -> str:
    from calibra.schemas import PRICING_PER_1M
    rows = [f"('{p}', '{m}', {r[0]!r}, {r[1]!r})" for p, ms in PRICING_PER_1M.items() for m, r in ms.items()]
    return ", ".join(rows)


CTES["f2"] = rf"""
calls AS (
  SELECT user_id AS run_id, event_id AS call_id, ts,
    CASE event_type WHEN 'click' THEN 'openai' WHEN 'view' THEN 'gemini' WHEN 'purchase' THEN 'anthropic'
      WHEN 'signup' THEN 'ollama' WHEN 'error' THEN 'acme' END AS provider,
    ['gpt-4o-mini', 'gemini-2.5-flash', 'unlisted-model'][CAST(event_id % 3 AS INTEGER) + 1] AS model,
    CAST(floor(value * 10) AS BIGINT) AS input_tokens,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens
  FROM events),
pricing AS (SELECT * FROM (VALUES {_pricing_values()}) t(provider, model, in_rate, out_rate)),
costed AS (
  SELECT c.*, (coalesce(input_tokens, 0) / 1000000.0) * coalesce(p1.in_rate, p2.in_rate, 1.0)
            + (coalesce(output_tokens, 0) / 1000000.0) * coalesce(p1.out_rate, p2.out_rate, 5.0) AS cost_usd
  FROM calls c
  LEFT JOIN pricing p1 ON lower(c.provider) = p1.provider AND c.model = p1.model
  LEFT JOIN pricing p2 ON lower(c.provider) = p2.provider AND p2.model = 'default')"""
ORDER.append("f2")

CTES["f3"] = r"""
attempts AS (
  SELECT cell_id, attempt, raw_response,
    nullif(upper(regexp_extract(raw_response, '(?i)ANSWER:\s*([A-D])', 1)), '') AS predicted_letter,
    CASE WHEN TRY_CAST(nullif(regexp_extract(raw_response, '(?i)CONFIDENCE:\s*(\d{1,3})', 1), '') AS INTEGER) <= 100
         THEN TRY_CAST(nullif(regexp_extract(raw_response, '(?i)CONFIDENCE:\s*(\d{1,3})', 1), '') AS INTEGER) END
      AS confidence,
    input_tokens, output_tokens, call_cost_usd, internal_prob_note
  FROM (
    SELECT l_orderkey AS cell_id,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey,
           l_extendedprice, l_quantity, l_shipdate) AS INTEGER) AS attempt,
      CASE WHEN l_tax < 0.04 AND l_linenumber % 2 = 1 THEN 'I am not able to answer this question.'
           ELSE 'ANSWER: ' || ['A','B','C','D'][CAST(l_partkey % 4 AS INTEGER) + 1] || chr(10) || 'CONFIDENCE: '
                || CAST(CAST(l_quantity * 2 AS INTEGER) AS VARCHAR) END AS raw_response,
      CAST(300 + CAST(l_quantity AS INTEGER) AS BIGINT) AS input_tokens,
      CAST(10 + l_linenumber * 5 AS BIGINT) AS output_tokens,
      CAST(l_extendedprice / 1000000 AS DOUBLE) AS call_cost_usd,
      CAST(NULL AS VARCHAR) AS internal_prob_note
    FROM lineitem) a),
attempts_3 AS (
  SELECT *, coalesce(predicted_letter IS NOT NULL AND confidence IS NOT NULL, false) AS parse_ok FROM attempts
  WHERE attempt <= 3)"""
ORDER.append("f3")

CTES["f5"] = r"""
f5_base AS (
  SELECT model_id, question_id, trial_index, l_linenumber AS ln, -l_discount * 10 AS lp,
    nullif(upper(regexp_extract(raw_response, '(?i)ANSWER:\s*([A-D])', 1)), '') AS L
  FROM raw_responses),
f5_parts AS (
  SELECT *, ' ' || coalesce(L, '?') AS sp_letter,
    ' ' || ['A','B','C','D'][((coalesce(list_position(['A','B','C','D'], L) - 1, 0) + 1) % 4) + 1] AS sp_other,
    CAST([] AS STRUCT(token VARCHAR, logprob DOUBLE)[]) AS no_top
  FROM f5_base),
f5_alts AS (
  SELECT *,
    [{'token': sp_letter, 'logprob': lp}, {'token': sp_other, 'logprob': lp - 1.5}] AS alts,
    [{'token': sp_letter, 'logprob': lp}, {'token': sp_other, 'logprob': lp - 1.5},
     {'token': sp_letter, 'logprob': lp - 0.5}] AS dup_alts,
    [{'token': 'ANSWER', 'logprob': -0.1, 'top_logprobs': no_top},
     {'token': ':', 'logprob': -0.01, 'top_logprobs': no_top}] AS head
  FROM f5_parts),
token_logprobs AS (
  SELECT model_id, question_id, trial_index, L AS predicted_letter,
    CASE
      WHEN ln = 2 THEN list_concat(head, [{'token': ' maybe', 'logprob': lp, 'top_logprobs': alts}])
      WHEN ln = 3 THEN list_concat(head, [{'token': sp_letter, 'logprob': lp, 'top_logprobs': alts},
                                          {'token': chr(10), 'logprob': -0.2, 'top_logprobs': no_top},
                                          {'token': coalesce(L, '?'), 'logprob': lp - 0.25, 'top_logprobs': alts}])
      WHEN ln = 4 THEN list_concat(head, [{'token': sp_letter, 'logprob': CAST(NULL AS DOUBLE), 'top_logprobs': alts}])
      WHEN ln = 5 THEN list_concat(head, [{'token': sp_letter, 'logprob': lp, 'top_logprobs': dup_alts}])
      WHEN ln = 6 THEN list_concat(head, [{'token': coalesce(L, '?') || 'n', 'logprob': lp - 2.0, 'top_logprobs': alts},
                                          {'token': sp_letter, 'logprob': lp, 'top_logprobs': alts}])
      WHEN ln = 7 THEN list_concat(head, [{'token': sp_letter, 'logprob': lp, 'top_logprobs': no_top}])
      ELSE list_concat(head, [{'token': sp_letter, 'logprob': lp, 'top_logprobs': alts}])
    END AS tokens
  FROM f5_alts)"""
ORDER.append("f5")
DEPS["f5"] = ["f1_raw"]

CTES["f6"] = r"""
payload_src AS (
  SELECT t.*, r.raw_response, r.input_tokens, r.output_tokens, r.l_linenumber AS line
  FROM token_logprobs t JOIN raw_responses r USING (model_id, question_id, trial_index)),
payloads AS (
  SELECT *, CASE WHEN model_id = 'R' THEN 'anthropic'
                 WHEN model_id = 'A' AND line IN (5, 6) THEN 'ollama'
                 WHEN model_id = 'A' THEN 'openai' ELSE 'gemini' END AS provider
  FROM payload_src)"""
ORDER.append("f6")
DEPS["f6"] = ["f5"]
