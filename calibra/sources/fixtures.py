"""Deterministic calibration inputs derived from the driver tables.

The study's own raw logs are not distributed, so every operator runs on
views that Spark derives from the driver tables (``lineitem``, ``part``,
``events``, ``documents``).  Their work grows with those tables.

F1 ``responses``       lineitem x part: one scored reply per lineitem row
F2 ``calls``           events: a spend ledger of API calls
F3 ``attempts``        lineitem: up to three parse attempts per order
F4 ``pool``/``original``  documents: a question pool and an original bank
F5 ``token_logprobs``  F1: per-reply token log-probabilities
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.functions import parsing
from calibra.functions.windows import segmented_row_number
from calibra.session import ship_package
from calibra.schemas import DOMAIN_SUBJECTS, LETTERS

# Configured model order of the fixture: non-alphabetical on purpose.
FIXTURE_MODELS = ["R", "A", "N"]
FIXTURE_BACKEND = {"R": "anthropic", "A": "openai", "N": "gemini"}
FIXTURE_MODEL_NAME = {"R": "claude-haiku", "A": "gpt-4o-mini", "N": "gemini-2.5-flash"}
EVENT_PROVIDER = {"click": "openai", "view": "gemini", "purchase": "anthropic",
                  "signup": "ollama", "error": "acme"}
EVENT_MODEL_BY_MOD3 = ["gpt-4o-mini", "gemini-2.5-flash", "unlisted-model"]
# Pool subjects: every configured subject in sorted order, then two subjects
# outside the configuration (dropped by the classification join).
POOL_SUBJECTS = sorted({s for subs in DOMAIN_SUBJECTS.values() for s in subs}) + [
    "anatomy", "virology"]
REFUSAL_TEXT = "I am not able to answer this question."
ORDER_BUCKET = 100_000  # order keys per numbering bucket
PROSE_PREFIX = "Let me think this through step by step."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _letter(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LETTERS]), (idx + 1).cast("int"))


def _case(col: Column, mapping: dict, default=None) -> Column:
    items = list(mapping.items())
    expr = F.when(col == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 before parsing: one reply per lineitem row (v2 record layout)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # trial number = position of the row within its (part, model) cell; a
    # segmented row number, so a part holding a third of all rows is
    # numbered by many tasks (buckets of order keys) rather than one
    li = segmented_row_number(
        li, ["l_partkey", "l_returnflag"],
        ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"],
        F.floor(F.col("l_orderkey") / ORDER_BUCKET), out="_trial")
    j = li.join(part, li.l_partkey == part.p_partkey)
    b = F.substring("p_brand", 7, 10).try_cast("int")
    ans = (F.col("l_partkey") % 4).cast("int")
    sent = F.when(F.col("l_linestatus") == "F", ans).otherwise(
        ((F.col("l_partkey") + 1 + F.col("l_suppkey") % 3) % 4).cast("int"))
    letter = _letter(sent)
    conf = (F.col("l_quantity") * 2).cast("int").cast("string")
    low_tax = F.col("l_tax") < 0.015
    ln = F.col("l_linenumber")
    # The reply is assembled from small parts so the letter expression occurs
    # once (the parse later references the reply several times).
    refusal = low_tax & (ln == 5)
    prefix = (F.when(refusal, F.lit(REFUSAL_TEXT)).when(ln == 2, F.lit("answer:"))
              .when(ln == 3, F.lit(PROSE_PREFIX + "\n\nANSWER: ")).otherwise(F.lit("ANSWER: ")))
    letter_part = F.when(refusal, F.lit("")).when(ln == 2, F.lower(letter)).otherwise(letter)
    mid = (F.when(refusal, F.lit("")).when(ln == 2, F.lit(" confidence:"))
           .otherwise(F.lit("\nCONFIDENCE: ")))
    conf_part = (F.when(refusal, F.lit("")).when(low_tax & (ln == 6), F.lit("150"))
                 .when(low_tax & (ln == 7), F.lit("1000")).otherwise(conf))
    suffix = F.when(ln == 3, F.lit("%")).otherwise(F.lit(""))
    reply = F.concat(prefix, letter_part, mid, conf_part, suffix)
    top_tax = F.col("l_tax") == 0.08
    model = F.col("l_returnflag")
    return j.select(
        F.when(top_tax & (ln == 7), F.lit("v1")).otherwise(F.lit("v2")).alias("config_version"),
        F.when(top_tax & (ln == 6), F.lit(None).cast("int"))
        .when(top_tax & (ln == 5), F.lit(512)).otherwise(F.lit(1024)).alias("max_output_tokens"),
        F.lit(0.3).alias("temperature"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("original_180"))
        .otherwise(F.lit("supplement_v2")).alias("bank_source"),
        F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("question_id"),
        F.col("p_brand").alias("subject"),
        _case(b % 3, {0: "STEM", 1: "Social_Science", 2: "Humanities"}).alias("domain"),
        _case(F.floor(b / 3) % 3, {0: "easy", 1: "medium", 2: "hard"}).alias("difficulty"),
        model.alias("model_id"),
        _case(model, FIXTURE_BACKEND).alias("backend"),
        _case(model, FIXTURE_MODEL_NAME).alias("model_name"),
        (F.col("_trial") - 1).cast("int").alias("trial_index"),
        F.col("l_shipdate").alias("collection_timestamp"),
        reply.alias("raw_response"),
        _letter(ans).alias("correct_letter"),
        ans.alias("answer_index"),
        F.when(model == "R", F.col("l_discount") * 10).alias("internal_prob_answer"),
        (300 + ln * 10 + F.col("l_quantity").cast("int")).cast("int").alias("input_tokens"),
        (20 + F.col("l_quantity").cast("int") * 2).cast("int").alias("output_tokens"),
        F.lit(None).cast("string").alias("error"),
        # provenance columns used by the logprob fixture
        ln.alias("l_linenumber"),
        F.col("l_discount").alias("l_discount"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: scored responses (reply parsed, correctness decided)."""
    from calibra.operators.scoring import score_responses
    return score_responses(raw_responses(spark, sf_dir).drop("l_linenumber", "l_discount"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call ledger from events (run = user, call = event)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("call_id"),
        F.col("ts").alias("ts"),
        _case(F.col("event_type"), EVENT_PROVIDER).alias("provider"),
        F.element_at(F.array(*[F.lit(m) for m in EVENT_MODEL_BY_MOD3]),
                     (F.col("event_id") % 3 + 1).cast("int")).alias("model"),
        F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("output_tokens"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parse attempts, cell = order, attempt = line position."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    letter = _letter((F.col("l_partkey") % 4).cast("int"))
    conf = (F.col("l_quantity") * 2).cast("int").cast("string")
    # every second line fails to parse when the tax is low: retries matter
    reply = F.when((F.col("l_tax") < 0.04) & (F.col("l_linenumber") % 2 == 1),
                   F.lit(REFUSAL_TEXT)).otherwise(
        F.concat(F.lit("ANSWER: "), letter, F.lit("\nCONFIDENCE: "), conf))
    p = parsing.parse_reply(reply)
    return li.select(
        F.col("l_orderkey").alias("cell_id"),
        F.row_number().over(w).cast("int").alias("attempt"),
        reply.alias("raw_response"),
        p["predicted_letter"].alias("predicted_letter"),
        p["confidence"].alias("confidence"),
        p["parse_ok"].alias("parse_ok"),
        (300 + F.col("l_quantity").cast("int")).cast("bigint").alias("input_tokens"),
        (10 + F.col("l_linenumber") * 5).cast("bigint").alias("output_tokens"),
        (F.col("l_extendedprice") / 1_000_000).cast("double").alias("call_cost_usd"),
        F.lit(None).cast("string").alias("internal_prob_note"),
    )


def _pool_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    subj = F.element_at(F.array(*[F.lit(s) for s in POOL_SUBJECTS]),
                        (F.col("n_chars") % len(POOL_SUBJECTS) + 1).cast("int"))
    return docs.select(
        "doc_id", "source", "lang",
        F.col("text").alias("question"),
        subj.alias("subject"),
        F.array(F.concat(F.lit("lang:"), F.col("lang")),
                F.concat(F.lit("source:"), F.col("source")),
                F.concat(F.lit("chars:"), F.col("n_chars").cast("string")),
                F.concat(F.lit("id:"), F.col("doc_id").cast("string"))).alias("choices"),
        (F.col("doc_id") % 4).cast("int").alias("answer"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus pool = every document outside source ``src0``."""
    return _pool_base(spark, sf_dir).filter(F.col("source") != "src0")


def original_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the frozen original bank = documents of source ``src0``, flattened."""
    from calibra.operators.bank import classify_pool, flatten_choices
    base = _pool_base(spark, sf_dir).filter(F.col("source") == "src0")
    flat = flatten_choices(classify_pool(base, spark))
    return flat.select(
        F.format_string("q%06d", F.col("doc_id")).alias("question_id"),
        "subject", "domain", "difficulty", "question",
        "choice_A", "choice_B", "choice_C", "choice_D", "answer_index", "answer_letter",
        F.lit("original_180").alias("bank_source"))


def token_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token log-probabilities per reply; shape varies by line number.

    1 normal, 2 no matching token, 3 two matches, 4 matched token without
    logprob, 5 duplicate alternative token, 6 a two-letter token first,
    7 empty alternatives.
    """
    tok = lambda t, l, top: F.struct(t.alias("token"), l.cast("double").alias("logprob"),
                                     top.alias("top_logprobs"))
    alt = lambda t, l: F.struct(t.alias("token"), l.cast("double").alias("logprob"))
    no_top = F.array().cast("array<struct<token:string,logprob:double>>")
    # the letter, then what is built from it, each worked out once a row
    r = raw_responses(spark, sf_dir).withColumn("_letter", parsing.answer_letter("raw_response")).withColumn("_lp", -F.col("l_discount") * 10)
    letter, lp = F.col("_letter"), F.col("_lp")
    sp_other = F.concat(F.lit(" "), _letter(((F.coalesce(parsing.letter_to_index(letter), F.lit(0)) + 1) % 4).cast("int")))
    r = r.withColumns({"_bare": F.coalesce(letter, F.lit("?")), "_sp": F.concat(F.lit(" "), F.coalesce(letter, F.lit("?"))), "_sp_other": sp_other})
    bare, sp_letter = F.col("_bare"), F.col("_sp")
    ln = F.col("l_linenumber")
    two = F.array(alt(sp_letter, lp), alt(F.col("_sp_other"), lp - 1.5))
    r = r.withColumn("_alts", F.when(ln == 5, F.concat(two, F.array(alt(sp_letter, lp - 0.5)))).when(ln == 7, no_top).otherwise(two))
    alts = F.col("_alts")
    head = F.array(tok(F.lit("ANSWER"), F.lit(-0.1), no_top), tok(F.lit(":"), F.lit(-0.01), no_top))
    arr = F.concat(head, (
        F.when(ln == 2, F.array(tok(F.lit(" maybe"), lp, alts)))
        .when(ln == 3, F.array(tok(sp_letter, lp, alts), tok(F.lit("\n"), F.lit(-0.2), no_top), tok(bare, lp - 0.25, alts)))
        .when(ln == 4, F.array(tok(sp_letter, F.lit(None), alts)))
        .when(ln == 6, F.array(tok(F.concat(bare, F.lit("n")), lp - 2.0, alts), tok(sp_letter, lp, alts)))
        .otherwise(F.array(tok(sp_letter, lp, alts)))))
    return r.select("model_id", "question_id", "trial_index",
                    letter.alias("predicted_letter"), arr.alias("tokens"), "raw_response",
                    "input_tokens", "output_tokens", F.col("l_linenumber").alias("line"))


GEMINI_AVG_LOGPROB = -0.25


def provider_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider JSON payloads built from F1 replies and F5 token arrays.

    R -> Anthropic content parts; A -> OpenAI choices with token logprobs
    (line 6: Ollama shape, line 5: Ollama without logprobs); N -> Gemini
    parts with a thought part and both candidate lists, whose chosen tokens
    differ from the most likely ones (line 4: chosenCandidates alone, line 3:
    topCandidates alone, line 6: the result at top level, with the short key,
    line 7: only an average log-probability).  Texts are padded with blanks;
    line 2 has an empty text.
    """
    m = F.col("model_id")
    t = token_logprobs(spark, sf_dir).withColumn("provider", F.when(m == "R", F.lit("anthropic"))
                                                 .when((m == "A") & F.col("line").isin(5, 6), F.lit("ollama"))
                                                 .when(m == "A", F.lit("openai")).otherwise(F.lit("gemini")))
    toks, ln = F.col("tokens"), F.col("line")
    reply = F.when(ln == 2, F.lit("")).otherwise(F.concat(F.lit("  "), F.col("raw_response"), F.lit(" \n")))
    inp, out = F.col("input_tokens").cast("long"), F.col("output_tokens").cast("long")
    anthropic = F.to_json(F.struct(
        F.array(F.struct(F.lit("thinking").alias("type"), F.lit("scratch").alias("text")),
                F.struct(F.lit("text").alias("type"), reply.alias("text"))).alias("content"),
        F.struct(inp.alias("input_tokens"), out.alias("output_tokens")).alias("usage")))
    openai = F.to_json(F.struct(
        F.array(F.struct(F.struct(reply.alias("content")).alias("message"),
                         F.struct(toks.alias("content")).alias("logprobs"))).alias("choices"),
        F.struct(inp.alias("prompt_tokens"), out.alias("completion_tokens")).alias("usage")))
    ollama = F.to_json(F.struct(reply.alias("response"), inp.alias("prompt_eval_count"),
                                out.alias("eval_count"),
                                F.when(ln != 5, toks).alias("logprobs")))
    cand = lambda tk, lp: F.struct(tk.alias("token"), lp.alias("logProbability"))
    short = lambda tk, lp: F.struct(tk.alias("token"), lp.alias("logprob"))
    # the most likely token of each position is not the one that was chosen
    top = F.transform(toks, lambda x: F.struct(F.concat(
        F.array(cand(F.lit("?"), F.lit(-0.05))),
        F.transform(x["top_logprobs"], lambda a: cand(a["token"], a["logprob"]))).alias("candidates")))
    chosen = F.transform(toks, lambda x: cand(x["token"], x["logprob"]))
    lpr = F.when(~ln.isin(6, 7), F.struct(F.when(ln != 4, top).alias("topCandidates"),
                                          F.when(ln != 3, chosen).alias("chosenCandidates")))
    lpr_top = F.when(ln == 6, F.struct(F.transform(toks, lambda x: short(x["token"], x["logprob"])).alias("chosenCandidates")))
    gemini = F.to_json(F.struct(
        F.array(F.struct(
            F.struct(F.array(F.struct(F.lit("Thinking it over.").alias("text"), F.lit(True).alias("thought")),
                             F.struct(reply.alias("text"), F.lit(None).cast("boolean").alias("thought")))
                     .alias("parts")).alias("content"),
            F.lit(GEMINI_AVG_LOGPROB).alias("avgLogprobs"),
            lpr.alias("logprobsResult"))).alias("candidates"),
        lpr_top.alias("logprobsResult"),
        F.struct(inp.alias("promptTokenCount"), out.alias("candidatesTokenCount")).alias("usageMetadata")))
    provider = F.col("provider")
    payload = (F.when(provider == "anthropic", anthropic).when(provider == "openai", openai)
               .when(provider == "ollama", ollama).otherwise(gemini))
    return t.select("model_id", "question_id", "trial_index", "provider",
                    payload.alias("payload"))


def freeform_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form (unconstrained) replies for the same cells as F1.

    By line number: 1 labelled answer, 2 lower-case label (fallback search),
    3 prose ending in the letter, 4 only the article "a", 5 no letter,
    6 label then a later letter, 7 label with a lower-case letter.
    """
    r = raw_responses(spark, sf_dir)
    sent = parsing.answer_letter("raw_response")
    x = F.coalesce(sent, F.lit("B"))
    ln = F.col("l_linenumber")
    text = (
        F.when(ln == 1, F.concat(F.lit("Reasoning about option "), x, F.lit(".\nFINAL_ANSWER: "), x))
        .when(ln == 2, F.concat(F.lit("final_answer: "), F.lower(x)))
        .when(ln == 3, F.concat(F.lit("I think it is a tough one; my pick is "), x, F.lit(".")))
        .when(ln == 4, F.lit("It is a hard question."))
        .when(ln == 5, F.lit("No idea."))
        .when(ln == 6, F.concat(F.lit("FINAL_ANSWER: "), x, F.lit("\nActually maybe B")))
        .otherwise(F.concat(F.lit("FINAL_ANSWER:"), F.lower(x)))
    )
    return r.select("model_id", "question_id", "trial_index", "difficulty", "correct_letter",
                    "answer_index", "raw_response", text.alias("freeform_reply"))
