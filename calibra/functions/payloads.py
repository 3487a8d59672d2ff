"""Provider payload parsing (P14, P15): JSON text -> reply text, usage, tokens.

One explicit schema with the fields of all providers, parsed once with
``from_json`` and reshaped with higher-order functions; the provider column selects the
branch.  An aggregate-only average log-probability is *not* a token
probability: such rows get no tokens and a note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, L_, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


TOK = _st(("token", S), ("logprob", D))
OPENAI_TOKEN = _st(("token", S), ("logprob", D), ("top_logprobs", T.ArrayType(TOK)))
GEM_CAND = _st(("token", S), ("logProbability", D), ("logprob", D))
GEMINI_RESULT = _st(
    ("topCandidates", T.ArrayType(_st(("candidates", T.ArrayType(GEM_CAND))))),
    ("chosenCandidates", T.ArrayType(GEM_CAND)))
# the top-level fields of all providers; none has two meanings
PAYLOAD_SCHEMA = _st(
    # OpenAI
    ("choices", T.ArrayType(_st(("message", _st(("content", S))),
                                ("logprobs", _st(("content", T.ArrayType(OPENAI_TOKEN))))))),
    # OpenAI and Anthropic
    ("usage", _st(("prompt_tokens", L_), ("completion_tokens", L_), ("input_tokens", L_), ("output_tokens", L_))),
    # Anthropic
    ("content", T.ArrayType(_st(("type", S), ("text", S)))),
    # Gemini
    ("candidates", T.ArrayType(_st(
        ("content", _st(("parts", T.ArrayType(_st(("text", S), ("thought", B)))))),
        ("avgLogprobs", D), ("logprobsResult", GEMINI_RESULT)))),
    ("logprobsResult", GEMINI_RESULT),
    ("usageMetadata", _st(("promptTokenCount", L_), ("candidatesTokenCount", L_))),
    # Ollama
    ("response", S), ("prompt_eval_count", L_), ("eval_count", L_),
    ("logprobs", T.ArrayType(OPENAI_TOKEN)))

# Note texts for providers without per-token probabilities.
NOT_PER_TOKEN = "not available at per-token granularity for this model/API version"
OLLAMA_MISSING = ("Ollama logprobs requested but not returned (null/absent). "
                  "internal_prob_answer set to None.")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _some(arr: Column) -> Column:
    """NULL for an empty array."""
    return F.when(F.size(F.coalesce(arr, F.array())) > 0, arr)


def payload_text(df: DataFrame, provider_col: str = "provider", payload_col: str = "payload") -> DataFrame:
    """Reply text, token usage and error from a provider JSON payload.

    Anthropic: text parts joined; Gemini: non-thought parts joined; both
    stripped, and without text the call is an error.  OpenAI: first choice's
    message; Ollama: ``response``, whose absence is an error; both as sent.
    The payload is parsed once, into a column that the fields are read from.
    """
    df = df.withColumn("_p", F.from_json(payload_col, PAYLOAD_SCHEMA))
    p, prov = F.col("_p"), F.lower(F.col(provider_col))
    join = lambda arr: F.array_join(F.filter(arr, lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    anth = join(F.transform(F.filter(p["content"], lambda x: x["type"] == "text"), lambda x: x["text"]))
    gem = join(F.transform(F.filter(F.get(p["candidates"], 0)["content"]["parts"],
                                    lambda x: ~F.coalesce(x["thought"], F.lit(False))), lambda x: x["text"]))
    text = (F.when(prov == "anthropic", F.coalesce(_strip(anth), F.lit("")))
            .when(prov == "gemini", F.coalesce(_strip(gem), F.lit("")))
            .when(prov == "openai", F.coalesce(F.get(p["choices"], 0)["message"]["content"], F.lit("")))
            .when(prov == "ollama", p["response"]))
    inp = (F.when(prov == "anthropic", p["usage"]["input_tokens"]).when(prov == "openai", p["usage"]["prompt_tokens"])
           .when(prov == "gemini", p["usageMetadata"]["promptTokenCount"]).when(prov == "ollama", p["prompt_eval_count"]))
    out = (F.when(prov == "anthropic", p["usage"]["output_tokens"]).when(prov == "openai", p["usage"]["completion_tokens"])
           .when(prov == "gemini", p["usageMetadata"]["candidatesTokenCount"]).when(prov == "ollama", p["eval_count"]))
    df = df.withColumns({"text": text, "input_tokens": F.coalesce(inp, F.lit(0)).cast("bigint"),
                         "output_tokens": F.coalesce(out, F.lit(0)).cast("bigint")}).drop("_p")
    lost = F.col("text").isNull() | (prov.isin("anthropic", "gemini") & (F.col("text") == ""))
    return df.withColumn("error", F.when(lost, F.concat(prov, F.lit(": no text in the reply"))))


def normalize_logprobs(df: DataFrame, provider_col: str = "provider",
                       payload_col: str = "payload") -> DataFrame:
    """One token array shape for every provider.

    Adds ``tokens`` (array<struct<token, logprob, top_logprobs>>, NULL when
    the provider returned none), ``only_avg`` and ``logprob_note``.
    """
    df = df.withColumn("_p", F.from_json(payload_col, PAYLOAD_SCHEMA))
    p, prov = F.col("_p"), F.lower(F.col(provider_col))
    token = lambda x: F.coalesce(x["token"], F.lit("")).alias("token")
    none = F.array().cast(T.ArrayType(TOK))
    as_norm = lambda arr: F.transform(arr, lambda t: F.struct(
        token(t), t["logprob"].alias("logprob"),
        F.transform(F.coalesce(t["top_logprobs"], none), lambda x: F.struct(token(x), x["logprob"].alias("logprob")))
        .alias("top_logprobs")))
    cand0 = F.get(p["candidates"], 0)
    # the chosen tokens, else the first of each position's candidates
    held = cand0["logprobsResult"].isNotNull()
    of = lambda f: F.when(held, _some(cand0["logprobsResult"][f])).otherwise(_some(p["logprobsResult"][f]))
    chosen = F.transform(of("chosenCandidates"), lambda c: F.struct(
        token(c), F.coalesce(c["logProbability"], c["logprob"]).alias("logprob"), none.alias("top_logprobs")))
    firsts = F.transform(F.filter(of("topCandidates"), lambda pos: F.size(F.coalesce(pos["candidates"], F.array())) > 0),
                         lambda pos: F.struct(
                             token(F.get(pos["candidates"], 0)), F.get(pos["candidates"], 0)["logProbability"].alias("logprob"),
                             F.transform(pos["candidates"], lambda c: F.struct(token(c), c["logProbability"].alias("logprob")))
                             .alias("top_logprobs")))
    tokens = (F.when(prov == "openai", as_norm(F.get(p["choices"], 0)["logprobs"]["content"]))
              .when(prov == "ollama", as_norm(_some(p["logprobs"])))
              .when(prov == "gemini", F.coalesce(chosen, _some(firsts))))
    df = df.withColumns({"tokens": tokens, "_avg": cand0["avgLogprobs"]}).drop("_p")
    bare = (prov == "gemini") & F.col("tokens").isNull()
    only_avg = bare & F.col("_avg").isNotNull()
    note = (F.when(only_avg, F.format_string(NOT_PER_TOKEN + " (avgLogprobs=%s)", F.col("_avg").cast("string")))
            .when(bare, F.lit(NOT_PER_TOKEN))
            .when((prov == "ollama") & F.col("tokens").isNull(), F.lit(OLLAMA_MISSING)))
    return df.withColumns({"only_avg": only_avg, "logprob_note": note}).drop("_avg")
