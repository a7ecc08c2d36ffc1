"""Model-backed operators (K1-K8) with pluggable models.

A model is a plain Python callable supplied by the caller (embedder:
``list[str] -> array (n, dims)``; text model: ``list[str] -> list[str]``;
moderator: ``list[str] -> list[bool]``). The operators run it as a scalar
Arrow UDF over the one input column (other columns stay in the JVM): the model
is built once per Python worker by its factory, called once per Arrow batch
(batched like the reference's batch embedding calls), retried with backoff
inside the task, and — if a batch still fails — Spark's task retry takes over. Rows a model cannot serve (NULL
or wrong-length vectors) are flagged, never written to gold.

Deterministic local models are provided for tests and for the registered
queries: a hashed character-trigram embedder, an echo text model and a rule
moderator.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.slices import trim
from quarry.session import materialize

RETRY_ATTEMPTS = 3
RETRY_WAIT = (1.0, 20.0)  # random exponential backoff bounds, seconds


def with_retries(fn: Callable, attempts: int = RETRY_ATTEMPTS, wait=RETRY_WAIT, sleep=time.sleep):
    def run(*a, **k):
        for i in range(attempts):
            try:
                return fn(*a, **k)
            except Exception:  # noqa: BLE001
                if i == attempts - 1:
                    raise
                sleep(min(wait[1], wait[0] * (2 ** i) * random.uniform(1.0, 2.0)))
    return run


# ------------------------------------------------------------------ local models
class HashingEmbedder:
    """Deterministic embedder: signed hashed character trigrams, L2-normalised.

    Vectorised per text with numpy: code points -> rolling trigram hash ->
    ``bincount`` into ``dims`` buckets with a hash-derived sign."""

    MULT = np.uint64(0x9E3779B1)

    def __init__(self, dims: int = 64):
        self.dims = dims

    def _one(self, t: str) -> np.ndarray:
        cp = np.frombuffer(f"  {t} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        if cp.size < 3:
            return np.zeros(self.dims, dtype=np.float64)
        h = (cp[:-2] * np.uint64(1_000_003) + cp[1:-1]) * np.uint64(1_000_003) + cp[2:]
        h = (h * self.MULT) & np.uint64(0xFFFFFFFF)
        idx = (h % np.uint64(self.dims)).astype(np.int64)
        sign = np.where((h >> np.uint64(16)) & np.uint64(1), 1.0, -1.0)
        return np.bincount(idx, weights=sign, minlength=self.dims)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for r, t in enumerate(texts):
            v = self._one(t or "")
            n = np.linalg.norm(v)
            out[r] = v / n if n > 0 else v
        return out


class EchoModel:
    """Text model that answers with the text after the last blank line, trimmed."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [(p or "").split("\n\n")[-1].strip() for p in prompts]


# The rule moderator's word list.
BLOCKED_WORDS = ["idiot", "moron", "clown", "worthless", "stupid", "loser", "pathetic"]
BLOCKED_PATTERN = "(?i)\\b(" + "|".join(BLOCKED_WORDS) + ")\\b"


def rule_flagged(text) -> Column:
    """K6 default: the rule moderator as a native expression."""
    t = text if isinstance(text, Column) else F.col(text)
    return F.coalesce(t.rlike(BLOCKED_PATTERN), F.lit(False))


# ------------------------------------------------------------------ K1 batch embed
_MODELS: dict = {}


def model_key() -> str:
    """A name for the models of one UDF; never given twice."""
    return uuid.uuid4().hex


def _model(key, factory):
    """One model instance per Python worker process (workers are reused across tasks)."""
    m = _MODELS.get(key)
    if m is None:
        m = _MODELS[key] = factory()
    return m


def _isolated(model: Callable, texts: list) -> tuple[list, list]:
    """(answers, errors) per text. The whole batch is tried with retries; if it still fails it
    is halved until the texts that fail alone are found, and the others keep their answers."""
    out, err = [None] * len(texts), [None] * len(texts)

    def solve(lo: int, hi: int, call: Callable) -> None:
        try:
            got = call(texts[lo:hi])
        except Exception as ex:  # noqa: BLE001
            if hi - lo == 1:
                err[lo] = str(ex) or type(ex).__name__
                return
            mid = (lo + hi) // 2
            solve(lo, mid, model)
            solve(mid, hi, model)
            return
        for i in range(lo, hi):
            out[i] = None if got is None or i - lo >= len(got) else got[i - lo]

    if texts:
        solve(0, len(texts), with_retries(model))
    return out, err


def embed(df: DataFrame, text_col: str, dims: int,
          embedder_factory: Callable[[], Callable] = None, out_col: str = "embedding", key: str | None = None) -> DataFrame:
    """K1: adds ``out_col`` (array<float>) and ``embed_error`` (NULL when fine). Calls with one
    ``key`` (of one factory and ``dims``) share the model of a worker.

    A scalar Arrow UDF over the text column only: the other columns of the row stay
    in the JVM. Marked non-deterministic so the optimizer never evaluates it twice
    (e.g. once more inside a pushed-down filter on ``embed_error``)."""
    factory = embedder_factory or (lambda: HashingEmbedder(dims))
    key = key or model_key()
    rtype = T.StructType([T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("e", T.StringType())])

    def one(texts: pa.Array) -> pa.Array:
        model = _model(key, factory)
        t = texts.to_pylist()
        vecs = [None] * len(t)
        errs = [None if x else "empty text" for x in t]
        idx = [i for i, x in enumerate(t) if x]
        if idx:
            m, bad = _isolated(model, [t[i] for i in idx])
            for j, i in enumerate(idx):
                v = m[j]
                if bad[j] is not None:
                    errs[i] = bad[j]
                elif v is None or len(v) != dims or not np.all(np.isfinite(np.asarray(v, dtype=np.float64))):
                    errs[i] = "invalid vector"
                else:
                    vecs[i] = np.asarray(v, dtype=np.float32)
        return pa.StructArray.from_arrays([pa.array(vecs, pa.list_(pa.float32())), pa.array(errs, pa.string())], ["v", "e"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield one(texts)
        finally:
            trim()

    udf = F.arrow_udf(run, rtype).asNondeterministic()
    tmp = "_emb_" + out_col
    return (df.withColumn(tmp, udf(F.col(text_col)))
            .withColumn(out_col, F.col(tmp)["v"]).withColumn("embed_error", F.col(tmp)["e"]).drop(tmp))


def cls_pool(tokens) -> Column:
    """K2: first token vector of the first sequence of ``array<array<array<float>>>``."""
    t = tokens if isinstance(tokens, Column) else F.col(tokens)
    return F.try_element_at(F.try_element_at(t, F.lit(1)), F.lit(1))


# ------------------------------------------------------------------ text models
def apply_text_model(df: DataFrame, prompt_col: str, out_col: str,
                     model_factory: Callable[[], Callable] = EchoModel) -> DataFrame:
    """Runs a text model over a prompt column (K4/K5): answer trimmed, a failing batch
    flagged in ``<out_col>_error``. A null prompt is not sent to the model. Scalar Arrow UDF
    over the prompt column only; non-deterministic for the optimizer, so the model is called
    once per row."""
    key = model_key()
    rtype = T.StructType([T.StructField("a", T.StringType()), T.StructField("e", T.StringType())])

    def run(prompts: pd.Series) -> pd.DataFrame:
        model = _model(key, model_factory)
        at = [i for i, p in enumerate(prompts.tolist()) if p is not None]
        ans, err = [None] * len(prompts), [None] * len(prompts)
        got, bad = _isolated(model, [prompts.iloc[i] for i in at])
        for j, i in enumerate(at):
            ans[i] = None if got[j] is None else str(got[j]).strip()
            err[i] = bad[j]
        return pd.DataFrame({"a": ans, "e": err})

    udf = F.pandas_udf(run, rtype).asNondeterministic()
    tmp = "_tm_" + out_col
    return (df.withColumn(tmp, udf(F.col(prompt_col)))
            .withColumn(out_col, F.col(tmp)["a"]).withColumn(out_col + "_error", F.col(tmp)["e"]).drop(tmp))


def moderate(df: DataFrame, text_col: str, model_factory: Callable[[], Callable] | None = None) -> DataFrame:
    """K6: adds ``flagged`` and ``moderation_error``. Without a model the native rule moderator is
    used; a model runs as a scalar Arrow UDF over the text column. A null text is not flagged and
    not sent. A text that the model fails on, alone, has its error and no flag (J8)."""
    if model_factory is None:
        return df.withColumn("flagged", rule_flagged(text_col)).withColumn("moderation_error", F.lit(None).cast("string"))
    key = model_key()

    def run(texts: pd.Series) -> pd.DataFrame:
        at = [i for i, t in enumerate(texts.tolist()) if t is not None]
        flag, err = [False] * len(texts), [None] * len(texts)
        got, bad = _isolated(_model(key, model_factory), [texts.iloc[i] for i in at])
        for i, x, e in zip(at, got, bad):
            flag[i], err[i] = None if e is not None else bool(x), e
        return pd.DataFrame({"f": pd.Series(flag, dtype=object), "e": pd.Series(err, dtype=object)})

    udf = F.pandas_udf(run, "f boolean, e string").asNondeterministic()
    return df.withColumn("_m", udf(F.col(text_col))).withColumns({"flagged": F.col("_m.f"), "moderation_error": F.col("_m.e")}).drop("_m")


VIOLATION_CODE = 200
VIOLATION_ERROR = 4019
FAILURE_CODE = 500


def moderation_gate(df: DataFrame, text_col: str, model_factory=None) -> tuple[DataFrame, DataFrame]:
    """Split into (passed, stopped). Violations carry code 200 / error 4019. A text whose
    moderation failed does not pass: it is stopped with code 500 and its ``moderation_error``."""
    m = moderate(df, text_col, model_factory)
    if model_factory is not None:
        m = materialize(m)  # both sides read it: the model runs once
    failed = F.col("moderation_error").isNotNull()
    passed = m.where(~failed & ~F.col("flagged")).drop("flagged", "moderation_error")
    stopped = (m.where(failed | F.col("flagged")).withColumn("code", F.when(failed, FAILURE_CODE).otherwise(VIOLATION_CODE))
               .withColumn("error_code", F.when(~failed, F.lit(VIOLATION_ERROR))).drop("flagged"))
    return passed, stopped


# ------------------------------------------------------------------ prompts
# Default prompt templates per authoring operation (kind, system, user).
# Deployments load their own templates as a table with the same columns.
DEFAULT_TEMPLATES = [
    ("fix-grammar", "completion", None, "Correct spelling and grammar; keep text between # as is:\n\n{{text}}"),
    ("summarize", "chat", "You shorten texts.", "Summarize:\n\n{{text}}"),
    ("summarize-into-steps", "chat", "You turn texts into steps.", "Summarize into steps:\n\n{{text}}"),
    ("change-tone", "chat", "You rewrite tone.", "Rewrite in a {{tone}} tone:\n\n{{text}}"),
    ("translate", "chat", "You translate.", "Translate into {{language}}:\n\n{{text}}"),
    ("improve-writing", "chat", "You improve writing.", "Improve:\n\n{{text}}"),
    ("reduce-reading-complexity", "chat", "You simplify.", "Simplify:\n\n{{text}}"),
    ("reduce-reading-time", "chat", "You shorten reading time.", "Make quicker to read:\n\n{{text}}"),
    ("expand-writing", "chat", "You expand texts.", "Expand:\n\n{{text}}"),
]
SUMMARY_TEMPLATE = "Question: {{question}}\n\n{{context}}"
NO_CONTEXT_ANSWER = "There is no context to answer this question."
TEMPLATE_SCHEMA = "operation string, kind string, system string, user string"


def templates(spark) -> DataFrame:
    """The template table (nine rows)."""
    return spark.createDataFrame(DEFAULT_TEMPLATES, TEMPLATE_SCHEMA)


def render_prompts(requests: DataFrame, tmpl: DataFrame) -> DataFrame:
    """Completion templates get ``{{text}}`` replaced in the prompt; chat templates
    in the last (user) message, then ``{{tone}}`` / ``{{language}}``. Adds ``messages``
    (array<struct<role, content>>) and ``prompt`` (the text sent to a text model)."""
    user = F.col("user")
    for k in ("text", "tone", "language"):
        user = F.replace(user, F.lit("{{" + k + "}}"), F.coalesce(F.col(k), F.lit("")))
    completion = F.replace(F.col("user"), F.lit("{{text}}"), F.coalesce(F.col("text"), F.lit("")))
    msg = F.when(F.col("kind") == "chat", F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content"))))
    prompt = F.when(F.col("kind") == "chat", user).otherwise(completion)
    return (requests.join(F.broadcast(tmpl), "operation", "left")  # nine rows: bounded
            .withColumn("messages", msg).withColumn("prompt", prompt)
            .drop("kind", "system", "user"))


def _json_str(c: Column) -> Column:
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def author(requests: DataFrame, tmpl: DataFrame, model_factory=EchoModel, moderator_factory=None) -> DataFrame:
    """K5 + K6 + K7: one authoring chain per request (request_id, operation, text,
    tone, language). Chains are (operation, moderation), except translate which is
    (moderation, translate). Returns per request: output (NULL on violation),
    status, error_code, steps (1 or 2) and the usage-log rows of the executed steps
    (K8) as ``log`` (array of two structs at most)."""
    r = render_prompts(requests, tmpl)
    is_tr = F.col("operation") == "translate"
    # translate: moderation of the input first; the model only runs when it passes
    # (a null input is not sent to a model, so every step is one pass over all requests)
    def checked(df: DataFrame, col: str, name: str) -> DataFrame:  # what cannot be moderated does not pass
        m = moderate(df, col, moderator_factory)
        return m.withColumn(name, F.coalesce("flagged", F.lit(True))).withColumnRenamed("moderation_error", name + "_error").drop("flagged")

    pre = checked(r.withColumn("_mod_in", F.when(is_tr, F.col("text"))), "_mod_in", "_pre_flag")
    sent = pre.withColumn("_sent", F.when(~is_tr | ~F.col("_pre_flag"), F.coalesce("prompt", F.lit(""))))
    both = apply_text_model(sent, "_sent", "answer", model_factory)
    post = checked(both.withColumn("_mod_out", F.when(~is_tr, F.col("answer"))), "_mod_out", "_post_flag")
    violation = F.when(is_tr, F.col("_pre_flag")).otherwise(F.col("_post_flag"))
    chain_id = F.concat(F.lit("chain-"), F.col("request_id").cast("string"))  # deterministic per request

    def log(op, prompt, inp, out):
        return F.struct(op.alias("operation"), prompt.alias("prompt"), _json_str(inp).alias("input"),
                        out.alias("output"))

    mod_out = lambda flag: F.when(flag, F.lit('"true"')).otherwise(F.lit('"false"'))
    op_log = log(F.col("operation"), F.to_json(F.coalesce(F.col("messages"), F.array(F.struct(
        F.lit("user").alias("role"), F.col("prompt").alias("content"))))), F.col("text"), _json_str(F.col("answer")))
    logs = F.when(is_tr & F.col("_pre_flag"), F.array(log(F.lit("moderation"), F.lit(None).cast("string"),
                                                          F.col("text"), mod_out(F.col("_pre_flag")))))
    logs = logs.when(is_tr, F.array(log(F.lit("moderation"), F.lit(None).cast("string"), F.col("text"),
                                        mod_out(F.col("_pre_flag"))), op_log))
    logs = logs.otherwise(F.array(op_log, log(F.lit("moderation"), F.lit(None).cast("string"),
                                              F.col("answer"), mod_out(F.col("_post_flag")))))
    return post.select(
        "request_id", "operation", chain_id.alias("chain_id"),
        F.when(violation, F.lit(None).cast("string")).otherwise(F.col("answer")).alias("output"),
        F.when(violation, F.lit("violation")).otherwise(F.lit("ok")).alias("status"),
        F.when(violation, F.lit(VIOLATION_ERROR)).alias("error_code"),
        F.size(logs).alias("steps"), logs.alias("log"))


def usage_rows(chains: DataFrame, audit: dict | None = None) -> DataFrame:
    """K8 + A12: one usage-log row per executed chain step."""
    audit = audit or {}
    x = chains.select("chain_id", F.col("operation").alias("chain_operation"),
                      F.posexplode("log").alias("step", "l"))
    x = x.withColumn("step", F.col("step").cast("int"))
    return x.select(
        F.xxhash64("chain_id", "step").alias("id"), F.col("l.operation").alias("operation"),
        F.col("l.prompt").alias("prompt"), F.col("l.input").alias("input"),
        F.lit(None).cast("string").alias("response"), F.col("l.output").alias("output"),
        "chain_id", "chain_operation", "step",
        F.lit(audit.get("user_id")).cast("long").alias("user_id"),
        F.lit(audit.get("org_id")).cast("int").alias("org_id"),
        F.lit(audit.get("project_id")).cast("long").alias("project_id"))


def summarize_answers(contexts: DataFrame, model_factory=EchoModel, template: str = SUMMARY_TEMPLATE) -> DataFrame:
    """K4: (query_id, question, context, n_options) -> answer; no options gives the
    fixed no-context message without calling the model."""
    prompt = F.replace(F.replace(F.lit(template), F.lit("{{context}}"), F.coalesce("context", F.lit(""))),
                       F.lit("{{question}}"), F.coalesce("question", F.lit("")))
    has = F.coalesce(F.col("n_options"), F.lit(0)) > 0
    withp = contexts.withColumn("prompt", prompt).withColumn("_sent", F.when(has, F.col("prompt")))
    answered = apply_text_model(withp, "_sent", "answer", model_factory)
    return answered.withColumn("answer", F.when(has, F.col("answer")).otherwise(F.lit(NO_CONTEXT_ANSWER))).drop("_sent")
