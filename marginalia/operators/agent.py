"""The bounded question loop over a table of questions.

Each node of the loop is a step over all questions at once; the two loops are unrolled:
one rewrite of questions that found nothing, one wider retrieval for answers that the
critic rejects, then degradation. So there are three retrieval passes at most, each on
the questions that still need one. Models are seams: column functions, with
deterministic stand-ins as defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import tokens
from marginalia.operators.fusion import hybrid, keep_max
from marginalia.plans.scratch import materialize

MAX_HOPS, MAX_CLAIMS = 3, 3
NOTE = "Only the parts that the sources support are given."
# Words of questions that are refused, by class.
REFUSALS = {"refuse-advice-escalate": ["sue", "lawsuit"], "refuse-jurisdiction": ["quebec", "alberta"], "refuse-out-of-scope": ["ignore", "prompt"]}


def scripted_guard(question: Column) -> Column:
    """``pass`` or the class of refusal."""
    out = F.lit("pass")
    for name, words in REFUSALS.items():
        out = F.when(F.arrays_overlap(tokens(question), F.array(*map(F.lit, words))), name).otherwise(out)
    return out


def scripted_plan(question: Column) -> Column:
    """A hop for each clause of the question."""
    return F.filter(F.transform(F.split(question, "[;?]"), F.trim), lambda q: q != "")


def scripted_rewrite(question: Column) -> Column:
    """The question's tokens without short ones."""
    return F.array_join(F.filter(tokens(question), lambda t: F.length(t) > 3), " ")


def scripted_claims(sources: Column) -> Column:
    """A claim for each of the best sources: its first sentence, citing it."""
    best = F.slice(sources, 1, MAX_CLAIMS)
    return F.transform(best, lambda s: F.struct(F.substring_index(s["text"], ".", 1).alias("text"), F.array(s["id"].cast("string")).alias("cites"), s["score"].alias("support")))


def scripted_critic(claim: Column) -> Column:
    """Whether a claim is grounded."""
    return (F.size(claim["cites"]) > 0) & (F.length(claim["text"]) >= 10)


@dataclass(frozen=True)
class Seams:
    guard: Callable[[Column], Column] = scripted_guard
    plan: Callable[[Column], Column] = scripted_plan
    rewrite: Callable[[Column], Column] = scripted_rewrite
    claims: Callable[[Column], Column] = scripted_claims
    critic: Callable[[Column], Column] = scripted_critic


def clamp_plan(hops: Column, question: Column) -> Column:
    """At most three hops; none, or a blank one, is the question itself (3.32)."""
    some = F.when(F.size(hops) > 0, F.slice(hops, 1, MAX_HOPS)).otherwise(F.array(question))
    return F.transform(some, lambda q: F.when(F.trim(q) == "", question).otherwise(q))


def retrieve(asked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Hops of ``asked(query_id, question, hops)`` retrieved and merged (11.20): best score of each text."""
    hops = asked.select("query_id", F.posexplode(clamp_plan(F.col("hops"), F.col("question"))).alias("hop", "text"))
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, hop int"
    found = hybrid(corpus, hops.select(F.to_json(F.struct("query_id", "hop")).alias("query_id"), "text"), k)
    found = found.withColumn("asked", F.from_json("query_id", kind)).select("asked.query_id", "asked.hop", "id", "score", "rank", "stages")
    return keep_max(found.withColumn("pos", F.struct("hop", "rank")), ["query_id", "id"]).drop("pos")


def run_agent(questions: DataFrame, corpus: DataFrame, seams: Seams | None = None, k: int = 8, authority: Column | None = None) -> DataFrame:
    """(query_id, behavior_class, answer, n_claims, passes, status) of every question.

    Refusals end at the guard. ``authority`` ranks columns of the corpus; without it the
    candidates keep their scores' order.
    """
    seams = seams or Seams()
    state = materialize(questions.select("query_id", F.col("text").alias("question"), seams.guard(F.col("text")).alias("verdict"), seams.plan(F.col("text")).alias("hops")))
    open_ = state.where("verdict = 'pass'")
    first = materialize(retrieve(open_, corpus, k).withColumn("passes", F.lit(1)))
    lost = open_.join(first.select("query_id").distinct(), "query_id", "left_anti")
    again = lost.select("query_id", F.col("question"), F.array(seams.rewrite(F.col("question"))).alias("hops"))
    # retrieved rows are written, so that their number decides how they meet the texts
    found = first.unionByName(materialize(retrieve(again, corpus, k).withColumn("passes", F.lit(2))))
    answers = materialize(_answer(found, corpus, seams, authority))
    weak = open_.join(answers.where("not grounded"), "query_id", "left_semi")
    wide = materialize(retrieve(weak, corpus, 2 * k).withColumn("passes", F.lit(3)))
    second = _answer(wide, corpus, seams, authority)
    kept = answers.where("grounded").unionByName(second)
    claims = F.when(F.col("grounded"), F.col("claims")).otherwise(F.filter("claims", seams.critic))
    text = F.array_join(F.transform(claims, lambda c: c["text"]), ". ")
    done = kept.select("query_id", F.when(F.col("grounded"), text).otherwise(F.concat_ws(" ", text, F.lit(NOTE))).alias("answer"), F.size(claims).alias("n_claims"), "passes", F.when(F.col("grounded"), "finished").otherwise("degraded").alias("status"))
    out = state.join(done, "query_id", "left")
    status = F.when(F.col("verdict") != "pass", "refused").otherwise(F.coalesce("status", F.lit("empty")))
    return out.select("query_id", F.when(F.col("verdict") == "pass", "answer").otherwise(F.col("verdict")).alias("behavior_class"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("passes", F.lit(0)).alias("passes"), status.alias("status"))


def _answer(found: DataFrame, corpus: DataFrame, seams: Seams, authority: Column | None) -> DataFrame:
    """(query_id, passes, claims, grounded): sources in order, claims of them, the critic's verdict."""
    rows = found.join(corpus, "id")
    level = authority if authority is not None else F.lit(0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(level, F.desc("score"), "id"))
    ranked = rows.withColumn("place", place)  # at most MAX_HOPS x k a question; the seam decides what it reads
    sources = F.array_sort(F.collect_list(F.struct("place", "id", "text", "score")))
    out = ranked.groupBy("query_id").agg(F.max("passes").alias("passes"), sources.alias("sources")).withColumn("claims", seams.claims(F.col("sources")))
    return out.select("query_id", "passes", "claims", F.forall("claims", seams.critic).alias("grounded"))


def enrich_missing(rows: DataFrame, cache: DataFrame, key: str, enrich: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Values of ``rows`` from a cache table, made only for keys it lacks (11.9-11.11): (values, new cache rows).

    Each missing key is made once however often it occurs; an empty value is an error.
    """
    missing = rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    made = enrich(missing)
    value = F.when(F.coalesce(F.col("value"), F.lit("")) == "", F.raise_error(F.concat(F.lit("empty enrichment for "), F.col(key))).cast("string")).otherwise(F.col("value"))
    made = materialize(made.select(key, value.alias("value")))
    return rows.join(cache.select(key, "value").unionByName(made), key, "left"), made
