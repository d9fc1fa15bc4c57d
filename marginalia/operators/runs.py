"""Entry points: retrieval debug, answer runs, comparison drivers.

Each is a plan over a table of questions or items, composed of the operators of this
package; models stay seams (column functions).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.numbers import summary_stage
from marginalia.functions.paths import document_of
from marginalia.functions.text import numbered_sources
from marginalia.operators import agent, cites, evaluation, stats
from marginalia.operators.fusion import PER_STAGE, reciprocal_rank_only, rrf
from marginalia.operators.retrieval import bm25, trigram_cosine

DIGITS = 6
MODES = ("hybrid", "vector")
# The arms of a comparison in their order, and the gaps that are published.
ARMS = ["stuff", "stuff-oracle", "naive-rag", "agent"]
GAP_PAIRS = [("stuff", "stuff-oracle"), ("stuff", "naive-rag"), ("stuff", "agent"), ("naive-rag", "agent")]
MEASURES = ["strict_pass", "behavior_match", "cite_precision", "cite_recall", "retrieval_hit_rate"]


# --- retrieval ----------------------------------------------------------------------------


def retrieve_debug(corpus: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = 8, *, level: str | None = None, levels: list[str] | None = None) -> DataFrame:
    """Candidates with their provenance (11.6, 11.7): ``(query_id, mode, candidate_count, id, rank, score, stage, stages, vector_rank, bm25_rank, level)``.

    ``vector`` is the same plan with an empty lexical stage. ``levels`` filters the corpus
    by its column ``level`` before both rankings.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    kept = corpus if levels is None else corpus.where(F.col(level).isin(levels))
    ranked = trigram_cosine(kept, queries, k * PER_STAGE).select("query_id", "id", "rank", F.lit("vector").alias("stage"))
    if mode == "hybrid":
        ranked = ranked.unionByName(bm25(kept, queries, k * PER_STAGE).select("query_id", "id", "rank", F.lit("bm25").alias("stage")))
    fused = rrf(ranked).where(F.col("rank") <= k)
    named = kept.select("id", (F.col(level) if level else F.lit(None).cast("string")).alias("level"))
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return fused.join(named, "id").select(
        "query_id", F.lit(mode).alias("mode"), count.alias("candidate_count"), "id", "rank", "score", summary_stage(F.col("stages")).alias("stage"),
        F.array_join("stages", ",").alias("stages"), F.col("stage_ranks")["vector"].alias("vector_rank"), F.col("stage_ranks")["bm25"].alias("bm25_rank"), "level",
    )


def hydrated(hits: DataFrame, chunks: DataFrame, stages: tuple[str, ...] = ("vector", "bm25")) -> DataFrame:
    """Fused ids with the row of the first hit (4.2): of ``hits(query_id, id, stage, rank)`` the earliest stage's, joined to ``chunks``."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    first = hits.groupBy("query_id", "id").agg(F.min_by(F.struct("stage", "rank"), F.struct(place, "rank")).alias("hit"))
    return first.select("query_id", "id", "hit.stage", "hit.rank").join(chunks, "id")


def expansion_candidates(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of expansion targets (4.7): ``keys(key)``, ``chunks(key, pos, text)``; no score, and of a repeated key the last row stands."""
    last = chunks.groupBy("key").agg(F.max_by("text", "pos").alias("text"))
    return keys.select("key").distinct().join(last, "key").select("key", "text", F.lit(0.0).alias("score"), F.lit("graph-expansion").alias("stage"))


def ranking_rerank(candidates: DataFrame, replies: DataFrame, by: str = "query_id", pos: str = "pos") -> DataFrame:
    """Place by a model's list of indices (7.10): adds ``place``; ``replies(by, ranking)``, an array of 0-based positions.

    Repeated and unknown indices are ignored; candidates that the model left out follow in
    their order.
    """
    index = F.row_number().over(Window.partitionBy(by).orderBy(pos)) - 1
    rows = candidates.withColumn("__index", index).join(replies.select(by, F.col("ranking").alias("__ranking")), by, "left")
    at = F.coalesce(F.array_position("__ranking", F.col("__index").cast("int")), F.lit(0))
    order = F.when(at > 0, at).otherwise(F.lit(2**31 - 1))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, "__index"))).drop("__index", "__ranking")


def select_reranker(provider: str, injected: dict[str, Callable], authority: Callable) -> Callable:
    """The reranker of a provider (7.12): a live one if it is there, else by authority; an unknown provider is an error."""
    if provider not in ("authority", "llm", "cohere"):
        raise ValueError(f"unknown reranker {provider!r}")
    return authority if provider == "authority" else injected.get(provider) or authority


# --- answers --------------------------------------------------------------------------------


def chunks_for_arm(chunks: DataFrame, documents: DataFrame, arm: str, corpora: list[str] | None = None) -> DataFrame:
    """Chunks of an arm (3.19-3.21) with ``doc_pos`` and ``corpus``; a table has no order, canonical is that of doc_pos.

    ``documents(document_id, doc_pos, corpus)``. Only ``stuff-oracle`` looks at ``corpora``;
    an empty list of them is an error, as is a chunk of an unmapped document.
    """
    if corpora is not None and not corpora:
        raise ValueError("at least one corpus must be named")
    rows = chunks.join(documents, "document_id", "left")
    unknown = F.raise_error(F.concat(F.lit("no corpus mapping for document "), F.col("document_id"))).cast("string")
    rows = rows.withColumn("corpus", F.coalesce("corpus", unknown))
    return rows.where(F.col("corpus").isin(corpora)) if arm == "stuff-oracle" and corpora else rows


def stuffed_candidates(chunks: DataFrame) -> DataFrame:
    """Chunks as candidates without a rank (11.14): score 0, stage ``stuffed``."""
    return chunks.withColumn("score", F.lit(0.0)).withColumn("stage", F.lit("stuffed")).withColumn("stages", F.array(F.lit("stuffed")))


def stuffed_source_count(chunks: DataFrame) -> DataFrame:
    """How many sources are stuffed (5.24)."""
    return chunks.agg(F.count(F.lit(1)).alias("sources"))


def synthesize(questions: DataFrame, sources: DataFrame, claims: Callable[[Column], Column] = agent.scripted_claims) -> DataFrame:
    """Answers from sources (11.16): ``(query_id, prompt_sources, claims, n_sources)``.

    ``sources(query_id, place, id, text, score)``. Cites of a claim that are no source of
    the question are dropped.
    """
    listed = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "text", "score"))).alias("s"))
    rows = questions.select("query_id").join(listed, "query_id", "left").withColumn("s", F.coalesce("s", F.expr("array()").cast(listed.schema["s"].dataType)))
    block = numbered_sources(F.transform("s", lambda x: F.struct(x["id"].cast("string").alias("path_key"), x["text"].alias("text"))))
    known = F.transform("s", lambda x: x["id"].cast("string"))
    clamped = F.transform(claims(F.col("s")), lambda c: F.struct(c["text"].alias("text"), F.array_intersect(c["cites"], known).alias("cites")))
    return rows.select("query_id", block.alias("prompt_sources"), clamped.alias("claims"), F.size("s").alias("n_sources"))


def naive_rag(questions: DataFrame, corpus: DataFrame, k: int = 8, claims: Callable[[Column], Column] = agent.scripted_claims) -> DataFrame:
    """One retrieval and one synthesis for every question (11.4, 11.15): ``(query_id, arm, answer, n_claims, n_sources)``."""
    found = reciprocal_rank_only(trigram_cosine(corpus, questions, k)).join(corpus.select("id", "text"), "id")
    out = synthesize(questions, found.withColumn("place", F.col("rank")), claims)
    return out.select("query_id", F.lit("naive-rag").alias("arm"), F.array_join(F.transform("claims", lambda c: c["text"]), ". ").alias("answer"), F.size("claims").alias("n_claims"), "n_sources")


def stuff_prompt(chunks: DataFrame, order_seed: int = 0) -> str:
    """The block of all stuffed sources in canonical or permuted order (11.15, 7.13): for one prompt, so on the driver; no chunk is an error."""
    rows = [(r.path_key, r.text) for r in chunks.orderBy("doc_pos", "pos").select("path_key", "text").collect()]
    if not rows:
        raise ValueError("nothing to stuff: an empty corpus")
    return "\n\n".join(f"[{i + 1}] {key}\n{text}" for i, (key, text) in enumerate(stats.permuted(rows, order_seed)))


def answer_envelopes(answers: DataFrame) -> DataFrame:
    """The envelope of each run (11.27, 11.30): ``answers(query_id, behavior_class, answer, ...)`` with ``trace_id`` and the envelope as JSON."""
    trace = F.md5(F.concat(F.lit("trace:"), F.col("query_id").cast("string")))
    body = F.to_json(F.struct(F.col("behavior_class").alias("behaviorClass"), "answer"))
    return answers.select("query_id", trace.alias("trace_id"), body.alias("envelope"))


def last_write_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """State rows with each field of ``new`` that is not null in place of the old one (11.26)."""
    fields = [c for c in old.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return old.join(renamed, key, "left").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in fields])


def ungrounded(critic: Column, claims: Column) -> Column:
    """Claims that the critic names, then those without a cite, each once (8.7)."""
    return F.array_union(critic, F.transform(F.filter(claims, lambda c: F.size(c["cites"]) == 0), lambda c: c["text"]))


# --- runs and comparisons -----------------------------------------------------------------------


def run_items(items: DataFrame, outcomes: DataFrame, required: DataFrame, candidate: DataFrame, retrieved: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Scores, dashboard and score rows of one arm (5.33).

    ``outcomes(item_id, trace_id, observed_behavior, latency_ms, cost_usd)``.
    """
    scores = cites.score_items(items, outcomes, required, candidate, retrieved, nodes).join(outcomes.select("item_id", "trace_id", "latency_ms", "cost_usd"), "item_id")
    return {"scores": scores, "dashboard": evaluation.score_dashboard(scores), "sink": evaluation.long_scores(scores, MEASURES)}


def arm_dashboard(naive: DataFrame, treated: DataFrame, by: str = "behavior_class") -> DataFrame:
    """All measures of two arms over the same items (5.10, 5.36): by class and over all, with the strict-pass difference."""
    evaluation.require_same_items({"naive": naive, "agent": treated})
    pick = lambda df, name: df.select("item_id", *([by] if name == "naive" else []), *[F.col(m).cast("double").alias(f"{name}_{m}") for m in MEASURES[:4]])
    joined = pick(naive, "naive").join(pick(treated, "agent"), "item_id")
    means = [F.round(F.avg(f"{arm}_{m}"), DIGITS).alias(f"{arm}_{m}") for m in MEASURES[:4] for arm in ("naive", "agent")]
    delta = F.round(F.avg("agent_strict_pass") - F.avg("naive_strict_pass"), DIGITS).alias("strict_pass_delta")
    return evaluation.slices_and_all(joined, by, F.count(F.lit(1)).alias("n"), *means, delta)


def four_arm_comparison(scores: dict[str, DataFrame], rag_arms: tuple[str, ...] = ("naive-rag", "agent")) -> DataFrame:
    """Cells of all four arms (5.36): a missing arm is an error, and all must cover the same items."""
    if missing := [a for a in ARMS if a not in scores]:
        raise ValueError(f"no scores of the arms {missing}")
    evaluation.require_same_items({a: scores[a] for a in ARMS})
    rows = reduce(DataFrame.unionByName, [scores[a].select("item_id", "behavior_class", "strict_pass", "retrieval_hit_rate", F.lit(a).alias("arm")) for a in ARMS])
    return evaluation.arm_table(rows, ARMS, list(rag_arms))


def context_inputs(outcomes: DataFrame, items: DataFrame, rag_arms: tuple[str, ...] = ("naive-rag", "agent")) -> DataFrame:
    """What a context evaluator is asked (5.31): ``(arm, item_id, question, contexts, reference)``.

    Only retrieval arms, and only items they retrieved for; ``outcomes(arm, item_id,
    retrieved, contexts)``. Retrieved candidates without any text are an error.
    """
    rows = outcomes.where(F.col("arm").isin(*rag_arms) & (F.size("retrieved") > 0)).join(items.select("item_id", "question", "reference"), "item_id")
    broken = F.raise_error(F.concat(F.lit("no context text of item "), F.col("item_id").cast("string"))).cast("array<string>")
    return rows.select("arm", "item_id", "question", F.when(F.size("contexts") > 0, F.col("contexts")).otherwise(broken).alias("contexts"), "reference")


def hit_rate_comparison(items: DataFrame, required: DataFrame, nodes: DataFrame, corpus: DataFrame, k: int = 8, by: str = "behavior_class") -> DataFrame:
    """Vector-only against hybrid retrieval on one corpus (5.34, 5.35): hit rates by class and over all.

    ``corpus(id, document_id, text)``, ids are path keys; ``items(item_id, behavior_class,
    question)``. Items need a cite that resolves in a document of the corpus; cites of
    other documents can never be reached and do not count.
    """
    held = corpus.select("document_id").distinct()
    reachable = required.withColumn("document_id", document_of(F.col("key"))).join(held, "document_id", "left_semi").select("item_id", "key")
    able = cites.resolves(reachable, nodes).where("resolves").select("item_id").distinct()
    chosen = items.join(able, "item_id", "left_semi")
    asked = chosen.select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    arms = []
    for mode in ("vector", "hybrid"):
        got = retrieve_debug(corpus, asked, mode, k).select(F.col("query_id").alias("item_id"), F.col("id").alias("key"))
        arms.append(chosen.select("item_id", by).join(cites.hit_rate(chosen, reachable, got, nodes), "item_id"))
    return evaluation.arm_comparison(arms[0], arms[1], "retrieval_hit_rate", by)


def half_width(point: Column, low: Column, high: Column) -> Column:
    """The larger distance from the point to a bound (12.3)."""
    return F.greatest(F.abs(high - point), F.abs(point - low))


def gap_dashboard(
    dev: DataFrame, pairs: list[tuple[str, str]], seed: int, iterations: int = 2000, *,
    holdout: DataFrame | None = None, floors: DataFrame | None = None, bootstrap: Callable[..., DataFrame] = stats.paired_bootstrap,
) -> tuple[DataFrame, DataFrame]:
    """Gaps with intervals, and the arms' rates on both sides (5.12): over ``dev(arm, item_id, strict_pass)``.

    Gap i is resampled with ``seed`` + i. With ``floors(arm, spread)`` a gap is within noise if
    it is not above the greater spread of its arms. Without ``holdout`` its columns are null.
    """
    named = sorted({a for p in pairs for a in p})
    known = {r.arm for r in dev.where(F.col("arm").isin(named)).select("arm").distinct().collect()}  # at most those that are named
    if missing := sorted({a for p in pairs for a in p} - known):
        raise ValueError(f"no scores of the arms {missing}")
    of = lambda arm, name: dev.where(F.col("arm") == arm).select("item_id", F.col("strict_pass").cast("double").alias(name))
    parts = []
    for i, (a, b) in enumerate(pairs):
        evaluation.require_same_items({"a": of(a, "x"), "b": of(b, "x")})
        ci = bootstrap(of(a, "baseline").join(of(b, "treatment"), "item_id"), seed + i, iterations)
        parts.append(ci.select(F.lit(a).alias("baseline_arm"), F.lit(b).alias("treatment_arm"), "point", "low", "high", F.round(half_width(F.col("point"), F.col("low"), F.col("high")), DIGITS).alias("half_width")))
    gaps = reduce(DataFrame.unionByName, parts)
    if floors is None:
        gaps = gaps.withColumn("within_noise", F.lit(None).cast("boolean"))
    else:
        spread = lambda arm, name: floors.select(F.col("arm").alias(arm), F.col("spread").alias(name))
        gaps = gaps.join(spread("baseline_arm", "__a"), "baseline_arm", "left").join(spread("treatment_arm", "__b"), "treatment_arm", "left")
        gaps = gaps.withColumn("within_noise", F.abs("point") <= F.coalesce(F.greatest("__a", "__b"), F.lit(0.0))).drop("__a", "__b")
    rate = lambda df, name: df.groupBy("arm").agg(F.avg(F.col("strict_pass").cast("double")).alias(name))
    sides = rate(dev, "dev_rate")
    sides = sides.join(rate(holdout, "holdout_rate"), "arm", "left") if holdout is not None else sides.withColumn("holdout_rate", F.lit(None).cast("double"))
    r = lambda c: F.round(c, DIGITS)
    return gaps, sides.select("arm", r(F.col("dev_rate")).alias("dev_rate"), r(F.col("holdout_rate")).alias("holdout_rate"), r(F.col("dev_rate") - F.col("holdout_rate")).alias("divergence"))


def variance_comparison(dev: DataFrame, repeats: DataFrame, pairs: list[tuple[str, str]], seed: int, iterations: int = 2000, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Noise floors of repeated runs and the gap dashboard under them (12.5): (floors, gaps, sides)."""
    floors = evaluation.noise_floor(repeats)
    return floors, *gap_dashboard(dev, pairs, seed, iterations, floors=floors, **options)


def order_probe(scores: DataFrame) -> DataFrame:
    """Strict pass by order seed (5.20): ``scores(seed, item_id, strict_pass)`` -> ``(seed, n, rate, spread, is_order_sensitive)``."""
    each = scores.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("strict_pass").cast("double")).alias("rate"))
    spread = each.agg((F.max("rate") - F.min("rate")).alias("spread"))  # one row
    out = each.join(F.broadcast(spread))
    return out.select("seed", "n", F.round("rate", DIGITS).alias("rate"), F.round("spread", DIGITS).alias("spread"), (F.col("spread") > 0).alias("is_order_sensitive"))


def rates_by_rung(scores: DataFrame) -> DataFrame:
    """Mean of a rung's measured items; a rung with none has no row, never 0 (5.7)."""
    return scores.where("strict_pass is not null").groupBy("rung_id").agg(F.round(F.avg(F.col("strict_pass").cast("double")), DIGITS).alias("rate"))


def smoke_run(scores: DataFrame, wanted: DataFrame, live: bool) -> DataFrame:
    """The dashboard of the named items of a run (12.13); without the gate's consent it is an error."""
    if not live:
        raise ValueError("the live gate is closed")
    return evaluation.score_dashboard(scores.join(wanted.select("item_id").distinct(), "item_id", "left_semi"))


def triage_and_recompute(points: DataFrame, corrections: DataFrame, by: str | None = None) -> dict[str, DataFrame]:
    """Agreement before and after one pass of corrections, and the report (12.9, 4.15, 5.22)."""
    from marginalia.operators.routing import triage_report

    corrected = evaluation.apply_corrections(points, corrections)
    return {"before": evaluation.agreement(points, by), "after": evaluation.agreement(corrected, by), "report": triage_report(points, corrections), "corrected": corrected}


def enqueue_failures(queue: DataFrame, failures: DataFrame) -> DataFrame:
    """The annotation queue with new failures behind it (12.11): ``(trace_id, item_id)``, a trace once."""
    new = failures.select("trace_id", "item_id").distinct().join(queue.select("trace_id"), "trace_id", "left_anti")
    return queue.select("trace_id", "item_id").unionByName(new)
