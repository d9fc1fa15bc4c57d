"""Entry points, build addresses, strict artifacts, prompts."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import prompts
from marginalia.operators import agent, builds, envelopes, retrieval, runs, stats
from marginalia.operators import graph
from marginalia.plans.scratch import materialize, release, scratch_dir

DOCS = [(1, "Rent increase rules apply each year. More.", "act"), (2, "Repairs are the duty of the landlord. More.", "rule"), (3, "Rent is due on the first day. More.", "act")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "id long, text string, level string")


def test_retrieve_debug(spark, corpus):
    asked = spark.createDataFrame([(1, "rent increase")], "query_id long, text string")
    both = {m: runs.retrieve_debug(corpus, asked, m, 2, level="level", levels=["act"]).orderBy("rank").collect() for m in runs.MODES}
    assert [r.id for r in both["hybrid"]] == [1, 3] and both["hybrid"][0].stages == "bm25,vector" and both["vector"][0].stages == "vector" and both["vector"][0].bm25_rank is None
    assert both["hybrid"][0].candidate_count == 2 and runs.retrieve_debug(corpus, asked, "hybrid", 2, level="level", levels=[]).collect() == []
    with pytest.raises(ValueError):
        runs.retrieve_debug(corpus, asked, "text")


def test_agent_takes_any_ids(spark, corpus):
    asked = spark.createDataFrame([("q#1", "rent increase"), ("q 2", "repairs; rent")], "query_id string, text string")
    assert {r.query_id: r.status for r in agent.run_agent(asked, corpus.select("id", "text")).collect()} == {"q#1": "finished", "q 2": "finished"}


def test_answers(spark, corpus):
    asked = spark.createDataFrame([(1, "rent increase"), (2, "zzz")], "query_id long, text string")
    out = {r.query_id: r for r in runs.naive_rag(asked, corpus, 2).collect()}
    assert out[1].n_sources == 2 and out[1].answer.startswith("Rent increase rules apply each year") and (out[2].n_sources, out[2].answer) == (0, "")
    chunks = spark.createDataFrame([("a", 0, 1, "x"), ("b", 1, 0, "y")], "path_key string, doc_pos int, pos int, text string")
    assert runs.stuff_prompt(chunks) == "[1] a\nx\n\n[2] b\ny"
    with pytest.raises(ValueError):
        runs.stuff_prompt(chunks.limit(0))
    claims = spark.range(1).select(F.expr("array(named_struct('text', 'a', 'cites', array('x')), named_struct('text', 'b', 'cites', cast(array() as array<string>)))").alias("c"))
    assert claims.select(runs.ungrounded(F.array(F.lit("z"), F.lit("b")), F.col("c")).alias("u")).first().u == ["z", "b"]


def test_comparisons(spark):
    scores = {a: spark.createDataFrame([(1, "x", True, 1.0), (2, "y", a == "agent", 0.5)], "item_id int, behavior_class string, strict_pass boolean, retrieval_hit_rate double") for a in runs.ARMS}
    cells = {(r.slice, r.arm): r for r in runs.four_arm_comparison(scores).collect()}
    assert cells[("all", "agent")].strict_pass_rate == 1.0 and cells[("all", "stuff")].hit_rate is None and cells[("all", "naive-rag")].hit_rate == 0.75
    with pytest.raises(ValueError):
        runs.four_arm_comparison({"stuff": scores["stuff"]})
    dev = scores["stuff"].withColumn("arm", F.lit("stuff")).unionByName(scores["agent"].withColumn("arm", F.lit("agent")))
    gaps, sides = runs.gap_dashboard(dev, [("stuff", "agent")], 3, 50)
    [gap] = gaps.collect()
    assert gap.point == 0.5 and gap.half_width == max(abs(gap.high - 0.5), abs(0.5 - gap.low)) and gap.within_noise is None
    assert {r.arm: (r.dev_rate, r.holdout_rate) for r in sides.collect()} == {"stuff": (0.5, None), "agent": (1.0, None)}
    with pytest.raises(ValueError):
        runs.gap_dashboard(dev, [("stuff", "none")], 3, 50)


def test_hit_rate_comparison(spark):
    corpus = spark.createDataFrame([("d|section:1", "d", "rent increase rules"), ("d|section:2", "d", "repairs by the landlord")], "id string, document_id string, text string")
    items = spark.createDataFrame([(1, "answer", "rent increase"), (2, "answer", "anything")], "item_id long, behavior_class string, question string")
    required = spark.createDataFrame([(1, "d|section:1"), (1, "other|section:1"), (2, "other|section:1")], "item_id long, key string")
    nodes = spark.createDataFrame([("d|section:1",), ("d|section:2",)], "key string")
    out = {r.slice: r for r in runs.hit_rate_comparison(items, required, nodes, corpus, 1).collect()}
    assert out["all"].n == 1 and (out["all"].baseline, out["all"].treatment, out["all"].delta) == (1.0, 1.0, 0.0)


def test_truth_and_strict_artifacts(spark):
    said = {"true": True, '"false"': True, '""': False, "0.0": False, "[]": False, "{}": False, "[0]": True, "null": False, "2": True}
    rows = spark.createDataFrame([(k,) for k in said], "j string").select("j", envelopes.truth(F.parse_json("j")).alias("t"))
    assert {r.j: r.t for r in rows.collect()} == said
    one = lambda column, **values: spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first().v
    assert one(builds.cli_envelope(F.col("j")), j='{"result":"ok","total_cost_usd":1}').result == "ok"
    for bad in ('{"result":"x","is_error":true}', '{"result":1}', "[]", "no"):
        with pytest.raises(Exception, match="not a result envelope"):
            one(builds.cli_envelope(F.col("j")), j=bad)
    with pytest.raises(Exception, match="two answers"):
        builds.answers_map(spark.createDataFrame([(1, "a"), (1, "b")], "item_id int, answer_text string")).collect()
    points = spark.createDataFrame([(1, "p")], "item_id int, point_id string")
    with pytest.raises(Exception, match="missing or no boolean"):
        builds.strict_verdicts(points, spark.createDataFrame([(1, "p", '"false"')], "item_id int, point_id string, value string")).collect()
    assert one(builds.backoff_ms(F.col("a"), F.lit(7)), a=3) == 8007 and one(builds.backoff_ms(F.col("a"), F.lit(0)), a=9) == 30000


def test_flags_builds_and_prompts(spark):
    assert builds.parse_flags({"chunkContext": True})["chunkContext"] and not builds.parse_flags({})["xrefExpansion"]
    for bad in ({"xref_expansion": True}, {"chunkContext": 1}):
        with pytest.raises(ValueError):
            builds.parse_flags(bad)
    found = builds.flags_from_environment({"E_RERANK": " True ", "E_XREF_EXPANSION": "yes"}, "E_")
    assert found["rerank"] and not found["xrefExpansion"] and found["rerankProvider"] == "authority"
    assert builds.rung_environment(["planner", "graph-expansion"], "E_") == {"E_XREF_EXPANSION": "1", "E_RERANK": "0", "E_DEFINITIONS_IN_PROMPT": "1", "E_QUERY_REFORMULATION": "1"}
    config = {"enrichmentModel": "m", "promptVersion": "v"}
    builds.check_build({"corpusBuildHash": "h", "configHash": builds.config_hash(config)}, "h", config)
    for artifact in ({"corpusBuildHash": "x", "configHash": builds.config_hash(config)}, {"corpusBuildHash": "h", "configHash": "x"}):
        with pytest.raises(ValueError):
            builds.check_build(artifact, "h", config)
    nodes = spark.createDataFrame([("d", 0, "d", None), ("d", 1, "d|section:1", "text")], "document_id string, pos int, path_key string, text string")
    chunks = spark.createDataFrame([("d", "c1", "d|section:1", "text", "hierarchy")], "document_id string, id string, citable_path_key string, text string, chunker string")
    cache = spark.createDataFrame([], "key string, value string")
    values, made = builds.enrichment_build(nodes, chunks, cache, config, lambda d: d.withColumn("value", F.upper("text")))
    assert values.first().value == "TEXT" and builds.enrichment_build(nodes, chunks, made, config, lambda d: d.withColumn("value", F.lit("new")))[0].first().value == "TEXT"
    with pytest.raises(Exception, match="cached prefix"):
        spark.range(1).select(prompts.send_suffix(F.lit("abc"), F.lit("x"))).collect()
    with pytest.raises(ValueError):
        builds.tier_items(nodes, "full", True)


def test_query_sets_beyond_the_old_bounds(spark):
    vectors = spark.range(5000).selectExpr("id", "array(cast(id % 97 + 1 as float), cast(id % 31 as float)) as vector")
    assert retrieval.vector_cosine(vectors, vectors.selectExpr("id as query_id", "vector"), 1).count() == 5000
    terms = spark.range(60_000).selectExpr("concat('term', id, 'x') as term")
    found = graph.attach_definitions(terms, spark.createDataFrame([(1, "term7x and TERM59999X")], "id int, text string"))
    assert sorted(r.term for r in found.collect()) == ["term59999x", "term7x"]


def test_poisson_bootstrap_and_scratch(spark):
    pairs = spark.range(200).selectExpr("id as item_id", "cast(0 as double) as baseline", "cast(id % 4 = 0 as double) as treatment")
    out = stats.poisson_bootstrap(pairs, 5, 400).first()
    assert out.point == 0.25 and 0.15 < out.low < 0.25 < out.high < 0.35 and out.iterations == 400
    kept = materialize(pairs)
    assert kept.count() == 200 and scratch_dir(spark) in kept.inputFiles()[0].replace("file://", "")
    release(spark)
    assert materialize(pairs).count() == 200
