"""Steps that must hold on larger tables: what is sent to the driver, how work is dealt, how rows grow."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.functions import poisson
from marginalia.operators import agent, artifacts, corpus, embedding, envelopes, graph, indexes, retrieval, stats
from marginalia.plans import queries_more


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_poisson_weights_of_blocks(spark):
    """Equal to md5 one by one, for short, long, non-ASCII, empty and null items and any number of digits."""
    items = ["1", "12", "77777", "é" * 20, "x" * 60, "", None, "y" * 47, "y" * 48]
    drawn = poisson.weights(17, items, 1200)
    for i, item in enumerate(items):
        for n in (0, 9, 10, 99, 100, 999, 1000, 1199):
            text = f"17:{n}" if item is None else f"17:{n}:{item}"
            assert drawn[i, n] == sum(int(hashlib.md5(text.encode()).hexdigest()[:8], 16) >= x for x in poisson.LIMITS)


def test_resampled_sums_are_dealt_to_tasks(spark):
    rows = [("a", 3, str(i), float(i % 3 - 1)) for i in range(60)] + [("b", 4, str(i), 1.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "grp string, seed int, item string, value double").coalesce(1)
    found = {(r.grp, r.iteration): (r.above, r.below) for r in stats.resampled_sums(frame, 25).collect()}
    each = frame.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(24))))
    each = each.withColumn("w", stats.poisson_weight(F.col("seed"), F.col("iteration"), F.col("item")))
    assert found == {(r.grp, r.iteration): (r.above, r.below) for r in each.groupBy("grp", "iteration").agg(F.sum(F.col("w") * F.col("value")).alias("above"), F.sum("w").alias("below")).collect()}
    assert "REPARTITION_BY_NUM" in plan_of(stats.resampled_sums(frame, 25))


def test_slices_in_many_documents(spark):
    """Entries keep the places of one whole slice, and no document holds it whole."""
    rows = spark.range(500).select(F.col("id").cast("string").alias("item_id"), F.lit("answer").alias("behavior_class"), (F.col("id") % 3 % 2).cast("int").alias("s"))
    docs = artifacts.render_slices(rows, "s", 20)
    assert docs.count() > 20 and max(r.doc.count('"id"') for r in docs.collect()) < 60
    found = sorted((r.seed, r.pos, r.item_id) for r in artifacts.slice_manifest(docs).collect())
    listed = [sorted((r.item_id for r in rows.where(F.col("s") == s).collect()), key=lambda x: hashlib.sha256(x.encode()).hexdigest()) for s in (0, 1)]
    assert found == [(s, i, x) for s in (0, 1) for i, x in enumerate(listed[s])]


def test_a_manifest_is_read_once(spark):
    """The seed is not parsed out of the whole document for every entry."""
    plan = plan_of(artifacts.slice_manifest(spark.createDataFrame([("{}",)], "doc string")))
    above = plan[: plan.index("Generate")]
    assert "$.seed" not in above and "doc#" not in above


def test_draws_are_not_broadcast(spark):
    """Resamples meet their items by shuffles, with either generator, and so do a judge's verdicts and the points."""
    rows = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)], "item_id long, treatment int, baseline int")
    points = rows.select(F.col("item_id").alias("point_id"), F.col("treatment").alias("human"), F.col("baseline").alias("judge"))
    for generator in ("hash", "mersenne"):
        for df in (stats.paired_bootstrap(rows, 7, 20, generator=generator), stats.kappa_bootstrap(points, 3, 20, generator=generator)):
            assert "ShuffledHashJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)
        whole = stats.bootstrap_of(rows, "item_id", stats.mean_of(F.col("treatment")), 3, 20, generator=generator)
        assert "ShuffledHashJoin" in plan_of(whole) and "BroadcastHashJoin" not in plan_of(whole)
    said = rows.select("item_id", F.lit('{"verdicts":[{"pointId":"p","credited":true}]}').alias("text"))
    assert "Broadcast" not in plan_of(envelopes.judge_verdicts(said, rows.select("item_id", F.lit("p").alias("point_id"))))


def test_draws_of_a_range(spark):
    """Every slot of every resample is drawn once, as the definition says."""
    found = sorted((r.iteration, r.idx) for r in stats.draws(spark, 13, 9, 7).collect())
    assert found == sorted((i, int(hashlib.md5(f"7:{i}:{s}".encode()).hexdigest()[:12], 16) % 13) for i in range(9) for s in range(13))
    assert stats.draws(spark, 0, 9, 7).count() == 0


def test_small_files_share_tasks(tmp_path):
    """Tasks of the stream follow the bytes; a range is in one task, cut as before."""
    from marginalia.sources.sse_stream import _Reader

    reader = _Reader({"path": str(tmp_path), "rangebytes": "4096"})
    end = {f"f{i}": 5000 for i in range(2000)}
    tasks = reader.partitions({"f0": 100}, end)
    assert len(tasks) < 40
    found = [(r.file, r.start, r.stop) for t in tasks for r in t.ranges]
    assert sorted(found) == sorted([("f0", 100, 4196), ("f0", 4196, 5000)] + [(f"f{i}", a, b) for i in range(1, 2000) for a, b in ((0, 4096), (4096, 5000))])
    assert reader.partitions(end, end) == []


def test_lanes_have_partitions_of_their_own(spark):
    rows = spark.range(4000).select("id", F.col("id").cast("string").alias("text"))
    found = embedding.embed(rows, embedding.counting_provider, lanes=16, spacing=0).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(found) == 16 and max(r["count"] for r in found) < 400


def test_coverage_sends_a_text_once(spark):
    """A document's parts meet its text in one row; overlaps, repeated, absent and null texts count as before."""
    parts = spark.createDataFrame([(1, "aa"), (1, "aa"), (1, "aa"), (1, "b"), (2, "x"), (3, "y"), (4, " "), (None, "z")], "document_id long, text string")
    whole = spark.createDataFrame([(1, "aaaaa b b"), (2, None), (4, "q")], "document_id long, text string")
    out = corpus.coverage(parts, whole)
    assert sorted(map(tuple, out.where("document_id is not null").collect())) == [(1, "aa", 3, 2), (2, "x", 1, 0), (3, "y", 1, 0)]
    assert out.where("document_id is null").count() == 1
    plan = plan_of(out)
    assert plan.index("MapInArrow") < plan.index("Join") and "collect_list" in plan[plan.index("Join") :]


def test_labels_are_parsed_once(spark):
    """No filter on a join key parses the rows again, and no side is broadcast."""
    plan = plan_of(queries_more.strict_artifacts(spark, "/root/testdata/sf0.001"))
    assert "point_text" not in plan and "BroadcastExchange" not in plan


def shuffled(spark, run):
    """What ``run`` gives, and the bytes that its stages wrote to shuffles."""
    jvm, context = spark._jvm, spark.sparkContext

    def total():
        stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    return run(), total() - before


def test_postings_are_not_shuffled(spark, tmp_path):
    """An index is built where its spans lie: texts are sorted, terms are counted, postings stay."""
    words = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.hex(F.pmod(F.xxhash64("id", i), F.lit(3000))))
    texts = spark.range(1500).select("id", F.array_join(words, " ").alias("text")).cache()
    n_bytes = texts.agg(F.sum(F.length("text"))).first()[0]
    (index, made), moved = shuffled(spark, lambda: indexes.ensure_text_index(texts, str(tmp_path), "t"))
    assert made and moved < 1.5 * n_bytes
    asked = texts.where("id % 300 = 0").withColumnRenamed("id", "query_id")
    assert sorted(indexes.search_text(index, asked, 4).result.collect()) == sorted(retrieval.bm25_joined(texts, asked, 4).collect())


def test_parts_of_a_span(spark):
    """Blocks of spans that tasks read in parts hold the same postings."""
    placed = spark.range(60).select(F.floor(F.col("id") / 20).alias("span"), (F.col("id") % 20).cast("int").alias("at"), F.concat(F.lit("a b b "), F.col("id") % 7).alias("text"))
    found = [
        sorted((r.term, r.span, at, x) for r in indexes._blocks(p, 4.0, 1.5, 0.75).collect() for at, x in zip(r.at, r.impacts, strict=True))
        for p in (placed.coalesce(1), placed.repartitionByRange(7, "span", "at").sortWithinPartitions("span", "at"))
    ]
    assert found[0] == found[1] and len(found[0]) == 180


def test_tokens_of_many_texts():
    """As those of one text, with letters that turn into ASCII ones."""
    texts = [None, "", "a", "İx K9 ÀB straße", " ", "\n", "z\nq", "no end", "-"]
    place, terms, code = retrieval.tokens_in(pa.array(texts))
    assert [[terms[c].as_py() for c in code[place == i].tolist()] for i in range(len(texts))] == [retrieval.tokens_of(t) for t in texts]


def test_grams_of_many_texts():
    """As those of one text; texts do not run into each other."""
    for texts in ([None, "", "a", "ab", "abc", "a b", "a.", "İx K9 ÀB straße", "\n", "z\nq", "aaaa-aaa"], [], [None], ["ab", "cd"]):
        place, codes, n = retrieval.counted(*retrieval._grams_in(pa.array(texts, pa.string())), 1 << 24)
        for i, t in enumerate(texts):
            alone, often = retrieval._gram_codes(t)
            assert codes[place == i].tolist() == alone.tolist() and n[place == i].tolist() == often.tolist()


def test_a_task_keeps_to_its_best_scores(spark):
    """Rows that cannot be among the best of a task's rows so far do not leave it, in either ranking; ties stay."""
    texts = spark.range(6000).coalesce(1).select("id", F.concat_ws(" ", F.lit("alpha"), F.when(F.col("id") % 2000 < 5, "beta")).alias("text"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, None)], "query_id long, text string")
    for ranking, joined in ((retrieval.bm25, retrieval.bm25_joined), (retrieval.trigram_cosine, retrieval.trigram_cosine_joined)):
        assert sorted(ranking(texts, asked, 4).collect()) == sorted(joined(texts, asked, 4).collect())
    left = [len(retrieval._running_best(np.zeros((4, 1)) + top, np.array([[0.5], [0.25], [0.0]]), 4)[1]) for top in (0, 0.25, 0.4, 0.6)]
    assert left == [2, 2, 1, 0]


def test_nothing_asked_reads_nothing(spark):
    """Without a question neither ranking passes over the texts, and a pass of the loop that no question needs costs none."""
    texts = spark.range(3).select("id", F.raise_error(F.lit("read")).cast("string").alias("text"))
    asked = spark.createDataFrame([], "query_id string, text string")
    for ranking in (retrieval.bm25, retrieval.trigram_cosine):
        assert ranking(texts, asked, 4).collect() == []
        assert ranking(texts, asked, 4).dtypes == ranking(texts.where("id < 0"), spark.createDataFrame([("q", "a")], asked.schema), 4).dtypes


def test_the_loop_does_not_shuffle_texts(spark):
    """Few candidates meet the texts where those lie."""
    words = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.hex(F.pmod(F.xxhash64("id", i), F.lit(3000))))
    texts = spark.range(3000).select("id", F.concat(F.array_join(words, " "), F.lit(".")).alias("text")).cache()
    n_bytes = texts.agg(F.sum(F.length("text"))).first()[0]
    asked = texts.where("id % 500 = 0").select(F.col("id").alias("query_id"), F.substring("text", 1, 40).alias("text"))
    out, moved = shuffled(spark, lambda: agent.run_agent(asked, texts).collect())
    assert len(out) == 6 and moved < 0.25 * n_bytes


def test_edges_without_a_seed_are_not_shuffled(spark):
    """Without broadcast joins too; keys of two types, null and repeated keys meet as before."""
    edges, many = (spark.range(n).select(F.struct("id").alias("edge_pos"), F.when(F.col("id") % 1000 > 0, F.pmod(F.xxhash64("id"), F.lit(5000))).alias("source"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)) + 4900).alias("target")) for n in (50_000, 1_500_000))
    seeds = spark.range(40).select((F.col("id") * 251 % 5000).cast("int").alias("key")).unionAll(spark.createDataFrame([(None,), (251,)], "key int"))
    chunks = spark.range(9000).withColumnRenamed("id", "key")
    known, best = {r.key for r in seeds.collect()} - {None}, {}
    for (pos,), a, b in edges.collect():
        for turn, via, key in ((0, a, b), (1, b, a)):
            if via in known and key is not None and key not in known and key < 9000:
                best[key] = min(best.get(key, (pos, turn, via)), (pos, turn, via))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.expand_one_hop(seeds, edges, chunks).collect()
        _, moved = shuffled(spark, lambda: graph.expand_one_hop(seeds, many, chunks).select("key", "via", "edge_pos").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.key: (r.edge_pos.id, r.via) for r in found} == {k: (pos, via) for k, (pos, turn, via) in best.items()} and len(found) == len(best)
    assert moved < 25_000_000  # most of it the bitmap, whatever the edges
