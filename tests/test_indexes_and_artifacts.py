"""Indexes against scans, strict artifacts with their error cases, statistics through one seam, ladders."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import artifacts, indexes, ladders, retrieval, stats
from marginalia.plans import queries_stored

R = random.Random(11)


def rows_of(df):
    return sorted(map(repr, df.collect()))


# --- text index -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of forty topics, null and empty ones, copies, and a very long one."""
    topics = [[f"{a}{t}" for a in ("alpha", "beta", "gamma", "delta")] for t in range(40)]
    common = ["the", "of", "and", "it", "is"]
    rows = []
    for i in range(2000):
        words = [R.choice(topics[i // 50]) if R.random() < 0.5 else R.choice(common) for _ in range(R.randint(1, 60))]
        rows.append((f"d{i:05d}", " ".join(words), f"t{i // 50:02d}", ["de", "en", None][i % 3]))
    rows += [("n1", None, "t00", "de"), ("n2", "", None, "en"), ("long", "the alpha3 " * 50_000, "t03", "de"), ("same", rows[7][1], "t99", "en")]
    return spark.createDataFrame(rows, "id string, text string, topic string, lang string").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(0, "alpha3 beta3 the"), (1, "gamma7"), (2, "the of and"), (3, "nothing here"), (4, None), (5, ""), (6, "delta39 delta38 ALPHA1 alpha1"), (7, "alpha0 it")]
    return spark.createDataFrame(rows, "query_id int, text string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ix"))
    made, new = indexes.ensure_text_index(corpus, folder, "chunks", filters=("lang",), near=("topic",), span_rows=16, n_buckets=8)
    again, second = indexes.ensure_text_index(corpus.limit(3), folder, "chunks")
    assert new and not second and again.n == made.n == corpus.count()
    return made


@pytest.mark.parametrize("k", [1, 8, 3000])
def test_text_search_equals_scan(corpus, asked, index, k):
    found = indexes.search_text(index, asked, k)
    assert rows_of(found.result) == rows_of(retrieval.bm25_joined(corpus, asked, k)) == rows_of(retrieval.bm25(corpus, asked, k))


def test_text_search_leaves_blocks_closed(asked, index):
    """Topics lie together: of two queries of rare terms few spans are opened."""
    found = indexes.search_text(index, asked.where("query_id in (0, 6)"), 8)
    assert found.result.count() == 16 and found.opened < 0.25 * found.blocks


def test_text_search_filtered(corpus, asked, index):
    scan = retrieval.bm25_joined(corpus, asked, None).join(corpus.where("lang = 'de'").select("id"), "id", "left_semi").drop("rank")
    found = indexes.search_text(index, asked, 5, where=F.col("lang") == "de").result
    assert rows_of(found) == rows_of(retrieval.top_k(scan.select("query_id", "id", "score"), 5))
    assert indexes.search_text(index, asked, 5, where=F.col("lang") == "xx").result.count() == 0


def test_text_search_in_blocks_of_queries(asked, index):
    whole = rows_of(indexes.search_text(index, asked, 4).result)
    assert rows_of(indexes.search_text(index, asked, 4, max_queries=2).result) == whole
    assert rows_of(indexes.search_text(index, asked, 4, matrix_bytes=32).result) == whole
    assert indexes.search_text(index, asked.limit(0)).result.collect() == []


def test_bm25_in_blocks_and_edges(spark, corpus, asked):
    whole = rows_of(retrieval.bm25(corpus, asked, 4))
    assert rows_of(retrieval.bm25(corpus, asked, 4, max_queries=3)) == whole == rows_of(retrieval.bm25(corpus, asked, 4, matrix_bytes=32))
    assert retrieval.bm25(corpus, asked.limit(0)).collect() == [] and retrieval.bm25(corpus.limit(0), asked).collect() == []


def test_text_index_of_nothing(corpus, asked, tmp_path):
    empty, _ = indexes.ensure_text_index(corpus.limit(0), str(tmp_path), "none")
    assert indexes.search_text(empty, asked).result.collect() == []


def test_failed_build_leaves_no_index(corpus, tmp_path):
    bad = corpus.withColumn("text", F.when(F.col("id") == "d00003", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        indexes.ensure_text_index(bad, str(tmp_path), "chunks")
    _, new = indexes.ensure_text_index(corpus.limit(10), str(tmp_path), "chunks")
    assert new


# --- vector index -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    centres = [[R.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [c + R.gauss(0, 0.05) for c in centres[i % 30]], i % 5) for i in range(3000)]
    rows += [(5000, None, 1), (5001, [0.0] * 8, 1), (None, [1.0] * 8, 1), (5002, rows[4][1], 4)]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int").cache()


def test_vector_search_equals_scan(spark, vectors, tmp_path):
    usable = vectors.where("id is not null and vector is not null and id <> 5001")
    index, new = indexes.ensure_vector_index(vectors, str(tmp_path), "v", filters=("label",), n_cells=60)
    assert new and not indexes.ensure_vector_index(vectors, str(tmp_path), "v")[1]
    asked = usable.where("id % 251 = 0").select(F.col("id").alias("query_id"), "vector")
    for k in (1, 8):
        found = indexes.search_vectors(index, asked, k)
        assert rows_of(found.result) == rows_of(retrieval.vector_cosine(usable, asked, k))
        assert found.read < 0.8 * found.cells  # clustered vectors: cells beyond the bound are never read
    one = asked.limit(1)
    assert indexes.search_vectors(index, one, 8).read <= 8
    some = indexes.search_vectors(index, asked, 8, where=F.col("label") == 2).result
    assert rows_of(some) == rows_of(retrieval.vector_cosine(usable.where("label = 2"), asked, 8))
    assert rows_of(indexes.search_vectors(index, asked, 8, max_queries=5).result) == rows_of(retrieval.vector_cosine(usable, asked, 8))
    assert indexes.search_vectors(index, asked.limit(0)).result.collect() == []


def test_vector_index_of_nothing(vectors, tmp_path):
    index, _ = indexes.ensure_vector_index(vectors.limit(0), str(tmp_path), "v")
    assert indexes.search_vectors(index, vectors.limit(2).select(F.col("id").alias("query_id"), "vector")).result.collect() == []


# --- strict artifacts -------------------------------------------------------------------


def envelope(spark, text):
    frame = spark.createDataFrame([(text,)], "j string")
    return frame.select(artifacts.cli_envelope(F.col("j")).alias("e")).first().e


@pytest.mark.parametrize("flag", ["true", "1", '"oops"', "[1]", '{"a":1}', "0.5", '" "'])
def test_envelopes_with_an_error(spark, flag):
    with pytest.raises(Exception, match="not a result envelope"):
        envelope(spark, f'{{"result":"x","is_error":{flag}}}')


@pytest.mark.parametrize("text", [None, "", "no json", "[]", '"text"', "{}", '{"result":null}', '{"result":7}', '{"result":["x"]}'])
def test_envelopes_without_a_result(spark, text):
    with pytest.raises(Exception, match="not a result envelope"):
        envelope(spark, text)


@pytest.mark.parametrize(("cost", "read"), [("3.5", 3.5), ("2", 2.0), ('"3.5"', None), ("true", 1.0), ("null", None), ("[1]", None)])
def test_envelope_cost_and_usage(spark, cost, read):
    for flag in ("false", "0", '""', "null", "[]", "{}", "0.0"):
        found = envelope(spark, f'{{"result":"","is_error":{flag},"total_cost_usd":{cost},"usage":{{"n":1}}}}')
        assert (found.result, found.cost, json.loads(found.usage)) == ("", read, {"n": 1})
    assert envelope(spark, '{"result":"a","usage":"many"}').usage is None


LABEL = {"item_id": "i", "point_id": "p", "question": "q", "answer": "a", "point_text": "t", "human_credited": True}


@pytest.mark.parametrize("change", [{"item_id": 7}, {"point_id": True}, {"question": ""}, {"answer": "  "}, {"point_text": None}, {"human_credited": "yes"}, {"human_credited": None}, {"human_credited": 1}, {"judge": True}, {"answer": ["a"]}])
def test_labels_are_read_by_type(spark, change):
    frame = lambda row: spark.createDataFrame([(json.dumps(row),)], "row string")
    assert artifacts.label_rows(frame(LABEL)).first().asDict() == LABEL
    with pytest.raises(Exception, match="not a filled label"):
        artifacts.label_rows(frame(LABEL | change)).collect()
    with pytest.raises(Exception, match="not a filled label"):
        artifacts.label_rows(frame({k: v for k, v in LABEL.items() if k != next(iter(change))} if next(iter(change)) in LABEL else [1])).collect()


def test_blind_sheet_is_filled_and_read(spark):
    points = spark.createDataFrame([("i", "p1", "q?", "a point", True), ("i", "p2", "q?", "é", False)], "item_id string, point_id string, question string, point_text string, judge boolean")
    sheet = artifacts.blind_sheet(points, spark.createDataFrame([("i", "an answer")], "item_id string, answer string"))
    rows = [json.loads(r.row) for r in sheet.collect()]
    assert all(set(r) == set(LABEL) and r["human_credited"] is None for r in rows)
    filled = spark.createDataFrame([(json.dumps(r | {"human_credited": r["point_id"] == "p1"}),) for r in rows], "row string")
    assert {(r.point_id, r.human_credited) for r in artifacts.label_rows(filled).collect()} == {("p1", True), ("p2", False)}
    with pytest.raises(Exception, match="no answer"):
        artifacts.blind_sheet(points, spark.createDataFrame([("j", "x")], "item_id string, answer string")).collect()


FIX = {"item_id": "i", "point_id": "p", "bucket": "human-error", "justification": "misread", "corrected_human_credited": False}


def fixes(spark, *rows, **more):
    doc = json.dumps({"corrections": list(rows)} | more)
    return artifacts.corrections(spark.createDataFrame([(doc,)], "doc string")).collect()


def test_corrections(spark):
    judged = {k: v for k, v in FIX.items() if k != "corrected_human_credited"} | {"bucket": "judge-error", "point_id": "p2"}
    assert fixes(spark) == [] and {(r.point_id, r.corrected_human_credited) for r in fixes(spark, FIX, judged)} == {("p", False), ("p2", None)}
    for bad in ({"bucket": "other"}, {"justification": " "}, {"item_id": 3}, {"corrected_human_credited": "no"}, {"corrected_human_credited": None}, {"bucket": "judge-error"}, {"note": 1}):
        with pytest.raises(Exception, match="not a correction"):
            fixes(spark, FIX | bad)
    with pytest.raises(Exception, match="corrected twice"):
        fixes(spark, FIX, FIX | {"bucket": "rubric-wrong"})
    with pytest.raises(Exception, match="not a list of corrections"):
        fixes(spark, FIX, extra=1)


def test_slice_manifests(spark):
    entry = {"id": "i", "behavior_class": "answer", "side": "dev"}
    read = lambda doc: artifacts.slice_manifest(spark.createDataFrame([(json.dumps(doc),)], "doc string")).collect()
    good = {"version": 1, "seed": 19, "slice": [entry, entry | {"id": "j"}]}
    assert [(r.seed, r.pos, r.item_id) for r in read(good)] == [(19, 0, "i"), (19, 1, "j")]
    for bad in ({"seed": "19"}, {"seed": True}, {"seed": 1.5}, {"slice": []}, {"slice": "x"}, {"more": 1}):
        with pytest.raises(Exception, match="not a slice manifest"):
            read(good | bad)
    for bad in ({"side": "holdout"}, {"behavior_class": "typo"}, {"id": ""}, {"id": 3}, {"x": 1}):
        with pytest.raises(Exception, match="not an entry"):
            read(good | {"slice": [entry | bad]})


# --- statistics -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, int(R.random() < 0.4), int(R.random() < 0.6), R.random()) for i in range(150)]
    return spark.createDataFrame(rows, "item_id long, baseline int, treatment int, v double").cache()


def test_one_seam_for_every_statistic(pairs):
    """Mean and kappa through the seam equal the functions of their own, with either generator."""
    gap = F.col("treatment").cast("double") - F.col("baseline").cast("double")
    found = stats.bootstrap_of(pairs, "item_id", stats.mean_of(gap), 5, 200, generator="hash").first()
    same = stats.paired_bootstrap(pairs, 5, 200).first()
    assert {c: found[c] for c in ("point", "low", "high", "iterations")} == same.asDict()
    poisson = stats.bootstrap_of(pairs, "item_id", stats.mean_of(gap), 5, 300).first()
    assert {c: poisson[c] for c in ("point", "low", "high", "iterations")} == stats.poisson_bootstrap(pairs, 5, 300).first().asDict()
    points = pairs.select(F.col("item_id").alias("point_id"), F.col("baseline").alias("human"), F.col("treatment").alias("judge"))
    kappa = stats.bootstrap_of(points, "point_id", stats.kappa_between(F.col("human"), F.col("judge")), 9, 200, generator="hash").first()
    assert {c: kappa[c] for c in ("point", "low", "high", "iterations")} == stats.kappa_bootstrap(points, 9, 200).first().asDict()


def test_percentiles_and_ratios_by_group(pairs):
    by = pairs.withColumn("g", F.col("item_id") % 2)
    found = {r.g: r for r in stats.bootstrap_of(by, "item_id", stats.percentile_of(F.col("v"), 0.5), 3, 200, by="g").collect()}
    exact = {r.g: r.m for r in by.groupBy("g").agg(F.round(F.percentile("v", F.lit(0.5)), 6).alias("m")).collect()}
    assert set(found) == {0, 1} and all(found[g].point == exact[g] and found[g].low < exact[g] < found[g].high for g in exact)
    [ratio] = stats.bootstrap_of(pairs, "item_id", stats.ratio_of(F.col("v"), F.lit(0)), 3, 10).collect()
    assert (ratio.point, ratio.low) == (None, None)
    with pytest.raises(ValueError):
        stats.bootstrap_of(pairs, "item_id", stats.mean_of(F.col("v")), 3, 0)


def test_ladder_run(spark):
    names = [r[2] for r in ladders.rungs()]
    rows = [(name, i, (i * 7 + n * 3) % 10 < 3 + n % 5) for n, name in enumerate(names) for i in range(40)]
    scores = spark.createDataFrame(rows, "rung_id string, item_id long, strict_pass boolean")
    found = {r.rung_id: r for r in ladders.ladder_run(spark, scores, 7, 300).collect()}
    assert len(found) == 17 and found[names[0]].delta == found[names[0]].low == found[names[0]].high == 0
    for rung, base, seed in ladders.compared_rungs(7):
        pick = lambda name, to: scores.where(F.col("rung_id") == name).select("item_id", F.col("strict_pass").alias(to))
        if rung in (names[1], names[8], names[-1]):
            one = stats.poisson_bootstrap(pick(base, "baseline").join(pick(rung, "treatment"), "item_id").withColumn("baseline", F.col("baseline").cast("int")).withColumn("treatment", F.col("treatment").cast("int")), seed, 300).first()
            assert (found[rung].delta, found[rung].low, found[rung].high) == (one.point, one.low, one.high)
    with pytest.raises(ValueError, match="same items"):
        ladders.ladder_run(spark, scores.where(f"not (rung_id = '{names[3]}' and item_id = 4)"), 7, 10)
    with pytest.raises(ValueError, match="without a score"):
        ladders.ladder_run(spark, scores.where(F.col("rung_id") != names[0]).where(F.col("rung_id") != names[1]), 7, 10)


def test_names_of_the_stored_queries():
    assert {"bm25_indexed", "dense_indexed", "chat_service_stream", "ladder_run"} <= set(queries_stored.NAMES)
