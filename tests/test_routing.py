"""Routing, envelopes and ladders."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators import envelopes, ladders, routing


def test_authority(spark):
    levels = spark.createDataFrame([("a", "act"), ("c", "contract")], "document_id string, level string")
    docs = spark.createDataFrame([("c", 1), ("ltb-guideline-3", 2), ("a", 3), ("a", 4)], "document_id string, pos int")
    out = routing.authority_of(docs, levels).select("document_id", routing.authority_rank(F.col("level")).alias("r")).distinct().collect()
    assert {r.document_id: r.r for r in out} == {"c": 6, "ltb-guideline-3": 2, "a": 0}
    assert [(r.document_id, r.pos) for r in routing.documents_at(docs, levels, ["act", "guideline"]).orderBy("pos").collect()] == [("ltb-guideline-3", 2), ("a", 3)]
    with pytest.raises(Exception, match="unknown document"):
        routing.authority_of(docs.withColumn("document_id", F.lit("zz")), levels).collect()
    file = spark.createDataFrame([("x/raw/tenancy/a.html",)], "p string")
    assert file.select(routing.corpus_of_file(F.col("p")).alias("c")).first().c == "tenancy"


def test_slices(spark):
    items = spark.createDataFrame([("1", "answer", "tenancy", True), ("2", "flag", "insurance", True), ("3", "answer", "governing", False), ("4", "answer", "governing", True)], "item_id string, behavior_class string, corpus string, verified boolean")
    cites = spark.createDataFrame([("1", "a|section:1"), ("1", "b|section:1"), ("2", "b|section:2"), ("4", "z|section:1")], "item_id string, key string")
    corpora = spark.createDataFrame([("a", "tenancy"), ("b", "insurance")], "document_id string, corpus string")
    sides = spark.createDataFrame([("1", "dev"), ("2", "holdout"), ("3", "dev"), ("4", "dev")], "item_id string, side string")
    assert {r.item_id: r.routed for r in routing.corpora_of_items(cites, corpora).collect()} == {"1": ["tenancy", "insurance"], "2": ["insurance"]}
    assert [(r.item_id, r.expected) for r in routing.corpus_conflicts(items, cites, corpora).collect()] == [("1", "cross-corpus")]
    assert [r.item_id for r in routing.run_items(items, cites, corpora, sides).collect()] == ["1"]
    wanted = spark.createDataFrame([("2", 1), ("3", 2), ("4", 3), ("9", 4)], "item_id string, pos int")
    found = {(r.problem, r.what) for r in routing.slice_problems(wanted, items, cites, corpora, sides, ["answer", "flag", "refuse"]).collect()}
    assert found == {("missing", "9"), ("unverified", "3"), ("not dev", "2"), ("not serviceable", "4"), ("class absent", "refuse"), ("corpus absent", "tenancy")}
    comments = spark.createDataFrame([(1, None, "<!--m--> a"), (2, 7, "x <!--m-->"), (3, 8, "<!--m--> b"), (4, 9, "<!--m--> c")], "pos int, id int, body string")
    assert routing.comment_to_update(comments, "<!--m-->") == 8 and routing.comment_to_update(comments, "none") is None


def test_triage(spark):
    points = spark.createDataFrame([(1, "a", True, True), (1, "b", True, False), (2, "a", False, True)], "item_id int, point_id string, human boolean, judge boolean")
    fixes = spark.createDataFrame([(1, "b", "human-error"), (2, "a", "judge-error")], "item_id int, point_id string, bucket string")
    assert {r.bucket: r.n for r in routing.triage_report(points, fixes).collect()} == {"human-error": 1, "judge-error": 1}
    with pytest.raises(Exception, match="untriaged"):
        routing.triage_report(points, fixes.where("item_id = 1")).collect()


def test_envelope(spark):
    good = {"behaviorClass": "answer", "answer": "yes", "claims": [{"text": "t", "cites": [{"documentId": "d", "segments": [{"kind": "section", "label": "1"}]}]}]}
    parse = lambda text: spark.createDataFrame([(text,)], "t string").select(envelopes.parse_envelope(F.col("t")).alias("e")).select("e", envelopes.cite_keys(F.col("e.claims")).alias("k")).first()
    assert parse("```json\n" + json.dumps(good) + "\n```").k == ["d|section:1"] and parse(json.dumps(good | {"claims": []})).e.answer == "yes"
    chapter = {"text": "t", "cites": [{"documentId": "d", "segments": [{"kind": "chapter", "label": "1"}]}]}
    for bad in (good | {"extra": 1}, good | {"behaviorClass": "maybe"}, {"answer": "x"}, good | {"claims": [{"text": "t", "cites": [], "x": 1}]}, good | {"claims": [chapter]}):
        with pytest.raises(Exception, match="not an answer envelope"):
            parse(json.dumps(bad))
    with pytest.raises(Exception, match="not an answer envelope"):
        parse("no json")


def test_judge(spark):
    points = spark.createDataFrame([(1, "a"), (1, "b")], "item_id int, point_id string")
    said = lambda verdicts: spark.createDataFrame([(1, json.dumps({"verdicts": verdicts}))], "item_id int, text string")
    out = envelopes.judge_verdicts(said([{"pointId": "a", "credited": True}, {"pointId": "b", "credited": False}, {"pointId": "z"}]), points)
    assert {r.point_id: r.credited for r in out.collect()} == {"a": True, "b": False}
    with pytest.raises(Exception, match="left out a point"):
        envelopes.judge_verdicts(said([{"pointId": "a", "credited": True}]), points).collect()
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    assert envelopes.known_edges(edges, spark.createDataFrame([("a",), ("b",)], "key string")).count() == 1
    with pytest.raises(Exception, match="unknown path"):
        envelopes.known_edges(edges, spark.createDataFrame([("a",)], "key string")).collect()


def test_ladders(spark):
    offline, live = ladders.rungs(), ladders.rungs(live=True)
    assert (len(offline), len(live)) == (9 + 8, 6 + 5)
    assert offline[0][4] == [] and offline[0][5] == "naive-chunks" and offline[8][4] == ladders.KEYS and offline[8][5] == "full"
    assert live[0][2] == "buildup-00-floor" and live[0][4] == ["hybrid-bm25", "metadata-filters", "critic"] and live[6][2] == "knockout-00-hierarchy-chunks"
    plan = ladders.run_plan(spark)
    scores = plan.select("rung_id", F.lit(0.5).alias("rate"))
    assert ladders.scored_plan(plan, scores).count() == 11
    with pytest.raises(ValueError):
        ladders.scored_plan(plan, scores.where("rung_id <> 'buildup-00-floor'"))
    with pytest.raises(ValueError):
        ladders.rungs(["full"])
