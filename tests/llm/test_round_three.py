"""Importance resampling, vector codes and line dedup against brute force and their SQL; odd names and repeated ids."""

import csv
import hashlib
import heapq
import inspect
import json
import math
import random
import re
import statistics
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import importance, language_id, line_crf, line_dedup, quality_rules, queries, vector_codes
from marginalia.llm.words import row_hash
from marginalia.plans.scratch import materialize

R = random.Random(3)
VOCAB = ["alpha", "Beta", "gamma,", "delta2", "ÉCLAIR", "straße", "x-y", "日本語", "a", "I"]
ODD = "doc_id long, text string, `a.b` string, ident long, print string, drops int, `back``tick` int, lang string, weight long"


def odd_rows(texts):
    return [(i if i % 9 else (None if i else 0), t, "v", 1, "p", 2, 3, "en", 5) for i, t in enumerate(texts)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " \n\t\n", "short\nshort", "a line that repeats\nother line here\n\nA LINE that repeats  ", "\tA line THAT repeats\r\nunique é line é é\n"]
    for _ in range(30):
        out.append("\n".join(R.choice(["a line that repeats", "second common line", "x" * 9, "y" * 10, "Éclair line one", "éclair line one", f"own line {R.random()}", ""]) for _ in range(R.randint(1, 90))))
    out += [" ".join(R.choice(VOCAB) for _ in range(R.randint(1, 200))) for _ in range(30)]
    out += [out[8], out[8], "w " * 20_000 + "\n" + "\n".join(f"line number {i % 700}" for i in range(9000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(odd_rows(texts), ODD).repartition(5).cache()


def brute_lines(rows):
    order = lambda d: math.inf if d is None else d
    first = {}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), math.inf), order(doc_id))
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(doc_id)]
        yield doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("seen", [64, 1])
def test_line_dedup(docs, texts, monkeypatch, seen):
    """With common lines told apart by the sample, and without."""
    monkeypatch.setattr(line_dedup, "_SEEN", seen)
    monkeypatch.setattr(line_dedup, "_SAMPLED", 2)
    rows = [r[:2] for r in odd_rows(texts)]
    found = line_dedup.line_dedup(docs)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert Counter(map(tuple, found.collect())) == Counter(brute_lines(rows))
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    expected = Counter((d, None if t is None else k) for (d, t), (_, _, _, k) in zip(rows, brute_lines(rows), strict=True))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected


def test_line_dedup_reads_ranges_without_a_second_shuffle(docs):
    plan = line_dedup.dropped_lines(docs)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window")
    assert plan[window:].count("Exchange") == 1 and "rangepartitioning" in plan[window:]


def test_line_dedup_empty(docs):
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


def brute_weights(rows, target, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (n + buckets) / ((s[k] + 1) * (m + buckets))))
    out = []
    for doc_id, text in rows:
        words, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("slice_bytes", [6_000_000, 300])
def test_importance(spark, docs, texts, monkeypatch, slice_bytes):
    monkeypatch.setattr(importance, "SLICE", slice_bytes)
    monkeypatch.setattr(importance, "PER_BLOCK", 5000)
    target = [None, "", "alpha beta", "A line that repeats! delta2 éclair", texts[40]]
    rows = [r[:2] for r in odd_rows(texts)]
    weighed = brute_weights(rows, target)
    found = importance.importance_resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, text_ int"))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in found.collect()) == Counter((d, n, w, s) for d, _, n, w, s in weighed)
    many = sorted(((-s, math.inf if d is None else d) for d, words, _, _, s in weighed if words >= 20))
    drawn = sorted((r for r in found.collect() if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(many) * 25 // 100 + 1))
    assert [(-r.score, math.inf if r.doc_id is None else r.doc_id) for r in drawn] == many[: len(drawn)]


def test_importance_edges(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.importance_resample(docs.limit(0), none).collect() == []
    assert importance.importance_resample(docs, none).count() == docs.count()


def test_ranks_of_many_equal_rows(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(3).cast("long").alias("score"))
    rows = rows.unionByName(spark.createDataFrame([(None, 3), (1, 3), (9, 4)], "doc_id long, score long"))
    found = {(r.doc_id, r["rank"]) for r in importance.ranked(rows, 19_000).collect()}
    assert {r for d, r in found if d == 9} == {1} and {r for d, r in found if d == 1} == {2} and {r for d, r in found if d is None} == {None}
    assert {r for d, r in found if d == 7} == {None, *range(3, 19_001)}


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(x * scale) for x in r[1]] for r in kept]
    size = len(whole[0]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    each = [cut(v) for v in whole]
    books = [[list(v[p]) for v in each[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        hit = [[near(p, v[p])[1] for p in range(parts)] for v in each]
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [v[p] for v, h in zip(each, hit, strict=True) if h[p] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(p, v[p]) for p in range(parts)] for v in each]
    error = [sum(d for d, _ in f) for f in found]
    label = Counter()
    for r, e in zip(kept, error, strict=True):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{i:02x}" for _, i in f), e, label[r[2]], digest) for r, f, e in zip(kept, found, error, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, `a.b` int, error string"


@pytest.mark.parametrize("count", [5, 200])
def test_vector_codes(spark, count):
    rows = [(i, [float(np.float32(R.gauss(0, 1) + i % 3)) for _ in range(16)], [None, 1, 2][i % 3], 1, "x") for i in range(count)]
    rows += [(count, None, 1, 1, "x"), (count + 1, [1.0] * 15 + [None], 1, 1, "x"), (count + 2, [math.nan] * 16, 1, 1, "x"), (count + 3, [math.inf] * 16, 1, 1, "x")]
    rows += [(None, [0.0] * 16, 2, 1, "x"), rows[0], rows[0], (0, [0.5] * 16, None, 1, "x")]
    found = vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, found.collect())) == brute_codes(rows)


def test_vector_codes_edges(spark):
    frame = spark.createDataFrame([(1, None, 1, 1, "x")], VECTORS)
    assert vector_codes.compress_vectors(frame).collect() == [] and vector_codes.compress_vectors(frame.limit(0)).collect() == []
    rows = [(1, [1e30, -1e30, 0.0], 1, 1, "x"), (2, [0.0, 0.0, 0.0], 1, 1, "x"), (3, [1.0], 1, 1, "x")]  # huge, few and of another length
    found = {r.vec_id: r for r in vector_codes.compress_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert set(found) == {1, 2} and found[1].error == 0 and len(found[1].code) == 16


def test_va_file_bounds_hold_and_filter():
    random_ = np.random.default_rng(1)
    entries = random_.integers(-1000, 1000, (16, 8))
    entries[3] = entries[7]
    known = vector_codes.VAFile(entries, 3)
    parts = random_.integers(-1500, 1500, (500, 8))
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    low, high = known.bounds(parts)
    assert (low <= exact).all() and (exact <= high).all()
    pick, error, refined = known.nearest(parts)
    assert (pick == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all() and refined < exact.size / 3


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_vector_codes", "op13_line_dedup"])
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, folder)
    assert found.columns == columns
    assert Counter(map(tuple, found.collect())) == Counter(expected.fetchall())


CONTRACT = {
    "op1_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_token_counts": {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """sf0.001 with repeated rows, null ids and texts, and columns of odd names."""
    folder = str(tmp_path_factory.mktemp("sf"))
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = source.limit(3).unionByName(source.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(source.limit(2).withColumn("text", F.lit(None).cast("string")))
    odd = source.unionByName(more).withColumn("a.b", F.lit(1)).withColumn("held_out", F.lit("x")).withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    odd.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, folder, name):
    """Types, all rows, held-out rows, thresholds; digests of the texts themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES[name](spark, folder)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs)
    crc = lambda d: zlib.crc32(str(d).encode())
    if name.startswith("op1_"):
        assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    if name.startswith("op9_"):
        assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
        assert {r.lang_pred for r in rows if r.doc_id is not None} <= {"und", *(r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang").distinct().collect())}
    if name.startswith("op4_"):
        assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs)


def test_labels_are_no_inputs_of_a_score(spark, folder, tmp_path):
    """Scores depend on held-out labels, source and lang in no way."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.withColumn("source", F.lit("other")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_quality_classifier", "op9_language_id"):
        one, two = (Counter(map(tuple, queries.QUERIES[name](spark, x).collect())) for x in (folder, str(tmp_path)))
        assert one == two


@pytest.mark.parametrize("ident", [1, 2, 3, 4, 5])
def test_language_id_one_id_for_a_language(spark, ident):
    """A language whose rows share one id, or are all equal, is learned; the sample keeps its bound."""
    same = spark.range(20_000).select(F.lit(ident).cast("long").alias("doc_id"), F.concat(F.lit("the house on the hill number "), (F.col("id") % 3000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    equal = spark.range(20_000).select(F.lit(ident).cast("long").alias("doc_id"), F.lit("una casa en la colina").alias("text"), F.lit("es").alias("lang"))
    few = spark.range(200).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("das haus am berg nummer "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    model = language_id.fit_language_id(same.unionByName(equal).unionByName(few))
    assert model.languages == ["de", "en", "es"]
    known = same.unionByName(equal).select("lang", F.xxhash64("doc_id", "text").alias("print"))
    chosen = Counter(r.lang for r in language_id._chosen(known, 400, 25_600).collect())
    assert chosen["es"] == 1 and 300 <= chosen["en"] <= 400


def test_line_crf_sample_is_bounded(spark, monkeypatch):
    """30,000 rows under one labelled id: at most ``max_docs`` texts reach the fit, equal ones once."""
    taken = []
    monkeypatch.setattr(line_crf.LineCRF, "fit", classmethod(lambda cls, features, lines, labels: taken.append(len(lines))))
    docs = spark.range(30_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("line "), (F.col("id") % 5000).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    line_crf.fit_line_crf(docs, labels, max_docs=1500)
    line_crf.fit_line_crf(docs.where("doc_id = 1").withColumn("text", F.lit("one text")), labels)
    assert taken == [1500, 1]


def test_row_hash_of_maps(spark):
    kind = "m map<string,int>, n array<map<string,int>>, s struct<x:map<int,string>>"
    rows = [({"a": 1, "b": 2}, [{"x": 1}], ({1: "a"},)), ({"b": 2, "a": 1}, [{"x": 1}], ({1: "a"},)), ({"a": 1, "b": 3}, [{"x": 1}], ({1: "a"},)), ({"a": 1, "b": 2}, [{"x": 2}], ({1: "a"},)), ({"a": 1, "b": 2}, [{"x": 1}], ({1: "b"},)), (None, None, None)]
    frame = spark.createDataFrame(rows, kind)
    hashes = [r[0] for r in frame.select(row_hash(frame)).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 5


def test_pipeline_with_odd_columns(spark, folder):
    """Names with dots and back ticks, names of the stages' own columns, maps, null and repeated ids: all stages run, columns stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("x`y", F.lit(2)).withColumn("__n", F.lit(1)).withColumn("row", F.lit("r")).withColumn("fp1", F.lit(1.5))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder))
        assert docs.columns == columns and docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_bands_keep_code_and_few_words_and_reject_junk(spark):
    code = [inspect.getsource(m) for m in (heapq.merge, textwrap.TextWrapper, statistics.linear_regression, csv.Sniffer, json.JSONEncoder)]
    few = " ".join(R.choice("the cat sat on a mat and then it ran to see what was there for food with no fear of dogs".split()) for _ in range(150))
    numbers = " ".join(str(R.randrange(10**6)) for _ in range(120))
    menu = " | ".join(R.choice(["ention", "erble", "heating", "ouning", "thatsh", "Edhand", "entat."]) + R.choice(["nd", "ed", "ing", "ou"]) for _ in range(120))
    rows = spark.createDataFrame(list(enumerate([*code, few, numbers, menu])), "doc_id long, text string")
    assert [r.kept for r in quality_rules.quality_rules(rows).orderBy("doc_id").collect()] == [True] * 6 + [False, False]


def test_bands_on_held_out_labels(spark):
    """Of sf0.1, rows outside the training rows of the bands: precision and recall of what the method alone rejects."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col("quality").isNotNull())
    found = Counter((r.quality, r.kept) for r in quality_rules.quality_rules(docs).where("not base_failed").join(held, "doc_id").collect())
    assert found[0, False] >= 0.85 * (found[0, False] + found[0, True]) and found[1, False] <= 0.003 * (found[1, False] + found[1, True])


def test_fit_bands(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality_rules.fit_bands(docs, labels, outside=0.01)
    assert fitted["Greek"] == quality_rules.BANDS["Greek"] and fitted["Latin"].curve[2] < 0 and 0 < fitted["Latin"].slack < 1
    bad = quality_rules.quality_rules(docs, bands=fitted).join(labels.where("quality = 0"), "doc_id").where("not base_failed")
    assert bad.where("not kept").count() > 0.8 * bad.count()
    assert quality_rules.fit_bands(docs.limit(0), labels) == quality_rules.BANDS
