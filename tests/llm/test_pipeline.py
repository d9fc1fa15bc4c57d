"""The stages of the pipeline over a small table, each held against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from marginalia.llm import byte_bpe, mixing, quality_rules, queries, secret_scan
from marginalia.llm.public_vocab import default_path
from marginalia.plans.scratch import materialize


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    words = "the council of the town met again to hear what people had to say about roads bridges schools and water while others spoke of trade farms rivers hills and weather in that part of the country".split()
    texts = []
    for i in range(12):
        texts.append(" ".join(words[(i * 7 + j * (i + 1)) % len(words)] + ("" if j % 4 else str(i)) for j in range(90)))
    near = texts[1].split()
    near[40] = "altered"
    texts += [texts[0], " ".join(near), "short one", "token = abcdefgh12345678 " + texts[2], None, "spam " * 80]
    rows = [(i, t, "en", f"src{i % 2}", len(t or ""), "extra") for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], folder)))
    return folder, out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stages(spark, stages):
    folder, (docs, good, single, clean, mixed, coded) = stages
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    assert {r.doc_id for r in good.collect()} == kept and {14, 16, 17} & kept == set()
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    parent = {r.doc_id: r.doc_id for r in rows}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            x, y = shingles(a.text), shingles(b.text)
            if 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((parent[a.doc_id], parent[b.doc_id]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    assert {r.doc_id for r in single.collect()} == set(parent.values())
    before = {r.doc_id: r for r in single.collect()}
    for r in clean.collect():
        assert r.text == secret_scan._redacted(before[r.doc_id].text, secret_scan.scan(before[r.doc_id].text)[1]) and r.n_chars == len(r.text)
    plan = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(plan)
    codec = byte_bpe.codec(default_path("byte_bpe_multi_50k.tiktoken"))
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert all(codec.decode(r.ids).decode() == text[r.doc_id] and r.n_tokens == len(r.ids) for r in coded.collect())
    for frame in (good, single, clean, mixed):
        assert frame.columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() == coded.count()


def test_empty_table(spark, stages, tmp_path):
    stages[1][0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
