"""Named queries over the driver tables, each with the same query in DuckDB SQL.

The tables stand in for the engine's own inputs: ``documents`` for chunks, ``benchmark``
for questions, the nations of the regions for a tree of citable paths, ``labels`` for two
raters, ``events`` for arms and repeats, ``conversations`` for sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import numbers, paths, text
from marginalia.operators import agent, cites, corpus, evaluation, fusion, graph, parse, retrieval, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# --- lexical and dense ranking ----------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""
  docs AS (SELECT doc_id AS id, {_TOK} AS t FROM documents {{where}}),
  words AS (SELECT id, len(t) AS l, unnest(t) AS term FROM docs),
  tf AS (SELECT id, l, term, count(*) AS tf FROM words GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
  q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark),
  bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 6) AS score
         FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, id),
  bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0)"""
_TRI = f"""
  dj AS (SELECT doc_id AS id, array_to_string({_TOK}, ' ') AS s FROM documents {{where}}),
  qj AS (SELECT item_id AS query_id, array_to_string({_TOK}, ' ') AS s FROM benchmark),
  dg0 AS (SELECT id, unnest(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END) AS g FROM dj),
  qg0 AS (SELECT query_id, unnest(CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) END) AS g FROM qj),
  dg AS (SELECT id, g, count(*) AS n FROM dg0 GROUP BY ALL), qg AS (SELECT query_id, g, count(*) AS m FROM qg0 GROUP BY ALL),
  dn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM dg GROUP BY id), qn AS (SELECT query_id, sqrt(sum(m * m)) AS qnorm FROM qg GROUP BY query_id),
  tc AS (SELECT query_id, id, round(sum(n * m) / (any_value(norm) * any_value(qnorm)), 6) AS score FROM dg JOIN qg USING (g) JOIN dn USING (id) JOIN qn USING (query_id) GROUP BY query_id, id),
  tcr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM tc WHERE score > 0)"""
_RRF = """
  ranked AS (SELECT query_id, id, rank, 'vector' AS stage FROM tcr WHERE rank <= 24 UNION ALL SELECT query_id, id, rank, 'bm25' FROM bmr WHERE rank <= 24),
  fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_stages, min(stage) AS only_stage FROM ranked GROUP BY query_id, id),
  hy AS (SELECT *, CASE WHEN n_stages > 1 THEN 'hybrid' ELSE only_stage END AS stage, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused)"""


@query(f"WITH t AS (SELECT unnest({_TOK}) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term")
def tokenize_terms(spark, sf_dir):
    """9.1: occurrences of every token."""
    return chunks(spark, sf_dir).select(F.explode(text.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BM25.format(where='')} SELECT query_id, id, score, rank FROM bmr WHERE rank <= 8")
def bm25_batch(spark, sf_dir):
    """5.1, 6.1, 7.1: the 8 best texts of every question."""
    return retrieval.bm25(chunks(spark, sf_dir), questions(spark, sf_dir))


@query(f"""WITH {_BM25.format(where='')} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf, round(a, 6) AS avg_length FROM df, st""")
def postings_stats(spark, sf_dir):
    """1.15, 10.9: document frequency and weight of every term."""
    docs = chunks(spark, sf_dir)
    df = retrieval.postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    joined = df.join(F.broadcast(retrieval.corpus_stats(docs)))
    return joined.select("term", "df", r6(numbers.idf(F.col("n"), F.col("df"))).alias("idf"), r6(F.col("avg_length")).alias("avg_length"))


@query(f"WITH {_TRI.format(where='')} SELECT query_id, id, score, rank FROM tcr WHERE rank <= 8")
def trigram_cosine_topk(spark, sf_dir):
    """9.2, 10.10, 7.7."""
    return retrieval.trigram_cosine(chunks(spark, sf_dir), questions(spark, sf_dir))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 8""")
def dense_cosine_topk(spark, sf_dir):
    """10.11, 7.5: the 8 most similar vectors of every hundredth."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.vector_cosine(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"))


@query(f"WITH {_BM25.format(where='')}, {_TRI.format(where='')}, {_RRF} SELECT query_id, id, score, stage, n_stages, rank FROM hy WHERE rank <= 8")
def hybrid_retrieve(spark, sf_dir):
    """11.5, 5.2, 10.21: two over-fetched rankings fused, with their stages."""
    out = fusion.hybrid(chunks(spark, sf_dir), questions(spark, sf_dir))
    return out.select("query_id", "id", "score", "stage", F.size("stages").cast("long").alias("n_stages"), "rank")


_LANGS = "WHERE lang IN ('de', 'fr')"


@query(f"WITH {_BM25.format(where=_LANGS)}, {_TRI.format(where=_LANGS)}, {_RRF} SELECT query_id, id, score, stage, rank FROM hy WHERE rank <= 8")
def hybrid_prefiltered(spark, sf_dir):
    """3.15, 3.16: languages stand for authority levels; the filter comes before both rankings."""
    out = fusion.hybrid(chunks(spark, sf_dir), questions(spark, sf_dir), allowed=F.col("lang").isin("de", "fr"))
    return out.select("query_id", "id", "score", "stage", "rank")


@query(f"""WITH {_BM25.format(where='')}, {_TRI.format(where='')}, {_RRF},
  kept AS (SELECT hy.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM hy JOIN documents ON doc_id = id WHERE lang IN ('de', 'fr'))
  SELECT query_id, id, score, place AS rank FROM kept WHERE place <= 8""")
def crowding_out(spark, sf_dir):
    """3.17: the same filter after fusion leaves what was not crowded out."""
    docs, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    dense = retrieval.trigram_cosine(docs, asked, 24).select("query_id", "id", "rank", F.lit("vector").alias("stage"))
    lexical = retrieval.bm25(docs, asked, 24).select("query_id", "id", "rank", F.lit("bm25").alias("stage"))
    fused = fusion.rrf(dense.unionByName(lexical)).join(docs.select("id", "lang"), "id")
    return fusion.guard_after_fusion(fused, F.col("lang"), ["de", "fr"], 8).select("query_id", "id", "score", "rank")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(1.0 / rank, 6)::DOUBLE AS score, rank FROM r WHERE rank <= 8""")
def vector_only_retrieve(spark, sf_dir):
    """6.2: one stage alone scores by its rank."""
    return fusion.reciprocal_rank_only(dense_cosine_topk(spark, sf_dir))


@query(f"""WITH {_BM25.format(where='')},
  hops AS (SELECT (query_id % 10) AS question, id, score, query_id AS hop, rank FROM bmr WHERE rank <= 8),
  m AS (SELECT *, row_number() OVER (PARTITION BY question, id ORDER BY score DESC, hop, rank) AS n FROM hops) SELECT question, id, score, hop FROM m WHERE n = 1""")
def merge_keep_max(spark, sf_dir):
    """6.3, 11.20: the hops of a question merged, the better score stays."""
    hops = bm25_batch(spark, sf_dir).withColumn("question", F.col("query_id") % 10).withColumn("pos", F.struct("query_id", "rank"))
    return fusion.keep_max(hops, ["question", "id"]).select("question", "id", "score", F.col("query_id").alias("hop"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1), o_totalprice DESC, o_orderkey) AS place FROM orders)
  SELECT o_custkey, o_orderkey, place FROM o""")
def authority_rerank(spark, sf_dir):
    """3.13, 7.8: order priorities stand for authority levels."""
    o = table(spark, sf_dir, "orders").withColumn("pos", F.col("o_orderkey"))
    return fusion.authority_rerank(o, F.substring("o_orderpriority", 1, 1), ["o_custkey"], "o_totalprice").select("o_custkey", "o_orderkey", "place")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_partkey WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 19 THEN 3 ELSE 4 END, p_partkey) AS place FROM part""")
def scripted_rerank(spark, sf_dir):
    """7.9: within each brand listed keys first, repeats ignored."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_partkey").alias("pos"))
    return fusion.scripted_rerank(part, "p_partkey", [7, 3, 7, 19], by=["p_brand"]).select("p_partkey", "place")


@query("""WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY user_id)
  SELECT user_id, CASE WHEN len(t) > 1 THEN 'hybrid' ELSE t[1] END AS stage, array_to_string(list_sort(list_distinct(list_append(t, 'rerank-survivor'))), ',') AS tags FROM s""")
def summary_stage_tags(spark, sf_dir):
    """8.9, 10.21."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return s.select("user_id", numbers.summary_stage(F.col("t")).alias("stage"), F.array_join(fusion.tag_survivors(F.col("t")), ",").alias("tags"))


# --- paths and cites -----------------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subsections of nations as sections of regions as parts."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    seg = lambda kind, col: F.struct(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("label"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("c_custkey", F.array(seg("part", "r_name"), seg("section", "n_name"), seg("subsection", "c_custkey")).alias("segments"))


_KEYS = "tree AS (SELECT c_custkey, concat_ws('|', 'geo', 'part:' || r_name, 'section:' || n_name, 'subsection:' || c_custkey) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_NODES = "nodes AS (SELECT DISTINCT array_to_string(string_split(key, '|')[1:d], '|') AS key FROM tree, (VALUES (1), (2), (3), (4)) AS x(d))"


def _keys(spark, sf_dir) -> DataFrame:
    return _tree(spark, sf_dir).select("c_custkey", paths.path_key(F.lit("geo"), F.col("segments")).alias("key"))


def _nodes(spark, sf_dir) -> DataFrame:
    parts = F.split("key", "\\|")
    return _keys(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "|"))).alias("key")).distinct()


@query(f"WITH {_KEYS} SELECT c_custkey, key FROM tree")
def path_key_build(spark, sf_dir):
    """9.17."""
    return _keys(spark, sf_dir)


@query("""SELECT c_custkey, 'geo / Part ' || r_name || ' / s. ' || n_name || ' / (' || c_custkey || ')' AS human, 3::BIGINT AS depth, c_custkey::VARCHAR AS last_label
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def path_key_parse(spark, sf_dir):
    """9.18, 9.19: keys read back and written for people."""
    parsed = _keys(spark, sf_dir).withColumn("p", paths.parse_key(F.col("key")))
    return parsed.select("c_custkey", paths.human_path(F.col("p.document_id"), F.col("p.segments")).alias("human"), F.size("p.segments").cast("long").alias("depth"), F.element_at("p.segments", -1)["label"].alias("last_label"))


@query(f"WITH {_KEYS}, {_NODES} SELECT a.key AS ancestor, count(*) AS descendants FROM nodes AS a JOIN nodes AS b ON starts_with(b.key, a.key || '|') GROUP BY a.key")
def ancestor_descendant_pairs(spark, sf_dir):
    """3.2, 3.3: descendants of every node; ancestors are read off each key, so nothing is compared."""
    parts = F.split("key", "\\|")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "|"))
    return _nodes(spark, sf_dir).where(F.size(parts) > 1).select(F.explode(up).alias("ancestor")).groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"))


_CITES = f"""{_KEYS}, {_NODES},
  required AS (SELECT o_orderkey AS item_id, CASE o_orderkey % 3 WHEN 0 THEN key ELSE array_to_string(string_split(key, '|')[1:3], '|') END AS key FROM orders JOIN tree ON o_custkey = c_custkey),
  candidate AS (SELECT DISTINCT o_orderkey AS item_id, CASE WHEN o_orderkey % 5 = 0 THEN key || '|clause:none' WHEN o_orderkey % 7 = 0 THEN array_to_string(string_split(key, '|')[1:2], '|') ELSE key END AS key
                FROM orders JOIN tree ON o_custkey + (o_orderkey % 2) = c_custkey),
  pairs AS (SELECT r.item_id, r.key AS required, c.key AS candidate, CASE WHEN n.key IS NULL THEN 'unresolvable' WHEN r.key = c.key THEN 'exact' WHEN starts_with(c.key, r.key || '|') THEN 'descendant-satisfies-ancestor'
              WHEN starts_with(r.key, c.key || '|') THEN 'ancestor-partial' ELSE 'no-match' END AS verdict
            FROM required AS r JOIN candidate AS c USING (item_id) LEFT JOIN nodes AS n ON n.key = c.key),
  good AS (SELECT DISTINCT item_id, candidate FROM pairs WHERE verdict IN ('exact', 'descendant-satisfies-ancestor')),
  done AS (SELECT DISTINCT item_id, required FROM pairs WHERE verdict IN ('exact', 'descendant-satisfies-ancestor')),
  pr AS (SELECT item_id, avg((g.candidate IS NOT NULL)::INT) AS p FROM candidate AS c LEFT JOIN good AS g USING (item_id) GROUP BY item_id),
  rc AS (SELECT item_id, avg((d.required IS NOT NULL)::INT) AS r FROM required LEFT JOIN done AS d USING (item_id) GROUP BY item_id),
  prc AS (SELECT o_orderkey AS item_id, round(coalesce(p, 1.0), 6)::DOUBLE AS cite_precision, round(coalesce(r, 1.0), 6)::DOUBLE AS cite_recall FROM orders LEFT JOIN pr ON pr.item_id = o_orderkey LEFT JOIN rc ON rc.item_id = o_orderkey)"""


def _cites(spark, sf_dir):
    """Items are orders: one required and at most one candidate cite each."""
    keys, orders = _keys(spark, sf_dir), table(spark, sf_dir, "orders")
    cut = lambda d: F.substring_index("key", "|", d)
    required = orders.join(keys, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("key")).otherwise(cut(3)).alias("key"))
    offered = orders.join(keys, F.col("o_custkey") + F.col("o_orderkey") % 2 == F.col("c_custkey"))
    key = F.when(F.col("o_orderkey") % 5 == 0, F.concat("key", F.lit("|clause:none"))).when(F.col("o_orderkey") % 7 == 0, cut(2)).otherwise(F.col("key"))
    candidate = offered.select(F.col("o_orderkey").alias("item_id"), key.alias("key")).distinct()
    return orders.select(F.col("o_orderkey").alias("item_id"), "o_orderstatus", "o_orderpriority", "o_totalprice"), required, candidate, _nodes(spark, sf_dir)


@query(f"WITH {_CITES} SELECT verdict, count(*) AS n, min(item_id) AS first_item, max(item_id) AS last_item FROM pairs GROUP BY verdict")
def cite_verdicts(spark, sf_dir):
    """3.5, 3.6, 4.1: the five verdicts."""
    _, required, candidate, nodes = _cites(spark, sf_dir)
    return cites.verdicts(required, candidate, nodes).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))


@query(f"WITH {_CITES} SELECT c.item_id, c.key, n.key IS NOT NULL AS resolves FROM candidate AS c LEFT JOIN nodes AS n ON n.key = c.key")
def resolves_to_node(spark, sf_dir):
    """3.4."""
    _, _, candidate, nodes = _cites(spark, sf_dir)
    return cites.resolves(candidate, nodes).select("item_id", "key", "resolves")


@query(f"WITH {_CITES} SELECT * FROM prc")
def cite_precision_recall(spark, sf_dir):
    """5.3."""
    items, required, candidate, nodes = _cites(spark, sf_dir)
    out = cites.precision_recall(items, required, candidate, nodes)
    return out.select("item_id", r6(F.col("cite_precision")).alias("cite_precision"), r6(F.col("cite_recall")).alias("cite_recall"))


@query(f"""WITH {_BM25.format(where='')}, hits AS (SELECT b.item_id, max((r.id IS NOT NULL)::INT) AS hit FROM benchmark AS b JOIN documents AS d ON contains(d.text, b.text)
    LEFT JOIN bmr AS r ON r.query_id = b.item_id AND r.id = d.doc_id AND r.rank <= 8 GROUP BY b.item_id, d.doc_id)
  SELECT b.item_id, round(coalesce(avg(hit), 1.0), 6)::DOUBLE AS hit_rate, count(hit) AS required FROM benchmark AS b LEFT JOIN hits USING (item_id) GROUP BY b.item_id""")
def retrieval_hit_rate(spark, sf_dir):
    """5.4: the documents that hold a benchmark passage are what its retrieval should reach."""
    asked = questions(spark, sf_dir)
    holds = graph.attach_definitions(asked.select(F.col("text").alias("term")), chunks(spark, sf_dir)).join(chunks(spark, sf_dir).select("id", F.col("text").alias("body")), "id")
    holds = holds.where(F.contains("body", "term")).join(asked.withColumnRenamed("text", "term"), "term").select("query_id", "id").distinct()
    found = bm25_batch(spark, sf_dir).select("query_id", "id", F.lit(1.0).alias("hit"))
    rate = holds.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("hit_rate"), F.count(F.lit(1)).alias("required"))
    out = asked.join(rate, "query_id", "left")
    return out.select(F.col("query_id").alias("item_id"), r6(F.coalesce("hit_rate", F.lit(1.0))).alias("hit_rate"), F.coalesce("required", F.lit(0)).alias("required"))


_SCORES = f"""{_CITES},
  scores AS (SELECT item_id, o_orderpriority AS behavior_class, o_orderstatus = 'F' AS behavior_match, cite_precision, cite_recall, cite_recall AS retrieval_hit_rate, o_orderstatus = 'F' AND cite_recall = 1.0 AS strict_pass,
             o_totalprice AS latency_ms, round(o_totalprice / 1e6, 9) AS cost_usd FROM prc JOIN orders ON o_orderkey = item_id)"""


def _scores(spark, sf_dir) -> DataFrame:
    items, required, candidate, nodes = _cites(spark, sf_dir)
    items = items.withColumnRenamed("o_orderpriority", "behavior_class")
    outcomes = items.select("item_id", F.when(F.col("o_orderstatus") == "F", F.col("behavior_class")).otherwise("other").alias("observed_behavior"))
    scored = cites.score_items(items.select("item_id", "behavior_class"), outcomes, required, candidate, candidate, nodes)
    return scored.join(items.select("item_id", F.col("o_totalprice").alias("latency_ms"), F.round(F.col("o_totalprice") / 1e6, 9).alias("cost_usd")), "item_id")


@query(f"WITH {_SCORES} SELECT item_id, behavior_class, behavior_match, cite_precision, cite_recall, retrieval_hit_rate, strict_pass FROM scores")
def item_scores(spark, sf_dir):
    """5.5, 3.27."""
    out = _scores(spark, sf_dir)
    return out.select("item_id", "behavior_class", "behavior_match", r6(F.col("cite_precision")).alias("cite_precision"), r6(F.col("cite_recall")).alias("cite_recall"), r6(F.col("retrieval_hit_rate")).alias("retrieval_hit_rate"), "strict_pass")


@query(f"""WITH {_SCORES} SELECT coalesce(behavior_class, 'all') AS slice, count(*) AS n, round(avg(strict_pass::INT), 6)::DOUBLE AS strict_pass_rate, round(avg(behavior_match::INT), 6)::DOUBLE AS behavior_rate,
  round(avg(cite_precision), 6) AS cite_precision, round(avg(cite_recall), 6) AS cite_recall, round(avg(retrieval_hit_rate), 6) AS hit_rate, round(median(latency_ms), 6) AS p50_latency_ms, round(sum(cost_usd), 6) AS cost_usd
  FROM scores GROUP BY GROUPING SETS ((behavior_class), ())""")
def score_dashboard(spark, sf_dir):
    """5.8, 10.13."""
    return evaluation.score_dashboard(_scores(spark, sf_dir))


@query(f"""WITH {_SCORES}, reached AS (SELECT DISTINCT p.item_id, p.required, unnest(CASE WHEN p.item_id % 2 = 0 THEN ['vector'] WHEN p.item_id % 3 = 0 THEN ['bm25', 'vector'] ELSE ['bm25', 'extra'] END) AS stage
    FROM pairs AS p WHERE verdict IN ('exact', 'descendant-satisfies-ancestor')),
  n AS (SELECT item_id, required, count(*) AS n FROM reached GROUP BY ALL),
  stages(stage, stage_pos) AS (VALUES ('vector', 1), ('bm25', 2), ('graph-expansion', 3), ('rerank-survivor', 4), ('extra', 99))
  SELECT stage, stage_pos, count(r.item_id) AS reached, count(*) FILTER (n.n = 1) AS rescued_only FROM stages LEFT JOIN reached AS r USING (stage) LEFT JOIN n USING (item_id, required) GROUP BY stage, stage_pos""")
def rescue_stats(spark, sf_dir):
    """5.13, 5.14, 7.15."""
    _, required, candidate, nodes = _cites(spark, sf_dir)
    lists = [F.array(*map(F.lit, x)) for x in (["vector"], ["bm25", "vector"], ["bm25", "extra"])]
    staged = candidate.withColumn("stages", F.when(F.col("item_id") % 2 == 0, lists[0]).when(F.col("item_id") % 3 == 0, lists[1]).otherwise(lists[2]))
    return cites.rescue_stats(required, staged, nodes)


@query("""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, list(l_partkey ORDER BY l_partkey) AS cites FROM lineitem GROUP BY ALL), x AS (SELECT id, n, unnest(cites) AS cite FROM c)
  SELECT id, n, cite::VARCHAR AS cite FROM x WHERE EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_orderkey = x.id AND l.l_partkey = x.cite AND l.l_returnflag <> 'R')""")
def claim_clamp(spark, sf_dir):
    """3.26, 10.24: cites of claims that were not retrieved drop out."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), "l_returnflag")
    claim = li.groupBy("id", "n").agg(F.collect_list(F.col("part").cast("string")).alias("cites"))
    claims = claim.groupBy("id").agg(F.collect_list(F.struct(F.col("n").cast("string").alias("text"), "cites")).alias("claims"))
    allowed = li.where("l_returnflag <> 'R'").select("id", F.col("part").cast("string").alias("key"))
    flat = cites.clamp_claims(claims, allowed).select("id", F.explode("claims").alias("c"))
    return flat.select("id", F.col("c.text").cast("int").alias("n"), F.explode("c.cites").alias("cite"))


# --- evaluation --------------------------------------------------------------------------------

_ARMS = """arms AS (SELECT user_id AS item_id, event_type AS arm, avg(value) AS v, count(*) AS k, avg(value) > 50 AS strict_pass, CASE user_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'refuse' ELSE 'flag' END AS behavior_class FROM events GROUP BY ALL)"""


def _arms(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item_id"), F.col("event_type").alias("arm")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("k"))
    cls = F.when(F.col("item_id") % 3 == 0, "answer").when(F.col("item_id") % 3 == 1, "refuse").otherwise("flag")
    return e.withColumn("strict_pass", F.col("v") > 50).withColumn("behavior_class", cls).withColumn("retrieval_hit_rate", F.col("v"))


@query(f"""WITH {_ARMS} SELECT coalesce(a.behavior_class, 'all') AS slice, count(*) AS n, round(avg(a.v), 6) AS baseline, round(avg(b.v), 6) AS treatment, round(avg(b.v) - avg(a.v), 6) AS delta
  FROM arms AS a JOIN arms AS b USING (item_id) WHERE a.arm = 'click' AND b.arm = 'view' GROUP BY GROUPING SETS ((a.behavior_class), ())""")
def arm_comparison(spark, sf_dir):
    """5.9, 4.8."""
    a = _arms(spark, sf_dir)
    return evaluation.arm_comparison(a.where("arm = 'click'"), a.where("arm = 'view'"), "v")


@query(f"""WITH {_ARMS} SELECT coalesce(behavior_class, 'all') AS slice, arm, count(*) AS n, round(avg(strict_pass::INT), 6)::DOUBLE AS strict_pass_rate, CASE WHEN arm IN ('click', 'view') THEN round(avg(v), 6) END AS hit_rate
  FROM arms GROUP BY GROUPING SETS ((behavior_class, arm), (arm))""")
def four_arm_table(spark, sf_dir):
    """5.11, 3.28: retrieval measures only for the retrieval arms."""
    a = _arms(spark, sf_dir)
    return evaluation.arm_table(a, None, ["click", "view"])


_POINTS = "points AS (SELECT l.doc_id AS point_id, quality = 1 AS human, toxic = 1 AS judge, lang FROM labels AS l JOIN documents USING (doc_id))"
_KAPPA = """a AS (SELECT coalesce(lang, 'all') AS slice, count(*) AS n, avg((human = judge)::INT) AS o, avg(human::INT) AS h, avg(judge::INT) AS j FROM points GROUP BY GROUPING SETS ((lang), ())),
  k AS (SELECT *, h * j + (1 - h) * (1 - j) AS e FROM a),
  kk AS (SELECT slice, n, round(CASE WHEN e >= 1 THEN CASE WHEN o >= 1 THEN 1.0 ELSE 0.0 END ELSE (o - e) / (1 - e) END, 6)::DOUBLE AS kappa, round(o, 6)::DOUBLE AS observed_agreement, round((h + j) / 2, 6)::DOUBLE AS positive_prevalence FROM k)"""


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("point_id"), (F.col("quality") == 1).alias("human"), (F.col("toxic") == 1).alias("judge"), "lang")


@query(f"WITH {_POINTS}, {_KAPPA} SELECT *, CASE WHEN kappa >= 0.61 THEN 'trusted' WHEN kappa >= 0.41 THEN 'published-with-analysis' ELSE 'not-trusted' END AS band FROM kk")
def cohen_kappa_by_class(spark, sf_dir):
    """5.15-5.17, 10.18."""
    return evaluation.agreement(_points(spark, sf_dir), "lang")


@query("""WITH r AS (SELECT doc_id, quality = 1 AS a, toxic = 1 AS b, doc_id % 3 = 0 AS c FROM labels),
  p AS (SELECT 'a~b' AS pair, a AS x, b AS y FROM r UNION ALL SELECT 'a~c', a, c FROM r UNION ALL SELECT 'b~c', b, c FROM r),
  s AS (SELECT pair, count(*) AS n, avg((x = y)::INT) AS o, avg(x::INT) AS h, avg(y::INT) AS j FROM p GROUP BY pair), k AS (SELECT *, h * j + (1 - h) * (1 - j) AS e FROM s)
  SELECT pair, n, round(CASE WHEN e >= 1 THEN CASE WHEN o >= 1 THEN 1.0 ELSE 0.0 END ELSE (o - e) / (1 - e) END, 6)::DOUBLE AS kappa FROM k""")
def judge_judge_kappa(spark, sf_dir):
    """5.18, 4.13."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    long = l.select(F.col("doc_id").alias("point_id"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"), (F.col("doc_id") % 3 == 0).alias("c")).unpivot("point_id", ["a", "b", "c"], "rater", "credited")
    return evaluation.rater_kappas(long, ["a", "b", "c"])


@query("""WITH r AS (SELECT event_type AS arm, ts::DATE AS d, avg((value > 50)::INT) AS rate FROM events GROUP BY ALL)
  SELECT arm, count(*) AS repeats, round(min(rate), 6)::DOUBLE AS low, round(max(rate), 6)::DOUBLE AS high, round(max(rate) - min(rate), 6)::DOUBLE AS spread FROM r GROUP BY arm""")
def noise_floor(spark, sf_dir):
    """5.19: days are repeats."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.to_date("ts").alias("repeat"), (F.col("value") > 50).alias("strict_pass"))
    return evaluation.noise_floor(e)


@query("""WITH f AS (SELECT o_orderkey AS item_id, CASE WHEN o_totalprice < 100000 THEN 'retrieval' ELSE 'synthesis' END AS stage, o_orderpriority AS behavior_class, n_name AS corpus, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS disposition
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
  t AS (SELECT stage, behavior_class, corpus, coalesce(disposition, 'none') AS d, count(*) AS m FROM f GROUP BY ALL),
  tt AS (SELECT stage, behavior_class, corpus, string_agg(d || '=' || m, ',' ORDER BY d || '=' || m) AS dispositions FROM t GROUP BY ALL),
  c AS (SELECT stage, behavior_class, corpus, count(*) AS n, min(item_id) AS first_item, max(item_id) AS last_item FROM f GROUP BY ALL)
  SELECT * FROM c JOIN tt USING (stage, behavior_class, corpus)""")
def failure_digest(spark, sf_dir):
    """5.21, 10.19."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    f = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("item_id"), numbers.failure_stage(F.col("o_totalprice") / 100000).alias("stage"), F.col("o_orderpriority").alias("behavior_class"), F.col("n_name").alias("corpus"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus")).alias("disposition")
    )
    return evaluation.failure_digest(f)


@query("SELECT o_orderkey AS object_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R'))")
def preflight_anti(spark, sf_dir):
    """4.17: orders without a returned line."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_returnflag").alias("disposition"))
    return evaluation.undispositioned(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id")), li, ["A", "R"])


@query("""SELECT trace_id, name, value FROM (SELECT event_id AS trace_id, value AS raw, (value > 50)::INT::DOUBLE AS passed FROM events WHERE value >= 10) UNPIVOT (value FOR name IN (raw, passed))""")
def score_sink_long(spark, sf_dir):
    """1.30: scores as long rows, untraced ones dropped."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("value") >= 10, F.col("event_id")).alias("trace_id"), F.col("value").alias("raw"), (F.col("value") > 50).alias("passed"))
    return evaluation.long_scores(e.withColumn("passed", F.col("passed").cast("int")), ["raw", "passed"])


@query("""SELECT doc_id AS item_id, round(avg(quality), 6)::DOUBLE AS point_score, bool_and(quality = 1) AS all_credited FROM labels GROUP BY doc_id""")
def point_score(spark, sf_dir):
    """5.25."""
    return evaluation.point_scores(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("credited")))


# --- statistics ---------------------------------------------------------------------------------


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, (quality - toxic)::DOUBLE AS gap FROM labels), n AS (SELECT count(*) AS n FROM i),
  d AS (SELECT it, ('0x' || substr(md5('7:' || it || ':' || slot), 1, 12))::BIGINT % n AS idx FROM n, range(200) AS a(it), range((SELECT count(*) FROM labels)) AS b(slot)),
  g AS (SELECT it, avg(gap) AS gap FROM d JOIN i USING (idx) GROUP BY it)
  SELECT round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high, count(*) AS iterations, (SELECT round(avg(gap), 6) FROM i) AS point FROM g""")
def bootstrap_ci_hash(spark, sf_dir):
    """12.1, 10.12, with the hash generator."""
    pairs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("treatment"), F.col("toxic").alias("baseline"))
    return stats.paired_bootstrap(pairs, 7, 200)


@query()
def bootstrap_ci_mersenne(spark, sf_dir):
    """12.1 with the sequential generator."""
    pairs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("treatment"), F.col("toxic").alias("baseline"))
    return stats.paired_bootstrap(pairs, 7, 100, generator="mersenne")


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, quality::DOUBLE AS h, toxic::DOUBLE AS j FROM labels), n AS (SELECT count(*) AS n FROM i),
  d AS (SELECT it, ('0x' || substr(md5('3:' || it || ':' || slot), 1, 12))::BIGINT % n AS idx FROM n, range(100) AS a(it), range((SELECT count(*) FROM labels)) AS b(slot)),
  s AS (SELECT it, avg((h = j)::INT) AS o, avg(h) AS h, avg(j) AS j FROM d JOIN i USING (idx) GROUP BY it UNION ALL SELECT -1, avg((h = j)::INT), avg(h), avg(j) FROM i),
  k AS (SELECT it, o, h * j + (1 - h) * (1 - j) AS e FROM s), kk AS (SELECT it, CASE WHEN e >= 1 THEN CASE WHEN o >= 1 THEN 1.0 ELSE 0.0 END ELSE (o - e) / (1 - e) END AS kappa FROM k)
  SELECT round(quantile_cont(kappa, 0.025) FILTER (it >= 0), 6) AS low, round(quantile_cont(kappa, 0.975) FILTER (it >= 0), 6) AS high, count(*) FILTER (it >= 0) AS iterations, round(max(kappa) FILTER (it < 0), 6) AS point FROM kk""")
def kappa_bootstrap_hash(spark, sf_dir):
    """12.2."""
    p = _points(spark, sf_dir)
    return stats.kappa_bootstrap(p, 3, 100)


@query("""WITH p AS (SELECT c_custkey AS item_id, c_mktsegment AS seg, c_nationkey AS nat, CASE WHEN c_custkey % 20 = 0 THEN CASE WHEN c_custkey % 40 = 0 THEN 'dev' ELSE 'holdout' END END AS pin, sha256(c_custkey::VARCHAR) AS h FROM customer),
  q AS (SELECT *, greatest(floor(0.7::DOUBLE * count(*) OVER w + 0.5::DOUBLE) - count(*) FILTER (pin = 'dev') OVER w, 0) AS quota, row_number() OVER (PARTITION BY seg, nat, pin IS NULL ORDER BY h, item_id) AS n FROM p WINDOW w AS (PARTITION BY seg, nat))
  SELECT item_id, coalesce(pin, CASE WHEN n <= quota THEN 'dev' ELSE 'holdout' END) AS side FROM q""")
def stratified_split(spark, sf_dir):
    """6.5, 4.12."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), "c_mktsegment", "c_nationkey")
    pin = F.when(F.col("item_id") % 20 == 0, F.when(F.col("item_id") % 40 == 0, "dev").otherwise("holdout"))
    return stats.stratified_split(c.withColumn("pin", pin), ["c_mktsegment", "c_nationkey"], frozen="pin").select("item_id", "side")


@query("""WITH p AS (SELECT doc_id::VARCHAR AS item_id, lang AS behavior_class, row_number() OVER (PARTITION BY lang ORDER BY sha256('19:' || doc_id), doc_id::VARCHAR) AS n FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT count_if(behavior_class = 'de') AS de, count_if(behavior_class = 'fr') AS fr FROM p)
  SELECT item_id, behavior_class FROM p, c WHERE behavior_class = 'de' AND n <= least(3, de) OR behavior_class = 'fr' AND n <= least(3, fr) OR behavior_class = 'en' AND n <= 20 - least(3, de) - least(3, fr)""")
def calibration_slice(spark, sf_dir):
    """6.12 with hash order: a floor for two classes, the rest from a third."""
    pool = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("string").alias("item_id"), F.col("lang").alias("behavior_class"))
    return stats.hash_slice(pool, 20, {"de": 3, "fr": 3}, "en", 19)


@query("""WITH p AS (SELECT DISTINCT conv_id, CASE WHEN sha256(conv_id::VARCHAR) < '8' THEN 'dev' ELSE 'holdout' END AS side FROM conversations) SELECT conv_id * 1000 + turn AS item_id, side FROM conversations JOIN p USING (conv_id)""")
def paraphrase_inherit(spark, sf_dir):
    """4.11: turns take the side of their conversation's first."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"))
    first = c.groupBy("conv_id").agg(F.min("item_id").alias("parent"))
    sides = first.select(F.col("parent").alias("item_id"), F.when(F.sha2(F.col("conv_id").cast("string"), 256) < "8", "dev").otherwise("holdout").alias("side"))
    items = c.join(first, "conv_id").select("item_id", F.when(F.col("item_id") != F.col("parent"), F.col("parent")).alias("paraphrase_of"))
    return stats.inherit_sides(items, sides).select("item_id", "side")


@query("""WITH r AS (SELECT event_type, avg((value > 50)::INT)::DOUBLE AS rate FROM events GROUP BY event_type), n AS (SELECT row_number() OVER (ORDER BY event_type) AS rung, rate FROM r)
  SELECT rung, round(rate, 6) AS rate, round(rate - lag(rate) OVER (ORDER BY rung), 6) AS step_delta, round(rate - (SELECT rate FROM n ORDER BY rung DESC LIMIT 1), 6) AS full_delta FROM n""")
def ladder_deltas(spark, sf_dir):
    """6.8, 6.9: event types are rungs."""
    rates = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("double")).alias("rate"))
    rungs = rates.select(F.row_number().over(Window.orderBy("event_type")).cast("long").alias("rung"), "rate")
    return stats.ladder_deltas(rungs).withColumn("rate", r6(F.col("rate")))


@query("""WITH b AS (SELECT user_id % 50 AS component, round(avg(CASE WHEN event_type = 'click' THEN value END) / 100 - 0.45, 6) AS build_delta, round(avg(CASE WHEN event_type = 'view' THEN value END) / 100 - 0.5, 6) AS knock_delta FROM events GROUP BY 1)
  SELECT * FROM b WHERE build_delta >= 0.10 AND abs(knock_delta) <= 0.05""")
def redundancy_findings(spark, sf_dir):
    """5.32."""
    e = table(spark, sf_dir, "events").withColumn("component", F.col("user_id") % 50)
    rate = lambda kind, off: e.where(F.col("event_type") == kind).groupBy("component").agg(r6(F.avg("value") / 100 - off).alias("delta"))
    return stats.redundancies(rate("click", 0.45), rate("view", 0.5))


# --- graph, corpus, scalar functions ---------------------------------------------------------------


@query("""WITH seeds AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'),
  e AS (SELECT [l_orderkey, l_linenumber, l_partkey, l_suppkey] AS pos, l_orderkey AS a, l_partkey + 10000000 AS b FROM lineitem),
  both_ AS (SELECT pos, 0 AS turn, a AS via, b AS key FROM e UNION ALL SELECT pos, 1, b, a FROM e),
  o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos, turn) AS n FROM both_ WHERE via IN (SELECT k FROM seeds) AND key NOT IN (SELECT k FROM seeds) AND key IN (SELECT p_partkey + 10000000 FROM part WHERE p_size > 5))
  SELECT key, via, pos[1] AS edge_order, pos[2] AS edge_line FROM o WHERE n = 1""")
def graph_expand_one_hop(spark, sf_dir):
    """4.3: order lines are edges from orders to parts."""
    li = table(spark, sf_dir, "lineitem")
    pos = F.struct(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])  # an order without numbering
    edges = li.select(pos.alias("edge_pos"), F.col("l_orderkey").alias("source"), (F.col("l_partkey") + 10000000).alias("target"))
    seeds = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    parts = table(spark, sf_dir, "part").where("p_size > 5").select((F.col("p_partkey") + 10000000).alias("key"))
    return graph.expand_one_hop(seeds, edges, parts).select("key", "via", F.col("edge_pos.l_orderkey").alias("edge_order"), F.col("edge_pos.l_linenumber").alias("edge_line"))


@query("""WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark), u AS (SELECT term FROM t WHERE length(term) >= 9) SELECT doc_id AS id, term FROM documents JOIN u ON contains(lower(text), lower(term))""")
def attach_definitions(spark, sf_dir):
    """4.6: long words of the benchmark are the dictionary."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).where("length(term) >= 9").distinct()
    return graph.attach_definitions(terms, chunks(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT line, count(*) AS expected FROM d WHERE doc_id % 2 = 0 GROUP BY line), b AS (SELECT line, count(*) AS parsed FROM d WHERE doc_id % 2 = 1 GROUP BY line)
  SELECT line, coalesce(expected, 0) AS expected, coalesce(parsed, 0) AS parsed FROM a FULL JOIN b USING (line) WHERE coalesce(expected, 0) <> coalesce(parsed, 0)""")
def multiset_diff(spark, sf_dir):
    """8.4, 5.26: lines of even and odd documents."""
    lines = chunks(spark, sf_dir).select("id", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.multiset_difference(lines.where("id % 2 = 0"), lines.where("id % 2 = 1"), "line")


@query("""WITH p AS (SELECT doc_id AS document_id, unnest(string_split(text, '. ')) AS part, text FROM documents) SELECT document_id, count(part) AS parts, count_if(contains(text, part || '.')) AS verbatim, round(avg(contains(text, part || '.')::INT), 6)::DOUBLE AS ratio FROM p GROUP BY document_id""")
def text_fidelity(spark, sf_dir):
    """5.29."""
    docs = chunks(spark, sf_dir).select(F.col("id").alias("document_id"), "text")
    parts = docs.select("document_id", F.explode(F.split("text", "\\. ")).alias("text"))
    return corpus.text_fidelity(parts.withColumn("text", F.concat("text", F.lit("."))), docs)


@query("""WITH c AS (SELECT doc_id AS document_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS whole FROM documents), p AS (SELECT document_id, whole, unnest(string_split(whole, '. ')) || '.' AS part FROM c),
  n AS (SELECT document_id, whole, part, count(*) AS needed FROM p GROUP BY ALL), f AS (SELECT *, ((length(whole) - length(replace(whole, part, ''))) / length(part))::BIGINT AS found FROM n)
  SELECT document_id, part, needed, found FROM f WHERE found < needed""")
def coverage_gaps(spark, sf_dir):
    """5.30: sentences against the whole text."""
    docs = chunks(spark, sf_dir).select(F.col("id").alias("document_id"), F.trim(F.regexp_replace("text", "\\s+", " ")).alias("text"))
    parts = docs.select("document_id", F.explode(F.split("text", "\\. ")).alias("text")).withColumn("text", F.concat("text", F.lit(".")))
    return corpus.coverage(parts, docs)


@query("""WITH m AS (SELECT page_id::VARCHAR AS id, CASE WHEN page_id % 10 = 0 THEN sha256('x') ELSE sha256(html) END AS sha, strlen(html) AS bytes FROM pages), a AS (SELECT page_id::VARCHAR AS id, sha256(html) AS found FROM pages WHERE starts_with(url, 'https:'))
  SELECT id, CASE WHEN found IS NULL THEN 'error' WHEN found = sha THEN 'ok' ELSE 'mismatch' END AS status FROM m LEFT JOIN a USING (id)""")
def manifest_verify(spark, sf_dir):
    """12.15, 10.1: some digests are wrong, some sources missing."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), F.col("page_id").cast("string").alias("id"), "url", "html")
    manifest = pages.select("id", F.when(F.col("n") % 10 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("html", 256)).alias("sha256"), F.octet_length("html").alias("bytes"))
    return corpus.verify_manifest(manifest, pages.where("startswith(url, 'https:')").select("id", F.encode("html", "UTF-8").alias("content"))).select("id", "status")


@query("""WITH d AS (SELECT source, doc_id, concat_ws(':', doc_id, sha256(text)) AS line, sha256(doc_id::VARCHAR) AS name FROM documents), a AS (SELECT source, left(name, 6) AS leaf, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY doc_id)) AS line FROM d GROUP BY ALL),
  b AS (SELECT source, left(leaf, 3) AS up, sum(n) AS n, sha256(string_agg(line, chr(10) ORDER BY leaf)) AS line FROM a GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(line, chr(10) ORDER BY up)) AS digest FROM b GROUP BY source""")
def build_hash(spark, sf_dir):
    """1.9, 10.8: a digest of each source, as digests of digests."""
    docs = chunks(spark, sf_dir).select("source", "id", F.sha2("text", 256).alias("h"))
    return corpus.tree_digest(docs, "id", "h", "source")


@query("""SELECT conv_id, round(sum(((length(text) - least(turn * 10, length(text))) * 1.25::DOUBLE + least(turn * 10, length(text)) * 0.31::DOUBLE + 7 * 10.0::DOUBLE) / 1e6), 9) AS cost FROM conversations GROUP BY conv_id""")
def token_cost(spark, sf_dir):
    """10.14, 10.15."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.round(F.sum(numbers.token_cost(F.length("text"), F.col("turn") * 10, F.lit(7))), 9).alias("cost"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'create' WHEN user_id % 2 = 1 THEN 'recreate' WHEN epoch_ms(ts) + 86400000 > 1704153600000 THEN 'reuse' ELSE 'recreate' END AS action FROM events""")
def cache_decision(spark, sf_dir):
    """10.17."""
    e = table(spark, sf_dir, "events")
    record = F.when(F.col("event_id") % 11 != 0, F.lit("h0"))
    action = numbers.cache_action(record, F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string")), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") + 86400000, F.lit(1704153600000))
    return e.select("event_id", action.alias("action"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<p\\b')) AS paragraphs FROM pages""")
def html_headings(spark, sf_dir):
    """9.3, 9.5, 2.3: the first heading's text and the number of paragraphs."""
    h = F.regexp_extract("html", "(?is)<h1\\b[^>]*>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.collapse_spaces(text.strip_tags(h)).alias("title"), F.regexp_count("html", F.lit("(?i)<p\\b")).cast("long").alias("paragraphs"))


@query()
def slugify_titles(spark, sf_dir):
    """9.6: titles as slugs."""
    title = text.html_text(F.regexp_extract("html", "(?is)<h1\\b[^>]*>(.*?)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", text.slugify(title).alias("slug"))


_SPLIT = lambda kind: text.head_marker(F.col("line"), kind)


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM s)
  SELECT doc_id, pos, nullif(regexp_extract(line, '^\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+', 1), '') AS section, nullif(regexp_extract(line, '^\\(\\s*(\\d+(?:\\.\\d+)*)\\s*\\)\\s*', 1), '') AS subsection,
    coalesce(nullif(regexp_extract(line, '(?i)^\\(\\s*([a-z]+(?:\\.\\d+)?)\\s*\\)\\s*', 1), ''), nullif(regexp_extract(line, '^(\\d+(?:\\.\\d+)*)\\.\\s+', 1), '')) AS clause, nullif(regexp_extract(line, '(?i)^\\(?\\s*([ivxlcdm]+)\\s*[).]\\s*', 1), '') AS subparagraph FROM l""")
def head_markers_of_lines(spark, sf_dir):
    """9.8-9.11 over every line of every document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), _SPLIT("section")["label"].alias("section"), _SPLIT("subsection")["label"].alias("subsection"), text.clause_marker(F.col("line"))["label"].alias("clause"), _SPLIT("subparagraph")["label"].alias("subparagraph"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
  m AS (SELECT conv_id, 0::BIGINT AS n, '' AS s FROM t WHERE n = 1 UNION ALL
    SELECT conv_id, n, CASE WHEN length(j) <= 2000 THEN j WHEN strpos(left(j, 2000), ' ') > 0 AND 2000 - strpos(reverse(left(j, 2000)), ' ') > 1000 THEN left(j, 2000 - strpos(reverse(left(j, 2000)), ' ')) ELSE left(j, 2000) END
    FROM (SELECT m.conv_id, t.n, CASE WHEN m.s = '' THEN t.text ELSE m.s || ' ' || t.text END AS j FROM m JOIN t ON t.conv_id = m.conv_id AND t.n = m.n + 1))
  SELECT conv_id, n AS turns, s AS summary FROM m WHERE n = (SELECT max(t.n) FROM t WHERE t.conv_id = m.conv_id)""")
def session_memory_batch(spark, sf_dir):
    """11.28 in batch: the fold of the stream, turn by turn, over each conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    step = lambda seen, t: text.cap_summary(F.when(seen == "", t["text"]).otherwise(F.concat(seen, F.lit(" "), t["text"])))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), turns.alias("t"))
    return c.select("conv_id", "turns", F.aggregate("t", F.lit(""), step).alias("summary"))


@query()
def prose_parse_nodes(spark, sf_dir):
    """2.3, 2.11: every page as a tree of nodes."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id")).alias("document_id"), F.lit("").alias("title"), F.lit("prose").alias("family"), "html")
    return parse.parse_documents(pages)


@query()
def hierarchy_chunks(spark, sf_dir):
    """11.1-11.3, 9.20: chunks of the parsed pages with their paths in front."""
    return parse.chunks(prose_parse_nodes(spark, sf_dir), "hierarchy")


@query()
def bounded_agent_loop(spark, sf_dir):
    """11.17-11.25 with scripted seams: every benchmark passage as a question."""
    return agent.run_agent(questions(spark, sf_dir), chunks(spark, sf_dir).select("id", "text"))
