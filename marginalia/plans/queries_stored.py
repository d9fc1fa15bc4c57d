"""Named queries over stored things, with their SQL: indexes, stores, file sinks, streams, ladders with intervals.

As in the catalogue the tables stand in for the engine's own inputs; each query says which. Indexes and stores lie
in the scratch folder of the application, so a second call with the same tables finds the index built.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import artifacts, builds, embedding, indexes, ladders, memo, stats
from marginalia.plans import queries_more, reports  # noqa: F401 (queries_more registers what reports are made of)
from marginalia.plans.catalogue import _BM25, ORACLES, QUERIES, chunks, query, questions, table
from marginalia.plans.scratch import materialize, scratch_dir
from marginalia.sources.files import FileSink
from marginalia.sources.manifest import read_bytes
from marginalia.sources.sse_stream import SseSource
from marginalia.sources.stores import KeyedStore
from marginalia.streaming import chat


def _place(spark: SparkSession, sf_dir: str, what: str) -> str:
    """A folder for what is made of the tables of ``sf_dir``."""
    return f"{scratch_dir(spark)}/{what}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


# --- indexes ----------------------------------------------------------------------------


def _text_index(spark: SparkSession, sf_dir: str) -> indexes.TextIndex:
    return indexes.ensure_text_index(chunks(spark, sf_dir), _place(spark, sf_dir, "indexes"), "text", filters=("lang",), near=("source",))[0]


@query(ORACLES["bm25_batch"])
def bm25_indexed(spark, sf_dir):
    """1.15, 7.6: the 8 best texts of every question from the stored index, its blocks pruned by their largest impacts."""
    return indexes.search_text(_text_index(spark, sf_dir), questions(spark, sf_dir)).result


_SOME = "WHERE lang IN ('de', 'fr')"


@query(f"""WITH {_BM25.format(where='')}, f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM bm JOIN (SELECT doc_id AS id FROM documents {_SOME}) USING (id) WHERE score > 0) SELECT query_id, id, score, rank FROM f WHERE rank <= 8""")
def bm25_indexed_filtered(spark, sf_dir):
    """1.15, 3.15: the same among two languages; term statistics stay those of all texts."""
    return indexes.search_text(_text_index(spark, sf_dir), questions(spark, sf_dir), where=F.col("lang").isin("de", "fr")).result


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, indexes.VectorIndex]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    index, _ = indexes.ensure_vector_index(v, _place(spark, sf_dir, "indexes"), "vectors", filters=("label",))
    return v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), index


@query(ORACLES["dense_cosine_topk"])
def dense_indexed(spark, sf_dir):
    """1.14, 7.5: the 8 most similar vectors of every hundredth from the stored index, its cells pruned by angles."""
    _, asked, index = _vectors(spark, sf_dir)
    return indexes.search_vectors(index, asked).result


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 100 = 0 AND v.label IN (1, 4)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 8""")
def dense_indexed_filtered(spark, sf_dir):
    """1.14, 3.15: the same among two labels, which stand for documents; the condition reaches the scan."""
    _, asked, index = _vectors(spark, sf_dir)
    return indexes.search_vectors(index, asked, where=F.col("label").isin(1, 4)).result


# --- stores and files -------------------------------------------------------------------


@query("""SELECT user_id, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) AS last_event FROM events GROUP BY user_id""")
def user_store_upserts(spark, sf_dir):
    """1.28: users kept in a bucketed store, into which the events go in four batches; read by key at the end."""
    store = KeyedStore(spark, _fresh(spark, "users"), "user_id long, events long, last_type string, last_event long, at timestamp_ntz", "user_id", 16)
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    for part in range(4):
        batch = events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part)
        new = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max(F.struct("at", "event_id", "event_type")).alias("m"), F.max("event_id").alias("last_event"))
        old = store.read().select("user_id", *(F.col(c).alias(f"old_{c}") for c in ("events", "last_type", "last_event", "at")), F.col("last_event").alias("old_id"))
        both = new.join(old, "user_id", "left")
        # the newest by time, then by id; the store holds the time of it
        newer = F.col("old_at").isNull() | (F.struct("m.at", "m.event_id") > F.struct("old_at", "old_id"))
        rows = both.select(
            "user_id", (F.col("events") + F.coalesce("old_events", F.lit(0))).alias("events"), F.when(newer, F.col("m.event_type")).otherwise(F.col("old_last_type")).alias("last_type"),
            F.greatest("last_event", "old_last_event").alias("last_event"), F.greatest("m.at", "old_at").alias("at"),
        )
        store.upsert(rows)
    return store.read().select("user_id", "events", "last_type", "last_event")


@query("""SELECT 'site/' || page_id % 100 || '/' || page_id || '.html' AS file, sha256(html) AS sha256, strlen(html) AS bytes FROM pages""")
def page_files(spark, sf_dir):
    """1.4, 1.6: every page written as a file of its own, in two phases, and read again."""
    spark.dataSource.register(FileSink)
    rows = table(spark, sf_dir, "pages").select(F.concat_ws("", F.lit("site/"), F.col("page_id") % 100, F.lit("/"), "page_id", F.lit(".html")).alias("file"), F.col("html").cast("binary").alias("content"))
    root = _fresh(spark, "files")
    rows.write.format("marginalia_files").mode("append").save(root)
    return read_bytes(spark, root, rows.select("file")).select("file", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


#: Texts of a lane, about: lanes grow with the table, so that no task does.
_LANE_ROWS = 5000


@query("""SELECT doc_id AS id, length(coalesce(text, '')) AS chars, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS blanks, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits FROM documents""")
def embedded_texts(spark, sf_dir):
    """11.8: every text through the embedding seam in full batches, with the provider that counts."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    lanes = max(2, spark.sparkContext.defaultParallelism, -(-rows.count() // _LANE_ROWS))
    found = embedding.embed(rows, embedding.counting_provider, lanes=lanes, spacing=0)
    part = lambda i, name: F.col("vector")[i].cast("long").alias(name)
    return found.select("id", part(0, "chars"), part(1, "blanks"), part(2, "digits"))


@query("""WITH k AS (SELECT doc_id, source || '|' || lang AS key FROM documents), f AS (SELECT DISTINCT key FROM k WHERE doc_id % 4 = 0 AND key LIKE '%|e%'),
  n AS (SELECT count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS hits, count(*) FILTER (WHERE key NOT IN (SELECT key FROM f)) AS misses FROM k WHERE key IS NOT NULL)
  SELECT doc_id, upper(key) AS value, hits, misses, 0::BIGINT AS coalesced FROM k, n""")
def memoised_contexts(spark, sf_dir):
    """11.11: a value for every document by its source and language from the shared cache, which a first run has filled in part."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("|"), "lang").alias("key"))
    cache = memo.Memo(spark, _fresh(spark, "memo"), lambda missing: missing.select("key", F.upper("key").alias("value")), "value string")
    cache.get(rows.where((F.col("doc_id") % 4 == 0) & F.col("key").contains("|e")))
    found, counts = cache.get(rows)
    return found.select("doc_id", "value", *(F.lit(n).cast("long").alias(name) for name, n in counts.items()))


# --- streams ----------------------------------------------------------------------------


def _run(stream: DataFrame, check: str, out: str) -> None:
    """Run a stream until its input is read."""
    stream.writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()


@query("SELECT conv_id, turn, role AS event, length(text) AS chars FROM conversations")
def sse_stream_events(spark, sf_dir):
    """1.32 as a stream: turns written as event-stream files, a part of them between two runs of the query."""
    spark.dataSource.register(FileSink)
    spark.dataSource.register(SseSource)
    c = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct("conv_id", "turn", "text"))
    frame = F.concat(F.lit("event: "), "role", F.lit("\n: a note\ndata: "), body, F.lit("\n\n"))
    root, check, out = (_fresh(spark, x) for x in ("sse", "check", "events"))
    for part in range(2):
        rows = c.where(F.col("conv_id") % 2 == part).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))).alias("t"))
        files = rows.select(F.concat(F.lit("part-"), F.col("conv_id") % 10, F.lit("/"), "conv_id", F.lit(".sse")).alias("file"), F.array_join(F.transform("t", lambda x: x["f"]), "").cast("binary").alias("content"))
        files.write.format("marginalia_files").mode("append").save(root)
        _run(spark.readStream.format("marginalia_sse").option("rangeBytes", 4096).load(root), check, out)
    known = spark.read.schema("stream string, at long, event string, data string").parquet(out).withColumn("d", F.from_json("data", "conv_id long, turn long, text string"))
    return known.select("d.conv_id", "d.turn", "event", F.length("d.text").cast("long").alias("chars"))


def _chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of users as requests: an even turn finds its own text as a source, and every third names its owner."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    found = F.when(F.col("turn") % 4 != 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("item_id"), F.coalesce("text", F.lit("")).alias("question"),
        F.when(F.col("conv_id") % 3 == 0, "owner").alias("owner_id"), F.array(F.concat(F.lit("k"), F.col("turn"))).alias("keys"), found.alias("contexts"), F.when(F.length(F.trim("text")) == 0, "question must be a text").alias("problem"),
    )


_CHAT = """WITH r AS (SELECT conv_id, turn, text, coalesce(length(trim(text)) = 0, false) AS bad, turn % 4 <> 0 AS found FROM conversations WHERE role = 'user'),
  k AS (SELECT *, NOT bad AND found AS kept, list_filter(regexp_split_to_array(text, '[\\s\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS w FROM r)
  SELECT conv_id::VARCHAR AS session_id, turn AS seq, bad AS failed, CASE WHEN NOT bad THEN CASE WHEN found THEN array_to_string(w[1:12], ' ') ELSE 'I cannot answer that from the sources.' END END AS answer,
    CASE WHEN NOT bad THEN coalesce(sum(kept::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS prior_turns,
    CASE WHEN NOT bad THEN CASE WHEN found THEN least(len(w), 12) ELSE 7 END END AS tokens FROM k"""


def _replies(events: DataFrame) -> DataFrame:
    """Answers with the turns remembered before them, and how many tokens were streamed."""
    ends = chat.service_response(events).withColumn("b", F.from_json("body", "answer string, priorTurns long"))
    last = events.where(F.col("type") == chat.RESULT).select("session_id", "seq", F.col("n").cast("long").alias("tokens"))
    return ends.join(last, ["session_id", "seq"], "left").select("session_id", "seq", "failed", F.col("b.answer").alias("answer"), F.col("b.priorTurns").alias("prior_turns"), "tokens")


@query(_CHAT)
def chat_service_batch(spark, sf_dir):
    """11.29, 11.30: every user's turn answered, as a fold over each session."""
    profiles = spark.createDataFrame([("owner", "has a flat")], "owner_id string, profile string")
    return _replies(materialize(chat.chat_events_batch(chat.with_profiles(_chat_requests(spark, sf_dir), profiles))))


@query(_CHAT)
def chat_service_stream(spark, sf_dir):
    """11.28-11.30: the same as a stream with state in three runs on one checkpoint."""
    root, check, out = (_fresh(spark, x) for x in ("requests", "check", "chat"))
    requests, provider = _chat_requests(spark, sf_dir), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(3):
            requests.where(F.least(F.floor(F.col("seq") / 2), F.lit(2)) == part).write.mode("append").parquet(root)
            stream = chat.chat_events(spark.readStream.schema(requests.schema).parquet(root))
            stream.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(chat.event_sink(out)).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return _replies(spark.read.parquet(f"{out}/events"))


# --- ladders and statistics -------------------------------------------------------------

_RUNG = [r[2] for r in ladders.rungs()]
_PAIRS = ladders.compared_rungs(7)
_CHANCE = "('0x' || substr(md5(seed || ':' || it || ':' || item_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_DRAW = "(" + " + ".join(f"({_CHANCE} >= {p:.8f}::DOUBLE)::INT" for p in stats.POISSON) + ")"
_STRICT = "(c + 13 * i) % (20 - i) >= 6"


@query(f"""WITH u AS (SELECT user_id AS item_id, sum(round(value * 100)::BIGINT)::BIGINT AS c FROM events GROUP BY user_id), r(rung_id, i) AS (VALUES {', '.join(f"('{r}', {i})" for i, r in enumerate(_RUNG))}),
  s AS (SELECT rung_id, item_id, ({_STRICT})::INT AS pass FROM u, r), p(rung_id, base_id, seed) AS (VALUES {', '.join(f"('{a}', '{b}', {s})" for a, b, s in _PAIRS)}),
  g AS (SELECT p.rung_id, seed, a.item_id, a.pass - b.pass AS gap FROM p JOIN s AS a ON a.rung_id = p.rung_id JOIN s AS b ON b.rung_id = base_id AND b.item_id = a.item_id),
  w AS (SELECT rung_id, it, gap, {_DRAW} AS w FROM g, range(2000) AS t(it)), m AS (SELECT rung_id, it, sum(w * gap)::DOUBLE / sum(w) AS mean FROM w GROUP BY ALL HAVING sum(w) > 0),
  ci AS (SELECT rung_id, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY rung_id)
  SELECT s.rung_id, round(avg(pass), 6) AS rate, coalesce((SELECT round(avg(gap), 6) FROM g WHERE g.rung_id = s.rung_id), 0) AS delta, coalesce(any_value(low), 0) AS low, coalesce(any_value(high), 0) AS high FROM s LEFT JOIN ci USING (rung_id) GROUP BY s.rung_id""")
def ladder_run(spark, sf_dir):
    """12.7: both ladders over all users, each change with an interval of 2,000 resamples, in one pass."""
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item_id")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"))
    each = users.select("item_id", "c", F.posexplode(F.array(*map(F.lit, _RUNG))).alias("i", "rung_id"))
    scores = each.select("rung_id", "item_id", ((F.col("c") + 13 * F.col("i")) % (20 - F.col("i")) >= 6).alias("strict_pass"))
    return ladders.ladder_run(spark, scores, 7).select("rung_id", "rate", "delta", "low", "high")


_SEEDED = _DRAW.replace("seed || ':'", "'3:'")


@query(f"""WITH d AS (SELECT doc_id AS item_id, quality AS q, toxic AS t FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
  w AS (SELECT it, q, t, {_SEEDED} AS w FROM d, range(2000) AS x(it)), m AS (SELECT it, sum(w * t)::DOUBLE / nullif(sum(w * q), 0) AS v FROM w GROUP BY it)
  SELECT (SELECT round(sum(t)::DOUBLE / nullif(sum(q), 0), 6) FROM d) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS iterations FROM m""")
def bootstrap_ratio(spark, sf_dir):
    """2.15 (seam of a statistic), 12.1: the interval of a ratio of sums over all labelled documents."""
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    return stats.bootstrap_of(rows, "doc_id", stats.ratio_of(F.col("toxic"), F.col("quality")), 3)


# --- reports ----------------------------------------------------------------------------

_SIGNED = "CASE WHEN {0} < 0 THEN '-' ELSE '+' END || printf('%.2f%%', abs({0}) * 100)"


@query(f"""WITH d AS ({ORACLES['arm_dashboard']}), l AS (
  SELECT 0 AS part, '000' AS key, '# users: view against click, paired by item' AS line
  UNION ALL SELECT 1, '', 'change in strict pass, all items: ' || {_SIGNED.format('strict_pass_delta')} || ' (' || CASE WHEN strict_pass_delta > 0 THEN 'view ahead' WHEN strict_pass_delta < 0 THEN 'click ahead' ELSE 'tied' END || ') of ' || n FROM d WHERE slice = 'all'
  UNION ALL SELECT 2, '000', 'slice | n | click strict | view strict | change | click behaviour | view behaviour | click cite recall | view cite recall'
  UNION ALL SELECT 3, CASE WHEN slice = 'all' THEN '1' ELSE '0' END || slice, concat_ws(' | ', slice, n::VARCHAR, printf('%.2f%%', naive_strict_pass * 100), printf('%.2f%%', agent_strict_pass * 100), {_SIGNED.format('strict_pass_delta')},
    printf('%.0f%%', naive_behavior_match * 100), printf('%.0f%%', agent_behavior_match * 100), printf('%.0f%%', naive_cite_recall * 100), printf('%.0f%%', agent_cite_recall * 100)) FROM d)
  SELECT part, key, line FROM l""")
def arm_report(spark, sf_dir):
    """13.1: the comparison of two arms as lines."""
    return reports.arm_report(QUERIES["arm_dashboard"](spark, sf_dir), "users", ("click", "view"))


@query(f"""WITH d AS ({ORACLES['order_probe']}) SELECT 0 AS part, '000' AS key, '# users: orders of the corpus' AS line UNION ALL SELECT 0, '001', 'seed | n | strict'
  UNION ALL SELECT 1, lpad(seed::VARCHAR, 20, '0'), concat_ws(' | ', seed::VARCHAR, n::VARCHAR, printf('%.2f%%', rate * 100)) || CASE WHEN seed = 0 THEN ' (as it is)' ELSE '' END FROM d
  UNION ALL SELECT 2, '', CASE WHEN bool_or(is_order_sensitive) THEN 'order matters: strict pass moves by ' || printf('%.2f%%', max(spread) * 100) ELSE 'order does not matter' END FROM d""")
def order_report(spark, sf_dir):
    """13.2: the order probe as lines."""
    return reports.order_report(QUERIES["order_probe"](spark, sf_dir), "users")


# --- strict artifacts -------------------------------------------------------------------


@query("""SELECT o_orderkey::VARCHAR AS item_id, 'p' AS point_id, (['rubric-wrong', 'human-error', 'judge-error'])[o_orderkey % 3 + 1] AS bucket, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 2 = 0 END AS corrected_human_credited FROM orders""")
def correction_documents(spark, sf_dir):
    """10.29: a document of corrections for each customer's orders, read strictly."""
    o = table(spark, sf_dir, "orders").withColumn("kind", F.col("o_orderkey") % 3)
    bucket = F.element_at(F.array(*map(F.lit, artifacts.BUCKETS)), (F.col("kind") + 1).cast("int"))
    row = F.struct(F.col("o_orderkey").cast("string").alias("item_id"), F.lit("p").alias("point_id"), bucket.alias("bucket"), F.lit("seen twice").alias("justification"), F.when(F.col("kind") < 2, F.col("o_orderkey") % 2 == 0).alias("corrected_human_credited"))
    docs = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(row).alias("corrections"))).alias("doc"))
    return artifacts.corrections(docs.select("doc")).drop("justification")


@query("""SELECT doc_id::VARCHAR AS item_id, 'answer' AS behavior_class, 'dev' AS side, row_number() OVER (PARTITION BY toxic ORDER BY sha256(doc_id::VARCHAR)) - 1 AS pos, toxic AS seed FROM labels WHERE toxic IS NOT NULL""")
def slice_manifests(spark, sf_dir):
    """10.29, 6.12: the labelled documents of each toxicity as a slice manifest, ordered by hash, written and read strictly."""
    rows = table(spark, sf_dir, "labels").where("toxic is not null").select(F.col("doc_id").cast("string").alias("item_id"), F.lit("answer").alias("behavior_class"), "toxic")
    found = artifacts.slice_manifest(artifacts.render_slices(rows, "toxic"))
    return found.select("item_id", "behavior_class", "side", F.col("pos").cast("long").alias("pos"), F.col("seed").cast("int").alias("seed"))


@query("""SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 7 < 4 THEN round(o_totalprice, 2) WHEN o_orderkey % 7 = 4 THEN 1.0 END AS cost, CASE WHEN o_orderkey % 2 = 0 THEN '{"n":' || o_orderkey || '}' END AS usage FROM orders""")
def cli_envelopes(spark, sf_dir):
    """10.28: envelopes whose cost is a number, a boolean, a text or missing, and whose usage is an object or a text."""
    o = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 7
    cost = F.when(kind < 4, F.round("o_totalprice", 2).cast("string")).when(kind == 4, "true").when(kind == 5, '"3.5"').otherwise("null")
    usage = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"n":'), "o_orderkey", F.lit("}"))).otherwise('"many"')
    flag = F.element_at(F.array(*map(F.lit, ["false", "0", '""', "null", "[]", "{}", "0.0"])), (kind + 1).cast("int"))
    text = F.concat(F.lit('{"result":"ok","is_error":'), flag, F.lit(',"total_cost_usd":'), cost, F.lit(',"usage":'), usage, F.lit("}"))
    return o.select(F.col("o_orderkey").alias("item_id"), artifacts.cli_envelope(text).alias("e")).select("item_id", "e.cost", "e.usage")


@query("""WITH e AS (SELECT o_custkey AS id, '[' || string_agg('{"from":"s' || o_orderkey || '","kind":"cites","to":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS x FROM orders GROUP BY 1),
  d AS (SELECT c_custkey AS id, '[{"term":"' || c_mktsegment || '","path_key":"d"}]' AS y FROM customer WHERE c_custkey % 2 = 0)
  SELECT id AS document_id, sha256('{"crossReferences":' || coalesce(x, '[]') || ',"definitions":' || coalesce(y, '[]') || '}') AS digest FROM e FULL JOIN d USING (id)""")
def facts_digests(spark, sf_dir):
    """10.7: digests of customers, whose orders stand for cross-references and whose segments for definitions, either of which may lack."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    edges = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("edge_pos"), F.concat(F.lit("s"), "o_orderkey").alias("source"), F.col("o_orderstatus").alias("target"), F.lit("cites").alias("kind"))
    terms = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("term"), F.lit("d").alias("path_key"))
    return builds.facts_digests(edges, terms)


#: The names of this module's queries.
NAMES = [name for name, f in QUERIES.items() if f.__module__ == __name__]
