"""More named queries over the driver tables, with their SQL: text functions, routing, strict artifacts, runs.

As in the catalogue the tables stand in for the engine's own inputs; each query says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import prompts, text
from marginalia.operators import builds, corpus, envelopes, evaluation, fusion, ladders, routing, runs, stats
from marginalia.plans.catalogue import _ARMS, _BM25, _CITES, _KEYS, _NODES, _RRF, _TRI, ORACLES, _cites, _keys, _nodes, chunks, query, questions, r6, table
from marginalia.plans.scratch import materialize
from marginalia.sources import golden, manifest

_S = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _decoded(sql: str) -> str:
    """Entities decoded in one pass."""
    named = " ".join(f"WHEN '&{k};' THEN {_quoted(v)}" for k, v in text.ENTITIES.items())
    one = f"CASE x {named} ELSE CASE WHEN regexp_matches(x, '^&#[0-9]+;$') THEN chr(TRY_CAST(regexp_extract(x, '[0-9]+') AS INT)) WHEN regexp_matches(x, '^&#[xX][0-9a-fA-F]+;$') THEN chr(TRY_CAST('0x' || regexp_extract(x, '[xX]([0-9a-fA-F]+)', 1) AS INT)) ELSE x END END"
    return f"array_to_string(list_transform(regexp_extract_all({sql}, '&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&'), lambda x: {one}), '')"


def _stripped(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g')"


def _collapsed(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{_S}+', ' ', 'g'))"


_H1 = "(?is)<h1\\b[^>]*>(.*?)</h1>"
_H1_TEXT = _collapsed(_decoded(_stripped(f"regexp_extract(html, '{_H1}', 1)")))

# --- text ---------------------------------------------------------------------------------------


@query(f"SELECT page_id, {_H1_TEXT} AS title, {_collapsed(_decoded(_stripped(chr(34) + 'p' + chr(34))))} AS paragraph FROM (SELECT *, regexp_extract(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1) AS p FROM pages)")
def html_text(spark, sf_dir):
    """9.3, 9.4, 9.5: the text of the first heading and of the first paragraph."""
    first = lambda tag: F.regexp_extract("html", f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(first("h1")).alias("title"), text.html_text(first("p")).alias("paragraph"))


ORACLES["slugify_titles"] = f"""WITH s AS (SELECT page_id, trim(regexp_replace(strip_accents(lower({_H1_TEXT})), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages)
  SELECT page_id, CASE WHEN slug = '' THEN 'section' ELSE slug END AS slug FROM s"""


def _region_sql() -> str:
    out = "html"
    for tag in ("body", "article", "main"):
        pattern = _quoted(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>")
        out = f"CASE WHEN regexp_matches(html, {pattern}) THEN regexp_extract(html, {pattern}, 1) ELSE {out} END"
    return out


def _chrome_sql(sql: str) -> str:
    for pattern in text.CHROME_PATTERNS:
        sql = f"regexp_replace({sql}, {_quoted('(?i)' + pattern)}, ' ', 'g')"
    return sql


@query(f"WITH r AS (SELECT page_id, {_region_sql()} AS region FROM pages) SELECT page_id, length(region) AS region_chars, md5({_chrome_sql('region')}) AS clean_md5 FROM r")
def page_regions(spark, sf_dir):
    """2.4, 2.5: the content of a page, and without its furniture."""
    r = table(spark, sf_dir, "pages").select("page_id", text.content_region(F.col("html")).alias("region"))
    return r.select("page_id", F.length("region").cast("long").alias("region_chars"), F.md5(text.strip_chrome(F.col("region")).cast("binary")).alias("clean_md5"))


_CELL = _collapsed(_stripped("c"))


@query(f"""WITH h AS (SELECT o_orderkey, '<table class="' || CASE WHEN o_orderkey % 2 = 0 THEN 'TOCid' ELSE 'data' END || '"><TR><th>' || o_orderkey || '</th><td> <b>a</b><br/>' || o_orderstatus || ' </td></TR><tr><td>' || o_orderpriority || '</td></tr></table>' AS html FROM orders),
  r AS (SELECT o_orderkey, regexp_matches(html, '(?i)\\bclass\\s*=\\s*["'']TOC(?:id|partCenter)') AS layout, regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1) AS rows FROM h), u AS (SELECT o_orderkey, layout, unnest(range(len(rows))) AS row_pos, unnest(rows) AS r FROM r),
  c AS (SELECT o_orderkey, layout, row_pos, unnest(range(len(cs))) AS cell_pos, unnest(cs) AS c FROM (SELECT *, regexp_extract_all(r, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>', 1) AS cs FROM u)) SELECT o_orderkey, layout, row_pos, cell_pos, {_CELL} AS cell FROM c""")
def html_table_cells(spark, sf_dir):
    """2.6, 2.7: orders as tables."""
    kind = F.when(F.col("o_orderkey") % 2 == 0, "TOCid").otherwise("data")
    html = F.concat(F.lit('<table class="'), kind, F.lit('"><TR><th>'), F.col("o_orderkey").cast("string"), F.lit("</th><td> <b>a</b><br/>"), F.col("o_orderstatus"), F.lit(" </td></TR><tr><td>"), F.col("o_orderpriority"), F.lit("</td></tr></table>"))
    h = table(spark, sf_dir, "orders").select("o_orderkey", html.alias("html"))
    rows = h.select("o_orderkey", text.is_layout_table(F.col("html")).alias("layout"), F.posexplode(text.table_cells(F.col("html"))).alias("row_pos", "cells"))
    return rows.select("o_orderkey", "layout", F.col("row_pos").cast("long").alias("row_pos"), F.posexplode("cells").alias("cell_pos", "cell")).withColumn("cell_pos", F.col("cell_pos").cast("long"))


_HEADS = "CASE pos % 5 WHEN 0 THEN 'Schedule ' || pos || ' ' || line WHEN 1 THEN 'table b ' || line WHEN 2 THEN 'PART iv.1 ' || line WHEN 3 THEN '“' || left(line, 9) || '” means' ELSE ' ' || pos || '. ' END"


@query(f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM s), h AS (SELECT doc_id, pos, trim({_HEADS}) AS h FROM l)
  SELECT doc_id, pos, nullif(trim(regexp_extract(h, '^“([^”]+)”', 1)), '') AS term, CASE WHEN regexp_matches(h, '^[Ss]chedule(?:\\s+(\\d+(?:\\.\\d+)?|[A-Z]))?(?:\\s|$)') THEN trim('Schedule ' || upper(regexp_extract(h, '^[Ss]chedule(?:\\s+(\\d+(?:\\.\\d+)?|[A-Z]))?(?:\\s|$)', 1))) END AS schedule,
    nullif(upper(regexp_extract(h, '(?i)^part\\s+([ivxlcdm]+(?:\\.\\d+)?)\\b', 1)), '') AS part, regexp_replace(h, '\\.$', '') AS number FROM h""")
def heading_labels(spark, sf_dir):
    """9.12, 9.13, 9.15, 9.16: lines of documents under made-up headings."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pos = F.col("pos").cast("string")
    head = (
        F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Schedule "), pos, F.lit(" "), F.col("line"))).when(F.col("pos") % 5 == 1, F.concat(F.lit("table b "), F.col("line"))).when(F.col("pos") % 5 == 2, F.concat(F.lit("PART iv.1 "), F.col("line")))
        .when(F.col("pos") % 5 == 3, F.concat(F.lit("“"), F.substring("line", 1, 9), F.lit("” means"))).otherwise(F.concat(F.lit(" "), pos, F.lit(". ")))
    )
    h = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim(head).alias("h"))
    return h.select("doc_id", "pos", text.definition_term(F.col("h")).alias("term"), text.coordinate_label(F.col("h"), "schedule").alias("schedule"), text.part_number(F.col("h")).alias("part"), text.section_number(F.col("h")).alias("number"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text WHEN strpos(left(text, 2000), ' ') > 0 AND 2000 - strpos(reverse(left(text, 2000)), ' ') > 1000 THEN left(text, 2000 - strpos(reverse(left(text, 2000)), ' ')) ELSE left(text, 2000) END AS summary FROM documents""")
def summary_caps(spark, sf_dir):
    """9.27 over every text."""
    return table(spark, sf_dir, "documents").select("doc_id", text.cap_summary(F.col("text")).alias("summary"))


_FENCED = "CASE turn % 3 WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '  ' || text || ' ' ELSE '```' || text || '```' END"


@query(f"""WITH f AS (SELECT conv_id, turn, trim({_FENCED}) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)^```(?:json)?\\s*(.*?)\\s*```$') THEN regexp_extract(t, '(?s)^```(?:json)?\\s*(.*?)\\s*```$', 1) ELSE t END AS body FROM f""")
def code_fences(spark, sf_dir):
    """9.22."""
    t = F.col("text")
    fenced = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("  "), t, F.lit(" "))).otherwise(F.concat(F.lit("```"), t, F.lit("```")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_code_fence(fenced).alias("body"))


@query("""SELECT event_id, CASE WHEN event_id % 7 > 0 THEN md5('t' || event_id) END AS trace_id, CASE WHEN event_id % 7 > 0 THEN left(md5('s' || event_id), 16) END AS span_id FROM events""")
def traceparents(spark, sf_dir):
    """9.29: headers built and read back; every seventh is malformed."""
    key = F.col("event_id").cast("string")
    header = text.traceparent(F.md5(F.concat(F.lit("t"), key).cast("binary")), F.substring(F.md5(F.concat(F.lit("s"), key).cast("binary")), 1, 16))
    ids = text.traceparent_ids(F.when(F.col("event_id") % 7 > 0, header).otherwise(F.upper(header)))
    return table(spark, sf_dir, "events").select("event_id", ids["trace_id"].alias("trace_id"), ids["span_id"].alias("span_id"))


@query("""WITH r AS (SELECT doc_id, replace(replace(text, 'the', '[redacted]'), 'und', '[redacted]') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '…' ELSE t END AS detail FROM r""")
def redacted_details(spark, sf_dir):
    """9.30."""
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text"), ["the", "", "und"]).alias("detail"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND trim(CASE WHEN turn % 4 = 0 THEN ' ' ELSE role END) <> '' THEN role || chr(10) || chr(10) || text ELSE text END AS whole, regexp_replace(role || CASE WHEN turn % 3 = 0 THEN '-e' ELSE '' END, '-e$', '') AS class FROM conversations""")
def embeddable_texts(spark, sf_dir):
    """9.21, 9.7: contexts before texts; class names without their suffix."""
    context = F.when(F.col("turn") % 4 == 0, " ").otherwise(F.col("role"))
    whole = F.when(F.col("turn") % 2 == 0, text.embeddable_text(F.col("text"), context, True)).otherwise(text.embeddable_text(F.col("text"), context, False))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", whole.alias("whole"), text.base_class(F.concat("role", F.when(F.col("turn") % 3 == 0, "-e").otherwise(""))).alias("class"))


_ASKED = "max(text) FILTER (turn = 0)"


@query(f"""WITH c AS (SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS sources, string_agg('- [' || role || '] ' || text, chr(10) ORDER BY turn) AS rubric, string_agg(text, chr(10) ORDER BY turn) AS reference, {_ASKED} AS asked FROM conversations GROUP BY conv_id)
  SELECT conv_id, md5('Answer.' || chr(10) || chr(10) || 'SOURCES:' || chr(10) || sources || chr(10) || chr(10) || 'QUESTION:' || chr(10) || asked) AS synthesis, md5('Grade.' || chr(10) || chr(10) || 'RUBRIC POINTS:' || chr(10) || rubric || chr(10) || chr(10) || 'QUESTION:' || chr(10) || asked || chr(10) || chr(10) || 'ANSWER:' || chr(10) || asked) AS judge,
    md5(reference) AS reference, length('CONVERSATION SO FAR:' || chr(10) || asked) AS memory_chars, length(sources) AS suffix_chars FROM c""")
def rendered_prompts(spark, sf_dir):
    """9.23-9.26, 9.28: the turns of a conversation as sources, as rubric points, as memory."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("path_key"), x["text"].alias("text"))).alias("s"), F.transform("t", lambda x: F.struct(x["role"].alias("id"), x["text"].alias("text"))).alias("p"), F.col("t")[0]["text"].alias("asked"))
    block = text.numbered_sources(F.col("s"))
    whole = prompts.prompt("synthesis", prompts.labelled("SOURCES", block), prompts.labelled("QUESTION", F.col("asked")), instruction="Answer.")
    judged = prompts.judge_prompt(F.col("p"), F.col("asked"), F.col("asked"), instruction="Grade.")
    md5 = lambda x: F.md5(x.cast("binary"))
    suffix = prompts.send_suffix(F.concat(F.lit("cached "), block), F.lit("cached "))
    return g.select("conv_id", md5(whole).alias("synthesis"), md5(judged).alias("judge"), md5(prompts.reference_of(F.col("p"))).alias("reference"), F.length(prompts.session_context(F.col("asked"))).cast("long").alias("memory_chars"), F.length(suffix).cast("long").alias("suffix_chars"))


@query("SELECT conv_id::VARCHAR AS stream, turn AS pos, role AS event, turn::VARCHAR AS data FROM conversations")
def sse_round_trip(spark, sf_dir):
    """1.32, 1.33: turns written as server-sent events and read back."""
    c = table(spark, sf_dir, "conversations")
    frames = c.select(F.col("conv_id").cast("string").alias("stream"), "turn", text.sse_frame(F.col("role"), F.col("turn").cast("string")).alias("f"))
    lines = frames.select("stream", F.posexplode(F.split("f", "\n")).alias("at", "line"), "turn").select("stream", (F.col("turn") * 10 + F.col("at")).alias("pos"), "line").where("pos % 10 < 3")
    return golden.parse_sse(lines).select("stream", F.col("data").cast("long").alias("pos"), "event", "data")


# --- routing and slices ---------------------------------------------------------------------------------

_LEVELS = "['act', 'regulation', 'guideline', 'declaration', 'bylaw', 'rule', 'contract']"


def _nation_documents(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_regionkey") < 3, F.col("n_name")).otherwise(F.concat(F.lit(routing.GUIDELINE_PREFIX), F.col("n_name")))
    return n.select(name.alias("document_id"), "n_nationkey", "n_regionkey", "n_name")


@query(f"""SELECT CASE WHEN n_regionkey < 3 THEN n_name ELSE 'ltb-guideline-' || n_name END AS document_id, CASE WHEN n_regionkey < 3 THEN ({_LEVELS})[n_regionkey + 4] ELSE 'guideline' END AS level, CASE WHEN n_regionkey < 3 THEN n_regionkey + 3 ELSE 2 END AS rank, 'region' || n_regionkey AS corpus FROM nation""")
def authority_levels(spark, sf_dir):
    """3.12, 3.13, 3.18: nations as documents, listed levels and the family's; the corpus read off a path."""
    docs = _nation_documents(spark, sf_dir)
    levels = docs.where("n_regionkey < 3").select("document_id", F.element_at(F.array(*map(F.lit, routing.AUTHORITY_LEVELS)), (F.col("n_regionkey") + 4).cast("int")).alias("level"))
    path = F.concat(F.lit("corpus/raw/region"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name"), F.lit(".html"))
    return routing.authority_of(docs, levels).select("document_id", "level", routing.authority_rank(F.col("level")).cast("long").alias("rank"), routing.corpus_of_file(path).alias("corpus"))


@query("""SELECT CASE WHEN n_regionkey < 3 THEN n_name ELSE 'ltb-guideline-' || n_name END AS document_id, min(c_custkey) AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 3, 4) GROUP BY 1""")
def documents_at_levels(spark, sf_dir):
    """3.14, 6.4: first-seen documents of two levels."""
    docs = _nation_documents(spark, sf_dir)
    levels = docs.where("n_regionkey < 3").select("document_id", F.when(F.col("n_regionkey") == 0, "declaration").otherwise("bylaw").alias("level"))
    rows = table(spark, sf_dir, "customer").join(docs, F.col("c_nationkey") == F.col("n_nationkey")).select("document_id", F.col("c_custkey").alias("pos"))
    return routing.documents_at(rows, levels, ["declaration", "guideline"])


_CORPUS = "(['tenancy', 'insurance', 'governing', 'selling'])[n_regionkey % 4 + 1]"
_ROUTED = f"""cit AS (SELECT l_orderkey AS item_id, {_CORPUS} AS corpus FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 4),
  ro AS (SELECT item_id, array_to_string(list_filter(['tenancy', 'insurance', 'governing', 'selling'], lambda x: list_contains(list(corpus), x)), ',') AS routed FROM cit GROUP BY item_id)"""


def _item_cites(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    cited = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("|section:"), F.col("l_linenumber").cast("string")).alias("key"))
    corpora = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("document_id"), F.element_at(F.array(*map(F.lit, routing.CORPORA)), (F.col("n_regionkey") % 4 + 1).cast("int")).alias("corpus"))
    return cited, corpora


@query(f"WITH {_ROUTED} SELECT item_id, routed, split_part(routed, ',', 1) AS failed_corpus FROM ro")
def oracle_routing(spark, sf_dir):
    """12.12, 10.20: order lines cite the nations of their suppliers; one region is in no corpus."""
    cited, corpora = _item_cites(spark, sf_dir)
    return routing.corpora_of_items(cited, corpora).select("item_id", F.array_join("routed", ",").alias("routed"), builds.failed_corpus(F.col("routed")).alias("failed_corpus"))


@query(f"""WITH {_ROUTED} SELECT item_id, 'tenancy' AS corpus, CASE WHEN contains(routed, ',') THEN 'cross-corpus' ELSE routed END AS expected FROM ro WHERE routed <> 'tenancy'""")
def corpus_conflicts(spark, sf_dir):
    """4.10: every order is declared to be of one corpus."""
    cited, corpora = _item_cites(spark, sf_dir)
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit("tenancy").alias("corpus"))
    return routing.corpus_conflicts(items, cited, corpora)


@query("""WITH bad AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey >= 4)
  SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 < 7 AND o_orderkey NOT IN (SELECT l_orderkey FROM bad)""")
def run_selection(spark, sf_dir):
    """3.22, 3.24, 3.25: verified, serviceable items of one side."""
    cited, corpora = _item_cites(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") != "P").alias("verified"))
    sides = o.select("item_id", F.when(F.col("item_id") % 10 < 7, "dev").otherwise("holdout").alias("side"))
    return builds.tier_items(routing.run_items(o, cited, corpora, sides, holdout=True), "smoke", False).select("item_id")


@query("""WITH i AS (SELECT o_orderkey, o_orderstatus <> 'P' AS ok, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 9 END AS parent FROM orders) SELECT a.o_orderkey AS item_id FROM i AS a JOIN i AS p ON p.o_orderkey = coalesce(a.parent, a.o_orderkey) AND p.ok AND p.parent IS NULL WHERE a.ok""")
def verified_items(spark, sf_dir):
    """3.23: some orders are paraphrases of others."""
    parent = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - F.col("o_orderkey") % 9)
    return golden.verified_items(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") != "P").alias("verified"), parent.alias("paraphrase_of"))).select("item_id")


@query("""WITH p AS (SELECT doc_id AS item_id, quality = 1 AS h, toxic = 1 AS j FROM labels), m AS (SELECT item_id, (['human-error', 'judge-error', 'rubric-unclear'])[item_id % 3 + 1] AS bucket FROM p WHERE h <> j) SELECT bucket, count(*) AS n FROM m GROUP BY bucket""")
def triage_buckets(spark, sf_dir):
    """5.22, 12.10: labels as points of two raters."""
    return routing.triage_report(*_triage(spark, sf_dir))


def _triage(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.lit("p").alias("point_id"), (F.col("quality") == 1).alias("human"), (F.col("toxic") == 1).alias("judge"))
    bucket = F.element_at(F.array(F.lit("human-error"), F.lit("judge-error"), F.lit("rubric-unclear")), (F.col("item_id") % 3 + 1).cast("int"))
    return p, p.where("human <> judge").select("item_id", "point_id", bucket.alias("bucket"), F.col("judge").alias("corrected"))


@query("""WITH p AS (SELECT doc_id AS item_id, quality = 1 AS h, toxic = 1 AS j FROM labels), c AS (SELECT 'before' AS pass, h, j FROM p UNION ALL SELECT 'after', CASE WHEN h <> j AND item_id % 3 = 0 THEN j ELSE h END, j FROM p),
  a AS (SELECT pass, count(*) AS n, avg((h = j)::INT) AS o, avg(h::INT) AS h, avg(j::INT) AS j FROM c GROUP BY pass), e AS (SELECT *, h * j + (1 - h) * (1 - j) AS e FROM a)
  SELECT pass, n, round(CASE WHEN e >= 1 THEN CASE WHEN o >= 1 THEN 1.0 ELSE 0.0 END ELSE (o - e) / (1 - e) END, 6)::DOUBLE AS kappa FROM e""")
def triage_recompute(spark, sf_dir):
    """4.15, 12.9: agreement before and after one pass of corrections."""
    out = runs.triage_and_recompute(*_triage(spark, sf_dir))
    return out["before"].select(F.lit("before").alias("pass"), "n", "kappa").unionByName(out["after"].select(F.lit("after").alias("pass"), "n", "kappa"))


@query("""WITH a AS (SELECT event_type AS arm, avg((value > 50)::INT)::DOUBLE AS rate FROM events GROUP BY 1), f AS (SELECT event_type, ts::DATE AS d, avg((value > 50)::INT) AS r FROM events GROUP BY ALL), s AS (SELECT max(hi - lo) AS floor FROM (SELECT round(max(r), 6)::DOUBLE AS hi, round(min(r), 6)::DOUBLE AS lo FROM f GROUP BY event_type)),
  g AS (SELECT arm, round(rate - 0.5, 6) AS gap FROM a) SELECT arm, gap, abs(gap) <= floor AS within_noise FROM g, s""")
def within_noise(spark, sf_dir):
    """3.30: the greatest spread over days is the floor."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.to_date("ts").alias("repeat"), (F.col("value") > 50).alias("strict_pass"))
    gaps = e.groupBy("arm").agg(r6(evaluation.share(F.col("strict_pass")) - 0.5).alias("gap"))
    return evaluation.within_noise(gaps, evaluation.noise_floor(e)).select("arm", "gap", "within_noise")


@query("""SELECT o_orderkey AS item_id, 't' || o_orderkey AS trace_id, CASE WHEN o_totalprice < 100000 THEN 'retrieval' ELSE 'synthesis' END AS stage, o_orderpriority AS corpus FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 4 > 0""")
def failed_items(spark, sf_dir):
    """4.16, 10.19, 12.11: failed orders with a trace, queued once."""
    o = table(spark, sf_dir, "orders")
    scores = o.select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") == "F").alias("strict_pass"), (F.col("o_totalprice") / 100000).alias("retrieval_hit_rate"))
    traces = o.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("trace_id"))
    failed = evaluation.failed_items(scores, o.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("corpus")), traces)
    queue = runs.enqueue_failures(failed.where("item_id % 8 = 1").select("trace_id", "item_id"), failed)
    return queue.join(failed.select("item_id", "stage", "corpus"), "item_id").select("item_id", "trace_id", "stage", "corpus")


# --- strict artifacts -------------------------------------------------------------------------------------

_SAID = ["true", "false", '"false"', '""', "0", "0.0", "1", "[]", "{}", "null", '"x"', "[0]"]


@query(f"SELECT o_orderkey AS item_id, (o_orderkey % {len(_SAID)}) IN (0, 2, 6, 10, 11) AS credited FROM orders")
def judge_truth(spark, sf_dir):
    """10.26: verdicts of every JSON type."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("item_id") % len(_SAID) + 1).cast("int"))
    body = F.concat(F.lit('```json\n{"verdicts":[7,{"pointId":"p","credited":true},{"pointId":"p","credited":'), said, F.lit('},{"pointId":3,"credited":true}]}\n```'))
    return envelopes.judge_verdicts(o.select("item_id", body.alias("text")), o.select("item_id", F.lit("p").alias("point_id"))).select("item_id", "credited")


@query("""SELECT o_orderkey AS item_id, 'geo|section:' || o_custkey || '|subsection:1' AS key, 'answer' AS behavior_class FROM orders""")
def envelope_cites(spark, sf_dir):
    """10.24, 10.25: answers as JSON, read strictly."""
    segment = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"))
    path = F.struct(F.lit("geo").alias("documentId"), F.array(segment("section", F.col("o_custkey")), segment("subsection", F.lit(1))).alias("segments"))
    body = F.to_json(F.struct(F.lit("answer").alias("behaviorClass"), F.col("o_orderstatus").alias("answer"), F.array(F.struct(F.lit("t").alias("text"), F.array(path).alias("cites"))).alias("claims")))
    parsed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), envelopes.parse_envelope(body).alias("e"))
    return parsed.select("item_id", F.explode(envelopes.cite_keys(F.col("e.claims"))).alias("key"), F.col("e.behaviorClass").alias("behavior_class"))


@query("""SELECT o_orderkey AS item_id, o_orderstatus AS result, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) END AS cost, o_orderkey % 3 = 0 AS credited, CASE WHEN o_orderkey % 5 < 4 THEN (['bug', 'rubric-wrong', 'known-limitation', 'noise'])[o_orderkey % 5 + 1] ELSE 'other' END IN ('bug', 'rubric-wrong', 'known-limitation', 'noise') AS valid, o_orderstatus AS answer FROM orders""")
def strict_artifacts(spark, sf_dir):
    """3.29, 4.14, 10.28-10.30: command envelopes, labels, verdicts, answers and dispositions, read strictly."""
    o = table(spark, sf_dir, "orders").withColumn("item_id", F.col("o_orderkey"))
    text_id = F.col("item_id").cast("string")
    cost = F.when(F.col("item_id") % 2 == 0, F.round("o_totalprice", 2))
    call = builds.cli_envelope(F.to_json(F.struct(F.col("o_orderstatus").alias("result"), F.lit(False).alias("is_error"), cost.alias("total_cost_usd"))))
    label = F.to_json(F.struct(text_id.alias("item_id"), F.lit("p").alias("point_id"), F.lit("q").alias("question"), F.col("o_orderstatus").alias("answer"), F.lit("t").alias("point_text"), (F.col("item_id") % 3 == 0).alias("human_credited")))
    # written once: else every join would filter on the keys by parsing the rows again, field by field
    labels = materialize(builds.label_rows(o.select(label.alias("row"))).select(F.col("item_id").cast("long").alias("item_id"), "point_id", F.col("human_credited").cast("string").alias("value")))
    verdicts = builds.strict_verdicts(labels.select("item_id", "point_id"), labels).select("item_id", "credited")
    answers = builds.answers_map(o.select("item_id", F.col("o_orderstatus").alias("answer_text")))
    ways = F.element_at(F.array(*map(F.lit, [*builds.DISPOSITIONS, "other"])), (F.col("item_id") % 5 + 1).cast("int"))
    rows = o.select("item_id", call.alias("c"), builds.is_valid_disposition(ways).alias("valid"))
    return rows.join(verdicts.hint("merge"), "item_id").join(answers.hint("merge"), "item_id").select("item_id", "c.result", "c.cost", "credited", "valid", "answer")


@query("""SELECT doc_id, sha256('["' || doc_id || '","doc|' || doc_id || '",' || to_json(text)::VARCHAR || ']') AS chunk_hash, '["chunk","situating-context","hierarchy","m","v1","' || md5(source) || '","","' || lang || '"]' AS cache_key FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def chunk_hashes(spark, sf_dir):
    """10.3, 10.6, 10.7: addresses of chunks and of their contexts."""
    from marginalia.functions.numbers import chunk_hash

    d, ident = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null"), F.col("doc_id").cast("string")
    key = builds.chunk_cache_key(F.lit("situating-context"), F.lit("hierarchy"), F.lit("m"), F.lit("v1"), F.md5(F.col("source").cast("binary")), F.lit(""), F.col("lang"))
    return d.select("doc_id", chunk_hash(ident, F.concat(F.lit("doc|"), ident), F.col("text")).alias("chunk_hash"), key.alias("cache_key"))


@query("""WITH n AS (SELECT r_name AS d, 0 AS pos, r_name AS key, NULL AS t FROM region UNION ALL SELECT r_name, 1 + n_nationkey, r_name || '|section:' || n_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT d AS document_id, sha256('{"documentId":' || to_json(d)::VARCHAR || ',"skeleton":' || to_json(list(key ORDER BY pos))::VARCHAR || ',"text":' || to_json(coalesce(list([key, t] ORDER BY key) FILTER (t IS NOT NULL), []))::VARCHAR || '}') AS tree_hash FROM n GROUP BY d""")
def tree_hashes(spark, sf_dir):
    """10.5, 2.12: regions as documents, nations as their sections."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    roots = r.select(F.col("r_name").alias("document_id"), F.lit(0).cast("long").alias("pos"), F.col("r_name").alias("path_key"), F.lit(None).cast("string").alias("text"))
    kids = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("document_id"), (F.col("n_nationkey") + 1).cast("long").alias("pos"), F.concat("r_name", F.lit("|section:"), F.col("n_name")).alias("path_key"), F.col("n_name").alias("text"))
    return builds.tree_hashes(roots.unionByName(kids))


@query("""WITH e AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 10), p AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
  SELECT k, 'missing' AS problem FROM e WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT k, 'unexpected' FROM p WHERE k NOT IN (SELECT k FROM e) UNION ALL SELECT k, 'duplicated' FROM p WHERE n > 1""")
def section_completeness(spark, sf_dir):
    """5.27, 8.3: parts that were expected against parts that were sold."""
    return corpus.set_difference(table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")), "k")


@query(f"""WITH {_KEYS}, {_NODES} SELECT key FROM tree WHERE c_custkey % 3 = 0 OR c_custkey % 7 = 0""")
def cite_round_trip(spark, sf_dir):
    """5.28, 3.11: some texts are of unknown keys, some are altered."""
    k = _keys(spark, sf_dir)
    nodes = k.where("c_custkey % 7 <> 0").select("key", F.col("c_custkey").cast("string").alias("text"))
    texts = k.select("key", F.when(F.col("c_custkey") % 3 == 0, "altered").otherwise(F.col("c_custkey").cast("string")).alias("text"))
    return corpus.cite_round_trip(texts, nodes)


@query("""SELECT page_id::VARCHAR AS id, CASE page_id % 5 WHEN 1 THEN 'sha256 is not 64 hex digits' WHEN 2 THEN 'date is not ISO' WHEN 3 THEN 'bytes is negative' ELSE 'unknown normalization' END AS problem FROM pages WHERE page_id % 5 > 0""")
def manifest_rules(spark, sf_dir):
    """1.2: four fifths of a manifest break a rule each."""
    rule = F.col("page_id") % 5
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.when(rule == 1, "zz").otherwise(F.sha2("html", 256)).alias("sha256"), F.when(rule == 2, "soon").otherwise("2024-01-01").alias("consolidationDate"),
        F.when(rule == 3, -1).otherwise(F.length("html")).alias("bytes"), F.when(rule == 4, "odd").otherwise("none").alias("normalization"),
    )
    return corpus.invalid_sources(rows).select("id", "problem")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 6 = 0 THEN 2 ELSE 0 END AS version FROM customer""")
def key_value_upsert(spark, sf_dir):
    """1.28, 11.26: changed rows in place of old ones, then fields that are given."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(0).alias("version"))
    out = manifest.upsert(c, c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("changed").alias("segment"), F.lit(1).alias("version")), "c_custkey")
    new = c.where("c_custkey % 6 = 0 and c_custkey % 4 <> 0").select("c_custkey", F.lit(None).cast("string").alias("segment"), F.lit(2).alias("version"))
    return runs.last_write_wins(out, new, "c_custkey")


# --- runs and comparisons ---------------------------------------------------------------------------------------

_RUNGS = ladders.rungs()


@query(
    "WITH p(rung_id, ladder, rung, build, n_on, i) AS (VALUES " + ", ".join(f"('{r[2]}', '{r[0]}', {r[1]}, '{r[5]}', {len(r[4])}, {i})" for i, r in enumerate(_RUNGS)) + f"""),
  s AS (SELECT event_id % {len(_RUNGS)} AS i, round(avg((value > 50)::INT), 6)::DOUBLE AS rate FROM events GROUP BY 1) SELECT rung_id, ladder, rung, build, n_on, rate FROM p JOIN s USING (i)"""
)
def ladder_scores(spark, sf_dir):
    """4.19, 5.7, 10.22, 12.6-12.8: the plan of both ladders with the rates of its rungs."""
    names = F.array(*(F.lit(r[2]) for r in _RUNGS))
    e = table(spark, sf_dir, "events").select(F.element_at(names, (F.col("event_id") % len(_RUNGS) + 1).cast("int")).alias("rung_id"), (F.col("value") > 50).alias("strict_pass"))
    out = ladders.scored_plan(ladders.run_plan(spark, live=False), runs.rates_by_rung(e))
    return out.select("rung_id", "ladder", "rung", "build", F.size("components").alias("n_on"), "rate")


@query("""WITH s AS (SELECT user_id % 3 AS seed, count(*) AS n, avg((value > 50)::INT)::DOUBLE AS rate FROM events GROUP BY 1), x AS (SELECT max(rate) - min(rate) AS spread FROM s) SELECT seed, n, round(rate, 6) AS rate, round(spread, 6) AS spread, spread > 0 AS is_order_sensitive FROM s, x""")
def order_probe(spark, sf_dir):
    """5.20: three seeds."""
    return runs.order_probe(table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("seed"), F.col("event_id").alias("item_id"), (F.col("value") > 50).alias("strict_pass")))


def _measured(spark, sf_dir, arm: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == arm).groupBy(F.col("user_id").alias("item_id")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("k"))
    cls = F.when(F.col("item_id") % 3 == 0, "answer").when(F.col("item_id") % 3 == 1, "refuse").otherwise("flag")
    return e.select("item_id", cls.alias("behavior_class"), (F.col("v") > 50).alias("strict_pass"), (F.col("k") > 1).alias("behavior_match"), (F.col("v") / 100).alias("cite_precision"), (F.col("v") / 200).alias("cite_recall"), F.col("v").alias("retrieval_hit_rate"))


@query(f"""WITH {_ARMS}, b AS (SELECT a.behavior_class AS c, a.strict_pass AS ns, b.strict_pass AS gs, a.k > 1 AS nb, b.k > 1 AS gb, a.v AS nv, b.v AS gv FROM arms AS a JOIN arms AS b USING (item_id) WHERE a.arm = 'click' AND b.arm = 'view')
  SELECT coalesce(c, 'all') AS slice, count(*) AS n, round(avg(ns::INT), 6)::DOUBLE AS naive_strict_pass, round(avg(gs::INT), 6)::DOUBLE AS agent_strict_pass, round(avg(nb::INT), 6)::DOUBLE AS naive_behavior_match, round(avg(gb::INT), 6)::DOUBLE AS agent_behavior_match, round(avg(nv / 100), 6) AS naive_cite_precision, round(avg(gv / 100), 6) AS agent_cite_precision,
    round(avg(nv / 200), 6) AS naive_cite_recall, round(avg(gv / 200), 6) AS agent_cite_recall, round(avg(gs::INT) - avg(ns::INT), 6)::DOUBLE AS strict_pass_delta FROM b GROUP BY GROUPING SETS ((c), ())""")
def arm_dashboard(spark, sf_dir):
    """5.10, 5.36: users with both kinds of events are the items."""
    a, b = _measured(spark, sf_dir, "click"), _measured(spark, sf_dir, "view")
    return runs.arm_dashboard(a.join(b.select("item_id"), "item_id", "left_semi"), b.join(a.select("item_id"), "item_id", "left_semi"))


_GAP_DRAW = "(" + " + ".join(f"(('0x' || substr(md5('5:' || it || ':' || item_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= {p:.8f}::DOUBLE)::INT" for p in stats.POISSON) + ")"


@query(f"""WITH {_ARMS}, d AS (SELECT a.item_id, b.strict_pass::INT - a.strict_pass::INT AS gap FROM arms AS a JOIN arms AS b USING (item_id) WHERE a.arm = 'click' AND b.arm = 'view'),
  w AS (SELECT it, gap, {_GAP_DRAW} AS w FROM d, range(2000) AS t(it)), g AS (SELECT it, sum(w * gap)::DOUBLE / sum(w) AS gap FROM w GROUP BY it),
  c AS (SELECT round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high, (SELECT round(avg(gap), 6) FROM d) AS point FROM g)
  SELECT 'click' AS baseline_arm, 'view' AS treatment_arm, point, low, high, round(greatest(abs(high - point), abs(point - low)), 6) AS half_width, abs(point) <= 0.05 AS within_noise FROM c""")
def gap_dashboard(spark, sf_dir):
    """5.12, 12.3, 12.5: one gap over all items with its interval of 2,000 resamples and the floor of its arms."""
    a, b = (_measured(spark, sf_dir, x) for x in ("click", "view"))
    dev = a.join(b.select("item_id"), "item_id", "left_semi").select(F.lit("click").alias("arm"), "item_id", "strict_pass").unionByName(b.join(a.select("item_id"), "item_id", "left_semi").select(F.lit("view").alias("arm"), "item_id", "strict_pass"))
    floors = spark.createDataFrame([("click", 0.05), ("view", 0.01)], "arm string, spread double")
    return runs.gap_dashboard(dev, [("click", "view")], 5, floors=floors, bootstrap=stats.poisson_bootstrap)[0]


@query(f"""WITH {_BM25.format(where="WHERE lang = 'de'")}, {_TRI.format(where="WHERE lang = 'de'")}, {_RRF}, v AS (SELECT query_id, id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank AS vector_rank, NULL::INT AS bm25_rank, 'vector' AS stage, 'vector' AS stages, rank FROM tcr WHERE rank <= 8),
  h AS (SELECT hy.query_id, hy.id, hy.score, t.rank AS vector_rank, b.rank AS bm25_rank, hy.stage, concat_ws(',', CASE WHEN b.rank IS NOT NULL THEN 'bm25' END, CASE WHEN t.rank IS NOT NULL THEN 'vector' END) AS stages, hy.rank FROM hy LEFT JOIN tcr AS t ON t.query_id = hy.query_id AND t.id = hy.id AND t.rank <= 24 LEFT JOIN bmr AS b ON b.query_id = hy.query_id AND b.id = hy.id AND b.rank <= 24 WHERE hy.rank <= 8),
  u AS (SELECT 'vector' AS mode, * FROM v UNION ALL SELECT 'hybrid', * FROM h) SELECT mode, query_id, count(*) OVER (PARTITION BY mode, query_id) AS candidate_count, id, rank, score, stage, stages, vector_rank, bm25_rank, 'de' AS level FROM u""")
def retrieve_debug(spark, sf_dir):
    """11.6, 11.7: both modes over one level of the corpus, with provenance."""
    docs, asked = chunks(spark, sf_dir), questions(spark, sf_dir)
    both = [runs.retrieve_debug(docs, asked, mode, 8, level="lang", levels=["de"]) for mode in runs.MODES]
    return both[0].unionByName(both[1])


@query(f"""WITH {_TRI.format(where='')}, r AS (SELECT tcr.query_id, tcr.rank, d.text FROM tcr JOIN documents AS d ON d.doc_id = tcr.id WHERE rank <= 8), a AS (SELECT query_id, count(*) AS n, string_agg(split_part(text, '.', 1), '. ' ORDER BY rank) FILTER (rank <= 3) AS answer FROM r GROUP BY query_id)
  SELECT item_id AS query_id, 'naive-rag' AS arm, coalesce(answer, '') AS answer, least(coalesce(n, 0), 3)::INT AS n_claims, coalesce(n, 0)::INT AS n_sources FROM benchmark LEFT JOIN a ON query_id = item_id""")
def naive_rag_answers(spark, sf_dir):
    """11.4, 11.15, 11.16: one retrieval and the scripted synthesis for every question."""
    return runs.naive_rag(questions(spark, sf_dir), chunks(spark, sf_dir))


@query("""WITH s AS (SELECT doc_id, source, length(source) % 2 AS c FROM documents WHERE source IS NOT NULL) SELECT arm, count(*) AS sources, min(doc_id) AS first_id, 0.0::DOUBLE AS score FROM (SELECT 'stuff' AS arm, doc_id FROM s UNION ALL SELECT 'stuff-oracle', doc_id FROM s WHERE c = 0) GROUP BY arm""")
def stuffed_sources(spark, sf_dir):
    """3.19-3.21, 5.24, 11.14: sources are documents of two corpora."""
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("document_id"), "doc_id")
    registry = d.select("document_id").distinct().select("document_id", F.xxhash64("document_id").alias("doc_pos"), F.when(F.length("document_id") % 2 == 0, "tenancy").otherwise("selling").alias("corpus"))
    parts = [runs.stuffed_candidates(runs.chunks_for_arm(d, registry, arm, ["tenancy"])).withColumn("arm", F.lit(arm)) for arm in ("stuff", "stuff-oracle")]
    return parts[0].unionByName(parts[1]).groupBy("arm").agg(F.count(F.lit(1)).alias("sources"), F.min("doc_id").alias("first_id"), F.max("score").alias("score"))


@query(f"""WITH {_CITES}, it AS (SELECT o_orderkey AS item_id, o_orderpriority AS c, o_orderkey % 40 AS q FROM orders) SELECT o_orderkey AS item_id, cite_recall = 1.0 AND o_orderstatus = 'F' AS strict_pass, 't' || o_orderkey AS trace_id FROM prc JOIN orders ON o_orderkey = item_id""")
def run_aggregate(spark, sf_dir):
    """5.33: one arm's scores over all orders; the dashboard and the score rows come with it."""
    items, required, candidate, nodes = _cites(spark, sf_dir)
    o = table(spark, sf_dir, "orders").withColumn("item_id", F.col("o_orderkey"))
    outcomes = o.select("item_id", F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("trace_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("other").alias("observed_behavior"), F.col("o_totalprice").alias("latency_ms"), F.lit(0.0).alias("cost_usd"))
    out = runs.run_items(o.select("item_id", F.col("o_orderpriority").alias("behavior_class")), outcomes, required, candidate, candidate, nodes)
    return out["scores"].select("item_id", "strict_pass", "trace_id")


@query("""WITH c AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE i WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, i) AS place FROM c""")
def ranking_rerank(spark, sf_dir):
    """7.10: a model's ranking of a user's events, with a repeat and an index that does not exist."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("pos"))
    replies = e.select("user_id").distinct().select("user_id", F.array(*map(F.lit, [2, 0, 2, -1, 100000])).alias("ranking"))
    return runs.ranking_rerank(e, replies, "user_id").select("user_id", "event_id", "place")


@query("""WITH r AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice / 1000) END AS rel FROM orders) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY rel DESC NULLS LAST, CASE WHEN rel IS NOT NULL THEN o_orderpriority END, o_orderkey) AS place FROM r""")
def relevance_rerank(spark, sf_dir):
    """7.11: outside relevance, priorities on ties, unscored orders last."""
    o = table(spark, sf_dir, "orders").withColumn("pos", F.col("o_orderkey")).withColumn("rel", F.when(F.col("o_orderkey") % 3 > 0, F.round(F.col("o_totalprice") / 1000)))
    return fusion.relevance_rerank(o, "rel", F.col("o_orderpriority"), ["o_custkey"]).select("o_custkey", "o_orderkey", "place")


@query("""WITH p AS (SELECT l_partkey AS key, max_by(l_comment, l_pos) AS text FROM (SELECT l_partkey, l_returnflag || l_linenumber AS l_comment, l_orderkey * 100 + l_linenumber AS l_pos FROM lineitem) GROUP BY 1) SELECT key, text, 0.0::DOUBLE AS score, 'graph-expansion' AS stage FROM p WHERE key % 2 = 0""")
def expansion_candidates(spark, sf_dir):
    """4.7: of a repeated key the last row stands."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return runs.expansion_candidates(li.where("key % 2 = 0").select("key"), li)


@query("""WITH w AS (SELECT doc_id, quality, toxic, it, ('0x' || substr(md5('7:' || it || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM labels, range(2000) AS a(it)),
  k AS (SELECT it, (quality - toxic)::DOUBLE AS gap, """ + " + ".join(f"(u >= {p:.8f}::DOUBLE)::INT" for p in stats.POISSON) + """ AS w FROM w), g AS (SELECT it, sum(w * gap) / sum(w) AS gap FROM k GROUP BY it)
  SELECT round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high, count(*) AS iterations, (SELECT round(avg(quality - toxic), 6)::DOUBLE FROM labels) AS point FROM g""")
def bootstrap_ci_poisson(spark, sf_dir):
    """12.1 with Poisson weights by hash, 2000 resamples: no numbering, no join."""
    pairs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("treatment"), F.col("toxic").alias("baseline"))
    return stats.poisson_bootstrap(pairs, 7)


@query(f"""WITH {_KEYS}, {_NODES} SELECT key, split_part(key, '|', 1) AS document_id, len(string_split(key, '|')) > 1 AS has_segments FROM nodes""")
def path_rules(spark, sf_dir):
    """3.7, 9.18: every node's key is a citable path."""
    from marginalia.functions.paths import document_of, parse_key

    n = _nodes(spark, sf_dir).withColumn("p", parse_key(F.col("key")))
    return n.where("p is not null").select("key", document_of(F.col("key")).alias("document_id"), (F.size("p.segments") > 0).alias("has_segments"))
