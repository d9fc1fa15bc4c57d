"""Strict JSON artifacts: read by the type that a value has, never coerced; and a blind sheet.

Every reader takes a column or table of JSON texts and raises on the first text that breaks a rule. A JSON text that
is no object, a key that is not known, and a value of another type than the rule's are all errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.envelopes import require
from marginalia.sources.golden import CLASSES

# Keys of the rows and documents, buckets of corrections, those that relabel, the side of a slice.
LABEL_KEYS = ["item_id", "point_id", "question", "answer", "point_text", "human_credited"]
CORRECTION_KEYS = ["item_id", "point_id", "bucket", "justification", "corrected_human_credited"]
BUCKETS, RELABEL = ["rubric-wrong", "human-error", "judge-error"], ["rubric-wrong", "human-error"]
SLICE_KEYS, ENTRY_KEYS, SLICE_SIDE = ["version", "seed", "slice"], ["id", "behavior_class", "side"], "dev"


def _part(body: Column, name: str) -> Column:
    return F.try_variant_get(body, f"$.{name}", "variant")


def kind_of(body: Column, name: str) -> Column:
    """The JSON type of a field: STRING, BOOLEAN, NUMBER, OBJECT, ARRAY, or NULL; null if it is not there."""
    kind = F.schema_of_variant(_part(body, name))
    other = F.when(kind == "VOID", "NULL").when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY")
    return F.when(kind.isin("STRING", "BOOLEAN"), kind).otherwise(F.coalesce(other, F.when(kind.isNotNull(), "NUMBER")))


def text_of(body: Column, name: str) -> Column:
    """A field that is a string; null if it is of another type."""
    return F.when(F.schema_of_variant(_part(body, name)) == "STRING", F.try_variant_get(body, f"$.{name}", "string"))


def flag_of(body: Column, name: str) -> Column:
    """A field that is a boolean; null if it is of another type."""
    return F.when(F.schema_of_variant(_part(body, name)) == "BOOLEAN", F.try_variant_get(body, f"$.{name}", "boolean"))


def _filled(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) > 0


def _known_keys(json: Column, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, keys)))) == 0, F.lit(False))


def is_truthy(body: Column, name: str) -> Column:
    """Whether a field says yes: true, a number but 0, a string, list or object that is not empty."""
    text = F.coalesce(F.to_json(_part(body, name)), F.lit("null"))
    number = F.coalesce(text.try_cast("double") == 0, F.lit(False))
    return ~(text.isin("null", "false", '""', "[]", "{}") | number)


def cli_envelope(text: Column) -> Column:
    """(result, cost, usage) of a command's JSON envelope (10.28).

    No object, an error flag that says yes in whatever type, or a result that is no string is an error. A cost counts if it
    is a number (or boolean, 1 or 0), usage if it is an object, as JSON.
    """
    body = F.try_parse_json(text)
    rule = F.schema_of_variant(body).startswith("OBJECT") & text_of(body, "result").isNotNull() & ~is_truthy(body, "is_error")
    kind = kind_of(body, "total_cost_usd")
    cost = F.when(kind == "NUMBER", F.try_variant_get(body, "$.total_cost_usd", "double")).when(kind == "BOOLEAN", flag_of(body, "total_cost_usd").cast("double"))
    usage = F.when(kind_of(body, "usage") == "OBJECT", F.to_json(_part(body, "usage")))
    shape = F.struct(text_of(body, "result").alias("result"), cost.alias("cost"), usage.alias("usage"))
    return require(shape, rule, "not a result envelope", "struct<result:string,cost:double,usage:string>")


def label_rows(labels: DataFrame) -> DataFrame:
    """Filled rows of a labelling sheet (10.29): ``labels(row)``, JSON objects.

    All keys but no other, texts that are strings and not blank, and a boolean grade, else an error.
    """
    *texts, graded = LABEL_KEYS
    parsed = labels.select("row", F.try_parse_json("row").alias("v"))
    read = parsed.select("row", *(text_of(F.col("v"), n).alias(n) for n in texts), flag_of(F.col("v"), graded).alias(graded))
    rule = _known_keys(F.col("row"), LABEL_KEYS) & F.col(graded).isNotNull()
    for text in texts:
        rule = rule & _filled(F.col(text))
    kind = "struct<" + ",".join(f"{n}:string" for n in texts) + ",human_credited:boolean>"
    return read.select(require(F.struct(*LABEL_KEYS), rule, "not a filled label", kind).alias("r")).select("r.*")


def blind_sheet(points: DataFrame, answers: DataFrame) -> DataFrame:
    """``(row)``: a JSON object for each rubric point to be graded, the grade null (10.29).

    ``points(item_id, point_id, question, point_text)``, ``answers(item_id, answer)``; an item without an answer is an
    error. No column of a judge is ever looked at, so none can be in a sheet.
    """
    joined = points.select("item_id", "point_id", "question", "point_text").join(answers.select("item_id", "answer"), "item_id", "left")
    answer = require(F.col("answer"), F.col("answer").isNotNull(), "an item has no answer", "string")
    row = F.struct("item_id", "point_id", "question", answer.alias("answer"), "point_text", F.lit(None).cast("boolean").alias("human_credited"))
    return joined.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))


def corrections(text: DataFrame) -> DataFrame:
    """``(item_id, point_id, bucket, justification, corrected_human_credited)`` of correction documents ``text(doc)`` (10.29).

    A document is an object with the list ``corrections`` and nothing else; the list may be empty. A row names a
    bucket and a justification; relabelling buckets state a boolean, the judge's error must not. Two rows for
    one point of an item are an error.
    """
    body = F.try_parse_json("doc")
    rule = _known_keys(F.col("doc"), ["corrections"]) & (kind_of(body, "corrections") == "ARRAY")
    listed = require(F.try_variant_get(body, "$.corrections", "array<variant>"), rule, "not a list of corrections", "array<variant>")
    rows = text.select(F.explode(listed).alias("v")).select("v", F.to_json("v").alias("row"))
    v = F.col("v")
    bucket, graded = text_of(v, "bucket"), kind_of(v, CORRECTION_KEYS[-1])
    coupled = F.when(bucket.isin(RELABEL), graded == "BOOLEAN").otherwise(graded.isNull())
    good = F.schema_of_variant(v).startswith("OBJECT") & _known_keys(F.col("row"), CORRECTION_KEYS) & bucket.isin(BUCKETS) & coupled
    for name in ("item_id", "point_id", "justification"):
        good = good & _filled(text_of(v, name))
    shape = F.struct(*(text_of(v, n).alias(n) for n in CORRECTION_KEYS[:-1]), flag_of(v, CORRECTION_KEYS[-1]).alias(CORRECTION_KEYS[-1]))
    kind = "struct<" + ",".join(f"{n}:string" for n in CORRECTION_KEYS[:-1]) + ",corrected_human_credited:boolean>"
    read = rows.select(require(shape, good, "not a correction", kind).alias("r")).select("r.*")
    many = F.count(F.lit(1)).over(Window.partitionBy("item_id", "point_id"))
    once = require(F.col("bucket"), many == 1, "a point is corrected twice", "string")
    return read.withColumn("bucket", once)


def slice_manifest(text: DataFrame) -> DataFrame:
    """``(seed, pos, item_id, behavior_class, side)`` of slice manifests ``text(doc)`` (10.29).

    A whole seed, entries with known keys only, an id, a known behaviour, and the side that is not sealed; a
    manifest without entries is an error. A column ``first`` of ``text`` is the place of a document's first entry in
    its whole slice, where that is dealt to many documents.
    """
    text = text.select("doc", (F.col("first") if "first" in text.columns else F.lit(0)).cast("long").alias("first"))
    body = F.try_parse_json("doc")
    seed = F.when(kind_of(body, "seed") == "NUMBER", F.try_variant_get(body, "$.seed", "double"))
    rule = _known_keys(F.col("doc"), SLICE_KEYS) & (seed == F.floor(seed)) & (kind_of(body, "slice") == "ARRAY")
    entries = F.try_variant_get(body, "$.slice", "array<variant>")
    listed = require(entries, rule & (F.size(entries) > 0), "not a slice manifest", "array<variant>")
    # columns of their own below the explode: in it they would be read again, from the whole document, for every entry
    whole = text.select("first", F.try_variant_get(body, "$.seed", "long").alias("seed"), listed.alias("listed"))
    rows = whole.select("seed", "first", F.posexplode("listed").alias("at", "v")).select("seed", (F.col("first") + F.col("at")).alias("pos"), "v", F.to_json("v").alias("row"))
    v = F.col("v")
    good = F.schema_of_variant(v).startswith("OBJECT") & _known_keys(F.col("row"), ENTRY_KEYS) & _filled(text_of(v, "id"))
    good = good & text_of(v, "behavior_class").isin(CLASSES) & (text_of(v, "side") == SLICE_SIDE)
    shape = F.struct(text_of(v, "id").alias("item_id"), text_of(v, "behavior_class").alias("behavior_class"), text_of(v, "side").alias("side"))
    read = rows.select("seed", "pos", require(shape, good, "not an entry of a slice", "struct<item_id:string,behavior_class:string,side:string>").alias("r"))
    return read.select("seed", "pos", "r.*")


def render_slice(entries: DataFrame, seed: int) -> DataFrame:
    """``(doc)``: one manifest of ``entries(item_id, behavior_class)``, ordered by the hash of the id; a slice is bounded."""
    entry = F.struct(F.col("item_id").alias("id"), "behavior_class", F.lit(SLICE_SIDE).alias("side"))
    placed = F.array_sort(F.collect_list(F.struct(F.sha2(F.col("item_id"), 256).alias("h"), entry.alias("e"))))
    return entries.agg(placed.alias("p")).select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(seed).alias("seed"), F.transform("p", lambda x: x["e"]).alias("slice"))).alias("doc"))


#: Entries that a document of a slice holds, about.
ENTRIES = 1000


def render_slices(entries: DataFrame, seed: str, size: int = ENTRIES) -> DataFrame:
    """``(doc, first)``: the slices of ``entries(item_id, behavior_class)`` by the column ``seed``, in documents of about ``size`` entries.

    Documents are ranges of the hash of the id, so a slice is their entries in the order of ``first``, the place of a
    document's first entry; entries of one hash are in one document.
    """
    ranges = max(1, -(-entries.count() // size))
    h = F.sha2(F.col("item_id"), 256)
    part = F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("long")
    entry = F.struct(F.col("item_id").alias("id"), "behavior_class", F.lit(SLICE_SIDE).alias("side"))
    rows = entries.select(F.col(seed).alias("seed"), part.alias("part"), h.alias("h"), entry.alias("e"))
    counts = rows.groupBy("seed", "part").agg(F.count(F.lit(1)).alias("n"))  # a row a document
    firsts = counts.select("seed", "part", (F.sum("n").over(Window.partitionBy("seed").orderBy("part")) - F.col("n")).alias("first"))
    placed = rows.groupBy("seed", "part").agg(F.array_sort(F.collect_list(F.struct("h", "e"))).alias("p"))
    docs = placed.select("seed", "part", F.to_json(F.struct(F.lit(1).alias("version"), "seed", F.transform("p", lambda x: x["e"]).alias("slice"))).alias("doc"))
    return docs.join(firsts, ["seed", "part"]).select("doc", "first")
