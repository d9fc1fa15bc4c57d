"""Cross-reference expansion and definitions."""

from __future__ import annotations

from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.fusion import first_seen
from marginalia.plans.scratch import materialize


#: Bits by which rows that meet no key are left out before a join, whatever the number of keys: 8 MB as longs.
_BITS, _PART = 1 << 26, 1 << 16


def _meets(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is none of ``keys(key)``; a join must decide on the rest.

    Keys are marked in a bitmap of fixed size, which every task holds, so that rows that meet no
    key are not shuffled. Of many more keys than bits it leaves out less.
    """
    kind = rows.select(column).union(keys.select("key")).schema[0].dataType  # equal keys of two types have one hash
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(_BITS))
    words = keys.select(spot("key").alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")).alias("bits"))
    dense = keys.sparkSession.range(_BITS // 64).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    parts = dense.groupBy(F.floor(F.col("word") * 64 / _PART).alias("__part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("__bits"))
    marked = F.broadcast(materialize(parts))
    spotted = rows.withColumn("__spot", spot(column)).withColumn("__part", F.shiftright("__spot", 16))
    word = F.get("__bits", F.shiftright(F.col("__spot") % _PART, 6).cast("int"))
    return spotted.join(marked, "__part").where(F.getbit(word, (F.col("__spot") % 64).cast("int")) == 1).select(*rows.columns)


def expand_one_hop(seeds: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Neighbours of seed keys (4.3): (key, via, edge_pos), first edge first.

    ``seeds(key)``, ``edges(source, target, edge_pos)`` in either direction,
    ``chunks(key)``: neighbours that are seeds or no chunk are left out. Edges that meet no seed
    are not shuffled.
    """
    both = edges.select("edge_pos", F.lit(0).alias("turn"), F.col("source").alias("via"), F.col("target").alias("key")).unionByName(
        edges.select("edge_pos", F.lit(1).alias("turn"), F.col("target").alias("via"), F.col("source").alias("key"))
    )
    seed = materialize(seeds.select("key").distinct())
    # written, or the planner would move the joins below before it
    out = materialize(_meets(both, "via", seed)).join(seed.withColumnRenamed("key", "via"), "via", "left_semi").join(seed, "key", "left_anti").join(chunks.select("key").distinct(), "key", "left_semi")
    return first_seen(out.withColumn("pos", F.struct("edge_pos", "turn")), ["key"]).select("key", "via", "edge_pos")


def expanded(seeds: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Seeds and their neighbours with where they come from (8.2)."""
    return seeds.select("key", F.lit("seed").alias("origin")).unionByName(expand_one_hop(seeds, edges, chunks).select("key", F.lit("graph-expansion").alias("origin")))


def edges_of_documents(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges of the candidates' documents (4.4)."""
    return edges.join(candidates.select("document_id").distinct(), "document_id", "left_semi")


def definitions_of_documents(definitions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Definitions of the candidates' documents; a later document's term stands (4.5)."""
    mine = definitions.join(candidates.select("document_id").distinct(), "document_id", "left_semi")
    return first_seen(mine.withColumn("pos", -F.col("doc_pos")), ["term"])


def attach_definitions(definitions: DataFrame, texts: DataFrame, max_terms: int | None = None, block: int = 50_000) -> DataFrame:
    """Terms that occur in a text, ignoring case (4.6): (id, term).

    Up to ``block`` terms are a dictionary that every task holds as an automaton; it reads each
    text once, whatever the number of terms. More terms are dealt to blocks with a pass each, of
    which the driver holds one at a time. More than ``max_terms``, where stated, are an error.
    """
    asked = definitions.select("term").where("term is not null and term <> ''").distinct()
    if max_terms is not None and len(asked.limit(max_terms + 1).collect()) > max_terms:
        raise ValueError(f"more than {max_terms} terms")
    rows = asked.limit(block + 1).collect()
    if len(rows) <= block:
        return _attach_block([r.term for r in rows], texts)
    return reduce(DataFrame.unionByName, [materialize(_attach_block([r.term for r in part], texts)) for part in batched(asked.toLocalIterator(), block)])


def _attach_block(terms: list[str], texts: DataFrame) -> DataFrame:
    """One pass for terms that a task can hold."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        found = ahocorasick.Automaton()
        for term in terms:
            found.add_word(term.lower(), (*found.get(term.lower(), ()), term))
        found.make_automaton()
        for batch in batches:
            ids, hits = [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = {t for _, ts in found.iter((text or "").lower()) for t in ts} if terms else set()
                ids += [ident] * len(seen)
                hits += sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(hits, pa.string())], ["id", "term"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, term string")
