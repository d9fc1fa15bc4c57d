"""Line dedup: every line that an earlier document holds already goes.

Lines are what ``\\n`` splits off; a null or empty text is one empty line. A line's key is
the line without white space (``[\\x20\\x09-\\x0D]``) at both ends, A-Z lower-cased. A key of
at least ``least`` code points is kept in the smallest doc_id that holds it (all its lines
there) and dropped everywhere else. A null doc_id counts as the largest; rows with one
doc_id are one document, so their common lines stay in all of them.

Plan. Only hashes move, not lines: (128-bit hash of the key, doc_id, position).

1. They are range-partitioned by hash and sorted within by document and position; a
   stream over each hash carries its first document along, later ones are dropped.
2. A line that may be very common (found often in a sample of the lines) would make one
   range too large. Those lines, ``many`` at most, whose number does not grow with the
   input, get their first document by an aggregation that is combined before the
   shuffle. The sample decides where a line's first document is looked for, never the
   result.
3. What is dropped comes back as a bitmap of each document: 64 positions a word, words
   without a dropped line left out. It is joined to the documents, where the kept lines are
   put together.

Only DataFrame and SQL functions are used. Every row is returned, equal rows too; extra
columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.words import quoted, spare
from marginalia.plans.scratch import materialize

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Of so many lines one is looked at for common ones; a line that is seen ``_SEEN`` times there is taken for one.
_SAMPLED, _SEEN = 32, 64


def line_key(line: Column) -> Column:
    """The key of a line."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells a row from others: its id, and a hash of its text and of whether it has an id."""
    return [F.coalesce(doc_id, F.lit(0).cast("long")).alias("ident"), F.xxhash64(doc_id.isNull(), text).alias("print")]


def _keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(h1, h2, doc_id, pos, ident, print)`` of every line whose key is long enough."""
    doc_id, text = quoted(id_col).cast("long"), quoted(text_col).cast("string")
    rows = docs.select(doc_id.alias("doc_id"), *_row_key(doc_id, text), F.posexplode(_lines(text)).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "pos", "ident", "print")


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, many: int = 4096) -> DataFrame:
    """``(ident, print, drops)``: bitmaps of the dropped lines of each row that loses any.

    ``drops`` holds ``(word, bits)`` in ascending order: bit b of word w stands for line 64 * w + b.
    """
    lines = materialize(_keys(docs, id_col, text_col, least))
    seen = lines.sample(1 / _SAMPLED, seed=11).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("seen"))
    common = seen.where(F.col("seen") >= _SEEN).orderBy(F.desc("seen"), "h1", "h2").limit(many).select("h1", "h2").collect()
    parts, rest = [], lines
    if common:
        hot = F.broadcast(docs.sparkSession.createDataFrame(common, "h1 long, h2 long"))
        rest = lines.join(hot, ["h1", "h2"], "left_anti")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("first")
        firsts = materialize(lines.join(hot, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(first))
        parts.append(lines.join(F.broadcast(firsts), ["h1", "h2"]))
    by_hash = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    # the window reads the ranges as they are: it needs no shuffle of its own
    parts.append(rest.repartitionByRange("h1", "h2").withColumn("first", F.first("doc_id").over(by_hash)))
    gone = [p.where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("ident", "print", "pos") for p in parts]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = reduce(DataFrame.unionByName, gone).groupBy("ident", "print", F.floor(F.col("pos") / 64).cast("int").alias("word"))
    words = words.agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("ident", "print").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def _dense(drops: Column) -> Column:
    """The words of a bitmap with the empty ones between them."""
    before = F.slice(F.concat(F.array(F.lit(-1)), F.transform(drops, lambda d: d["word"])), F.lit(1), F.size(drops))
    zero = F.lit(0).cast("long")
    filled = F.zip_with(drops, before, lambda d, b: F.concat(F.array_repeat(zero, d["word"] - b - 1), F.array(d["bits"])))
    return F.flatten(filled)


def kept_text(text: Column, drops: Column) -> Column:
    """The lines of ``text`` that ``drops`` leaves, joined; null drops leave all."""

    def without(words: Column) -> Column:
        def stays(_: Column, i: Column) -> Column:
            word = F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
            return F.call_function("shiftrightunsigned", word, i % 64).bitwiseAND(F.lit(1).cast("long")) == 0

        return F.array_join(F.filter(_lines(text), stays), "\n")

    # the one-element array binds the words, which are so made once a text, not once a line
    shortened = F.get(F.transform(F.array(_dense(drops)), without), F.lit(0))
    return F.when(drops.isNull(), F.coalesce(text, F.lit(""))).otherwise(shortened)


def _with_drops(docs: DataFrame, keys: list[str], drops: str, id_col: str, text_col: str, options: dict) -> DataFrame:
    """``docs`` with the key of each row and its bitmap."""
    found = dropped_lines(docs, id_col=id_col, text_col=text_col, **options)
    found = found.select(F.col("ident").alias(keys[0]), F.col("print").alias(keys[1]), F.col("drops").alias(drops))
    made = _row_key(quoted(id_col).cast("long"), quoted(text_col).cast("string"))
    keyed = docs.select("*", *(c.alias(k) for c, k in zip(made, keys, strict=True)))
    return keyed.join(found, keys, "left")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` of every row: lines before, lines dropped, and the text that is left."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    rows = _with_drops(rows, ["ident", "print"], "drops", "doc_id", "text", options)
    gone = F.aggregate("drops", F.lit(0).cast("long"), lambda n, d: n + F.bit_count(d["bits"]))
    return rows.select(
        "doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0).cast("long")).alias("n_dropped"),
        kept_text(F.col("text"), F.col("drops")).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated lines of each text dropped; a null text stays null, other columns are untouched."""
    keys, drops = [spare(docs.columns, "ident"), spare(docs.columns, "print")], spare(docs.columns, "drops")
    rows = _with_drops(docs, keys, drops, id_col, text_col, options)
    text = quoted(text_col).cast("string")
    new = F.when(quoted(drops).isNull(), text).otherwise(kept_text(text, quoted(drops)))
    return rows.select(*(new.alias(c) if c == text_col else quoted(c) for c in docs.columns))
