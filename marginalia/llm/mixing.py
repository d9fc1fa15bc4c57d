"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order, null last, weigh ``weights``, repeating, and share
``share`` of all words. A target stops at ``most`` times its source's words; what is
over goes to the others by weight until none is above (water filling: the level is
found with prefix sums over the sources in order of most * words / weight).

Each document is expected target / source words copies. The whole part is taken; the
fractional parts are rounded dependently: of two documents with fractions, mass in
words moves from one to the other until one fraction is 0 or 1, in the direction and
with the probability that leave both expectations unchanged. So the words taken of a
source do not move at all until its last fraction is rounded alone.

Rows equal in all columns are counted first and are one item: of n rows with the fraction p the whole
part of n * p rows is taken, and the rest of it is the item's fraction. So copies of one
row never meet in one block, however many they are.

The reduction is a tree: items of a source are dealt by hash to blocks of about
``fan_in``, each block is reduced to at most one residual item by a fold over its
array, and the residuals of ``fan_in`` blocks meet in a block of the next level. A hot
source only has more blocks. All randomness is a hash of ids and level: reruns agree.

Only DataFrame and SQL functions are used. A null text has size 0; documents of size
0 are taken with 0 words. Every row is returned, those with a null or repeated id too.
Of the documents only id, source, size and a hash go through the tree. Extra columns may
have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.words import quoted, row_hash, spare
from marginalia.plans.scratch import materialize

WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, size, n)`` -> ``(source, source_no, source_size, n_docs, target)``; n: so many equal rows."""
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    by = by.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(above), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(above), F.lit(0.0)))
    by = by.withColumn("level", level)
    by = by.withColumn("water", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water")))
    return by.select("source", "source_no", "source_size", "n_docs", target.alias("target"))


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


_ITEM = ["h", "doc_id", "row", "size", "n"]
_ITEM_TYPE = "struct<h:bigint,doc_id:bigint,row:bigint,size:bigint,n:bigint,p:double>"


def _fold(items: Column, level: int, seed: int) -> Column:
    """Reduce an array of items to decisions and at most one residual."""
    start = F.struct(F.lit(None).cast(_ITEM_TYPE).alias("held"), F.expr(f"cast(array() as array<{_ITEM_TYPE}>)").alias("done"))

    def step(acc: Column, new: Column) -> Column:
        held = acc["held"]
        a, b = (x["size"].cast("double") for x in (held, new))
        room_a, room_b = a * (1 - held["p"]), b * (1 - new["p"])
        mass_a, mass_b = a * held["p"], b * new["p"]
        up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
        rises = _uniform(F.lit(seed), F.lit(level), held["h"], new["h"]) * (up + down) < down
        a_ends = F.when(rises, room_a <= mass_b).otherwise(mass_a <= room_b)
        b_ends = F.when(rises, mass_b <= room_a).otherwise(room_b <= mass_a)
        p_a = F.when(rises, F.when(a_ends, 1.0).otherwise(held["p"] + mass_b / a)).otherwise(F.when(a_ends, 0.0).otherwise(held["p"] - room_b / a))
        p_b = F.when(rises, F.when(b_ends, 0.0).otherwise(new["p"] - room_a / b)).otherwise(F.when(b_ends, 1.0).otherwise(new["p"] + mass_a / b))
        now_a, now_b = (F.struct(*[x[c].alias(c) for c in _ITEM], p.alias("p")) for x, p in ((held, p_a), (new, p_b)))
        ended = F.filter(F.array(F.when(a_ends, now_a), F.when(b_ends, now_b)), lambda x: x.isNotNull())
        rest = F.when(~a_ends, now_a).when(~b_ends, now_b)
        met = F.struct(rest.cast(_ITEM_TYPE).alias("held"), F.concat(acc["done"], ended.cast(f"array<{_ITEM_TYPE}>")).alias("done"))
        return F.when(held.isNull(), F.struct(new.cast(_ITEM_TYPE).alias("held"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(items, start, step)


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, fan_in: int, seed: int) -> DataFrame:
    """What is taken of ``rows(doc_id, source, row, size)``, a row for each set of equal ones.

    ``(doc_id, source, row, size, n, source_size, target, whole, extra, bit)``: each of the n rows is
    taken ``whole`` times, ``extra`` of them once more, and one further row ``bit`` times more.
    """
    sizes = materialize(rows.groupBy("doc_id", "source", "row", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(sizes, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    targets = materialize(targets.select("*", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("part")))
    most_docs = targets.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]

    some = F.col("n") * F.col("part")
    left = F.greatest(some - F.floor(some + 1e-12), F.lit(0.0))
    known = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        "source_no", "n_docs", F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "row", "size").alias("h"), "doc_id", "row", "size", "n", left.alias("p")
    )
    alone = (F.col("size") == 0) | (F.col("p") < 1e-12)
    settled = known.where(alone).select("source_no", "doc_id", "row", "size", "n", (_uniform(F.lit(seed), F.col("h")) < F.col("p")).cast("int").alias("bit"))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.ceil(F.col("n_docs") / fan_in))
    open_ = known.where(~alone).select("source_no", block.alias("block"), F.struct(*_ITEM, "p").alias("item"))

    decided = lambda item, bit: [*(item[c].alias(c) for c in _ITEM[1:]), bit.cast("int").alias("bit")]
    order = lambda x, y: F.when(x["size"] != y["size"], F.when(x["size"] > y["size"], -1).otherwise(1)).when(x["h"] < y["h"], -1).when(x["h"] > y["h"], 1).otherwise(0)
    parts, level, width = [settled], 0, max(1, -(-most_docs // fan_in))
    while True:
        # larger documents first: what a block leaves over has met the smaller ones
        items = F.array_sort(F.collect_list("item"), order)
        folded = materialize(open_.groupBy("source_no", "block").agg(items.alias("items")).select("source_no", "block", _fold(F.col("items"), level, seed).alias("out")))
        parts.append(folded.select("source_no", F.explode("out.done").alias("d")).select("source_no", *decided(F.col("d"), F.col("d.p"))))
        open_ = folded.where("out.held is not null").select("source_no", F.floor(F.col("block") / fan_in).alias("block"), F.col("out.held").alias("item"))
        if width == 1:
            last = _uniform(F.lit(seed), F.lit(-1), F.col("item.h")) < F.col("item.p")
            parts.append(open_.select("source_no", *decided(F.col("item"), last)))
            break
        level, width = level + 1, -(-width // fan_in)
    out = reduce(DataFrame.unionByName, parts)
    return out.join(targets, "source_no").select("doc_id", "source", "row", "size", "n", "source_size", "target", F.col("whole").cast("long"), F.floor(some + 1e-12).alias("extra"), "bit")


#: Rows that one row is repeated to in one task; more are dealt to tasks first.
REPEATS = 4096


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says, which is dropped."""
    total = F.col(f"`{times}`")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / REPEATS)), lambda i: F.least(F.lit(REPEATS).cast("long"), total - i * REPEATS))
    out = df.where(total > 0).withColumn(times, F.explode(parts))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), total))).drop(times)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, fan_in: int = 48, seed: int = 7) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of every row."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(source_col).cast("string").alias("source"), row_hash(docs).alias("row"), _size(quoted(text_col)).alias("size"))
    plan = _plan(rows, weights, share, most, fan_in, seed)
    extra, one = F.col("extra"), F.when(F.col("extra") < F.col("n"), 1).otherwise(0).cast("long")
    shares = F.array(*(F.struct((F.col("whole") + more).cast("int").alias("copies"), times.alias("times")) for more, times in ((F.lit(1), extra), (F.col("bit"), one), (F.lit(0), F.col("n") - extra - one))))
    each = plan.withColumn("s", F.explode(shares)).select("doc_id", "source", "size", "source_size", "target", F.col("s.copies").alias("copies"), F.col("s.times").alias("times"))
    return _repeated(each, "times").withColumn("taken", F.col("copies") * F.col("size"))


def resample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, fan_in: int = 48, seed: int = 7) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns unchanged.

    Rows are told apart by a hash of all their columns, so rows with one id, or none, are
    each taken as planned; rows equal in every column are taken as often as their number.
    """
    row, size, ident, times = (spare(docs.columns, x) for x in ("row", "size", "ident", "times"))
    doc_id = quoted(id_col).cast("long")
    mine = docs.withColumn(row, row_hash(docs)).withColumn(size, _size(quoted(text_col))).withColumn(ident, F.coalesce(doc_id, F.lit(0).cast("long")))
    rows = mine.select(doc_id.alias("doc_id"), quoted(source_col).cast("string").alias("source"), F.col(row).alias("row"), F.col(size).alias("size"))
    plan = _plan(rows, weights, share, most, fan_in, seed)
    total = (F.col("n") * F.col("whole") + F.col("extra") + F.when(F.col("extra") < F.col("n"), F.col("bit")).otherwise(0)).cast("long")
    plan = plan.select(F.col("row").alias(row), F.col("size").alias(size), F.coalesce("doc_id", F.lit(0).cast("long")).alias(ident), total.alias(times)).where(F.col(times) > 0)
    joined = mine.dropDuplicates([row, size, ident]).join(plan, [row, size, ident])
    columns = [quoted(c) for c in docs.columns]
    return _repeated(joined.select(*columns, times), times).select(*columns)
