"""Interaction of filters: what each of five filters removes, alone and in every order.

Conditions A to D look at a text alone and take one pass with DataFrame functions. Condition E, "the same text has a smaller doc_id", is
an existential self-join: a document is kept by a left-semi join with the distinct texts on two hashes, the exact text and a smaller doc_id. Only
documents whose hashes occur with a smaller doc_id bring their text to that join. Its right side is one row for each distinct text (least doc_id, by
a map-side aggregate); where a text has more than ``HOT_COPIES`` copies, its row is repeated for a number of salts that follows that count
and the copies are dealt over them, so no task gets all copies of a text. The ids that fail E are united with all ids and
their other failures, summed to a bit combination for each id, and counted: at most 32 combinations for each part. Orders are
worked out on these counts alone.

Defined results: null text counts as empty, a null ``source`` as the part ""; a null doc_id is smaller than none and has no smaller one; rows
with equal doc_id and text are no copies of each other and each counts; a document with several labels is good, or toxic, if one says so; a text of
any length is measured whole; without documents there are no parts and no rows; further columns are not carried.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side, text_of

SPACE, FILTERS = r"[\x20\x09-\x0D]+", "ABCDE"
HOT_COPIES = 4096
DUPLICATE = 1 << FILTERS.index("E")


def failures(text: Column, words: Column) -> Column:
    """Bits of the conditions A to D that a text fails."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike("[#$%&*|]")]
    bits = F.lit(0)
    for i, condition in enumerate(failed):
        bits = bits + F.when(condition, 1 << i).otherwise(0)
    return bits


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(0), text).alias("hash_a"), F.xxhash64(F.lit(1), text).alias("hash_b")]


def _part(docs: DataFrame, part_col: str) -> Column:
    return (F.coalesce(F.col(part_col).cast("string"), F.lit("")) if part_col in docs.columns else F.lit("")).alias("part")


def measured(docs: DataFrame, part_col: str = "source") -> DataFrame:
    """``(doc_id, part, hash_a, hash_b, bits)`` of each row, without its text."""
    rows = docs.select("doc_id", _part(docs, part_col), text_of().alias("t")).withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    return rows.select("doc_id", "part", *_hashes(F.col("t")), failures(F.col("t"), F.col("w")).alias("bits"))


def copies(docs: DataFrame, rows: DataFrame, part_col: str = "source") -> DataFrame:
    """``(doc_id, part, hash_a, hash_b)`` of rows whose text has a smaller doc_id; ``rows`` are the saved rows of ``measured``."""
    key = ["hash_a", "hash_b"]
    groups = rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
    groups = saved(groups.select(*key, F.ceil(F.col("n") / HOT_COPIES).cast("int").alias("salts")))
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", _part(docs, part_col), text_of().alias("t"))
    texts = saved(texts.select("*", *_hashes(F.col("t"))).join(small_side(groups), key))
    least = texts.groupBy(*key, "t", "salts").agg(F.min("doc_id").alias("least"))
    least = least.select(*key, "t", "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    same = [dealt[c] == least[c] for c in (*key, "salt", "t")]
    return dealt.join(least, [*same, least["least"] < dealt["doc_id"]], "left_semi").select("doc_id", "part", *key)


def combinations(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """``(part, bits, n, good, toxic)``: documents of each part by the set of conditions they fail."""
    rows = saved(measured(docs, part_col))
    key = ["doc_id", "part", "hash_a", "hash_b"]
    marks = copies(docs, rows, part_col).select(*key, F.lit(DUPLICATE).alias("bits"), F.lit(0).alias("n"))
    ids = rows.select(*key, "bits", F.lit(1).alias("n")).unionByName(marks).groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    known = ids.join(told, "doc_id", "left")

    def those(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)

    return known.groupBy("part", "bits").agg(F.sum("n").alias("n"), those("good"), those("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """What each filter of each order keeps and removes, from the rows of ``combinations``: 600 rows for each part.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``; ``shapley`` is what the filter
    removes, summed over all orders: of documents that fail k filters each of them removes its share in 120 / k orders.
    """
    counts = counted.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # at most 32
    steps = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(name) for name in order]
        steps += [{"filter_order": "".join(order), "step": i + 1, "before": sum(bits[:i]), "own": bits[i]} for i in range(len(order))]
    steps_of = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    rows = counts.select("part", "c", F.inline(steps_of))

    def total(value: str, condition: str) -> Column:
        return F.expr(f"aggregate(c, 0L, (a, x) -> a + if({condition}, {value}, 0L))")

    here = "(x.bits & before) = 0 AND (x.bits & own) <> 0"
    return rows.select(
        "part", "filter_order", "step",
        total("x.n", "(x.bits & (before | own)) = 0").alias("kept"),
        total("x.n", here).alias("removed"),
        total("x.n", "(x.bits & before) <> 0 AND (x.bits & own) <> 0").alias("redundant"),
        total("x.n", "x.bits = own").alias("unique_fails"),
        total("x.good", here).alias("good_lost"),
        total("x.toxic", here).alias("toxic_lost"),
        total("x.n * (120 div bit_count(x.bits))", "(x.bits & own) <> 0").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    return audit(combinations(docs, labels, part_col))
