"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions alone.

An item's windows are its runs of ``window`` words. A first pass counts the test terms in the corpus; each window then
has a rarest term. A second pass stores the postings of those terms: term, document, position, and the words around it, as far as a window
reaches. A window's matches are looked up from its rarest list; the lists of its other terms, adjusted by their offsets, are
the neighbouring words of the posting, so the intersection needs no further join: the slice that starts at
(position - offset) must equal the window. A proximity match asks for all its terms within ``reach`` words of the posting, in any order.

Windows of one term come together in groups of at most ``GROUP_WINDOWS`` on average, so a posting meets each group once; a passage that a
third of the documents share yields a few postings for each of them. Test terms are broadcast only below a measured size.

Defined results: null text has no words; an item without words has no window, one with fewer than ``window`` words is one window;
a null item_id counts as ""; items with equal ids count once; repeated rows each get their result; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fits, row_key, saved, small_side, text_of

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GROUP_WINDOWS = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """``(item, terms)``: the distinct windows of each item."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_of()).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(window)))).alias("terms")).distinct()


def _rows(docs: DataFrame) -> DataFrame:
    """The key and the words of each document."""
    text = text_of()
    return docs.select("doc_id", *row_key(F.col("doc_id"), text), words_of(text).alias("w"))


def rarest_terms(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(terms, term, at)``: each distinct window with its rarest term and that term's offset; windows with a term that
    the corpus lacks are left out, as they cannot match."""
    terms = windows.select("terms").distinct()
    each = terms.select("terms", F.posexplode("terms").alias("at", "term"))
    tested = saved(each.select("term").distinct())
    found = _rows(docs).select(F.explode("w").alias("term")).join(small_side(tested), "term", "left_semi").groupBy("term").count()
    ranked = each.join(saved(found), "term", "left").groupBy("terms").agg(
        F.min(F.struct("count", "at", "term")).alias("least"), F.min(F.col("count").isNotNull()).alias("all")
    )
    return ranked.filter("all").select("terms", "least.term", "least.at")


def index(docs: DataFrame, terms: DataFrame, reach: int = 9) -> DataFrame:
    """Postings ``(term, key_a, key_b, pos, left, around)`` of ``terms(term)``; ``around[left]`` is the term itself."""
    terms, rows, key = saved(terms), _rows(docs).filter(F.size("w") > 0), ["key_a", "key_b"]
    left = F.least("pos", F.lit(reach))
    around = F.slice("w", F.col("pos") - left + 1, left + reach + 1)
    if fits(terms):
        each = rows.select(*key, "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(terms), "term", "left_semi")
    else:  # the words of a document must not travel with each of its terms: find the positions first
        at = rows.dropDuplicates(key).select(*key, F.posexplode("w").alias("pos", "term")).join(terms.hint("shuffle_merge"), "term", "left_semi")
        at = at.groupBy(*key).agg(F.collect_list(F.struct("pos", "term")).alias("at"))
        each = rows.join(at, key).select(*key, "w", F.inline("at"))
    return each.select("term", *key, "pos", left.alias("left"), around.alias("around"))


def matches(docs: DataFrame, items: DataFrame, window: int = 10, near: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(key_a, key_b, pos, n, exact, terms)`` for each match, and ``(item, terms)`` of the windows.

    Exact phrases, and with ``near`` also proximity matches: all terms within ``near`` words of the rarest one.
    """
    windows = saved(item_windows(items, window))
    rarest = saved(rarest_terms(docs, windows))
    postings = saved(index(docs, rarest.select("term").distinct(), max(window - 1, near or 0)))
    sizes = rarest.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / GROUP_WINDOWS).alias("groups"))
    grouped = rarest.join(sizes, "term").withColumn("group", F.pmod(F.xxhash64("terms"), F.col("groups")))
    grouped = saved(grouped.groupBy("term", "group").agg(F.collect_list(F.struct("terms", "at")).alias("tests")))
    met = postings.join(grouped, "term")

    def exact(t: Column) -> Column:
        first = F.col("left") - t["at"]  # from 0
        return (first >= 0) & (F.slice("around", F.greatest(first, F.lit(0)) + 1, F.size(t["terms"])) == t["terms"])

    found = F.filter("tests", exact)
    made = F.transform(found, lambda t: F.struct((F.col("pos") - t["at"]).alias("start"), F.size(t["terms"]).alias("n"), F.lit(True).alias("exact"), t["terms"].alias("terms")))
    if near is not None:
        close = F.slice("around", F.greatest(F.col("left") - near, F.lit(0)) + 1, F.least("left", F.lit(near)) + near + 1)
        wide = F.filter("tests", lambda t: (F.size(F.array_except(t["terms"], F.col("close"))) == 0) & ~exact(t))
        met = met.withColumn("close", close)
        made = F.concat(made, F.transform(wide, lambda t: F.struct(F.col("pos").alias("start"), F.lit(1).alias("n"), F.lit(False).alias("exact"), t["terms"].alias("terms"))))
    return met.select("key_a", "key_b", F.inline(made)).withColumnRenamed("start", "pos").distinct(), windows


def _covered(spans: Column) -> Column:
    """Words covered by spans (pos, n), which are sorted."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(a: Column, s: Column) -> Column:
        end = s["pos"] + s["n"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["sum"] + F.greatest(end - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("sum"))

    return F.aggregate(spans, zero, add, lambda a: a["sum"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every document."""
    found, windows = matches(docs, items, window)
    found = saved(found.filter("exact").select("key_a", "key_b", "pos", "n", "terms"))
    key = ["key_a", "key_b"]
    hits = found.groupBy(*key).agg(_covered(F.sort_array(F.collect_set(F.struct("pos", "n")))).alias("n_hit"))
    named = found.select(*key, "terms").distinct().join(windows, "terms").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = _rows(docs).select("doc_id", *key, F.size("w").cast("long").alias("n_words"))
    rows = rows.join(hits.join(named, key), key, "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a window of an item."""
    found, _ = matches(docs, items, window)
    bad = saved(found.filter("exact").select("key_a", "key_b").distinct())
    a, b = row_key(F.col("doc_id"), text_of())
    rows = docs.select(F.struct(*docs.columns).alias("row"), a, b) if docs.columns else docs
    return rows.join(small_side(bad), ["key_a", "key_b"], "left_anti").select("row.*")
