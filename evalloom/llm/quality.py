"""Quality rules with risk-controlled cutoffs, by DataFrame functions alone.

Each text is measured in one pass without a shuffle. A rule rejects texts whose measure lies above a cutoff;
cutoffs are chosen for each stratum on labelled documents. A stratum walks one path of settings, each with a cutoff for every
rule (or none), from loose to strict. The path is laid by an eighth of its good labelled documents (by a hash of the doc_id): first the
strictest cutoffs that reject none of them, loosened by six notches, then five, down to none, then cutoffs that reject a
quarter, a half and all of the permitted share. The other seven eighths are the holdout: a setting with k of n good ones rejected by any rule is safe when a
binomial with rate ``alpha`` gives k or fewer with a probability of at most ``delta`` over the number of strata. That is the exact
binomial bound on all rules together; settings are tested in the order of the path up to the first that is not safe, so they
need no further correction (fixed-sequence testing), and strata are corrected by Bonferroni. The last safe setting holds; without one no rule
rejects there. So at most ``alpha`` of a stratum's good documents are rejected, with confidence 1 - delta over all strata at once.
``risk_table`` tells for each stratum whether its labels sufficed.

Only counts for each stratum and cutoff are gathered, by map-side aggregates; their number does not depend on the rows.

Repeated windows: each 8-word window of a text gets a hash; only where hashes repeat in the text are the positions
sorted by hash, and the windows there compared word by word, so the count is exact.

Defined results: null and empty texts have no words, and fail; texts of any length are measured whole; equal measures are on one side of a cutoff; a null stratum counts as the stratum ``""``; a document with several
labels is good if one says so; null labels are left out; repeated rows are each measured; without labels no rule rejects beyond the base; an empty table
gives an empty table; other columns, whatever their names, stay inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_side, text_of

SPACE, WINDOW = r"[\x20\x09-\x0D]+", 8
#: A measure for each rule, and the cutoffs that are tested, strictest first.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.05, 0.1, 0.15, 0.2, 0.25]),
    "long_words": ("word_chars / greatest(n_words, 1)", [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
    "short_words": ("-word_chars / greatest(n_words, 1)", [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5]),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _neighbours(items: Column, same) -> Column:
    """The items of a sorted array that are the ``same`` as the one before or after."""
    return F.filter(items, lambda x, k: same(x, F.get(items, k - 1)) | same(x, F.get(items, k + 1)))


def measured(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """``row`` (all columns of ``docs``), ``stratum`` and the measures of the text."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col in docs.columns else F.lit("")
    rows = docs.select(F.struct(*docs.columns).alias("row"), stratum.alias("stratum"), text_of().alias("t"))
    rows = rows.select("row", "stratum", "t", F.array_remove(F.split("t", SPACE), "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n, width = F.size("words"), F.lit(WINDOW)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, width))))
    rows = rows.withColumn("windows", windows)
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("at", F.when(repeated, F.expr("sort_array(transform(windows, (h, i) -> (h & -shiftleft(1L, length(bin(size(windows))))) | i))")))
    bits = F.expr("length(bin(size(windows)))")
    rows = rows.withColumn("bits", bits)
    close = _neighbours(F.col("at"), lambda x, y: F.call_function("shiftright", x, F.col("bits")) == F.call_function("shiftright", y, F.col("bits")))
    rows = rows.withColumn("at", F.when(F.col("at").isNotNull(), close))
    texts = F.transform("at", lambda x: (lambda i: F.struct(F.array_join(F.slice("words", i + 1, width), " ").alias("w"), i.alias("i")))((x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)).cast("int")))
    rows = rows.withColumn("at", F.when(F.col("at").isNotNull(), F.sort_array(texts)))
    rows = rows.withColumn("at", F.when(F.col("at").isNotNull(), F.sort_array(F.transform(_neighbours(F.col("at"), lambda x, y: x["w"] == y["w"]), lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("at", lambda x, k: F.least(width, F.coalesce(F.get("at", k + 1) - x, width))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return rows.select(
        "row", "stratum",
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), by the ratio of successive terms in logarithms."""
    odds = F.log(F.lit(rate / (1 - rate)))
    zero = F.struct((n * F.log(F.lit(1 - rate))).alias("t"), F.exp(n * F.log(F.lit(1 - rate))).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, zero, add, lambda acc: acc["s"])


#: Settings of the path, loose to strict: share of ``alpha`` that may go among the documents that lay it, and notches by which cutoffs are loosened.
PATH: list[tuple[float, int]] = [*[(0.0, notch) for notch in range(6, -1, -1)], (0.25, 0), (0.5, 0), (1.0, 0)]


def _good(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures of good documents beyond the base rules; ``lays`` marks the eighth that lays the path."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1")
    known = marked.select(F.col("row.doc_id").alias("doc_id"), "stratum", *MEASURES).filter(~base_failed()).join(good.select("doc_id"), "doc_id", "left_semi")
    return known.withColumn("lays", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1"))


def paths(good: DataFrame, alpha: float) -> DataFrame:
    """``(stratum, step, cut_<rule>...)``: the settings of each stratum's path, a null cutoff where a rule is off."""
    def counts(rule: str) -> Column:
        measure, cuts = RULES[rule]
        return F.array(*[F.count_if(F.col("lays") & (F.expr(measure) > c)) for c in cuts]).alias(f"k_{rule}")

    counted = good.groupBy("stratum").agg(F.count_if("lays").alias("n"), *[counts(r) for r in RULES]).filter("n > 0")
    steps = F.array(*[F.struct(F.lit(t).alias("step"), F.lit(share * alpha).alias("share"), F.lit(notch).alias("notch")) for t, (share, notch) in enumerate(PATH)])

    def cut(rule: str) -> Column:
        first = F.array_position(F.transform(f"k_{rule}", lambda k: k <= F.col("share") * F.col("n")), True)  # from 1; 0 without any
        return F.when(first > 0, F.get(F.array(*[F.lit(float(c)) for c in RULES[rule][1]]), (first - 1 + F.col("notch")).cast("int"))).alias(f"cut_{rule}")

    return counted.select("*", F.inline(steps)).select("stratum", "step", *[cut(r) for r in RULES])


def risk_table(marked: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """``(stratum, step, n, k, tail, safe, chosen, cut_<rule>...)``: every setting on the holdout; ``chosen`` marks the one that holds.

    A stratum whose first setting is not safe has too few labels, or its rules reject good documents wherever they act.
    """
    good = saved(_good(marked, labels))
    rejected = F.lit(False)
    for rule, (measure, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(measure) > F.col(f"cut_{rule}"), F.lit(False))
    settings = saved(paths(good, alpha))
    held = good.filter("NOT lays").join(small_side(settings), "stratum")  # ten settings for each document
    counted = held.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if(rejected).alias("k"))
    strata = marked.select("stratum").distinct().agg(F.count(F.lit(1)).alias("strata"))
    rows = settings.join(counted, ["stratum", "step"]).join(F.broadcast(strata))  # one row
    tail = F.when(F.col("k") < F.col("n") * alpha, _tail(F.col("k"), F.col("n"), alpha)).otherwise(1.0)
    rows = rows.withColumn("tail", tail).withColumn("safe", F.col("tail") <= delta / F.col("strata"))
    stop = rows.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("safe"), F.col("step"))), F.lit(len(PATH))).alias("stop"))
    rows = rows.join(stop, "stratum").withColumn("chosen", F.col("step") == F.col("stop") - 1)
    return rows.select("stratum", "step", "n", "k", "tail", "safe", "chosen", *[f"cut_{r}" for r in RULES])


def cutoffs(marked: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """``(stratum, rule, cutoff)`` of the setting that holds in each stratum, without rules that are off.

    ``marked`` comes from ``measured``; ``labels`` has doc_id and quality, 1 for good documents.
    """
    held = risk_table(marked, labels, alpha, delta).filter("chosen")
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"cut_{r}").alias("cutoff")) for r in RULES])
    return held.select("stratum", F.inline(each)).filter("cutoff IS NOT NULL")


def judged(marked: DataFrame, chosen: DataFrame) -> DataFrame:
    """``marked`` with ``base_failed``, ``reasons`` (rules that reject the text) and ``kept``."""
    wide = chosen.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    rows = marked.join(small_side(saved(wide)), "stratum", "left")  # so that texts don't meet by stratum
    reasons = F.array_compact(F.array(*[F.when(F.expr(m) > F.col(f"cut_{r}"), F.lit(r)) for r, (m, _) in RULES.items()]))
    failed = base_failed()
    return rows.select(*marked.columns, failed.alias("base_failed"), reasons.alias("reasons"), (~failed & (F.size(reasons) == 0)).alias("kept"))


def quality_verdicts(marked: DataFrame, labels: DataFrame, **risk: float) -> DataFrame:
    """``judged`` with cutoffs from the labels of these documents."""
    return judged(marked, cutoffs(marked, labels, **risk))
