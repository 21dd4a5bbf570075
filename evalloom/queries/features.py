"""Counts, slots, pooling, scaling, encoders and linear heads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import CHANNEL_MEAN, CHANNEL_STD, normalize_channel, quantize_u8
from ..operators import features as G
from ..operators import heads as H
from ..operators.evaluate import auc, fold_summary, reference_predictors
from ..operators.labels import supervision
from ..session import reuse
from .base import FOLDS, TARGETS, fold_targets, label_table, query, r6, table, window_vectors
from .profiles import LINES


@query("""
    SELECT o.o_orderkey AS id, count(l.l_orderkey)::DOUBLE AS total, count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS "l_returnflag_A",
           count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS "l_returnflag_N", count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS "l_returnflag_R",
           count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS "l_linestatus_F", count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS "l_linestatus_O"
    FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def count_features(spark, sf):
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", "l_linestatus")
    return G.count_features(parents, children, LINES)


def listed(x: str) -> F.Column:
    """Arrays as text of rounded values, so both sides compare exactly."""
    return F.array_join(F.transform(x, lambda v: F.format_string("%.4f", F.round(v.cast("double"), 4) + F.lit(0.0))), ",")


def listed_sql(x: str) -> str:
    return f"array_to_string([printf('%.4f', round(v::DOUBLE, 4) + 0.0) FOR v IN {x}], ',')"


@query(f"""
    WITH c AS (SELECT id, plane, i.pos, avg(vec[i.pos]::DOUBLE) AS m FROM window_vectors CROSS JOIN range(1, 65) i(pos) GROUP BY id, plane, i.pos),
    p AS (SELECT id, plane, list(m ORDER BY pos) AS v FROM c GROUP BY id, plane), i AS (SELECT DISTINCT vec_id // 20 AS id FROM embeddings),
    s AS (SELECT i.id, max(CASE WHEN plane = 'Sagittal' THEN v END) AS s, max(CASE WHEN plane = 'Coronal' THEN v END) AS c, max(CASE WHEN plane = 'Axial' THEN v END) AS a
          FROM i LEFT JOIN p ON p.id = i.id GROUP BY i.id),
    x AS (SELECT id, list_concat(COALESCE(s::DOUBLE[], [0.0::DOUBLE FOR k IN range(64)]), COALESCE(c::DOUBLE[], [0.0::DOUBLE FOR k IN range(64)]),
                 COALESCE(a::DOUBLE[], [0.0::DOUBLE FOR k IN range(64)]), [(s IS NOT NULL)::INT::DOUBLE, (c IS NOT NULL)::INT::DOUBLE, (a IS NOT NULL)::INT::DOUBLE]) AS x FROM s)
    SELECT id, {listed_sql('x')} AS x FROM x""", uses="window_vectors")
def assembled_slots(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("id")).distinct()
    return G.assemble_slots(ids, G.mean_pool_windows(window_vectors(spark, sf)), 64).select("id", listed("x").alias("x"))


@query(f"""
    WITH c AS (SELECT id, plane, i.pos, avg(vec[i.pos]::DOUBLE) AS m FROM window_vectors CROSS JOIN range(1, 65) i(pos) GROUP BY id, plane, i.pos)
    SELECT id, plane, {listed_sql('list(m ORDER BY pos)')} AS vec FROM c GROUP BY id, plane""", uses="window_vectors")
def pooled_windows(spark, sf):
    return G.mean_pool_windows(window_vectors(spark, sf)).select("id", "plane", listed("vec").alias("vec"))


_CHANNELS = ["l_discount", "l_tax", "l_quantity / 50"]


@query(f"""
    SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - {m}::DOUBLE) / {d}::DOUBLE, 6) AS normalized_{i}' for i, (c, m, d) in enumerate(zip(_CHANNELS, CHANNEL_MEAN, CHANNEL_STD)))},
           round_even(255 * greatest(0, least(1, l_tax * 13 - 0.1)), 0)::SMALLINT AS quantized FROM lineitem""")
def normalized_channels(spark, sf):
    channels = [r6(normalize_channel(F.expr(c), m, d)).alias(f"normalized_{i}") for i, (c, m, d) in enumerate(zip(_CHANNELS, CHANNEL_MEAN, CHANNEL_STD))]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *channels, quantize_u8(F.col("l_tax") * 13 - 0.1).alias("quantized"))


@query("""
    WITH p AS (SELECT e.vec_id AS image, i.pos AS pixel, e.embedding[i.pos]::DOUBLE AS v FROM embeddings e CROSS JOIN range(1, 65) i(pos)),
    n AS (SELECT image, pixel, min(v) OVER (PARTITION BY image) + max(v) OVER (PARTITION BY image) - v AS v FROM p),
    q AS (SELECT image, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM n GROUP BY image)
    SELECT n.image, n.pixel::INT AS pixel, round(CASE WHEN hi <= lo THEN 0 ELSE greatest(0, least(1, (v - lo) / (hi - lo))) END, 6) AS scaled FROM n JOIN q ON q.image = n.image""")
def clipped_images(spark, sf):
    pixels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("pixel", "value"))
    pixels = pixels.select("image", (F.col("pixel") + 1).alias("pixel"), F.col("value").cast("double").alias("value"))
    return G.clip_scale(pixels, invert=True).withColumn("scaled", r6("scaled"))


def projection(width: int = 8, dim: int = 64) -> np.ndarray:
    return np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(dim)] for i in range(width)])


_PROJECTED = "[list_sum([vec[j + 1]::DOUBLE * (((i * 7 + j * 3) % 11 - 5) / 10) FOR j IN range(64)]) FOR i IN range(8)]"


@query("""
    SELECT id, plane, "window", k.i::INT AS i, round(list_sum([vec[j + 1]::DOUBLE * (((k.i * 7 + j * 3) % 11 - 5) / 10) FOR j IN range(64)]), 3) + 0.0 AS x
    FROM window_vectors CROSS JOIN range(8) k(i)""", uses="window_vectors")
def encoded_windows(spark, sf):
    weights = projection()

    def encoder(block: np.ndarray) -> np.ndarray:
        return block.astype(float) @ weights.T

    out = G.encode_batches(window_vectors(spark, sf), encoder, 8, col="vec")
    return out.select("id", "plane", "window", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 3) + F.lit(0.0))


@query()
def pixel_hashes(spark, sf):
    return window_vectors(spark, sf).select("id", "plane", "window", G.pixel_hash(F.col("vec")).alias("sha256"))


def attention_params() -> dict[str, np.ndarray]:
    """A fixed head: 8 hidden units, 30 slots, two targets."""
    def grid(rows: int, cols: int, a: int, b: int) -> np.ndarray:
        return np.array([[((i * a + j * b) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)])

    return {
        "proj": projection(), "proj_bias": np.zeros(8), "slot": grid(30, 8, 2, 5), "query": grid(2, 8, 3, 4), "out": grid(2, 8, 5, 2), "out_bias": np.array([0.1, -0.2]),
    }


@query("""
    WITH h AS (SELECT id, (CASE plane WHEN 'Sagittal' THEN 0 WHEN 'Coronal' THEN 1 ELSE 2 END) * 10 + "window" AS slot, vec FROM window_vectors),
    u AS (SELECT id, slot, [list_sum([vec[j + 1]::DOUBLE * (((i * 7 + j * 3) % 11 - 5) / 10) FOR j IN range(64)]) + ((slot * 2 + i * 5) % 11 - 5) / 10 FOR i IN range(8)] AS hidden FROM h),
    s AS (SELECT u.id, t.target, list_sum([hidden[i + 1] * ((t.target * 3 + i * 4) % 11 - 5) / 10 FOR i IN range(8)]) / sqrt(8::DOUBLE) AS score,
                 list_sum([hidden[i + 1] * ((t.target * 5 + i * 2) % 11 - 5) / 10 FOR i IN range(8)]) AS part FROM u CROSS JOIN range(2) t(target))
    SELECT id, target::INT AS target, round(sum(exp(score) * part) / sum(exp(score)) + CASE target WHEN 0 THEN 0.1 ELSE -0.2 END, 6) AS logit FROM s GROUP BY id, target""", uses="window_vectors")
def attention_scores(spark, sf):
    place = F.when(F.col("plane") == "Sagittal", 0).when(F.col("plane") == "Coronal", 1).otherwise(2)
    vectors = window_vectors(spark, sf).withColumn("plane", place)
    return G.attention_pool(vectors, attention_params(), ids=vectors.select("id").distinct()).withColumn("logit", r6("logit"))


# --- Heads ----------------------------------------------------------------------------

def document_features(spark, sf):
    """Narrow features of a document: size, line count, share of letters, language flags. No text counts as an empty one, whose share of letters is 0."""
    d = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    size = F.coalesce("n_chars", F.length("text"))
    cells = [size / 1000.0, lines.cast("double"), F.length(F.regexp_replace("text", "[^a-z]", "")) / F.greatest(size, F.lit(1))]
    cells += [(F.col("lang") == x).cast("double") for x in ("en", "es", "fr")]
    return d.select(F.col("doc_id").alias("id"), F.array(*cells).alias("x"))


_X = """[n_chars / 1000.0::DOUBLE, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE, length(regexp_replace(text, '[^a-z]', '', 'g')) / n_chars::DOUBLE,
         (lang = 'en')::INT::DOUBLE, (lang = 'es')::INT::DOUBLE, (lang = 'fr')::INT::DOUBLE]"""


@query(f"""
    WITH x AS (SELECT doc_id AS id, {_X} AS x FROM documents), u AS (SELECT DISTINCT id FROM label_table WHERE mask)
    SELECT k.i::INT AS i, round(avg(x[k.i + 1]), 5) AS mean, round(CASE WHEN stddev_pop(x[k.i + 1]) = 0 THEN 1 ELSE stddev_pop(x[k.i + 1]) END, 5) AS scale, count(*) AS rows
    FROM x JOIN u ON u.id = x.id CROSS JOIN range(6) k(i) GROUP BY k.i""", uses="label_table")
def feature_scaler(spark, sf):
    n, mean, scale, _ = H.fit_scaler(document_features(spark, sf), supervision(label_table(spark, sf), 0.25))
    rows = [(i, float(round(m, 5)), float(round(s, 5)), n) for i, (m, s) in enumerate(zip(mean, scale))]
    return spark.createDataFrame(rows, "i int, mean double, scale double, rows bigint")


@query()
def fitted_heads(spark, sf):
    heads = H.fit_heads(reuse(document_features(spark, sf)), supervision(reuse(label_table(spark, sf)), 0.25), TARGETS, recipe="silver_0.25")
    return H.model_table(spark, heads).select("recipe", "target", r6("intercept").alias("intercept"), "coef", "observed", "derived")


@query()
def reduced_heads(spark, sf):
    heads = H.fit_heads(reuse(document_features(spark, sf)), supervision(reuse(label_table(spark, sf)), 0.0), TARGETS, pca=3)
    return H.model_table(spark, heads).select("recipe", "target", r6("intercept").alias("intercept"), "coef", "explained")


FIXED_HEADS = [
    H.Head("fixed", -1, "quality", 0.2, [0.5, -0.3, 0.8, 0.1, -0.1, 0.2], [2.0, 10.0, 0.7, 0.5, 0.1, 0.1], [1.5, 8.0, 0.1, 0.5, 0.3, 0.3], 0, 0, []),
    H.Head("fixed", -1, "toxic", -1.0, [-0.4, 0.2, 0.3, -0.2, 0.4, 0.1], [2.0, 10.0, 0.7, 0.5, 0.1, 0.1], [1.5, 8.0, 0.1, 0.5, 0.3, 0.3], 0, 0, []),
]


def _fixed_sql(x: str, head: H.Head) -> str:
    terms = " + ".join(f"({x}[{i + 1}] - {m}::DOUBLE) / {s}::DOUBLE * {c}::DOUBLE" for i, (c, m, s) in enumerate(zip(head.coef, head.mean, head.scale)))
    return f"1 / (1 + exp(-(greatest(-700::DOUBLE, least(700::DOUBLE, {head.intercept}::DOUBLE + {terms})))))"


@query(" UNION ALL ".join(f"SELECT doc_id AS id, 'fixed' AS recipe, '{h.target}' AS target, round({_fixed_sql(_X, h)}, 6) AS p FROM documents" for h in FIXED_HEADS))
def scored_documents(spark, sf):
    return H.predict_heads(document_features(spark, sf), FIXED_HEADS).withColumn("p", r6("p"))


COUNT_HEAD = H.Head("fixed", -1, "late", -0.5, [0.3, 0.2, -0.1, 0.4, 0.1, -0.3], [4.0, 1.3, 1.3, 1.3, 2.0, 2.0], [2.0, 1.1, 1.1, 1.1, 1.4, 1.4], 0, 0, [])
_COUNTS = """[total, "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_linestatus_F", "l_linestatus_O"]"""


@query(f"""
    WITH c AS (SELECT o.o_orderkey AS id, count(l.l_orderkey)::DOUBLE AS total, count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS "l_returnflag_A",
                      count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS "l_returnflag_N", count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS "l_returnflag_R",
                      count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS "l_linestatus_F", count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS "l_linestatus_O"
               FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)
    SELECT id, 'fixed' AS recipe, 'late' AS target, round({_fixed_sql(_COUNTS, COUNT_HEAD)}, 6) AS p FROM c""")
def scored_new_ids(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", "l_linestatus")
    return H.score_new_ids(ids, children, [COUNT_HEAD], LINES).withColumn("p", r6("p"))


def vector_head() -> H.Head:
    """A fixed line over three pooled planes and their presence flags."""
    d = 3 * 64 + 3
    return H.Head("fixed", -1, "t", 0.25, [((i * 7) % 11 - 5) / 20 for i in range(d)], [(i % 3) / 10 for i in range(d)], [1 + (i % 4) / 2 for i in range(d)], 0, 0, [])


@query("""
    WITH c AS (SELECT id, plane, i.pos, avg(vec[i.pos]::DOUBLE) AS m FROM window_vectors CROSS JOIN range(1, 65) i(pos) GROUP BY id, plane, i.pos),
    s AS (SELECT id, (CASE plane WHEN 'Sagittal' THEN 0 WHEN 'Coronal' THEN 1 ELSE 2 END) * 64 + pos - 1 AS k, m FROM c),
    f AS (SELECT DISTINCT id, 192 + CASE plane WHEN 'Sagittal' THEN 0 WHEN 'Coronal' THEN 1 ELSE 2 END AS k, 1.0::DOUBLE AS m FROM window_vectors),
    x AS (SELECT i.id, k.k, coalesce(v.m, 0) AS m FROM (SELECT DISTINCT id FROM window_vectors) i CROSS JOIN range(195) k(k)
            LEFT JOIN (SELECT * FROM s UNION ALL SELECT * FROM f) v ON v.id = i.id AND v.k = k.k),
    z AS (SELECT id, 0.25::DOUBLE + sum((m - (k % 3) / 10::DOUBLE) / (1 + (k % 4) / 2::DOUBLE) * (((k * 7) % 11 - 5) / 20::DOUBLE)) AS logit FROM x GROUP BY id)
    SELECT row_number() OVER (ORDER BY id) - 1 AS row_idx, id, 'fixed' AS recipe, 't' AS target, round(1 / (1 + exp(-logit)), 6) AS p FROM z""", uses="window_vectors")
def scored_new_vectors(spark, sf):
    """New ids scored from their window vectors alone: pooled, assembled, held against the head, in id order."""
    vectors = window_vectors(spark, sf)
    return H.score_new_vectors(vectors.select("id").distinct(), vectors, [vector_head()], 64).withColumn("p", r6("p"))


@query()
def cross_validated(spark, sf):
    oof, _ = H.cross_validate(reuse(document_features(spark, sf)), reuse(label_table(spark, sf)), FOLDS, TARGETS)
    return oof.withColumn("p", r6("p"))


@query()
def recipe_comparison(spark, sf):
    recipes = {"observed_only": 0.0, "silver_0.25": 0.25}
    oof, _ = H.cross_validate(reuse(document_features(spark, sf)), reuse(label_table(spark, sf)), FOLDS, TARGETS, recipes)
    summary = reuse(fold_summary(auc(reuse(oof), ["model", "fold", "target"])))
    chosen = H.select_recipe(summary, list(recipes))
    return summary.select("model", r6("mean_macro_auc").alias("mean_macro_auc"), r6("std_macro_auc").alias("std_macro_auc"), (F.col("model") == chosen).alias("chosen"))


@query("""
    WITH o AS (SELECT fold, target, sum(value) AS s, count(value) AS n FROM fold_targets GROUP BY fold, target),
    w AS (SELECT fold, target, (sum(s) OVER (PARTITION BY target) - s) / (sum(n) OVER (PARTITION BY target) - n)::DOUBLE AS p FROM o)
    SELECT m.model, t.fold, t.id, t.target, t.value AS y, round(CASE m.model WHEN 'constant' THEN 0.5 ELSE w.p END, 6) AS p
    FROM fold_targets t JOIN w ON w.fold = t.fold AND w.target = t.target CROSS JOIN (VALUES ('constant'), ('prevalence')) m(model) WHERE t.value IS NOT NULL""", uses="fold_targets")
def reference_predictions(spark, sf):
    return reference_predictors(fold_targets(spark, sf).withColumnRenamed("value", "y")).withColumn("p", r6("p"))
