"""Folds, samples, schedules and slice stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stacks as X
from ..operators import splits as S
from ..operators.provenance import table_fingerprint
from .base import (
    FOLDS, SERIES_PLANES, SPLIT_SEED, TARGETS, event_series, folds, groups, headers, label_table, members, query, r6, table, targets, turns,
)
from .contracts import check_sql


@query("SELECT id, group_id, fold FROM folds", uses="folds")
def grouped_folds(spark, sf):
    return folds(spark, sf)


@query("""
    SELECT fold, target, count(value) AS observed, count(*) FILTER (WHERE value = 1) AS positive, count(*) FILTER (WHERE value = 0) AS negative
    FROM fold_targets GROUP BY fold, target""", uses="fold_targets")
def validated_folds(spark, sf):
    return S.validate_folds(members(spark, sf), folds(spark, sf), targets(spark, sf), TARGETS, len(FOLDS))


@query("""
    WITH u AS (SELECT id, max(mask) AS usable FROM label_table WHERE fold <> 1 GROUP BY id)
    SELECT l.id, l.fold, l.target, l.value, l.source FROM label_table l JOIN u ON u.id = l.id WHERE u.usable""", uses="label_table")
def training_rows(spark, sf):
    return S.training_partition(label_table(spark, sf), 1).select("id", "fold", "target", "value", "source")


@query("""
    WITH p AS (SELECT id, max(fold) AS fold, max(mask) AS usable FROM label_table GROUP BY id)
    SELECT h.fold AS heldout_fold, count(*) FILTER (WHERE p.fold <> h.fold AND usable) AS training_ids,
           count(*) FILTER (WHERE p.fold <> h.fold AND NOT usable) AS excluded_unlabeled
    FROM p CROSS JOIN (SELECT DISTINCT fold FROM p) h GROUP BY h.fold""", uses="label_table")
def training_counts(spark, sf):
    out = S.training_counts(label_table(spark, sf))
    return out.select("heldout_fold", F.col("training_ids").cast("bigint"), F.col("excluded_unlabeled").cast("bigint"))


@query("""
    WITH r AS (SELECT g.id, g.group_id AS component, d.lang AS stratum, sha256('pilot-v1:' || g.id) AS h, l.doc_id IS NOT NULL AS bad
               FROM groups g JOIN documents d ON d.doc_id = g.id LEFT JOIN labels l ON l.doc_id = g.id),
    b AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY h, id) AS i, bool_or(bad) OVER (PARTITION BY component) AS touched FROM r),
    t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, id)::INT AS place FROM b WHERE i = 1 AND NOT touched)
    SELECT stratum, component, id, place, CASE WHEN place <= 8 THEN 'dev' ELSE 'audit' END AS role FROM t WHERE place <= 24""", uses="groups")
def hash_sample(spark, sf):
    ids = groups(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum")), "id")
    ids = ids.select("id", F.coalesce("group_id", F.lit("")).alias("component"), "stratum")  # texts that are missing stand for one
    out = S.hash_sample(ids, table(spark, sf, "labels").select(F.col("doc_id").alias("id")), 8, 16, "pilot-v1")
    return out.withColumn("component", F.nullif("component", F.lit("")))


def schedule_ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"))


_SLOTS = """
    SELECT e.epoch::INT AS epoch, doc_id AS id, p.plane::INT AS plane FROM documents CROSS JOIN range(6) e(epoch) CROSS JOIN range(3) p(plane)"""
_ANCHOR = f"""
    SELECT *, (('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2)
               || substr(h, 1, 2))::UBIGINT % 10)::INT AS "window"
    FROM (SELECT *, sha256('20260916:' || epoch || ':' || id || ':' || plane) AS h FROM ({_SLOTS}))"""
_MULTI = f"""
    SELECT epoch, id, plane, list_sort(list_append(list_slice([x.w FOR x IN list_sort([{{'h': sha256('multi-window-v1:20260916:' || epoch || ':' || id || ':' || plane || ':' || w), 'w': w::INT}}
             FOR w IN range(10) IF w <> "window"])], 1, 2), "window")) AS windows FROM ({_ANCHOR})"""


@query(f'SELECT epoch, id, plane, "window" FROM ({_ANCHOR})')
def window_schedule(spark, sf):
    return S.window_schedule(schedule_ids(spark, sf))


@query(f"SELECT epoch, id, plane, array_to_string(windows, ',') AS windows FROM ({_MULTI})")
def multi_window_schedule(spark, sf):
    return S.multi_window_schedule(schedule_ids(spark, sf)).withColumn("windows", F.array_join(F.col("windows").cast("array<string>"), ","))


@query(f"SELECT epoch, id, plane, array_to_string(range(10), ',') AS windows FROM ({_SLOTS})")
def all_window_schedule(spark, sf):
    return S.all_window_schedule(schedule_ids(spark, sf)).withColumn("windows", F.array_join(F.col("windows").cast("array<string>"), ","))


@query(check_sql(
    ("window_range", "schedule", "SELECT 0"), ("window_count", "schedule", "SELECT 0"), ("window_repeat", "schedule", "SELECT 0"),
    ("empty", "schedule", "SELECT 0"), ("null_key", "schedule", "SELECT 0"), ("blank_key", "schedule", "SELECT 0"), ("padded_key", "schedule", "SELECT 0"),
    ("duplicate_key", "schedule", "SELECT 0"), ("missing_right", "slots", "SELECT 0"), ("missing_left", "slots", "SELECT 0"),
))
def schedule_checks(spark, sf):
    ids = schedule_ids(spark, sf)
    return S.check_schedule(S.multi_window_schedule(ids), 3, ids, S.EPOCHS, 3)


@query(f"""
    SELECT count(*) AS rows, (sum(('0x' || substr(sha256(concat_ws('|', '1:' || epoch, length(id::VARCHAR) || ':' || id, '1:' || plane, '1:' || "window")), 1, 15))::BIGINT::HUGEINT)
           % 2305843009213693951)::BIGINT AS fingerprint FROM ({_ANCHOR})""")
def schedule_fingerprint(spark, sf):
    return table_fingerprint(S.window_schedule(schedule_ids(spark, sf)), ["epoch", "id", "plane", "window"])


@query(f"""
    SELECT round(avg(c), 6) AS mean_positions, min(c)::INT AS least, max(c)::INT AS most
    FROM (SELECT len(list_distinct(flatten([[w, w + 1, w + 2] FOR w IN windows]))) AS c FROM ({_MULTI}))""")
def schedule_coverage(spark, sf):
    return S.schedule_coverage(S.multi_window_schedule(schedule_ids(spark, sf))).withColumn("mean_positions", r6("mean_positions"))


def study_ids(spark, sf):
    """Event users and all customers: most customers have no series."""
    return table(spark, sf, "events").select(F.col("user_id").alias("id")).union(table(spark, sf, "customer").select("c_custkey")).distinct()


@query("""
    WITH b AS (SELECT id, plane, arg_min(series_id, {'a': 1 - fluid, 'b': 1 - fat, 's': series_id}) AS series_id FROM event_series GROUP BY id, plane)
    SELECT i.id, p.plane, b.series_id FROM (SELECT DISTINCT user_id AS id FROM events UNION SELECT c_custkey FROM customer) i
    CROSS JOIN (VALUES ('click'), ('view'), ('error')) p(plane) LEFT JOIN b ON b.id = i.id AND b.plane = p.plane""", uses="event_series")
def selected_series(spark, sf):
    return X.select_series(study_ids(spark, sf), event_series(spark, sf), SERIES_PLANES)


@query("""
    SELECT h.series, h.slice, m.method, m.reason, count(*) OVER (PARTITION BY h.series) AS n,
           CASE WHEN m.method <> 'rejected' THEN row_number() OVER (PARTITION BY h.series ORDER BY CASE m.method WHEN 'geometry' THEN -x ELSE instance END, slice) - 1 END AS pos,
           CASE WHEN m.method = 'geometry' THEN round(-x, 6) END AS position
    FROM headers h JOIN series_method m ON m.series = h.series""", uses="headers series_method")
def ordered_slices(spark, sf):
    return X.order_slices(headers(spark, sf)).withColumn("position", r6("position"))


def ordered_turns(spark, sf):
    """Conversation turns as an ordered stack."""
    from ..operators.ordering import ranked

    return ranked(turns(spark, sf), ["series"], ["slice"]).withColumn("pos", F.col("rn") - 1)


_SAMPLED = """
    SELECT series, role, chars, pos, s.sample::INT AS sample FROM turns CROSS JOIN range(12) s(sample)
    WHERE pos = round_even(CASE WHEN s.sample = 11 THEN 0.8::DOUBLE * (n - 1) ELSE 0.2::DOUBLE * (n - 1)
                           + s.sample * ((0.8::DOUBLE * (n - 1) - 0.2::DOUBLE * (n - 1)) / 11) END, 0)::BIGINT"""


@query(f"SELECT series, pos, sample FROM ({_SAMPLED})", uses="turns")
def sampled_slices(spark, sf):
    return X.even_sample(ordered_turns(spark, sf), 12, 0.2, 0.8).select("series", "pos", "sample")


@query(f"""
    SELECT series, "window", array_to_string(items, ',') AS items FROM (
      SELECT series, sample AS "window", [chars, lead(chars, 1) OVER w, lead(chars, 2) OVER w] AS items, lead(sample, 2) OVER w AS last
      FROM ({_SAMPLED}) WINDOW w AS (PARTITION BY series ORDER BY sample)) WHERE last IS NOT NULL""", uses="turns")
def neighbor_windows(spark, sf):
    samples = X.even_sample(ordered_turns(spark, sf), 12, 0.2, 0.8)
    return X.neighbor_windows(samples, "chars").withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


_FILLED = f"""
    SELECT s.series, s.sample, s.pos, g.sample AS source, g.chars, s.sample <> g.sample OR s.role <> 'user' AS repeated FROM (
      SELECT s.series, s.sample, s.pos, s.role, (SELECT arg_min(g.sample, {{'d': abs(g.pos - s.pos), 's': abs(g.sample - s.sample) * (g.pos = s.pos AND s.role = 'user')::INT, 'i': g.sample}})
             FROM sampled g WHERE g.series = s.series AND g.role = 'user') AS pick FROM sampled s) s
    JOIN sampled g ON g.series = s.series AND g.sample = s.pick"""


@query(f"WITH sampled AS ({_SAMPLED}) {_FILLED}", uses="turns")
def filled_samples(spark, sf):
    samples = X.even_sample(ordered_turns(spark, sf), 12, 0.2, 0.8).withColumn("ok", F.col("role") == "user")
    return X.fill_nearest(samples, "chars", 12)


def _audited(spark, sf):
    """Selected series of every study with its file count, order method and failure counts."""
    e = table(spark, sf, "events")
    per = e.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("value") > 200).alias("big"), F.count_if(F.col("value") < 0.5).alias("tiny")
    )
    method = X.order_methods(headers(spark, sf)).select(F.col("series").alias("id"), "method")
    rows = X.select_series(study_ids(spark, sf), event_series(spark, sf), SERIES_PLANES).join(per, "id", "left").join(method, "id", "left")
    has = F.col("series_id").isNotNull()
    zero = F.lit(0).cast("bigint")
    rows = rows.select(
        "id", "plane", "series_id", F.when(has & (F.col("plane") == "view") & (F.col("tiny") > 1), zero).when(has, F.col("files")).otherwise(zero).alias("n_files"),
        F.when(has, F.col("method")).otherwise("").alias("method"), F.when(F.col("plane") == "error", F.coalesce("tiny", zero)).otherwise(F.lit(1).cast("bigint")).alias("good"),
        F.coalesce("big", zero).alias("header_failures"), zero.alias("decode_failures"), zero.alias("repeated_failed_samples"), F.coalesce("tiny", zero).alias("spacing_fallbacks"),
    )
    return X.series_status(rows)


_AUDITED = """
    WITH per AS (SELECT user_id AS id, count(*) AS files, count(*) FILTER (WHERE value > 200) AS big, count(*) FILTER (WHERE value < 0.5) AS tiny FROM events GROUP BY user_id),
    base AS (SELECT i.id, p.plane, per.id IS NOT NULL AS has, files, COALESCE(big, 0) AS big, COALESCE(tiny, 0) AS tiny, m.method
             FROM (SELECT DISTINCT user_id AS id FROM events UNION SELECT c_custkey FROM customer) i CROSS JOIN (VALUES ('click'), ('view'), ('error')) p(plane)
             LEFT JOIN per ON per.id = i.id LEFT JOIN series_method m ON m.series = i.id),
    audited AS (SELECT *, CASE WHEN NOT has THEN 'no_matching_series' WHEN plane = 'view' AND tiny > 1 THEN 'no_dicom_files' WHEN method = 'rejected' THEN 'unorderable_series'
                     WHEN plane = 'error' AND tiny = 0 THEN 'all_sampled_slices_failed' WHEN big + tiny > 0 OR method <> 'geometry' THEN 'usable_with_fallback' ELSE 'usable' END AS status
                FROM base)"""


@query(_AUDITED + " SELECT id, plane, status FROM audited", uses="series_method")
def series_status(spark, sf):
    return _audited(spark, sf).select("id", "plane", "status")


@query(_AUDITED + """
    SELECT id, count(*) FILTER (WHERE status LIKE 'usable%')::INT AS usable_planes,
           COALESCE(string_agg(plane, '|' ORDER BY CASE plane WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) FILTER (WHERE status NOT LIKE 'usable%'), '') AS missing_planes,
           sum(big)::BIGINT AS header_failures, 0::BIGINT AS decode_failures, 0::BIGINT AS repeated_failed_samples, sum(tiny)::BIGINT AS spacing_fallbacks,
           count(*) FILTER (WHERE has AND method = 'InstanceNumber') AS instance_number_planes FROM audited GROUP BY id""", uses="series_method")
def study_quality(spark, sf):
    return X.study_quality(_audited(spark, sf), SERIES_PLANES)


_SPREAD = """list_avg(list_transform([0, 1, 2], lambda c: list_aggregate(list_transform([0, 1, 2],
                 lambda g: (r.have[g * 3 + c + 1] + CASE WHEN g = f THEN o.v[c + 1] ELSE 0 END) / total[c + 1]), 'stddev_pop')))"""


@query(f"""
    WITH RECURSIVE c AS (SELECT group_id, [count(*) FILTER (WHERE stratum = -1), count(*) FILTER (WHERE stratum = 0), count(*) FILTER (WHERE stratum = 1)] AS v FROM strata GROUP BY group_id),
    o AS (SELECT group_id, v, row_number() OVER (ORDER BY list_sum(v) * list_sum(v) - 3 * list_sum(list_transform(v, lambda x: x * x)), v, sha256('42:' || group_id)) AS rn FROM c),
    w AS (SELECT [greatest(sum(v[1]), 1)::DOUBLE, greatest(sum(v[2]), 1)::DOUBLE, greatest(sum(v[3]), 1)::DOUBLE] AS total FROM c),
    run(rn, group_id, fold, have) AS (
      SELECT 0::BIGINT, '', -1, [0, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]
      UNION ALL
      SELECT rn, group_id, best, list_transform(range(0, 9), lambda i: have[i + 1] + CASE WHEN i // 3 = best THEN v[i % 3 + 1] ELSE 0 END) FROM (
        SELECT o.rn, o.group_id, o.v, r.have, list_sort(list_transform([0, 1, 2], lambda f: struct_pack(s := round({_SPREAD}, 12), n := r.have[f * 3 + 1] + r.have[f * 3 + 2] + r.have[f * 3 + 3], f := f)))[1].f AS best
          FROM run r JOIN o ON o.rn = r.rn + 1 CROSS JOIN w))
    SELECT s.id, s.group_id, run.fold::INT AS fold FROM strata s JOIN run ON run.group_id = s.group_id WHERE run.rn > 0""", uses="strata")
def greedy_folds(spark, sf):
    strata = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("value"))
    return S.greedy_stratified_folds(groups(spark, sf), strata, len(FOLDS), SPLIT_SEED)
