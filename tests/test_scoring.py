"""Scores, resampling, heads, blends and composite jobs on small hand-computed inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import blend as B
from evalloom.operators import evaluate as E
from evalloom.operators import heads as H
from evalloom.operators import joint
from evalloom.operators import labels as W
from evalloom.operators import resample as R
from evalloom.operators import stacked
from evalloom.operators.checks import ContractError, enforce
from evalloom.plans import jobs as J
from evalloom.session import scratch_dir


def brute_auc(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = [(a, b) for a, t, b in zip(p, y, w) if t == 1], [(a, b) for a, t, b in zip(p, y, w) if t == 0]
    wins = sum(wa * wb * (1.0 if a > b else 0.5 if a == b else 0.0) for a, wa in pos for b, wb in neg)
    return wins / (sum(b for _, b in pos) * sum(b for _, b in neg))


def test_auc_by_hand_and_strict_macro(spark):
    """Positives .9 and .3 against negatives .4, .2 and .3: 3 + 1 + a half of 6 pairs."""
    cells = list(zip([1, 0, 1, 0, 0], [.9, .4, .3, .2, .3]))
    rows = [("m", 2, t, i, y, p if t == "scored" else .25) for t in ("scored", "level") for i, (y, p) in enumerate(cells)]
    df = spark.createDataFrame(rows, "model string, fold int, target string, id long, y int, p double")
    scores = E.auc(df, ["model", "fold", "target"])
    assert {r["target"]: r["auc"] for r in scores.collect()} == {"scored": .75, "level": .5}
    assert E.fold_macro(scores).first()["macro_auc"] == .625
    single = E.auc(df.withColumn("y", F.when(F.col("target") == "level", 0).otherwise(F.col("y"))), ["model", "fold", "target"])
    assert {r["target"]: r["auc"] for r in single.collect()} == {"scored": .75, "level": None}
    for summary in (E.fold_summary, E.target_means):
        with pytest.raises(Exception, match="both classes"):
            summary(single).collect()
    with pytest.raises(Exception, match="outside the fold for target level"):
        E.prevalence_reference(df.filter("target = 'level'")).collect()


@pytest.mark.parametrize("sizing", [{}, {"min_rows": 1, "buckets": 16}])
def test_auc_ties_weights_and_null_truth(spark, sizing):
    rng = np.random.default_rng(5)
    y, p, w = rng.integers(0, 2, 400), rng.integers(0, 30, 400) / 30, rng.integers(0, 4, 400)
    rows = [("g", int(a), float(b), int(c)) for a, b, c in zip(y, p, w)] + [("g", None, .5, 3)]
    df = spark.createDataFrame(rows, "g string, y int, p double, w int")
    assert E.auc(df, ["g"], **sizing).first()["auc"] == pytest.approx(brute_auc(y, p))
    assert E.auc(df.filter("w > 0"), ["g"], weight="w", **sizing).first()["auc"] == pytest.approx(brute_auc(y, p, w))


def oof_case(spark):
    rows = []
    for i in range(12):
        y, fold = i % 2, i // 6
        for m, p in {"a": .8 * y + .1, "b": .8 * y + .1, "c": .8 * y + .1, "d": 1 - (.8 * y + .1)}.items():
            for t in ("t0", "t1"):
                rows.append((m, fold, f"s{i:02d}", t, y, p))
    rows = spark.createDataFrame(rows, "model string, fold int, id string, target string, y int, p double")
    folds = rows.select("id", F.col("id").alias("group_id"), "fold").distinct()
    return rows, folds


def test_paired_analysis(spark):
    rows, folds = oof_case(spark)
    report, errors = J.paired_oof_analysis(rows, folds, [("a", "d"), ("a", "b")], 2, 2, 25, 7)
    got = {(r["section"], r["metric"], r["key"]): r["value"] for r in report.collect()}
    assert got["summary", "mean_macro_auc", "a"] == 1 and got["summary", "mean_macro_auc", "d"] == 0
    assert got["intervals", "low", "a_minus_d|macro"] == got["intervals", "high", "a_minus_d|macro"] == 1
    assert got["intervals", "low", "a_minus_b|t0"] == 0 and 0 < got["intervals", "accepted", "a_minus_d|macro"] <= 25
    assert errors.filter("model = 'a' and target = 't0'").orderBy("place").first()["id"] == "s00"
    shifted = rows.withColumn("p", F.when(F.col("fold") == 1, F.col("p") / 100).otherwise(F.col("p")))
    assert E.fold_summary(E.auc(shifted, ["model", "fold", "target"])).filter("model = 'a'").first()["mean_macro_auc"] == 1
    for bad in (folds.withColumn("group_id", F.lit("g")), folds.withColumn("group_id", F.when(F.col("id").isin("s00", "s01"), "g").otherwise(F.col("id")))):
        with pytest.raises(ContractError):
            J.paired_oof_analysis(rows, bad, [("a", "d")], 2, 2, 5, 7)


def plain_times(ids, replicates, seed, fold):
    import hashlib

    ids = sorted(ids)
    out = {i: [0] * replicates for i in ids}
    for r in range(replicates):
        for j in range(len(ids)):
            word = int(hashlib.sha256(f"{seed}:{r}:{fold}:{j}".encode()).hexdigest()[:15], 16)
            out[ids[word % len(ids)]][r] += 1
    return out


def test_draws_are_exact_and_independent_of_partitions(spark):
    rows, _ = oof_case(spark)
    want = {}
    for fold in (0, 1):
        want |= {(fold, i): t for i, t in plain_times([f"s{i:02d}" for i in range(fold * 6, fold * 6 + 6)], 10, 3, fold).items()}
    for df, sizing in ((rows, {}), (rows.repartition(13), {"min_rows": 1, "buckets": 16})):
        assert {(r["fold"], r["id"]): r["times"] for r in R.draw_counts(df.select("fold", "id").distinct(), 10, 3, **sizing).collect()} == want


def test_poisson_counts(spark):
    units = spark.range(2000).select((F.col("id") % 2).cast("int").alias("fold"), "id")
    a = {r["id"]: r["times"] for r in R.draw_counts(units, 50, 9, exact=False).collect()}
    assert a == {r["id"]: r["times"] for r in R.draw_counts(units.repartition(7), 50, 9, exact=False).collect()}
    t = np.array(list(a.values()))
    assert t.shape == (2000, 50) and abs(t.mean() - 1) < 0.02 and abs(t.var() - 1) < 0.05 and abs((t == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(t[:, 0], t[:, 1])[0, 1]) < 0.08 and R.draw_counts(units.limit(0), 3, 1).count() == 0


def test_units_alike_share_poisson_counts(spark):
    """One row for each distinct unit; the spread of the differences is that of single counts."""
    rng = np.random.default_rng(6)
    cells = []
    for i in range(300):
        y = int(rng.integers(0, 2))
        cells += [(m, i % 2, i, "t", y, round(float(rng.integers(0, 4) + k * y), 1)) for k, m in enumerate(("a", "b"))]
    rows = spark.createDataFrame(cells, "model string, fold int, id long, target string, y int, p double")
    grouped = R._grouped_units(rows)
    assert grouped.select("id").distinct().count() < 150 and grouped.select("fold", "id", "size").distinct().agg(F.sum("size")).first()[0] == 300
    spread = [R.paired_bootstrap(rows, [("b", "a")], 2, 1, 400, 5, exact=e).filter("target = 'macro'").agg(F.avg("difference"), F.stddev("difference")).first() for e in (True, False)]
    assert spread[0][0] == pytest.approx(spread[1][0], abs=0.01) and spread[0][1] == pytest.approx(spread[1][1], rel=0.2)


@pytest.mark.parametrize("cells", [1 << 20, 8])
def test_replicate_auc_in_runs(spark, monkeypatch, cells):
    """Many runs, merged in steps, give the weighted AUC of each replicate."""
    monkeypatch.setattr(R, "RUN_VALUES", cells)
    monkeypatch.setattr(R, "MERGED_RUNS", 3)
    rng = np.random.default_rng(2)
    y, p, t = rng.integers(0, 2, 90), rng.integers(0, 40, 90) / 40, rng.integers(0, 3, (90, 4))
    t[y == 1, 3] = 0
    rows = spark.createDataFrame([("m", 0, i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))] + [("m", 0, 99, None, 0.5)], "model string, fold int, id long, y int, p double")
    times = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(t)] + [(0, 99, [1] * 4)], "fold int, id long, times array<int>")
    got = R.replicate_auc(rows, times, ["model"], 4).first()["auc"]
    assert got[:3] == pytest.approx([brute_auc(y, p, t[:, r]) for r in range(3)]) and np.isnan(got[3])


def test_interval_without_accepted_draws(spark):
    draws = spark.createDataFrame([(0, "a_minus_b", "t", 0.5)], "replicate int, pair string, target string, difference double")
    got = {(r["pair"], r["target"]): tuple(r)[2:] for r in R.percentile_interval(draws, 10, R.interval_cells([("a", "b")], ["t"])).collect()}
    assert got == {("a_minus_b", "t"): (0.5, 0.5, 1, 10), ("a_minus_b", "macro"): (None, None, 0, 10)}


def test_errors_parity_promotion(spark):
    rows, _ = oof_case(spark)
    a, d = rows.filter("model = 'a'"), rows.filter("model = 'd' and id <> 's03'")
    got = E.prediction_parity(a, d, 1e-9).first()
    assert got["missing_b"] == 2 and got["max_abs_difference"] == pytest.approx(.8) and got["beyond_tolerance"] == 22
    macro = E.fold_macro(E.auc(rows, ["model", "fold", "target"]))
    assert {r["control"]: r["passes"] for r in E.promotion_rule(macro, "a", ["b", "d"]).collect()} == {"b": False, "d": True}
    with pytest.raises(ContractError):
        J.candidate_decision(rows, d, "a", "d", 1e-6)
    with pytest.raises(ContractError):
        enforce(E.oof_coverage(d, a))


def blend_case(spark):
    own = {"k1": (.2, .3), "k2": (.2, .6), "k3": (.7, .6), "k4": (.9, .6), "k5": (.1, .0)}
    ids = B.with_row_idx(spark.createDataFrame([(i,) for i in own], "id string"))
    part = [spark.createDataFrame([(i, "t", float(v[k])) for i, v in own.items()], "id string, target string, p double") for k in (0, 1)]
    return ids, {"first": part[0], "own": part[1]}


WEIGHTS = {"first": .75, "own": .25}


@pytest.mark.parametrize("sizing", [{}, {"min_rows": 1, "buckets": 16}])
def test_rank_blend(spark, sizing):
    """Ranks of first: 1, 2.5, 2.5, 4, 5; of own: 1, 2 and three times 4; all over 5."""
    ids, parts = blend_case(spark)
    got = {r["id"]: r["p"] for r in B.rank_blend(parts, WEIGHTS, **sizing).collect()}
    assert got == pytest.approx({"k1": .475, "k2": .575, "k3": .8, "k4": .95, "k5": .2})
    rng = np.random.default_rng(12)
    values = {name: rng.integers(0, 90, 700) / 90 for name in WEIGHTS}
    frames = {n: spark.createDataFrame([(i, "t", float(x)) for i, x in enumerate(v)], "id long, target string, p double") for n, v in values.items()}
    want = sum(w * ((values[n][:, None] > values[n]).sum(1) + ((values[n][:, None] == values[n]).sum(1) + 1) / 2) / 700 for n, w in WEIGHTS.items())
    rows = B.rank_blend(frames, WEIGHTS, **sizing).collect()
    assert len(rows) == 700 and all(r["p"] == pytest.approx(want[r["id"]]) for r in rows)
    lacking = {"first": parts["first"], "own": parts["own"].filter("id <> 'k2'")}
    assert {r["id"] for r in B.rank_blend(lacking, WEIGHTS, **sizing).collect() if r["p"] is None} == {"k2"}


def test_alignment_and_gate_reject(spark):
    ids, parts = blend_case(spark)
    p = parts["own"]
    bad = [p.filter("id <> 'k1'"), p.union(p.limit(1)), p.withColumn("p", F.lit(float("nan"))), p.withColumn("p", F.lit(1.5)), p.withColumn("p", F.lit(-.1)),
           p.withColumn("target", F.lit("other")), p.union(spark.createDataFrame([("k9", "t", .5)], p.schema)), p.withColumn("id", F.when(F.col("id") == "k1", "").otherwise(F.col("id")))]
    for frame in bad:
        with pytest.raises(ContractError):
            B.align_component(ids, frame, ["t"])
    assert B.align_component(ids, p, ["t"]).count() == 5
    members = spark.createDataFrame([("own", f"m{i}", "0" * 64, 10) for i in range(20)], "component string, id string, sha256 string, windows int")
    manifest = spark.createDataFrame([("own", "complete", 5, "x", "x")], "component string, status string, rows long, digest string, found_digest string")
    enforce(B.check_component(manifest, members, members, ids, 20))
    for broken in (manifest.withColumn("status", F.lit("running")), manifest.withColumn("rows", F.lit(6)), manifest.withColumn("status", F.lit(None).cast("string")), manifest.withColumn("rows", F.lit(None).cast("long")), manifest.filter("false"), manifest.withColumn("component", F.lit("other")), manifest.union(manifest), manifest.withColumn("found_digest", F.lit("y"))):
        with pytest.raises(ContractError):
            enforce(B.check_component(broken, members, members, ids, 20))
    with pytest.raises(ContractError):
        enforce(B.check_component(manifest, members.filter("id <> 'm3'"), members, ids, 20))
    path = f"{scratch_dir(spark)}/blend"
    passed = [B.check_component(manifest, members, members, ids, 20)]
    J.blend_publish(passed, ids, parts, WEIGHTS, path)
    with pytest.raises(Exception):
        J.blend_publish(passed, ids, parts, WEIGHTS, path)
    with pytest.raises(ContractError):
        J.blend_publish([], ids, parts, WEIGHTS)


def test_submission(spark):
    sample = B.constant_submission(B.with_row_idx(spark.createDataFrame([("study-b",), ("study-a",)], "id string")), {"t0": .5, "t1": .25})
    enforce(B.check_submission(sample, sample, ["t0", "t1"]))
    for bad in (sample.withColumn("row_idx", 1 - F.col("row_idx")), sample.select("row_idx", "id", "t1", "t0"), sample.drop("t1"), sample.filter("false"), sample.withColumn("t0", F.lit(2.0))):
        with pytest.raises(Exception):
            enforce(B.check_submission(bad, sample, ["t0", "t1"]))


def weak_case(spark, n=24):
    rows, labels = [], []
    for i in range(n):
        rows.append((i, [(-2.0, 2.0)[i % 2], i / n]))
        for t in ("t0", "t1"):
            y = (i + (t == "t1") * (i % 3 == 0)) % 2
            seen = i % 4 < 2
            labels.append((i, i // 8, t, y, y if seen else None, .9 if y else .1, "YES" if y else "NO", True, .9))
    features = spark.createDataFrame(rows, "id long, x array<double>")
    table = spark.createDataFrame(labels, "id long, fold int, target string, value int, observed int, derived double, verdict string, mask boolean, confidence double")
    return features, table


def gradient(head, features, sup, c=H.INVERSE_PENALTY):
    x = {r["id"]: np.array(r["x"]) for r in features.collect()}
    rows = [(x[r["id"]], r["y"], r["weight"]) for r in sup.filter(F.col("target") == head.target).collect() if r["weight"] > 0]
    z = np.array([(v - np.array(head.mean)) / np.array(head.scale) for v, _, _ in rows])
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-(z @ np.array(head.coef) + head.intercept)))
    return np.abs(np.append(np.array(head.coef) + c * z.T @ (w * (p - y)), c * (w * (p - y)).sum())).max()


def test_heads_solve_the_penalized_problem(spark, monkeypatch):
    features, table = weak_case(spark)
    sup = W.supervision(table, .25)
    shared = H.fit_heads(features, sup, ["t0", "t1"])
    assert max(gradient(h, features, sup) for h in shared) < 1e-8 and shared[0].observed == 12 and shared[0].derived == 12
    monkeypatch.setattr(H, "JOINT_WIDTH", 0)
    single = H.fit_heads(features, sup, ["t0", "t1"])
    assert max(gradient(h, features, sup) for h in single) < 1e-5
    assert np.allclose(shared[0].coef, single[0].coef, atol=1e-5)
    reduced = H.fit_heads(features, sup, ["t0", "t1"], pca=2)  # all components: the same line
    assert np.allclose(reduced[1].coef, single[1].coef, atol=1e-4) and sum(reduced[0].explained) == pytest.approx(1)
    with pytest.raises(ContractError, match="both classes"):
        H.fit_heads(features, sup.withColumn("y", F.lit(1.0)), ["t0", "t1"])


def test_gold_only_ignores_silver_and_wide_scoring_agrees(spark, monkeypatch):
    features, table = weak_case(spark)
    flipped = table.withColumn("value", F.when(F.col("observed").isNull(), 1 - F.col("value")).otherwise(F.col("value")))
    a = H.fit_heads(features, W.supervision(table, 0.0), ["t0", "t1"])
    b = H.fit_heads(features, W.supervision(flipped, 0.0), ["t0", "t1"])
    assert a == b
    native = sorted(map(tuple, H.predict_heads(features, a).collect()))
    x = {r["id"]: np.array(r["x"]) for r in features.collect()}
    line = {h.target: h for h in a}
    want = [1 / (1 + np.exp(-(line[t].intercept + ((x[i] - line[t].mean) / line[t].scale) @ line[t].coef))) for i, _, t, _ in native]
    assert np.allclose([r[3] for r in native], want)


def test_cross_validation_never_sees_the_held_out_fold(spark):
    features, table = weak_case(spark)
    oof, heads = H.cross_validate(features, table, [0, 1, 2], ["t0", "t1"], {"observed_only": 0.0, "silver": .25})
    assert oof.count() == 2 * 2 * 12 and len(heads) == 12
    for moved in (table.withColumn("observed", F.when(F.col("fold") == 0, 1 - F.col("observed")).otherwise(F.col("observed"))), None):
        f = features if moved is not None else features.withColumn("x", F.when(F.col("id") < 8, F.transform("x", lambda v: v + 1000)).otherwise(F.col("x")))
        _, again = H.cross_validate(f, table if moved is None else moved, [0, 1, 2], ["t0", "t1"], {"observed_only": 0.0, "silver": .25})
        for h, g in zip(heads, again):
            if h.fold == 0:
                assert np.allclose(h.coef, g.coef) and h.mean == pytest.approx(g.mean)
    fold0 = [h for h in heads if h.fold == 0 and h.recipe == "silver"][0]
    x = np.array([r["x"] for r in features.orderBy("id").collect()])[8:]
    assert np.allclose(fold0.mean, x.mean(axis=0)) and np.allclose(fold0.scale, x.std(axis=0))


def vectors_like(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>")


@pytest.mark.parametrize("joint_width", [32, 0])
@pytest.mark.parametrize("broken", [None, [1.0, float("nan")], [1.0, None], [1.0, float("inf")], [1.0], [1.0, 2.0, 3.0]])
def test_broken_vectors_are_errors_at_any_width(spark, monkeypatch, joint_width, broken):
    """NULL, NaN, holes, short and long vectors, in training and scoring, whichever fitter runs."""
    monkeypatch.setattr(H, "JOINT_WIDTH", joint_width)
    features, table = weak_case(spark)
    rows = [(r["id"], broken if r["id"] == 3 else r["x"]) for r in features.collect()]
    bad, sup = vectors_like(spark, rows), W.supervision(table, .25)
    with pytest.raises(ContractError, match="finite"):
        H.fit_heads(bad, sup, ["t0", "t1"])
    with pytest.raises(ContractError, match="finite"):
        H.cross_validate(bad, table, [0, 1, 2], ["t0", "t1"], {"observed_only": 0.0})
    head = [H.Head("f", -1, "t", 0.0, [1.0, 1.0], [0.0, 0.0], [1.0, 1.0], 0, 0, [])]
    with pytest.raises(Exception, match="not 2 finite numbers"):
        H.predict_heads(bad, head).collect()


@pytest.mark.parametrize("joint_width", [32, 0])
def test_orphans_and_open_heads_are_errors(spark, monkeypatch, joint_width):
    monkeypatch.setattr(H, "JOINT_WIDTH", joint_width)
    features, table = weak_case(spark)
    fewer = features.filter("id <> 4")
    with pytest.raises(ContractError, match="orphan_key"):
        H.fit_heads(fewer, W.supervision(table, 0.0), ["t0", "t1"])
    with pytest.raises(ContractError, match="orphan_key"):
        H.cross_validate(fewer, table, [0, 1, 2], ["t0", "t1"], {"observed_only": 0.0})
    monkeypatch.setattr(joint, "MAX_STEPS", 1)
    monkeypatch.setattr(stacked, "MAX_PASSES", 1)
    with pytest.raises(ContractError, match="converge"):
        H.fit_heads(features, W.supervision(table, 0.0), ["t0", "t1"])


def test_known_probabilities_and_new_ids(spark):
    rng = np.random.default_rng(31)
    coef, mean, scale, x = (rng.normal(size=(9, 4)) for _ in range(4))
    heads = [H.Head("f", -1, f"t{k}", float(k) / 5, coef[k].tolist(), mean[k].tolist(), np.abs(scale[k]).tolist(), 0, 0, []) for k in range(9)]
    rows = H.predict_heads(vectors_like(spark, [(i, v.tolist()) for i, v in enumerate(x)]), heads).collect()
    for r in rows:
        k = int(r["target"][1:])
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-(k / 5 + ((x[r["id"]] - mean[k]) / np.abs(scale[k])) @ coef[k]))))
    ids, kids = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "x")], "id string, c string")
    head = [H.Head("f", -1, "t", 0.0, [1.0, 1.0], [0.0, 0.0], [1.0, 1.0], 0, 0, [])]
    assert {r["id"]: round(r["p"], 4) for r in H.score_new_ids(ids, kids, head, {"c": ["x"]}).collect()} == {"a": 0.8808, "b": 0.5}
    with pytest.raises(ContractError):
        H.score_new_ids(ids, kids.withColumn("id", F.lit("foreign")), head, {"c": ["x"]})


def test_experiment_end_to_end(spark):
    features, table = weak_case(spark)
    out = J.experiment(features, table, [0, 1, 2], ["t0", "t1"], features.limit(3), recipes={"observed_only": 0.0, "silver": .25}, replicates=20, seed=1)
    summary = {r["model"]: r["mean_macro_auc"] for r in out["summary"].collect()}
    assert summary["constant"] == .5 and summary["prevalence"] == .5 and out["chosen"] in ("observed_only", "silver")
    assert out["submission"].count() == 6 and out["interval"].count() == 3
