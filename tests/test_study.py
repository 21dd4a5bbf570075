"""Labels, linkage, splits, stacks and features on small hand-computed inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import features as G
from evalloom.operators import labels as W
from evalloom.operators import linkage as L
from evalloom.operators import profile as P
from evalloom.operators import splits as S
from evalloom.operators import stacks as X
from evalloom.operators.checks import ContractError, enforce

NAMES = ["ACL", "MCL"]


def test_text_keys(spark):
    rows = [("a", "  SYNTHETIC\nＲＥＰＯＲＴ  "), ("b", "synthetic report"), ("c", None), ("d", "  "), ("e", "Straße"), ("f", "STRASSE"), ("g", "　")]
    got = {r["id"]: r["group_id"] for r in L.text_group_key(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got["a"] == got["b"] == hashlib.sha256(b"synthetic report").hexdigest()
    assert got["c"] == hashlib.sha256(b"missing-report:c").hexdigest() and len({got["c"], got["d"], got["g"]}) == 3
    assert got["e"] == got["f"]


def test_components_with_hub_and_chain(spark):
    rows = [("p", i, "hub") for i in range(40)] + [("q", i, f"c{i // 2}") for i in range(50, 70)] + [("r", i, f"d{(i + 1) // 2}") for i in range(50, 70)]
    keys = spark.createDataFrame(rows, "kind string, id long, key string").repartition(5)
    got = {r["id"]: r["component"] for r in L.link_components(spark.range(80), keys).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(50, 70)} == {50}
    assert all(got[i] == i for i in [*range(40, 50), *range(70, 80)])


def test_overlap_audit(spark):
    """k1 stays in fold 0; k2 joins folds 0 and 2 and two gold units; k3 joins train and test; blank keys are none."""
    ids = spark.createDataFrame(
        [("u1", "train", 0, True), ("u2", "train", 2, True), ("u3", "train", 2, False), ("u4", "test", None, False), ("u5", "train", 0, False)],
        "id string, split string, fold int, gold boolean",
    )
    k1, k2, k3 = "a" * 64, "b" * 64, "c" * 64
    keys = [("scanner", i, k1) for i in ("u1", "u5", "u5")] + [("scanner", i, k2) for i in ("u2", "u3", "u1")] + [("scanner", i, k3) for i in ("u4", "u5")]
    keys += [("site", i, k1) for i in ("u3", "u5")] + [("site", "u2", ""), ("site", "u1", None)]
    got = {(r["kind"], r["metric"]): r["value"] for r in L.key_overlap_audit(spark.createDataFrame(keys, "kind string, id string, key string"), ids, [0, 2]).collect()}
    want = {
        "unique_keys": 3, "multi_study_groups": 3, "largest_group_studies": 3, "studies_with_key": 5, "cross_fold_groups": 1, "cross_fold_groups_touching_gold": 1,
        "cross_fold_gold_to_gold_groups": 1, "cross_fold_gold_studies": 2, "train_test_groups": 1, "fold_0_studies_with_key": 2, "fold_2_studies_with_key": 2,
    }
    assert {m: got[("scanner", m)] for m in want} == want
    want = {"unique_keys": 1, "cross_fold_groups": 1, "cross_fold_groups_touching_gold": 0, "cross_fold_gold_studies": 0, "train_test_groups": 0, "studies_with_key": 2}
    assert {m: got[("site", m)] for m in want} == want


def test_pseudonyms_and_revision(spark):
    df = spark.createDataFrame([(" P1 ", "H\"x"), ("", "H"), (None, None)], "pid string, issuer string")
    got = [tuple(r) for r in L.pseudonymize(df, {"k": ["pid", "issuer"]}, {"k": "pid"}).select("k").collect()]
    assert got == [(hashlib.sha256(b'["P1", "H\\"x"]').hexdigest(),), ("",), ("",)]
    folds = spark.createDataFrame([("a", "g1", 0), ("b", "g2", 1), ("c", "g3", 2), ("d", "g4", 1)], "id string, group_id string, fold int")
    comp = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "id string, component string")
    gold = spark.createDataFrame([("b",)], "id string")
    assert {r["id"]: r["revised_fold"] for r in L.revise_split(folds, comp, gold).collect()} == {"a": 1, "b": 1, "c": 1, "d": 1}
    with pytest.raises(ContractError):
        L.revise_split(folds, comp, spark.createDataFrame([("a",), ("b",)], "id string"))


def split_case(spark):
    """48 cases; the last four repeat the texts of the first four; every eighth has no target."""
    ids = [f"case{i}" for i in range(48)]
    texts = spark.createDataFrame([(s, f"note {i % 44}") for i, s in enumerate(ids)], "id string, text string")
    targets = spark.createDataFrame([(s, t, None if i % 8 == 7 else (i // 2 + k) % 2) for i, s in enumerate(ids) for k, t in enumerate(NAMES)], "id string, target string, value int")
    return L.text_group_key(texts).select("id", "group_id"), targets


def test_grouped_folds(spark):
    members, targets = split_case(spark)
    strata = targets.filter("target = 'MCL'")
    folds = S.grouped_stratified_folds(members, strata, 4, 11)
    support = S.validate_folds(members, folds, targets, NAMES, 4).collect()
    assert len(support) == 8 and all(r["positive"] and r["negative"] for r in support)
    got = {r["id"]: r["fold"] for r in folds.collect()}
    assert len(got) == 48 and all(got[f"case{i}"] == got[f"case{i + 44}"] for i in range(4))
    again = S.grouped_stratified_folds(members.repartition(9), strata.repartition(4), 4, 11, min_rows=1, buckets=16)
    assert {r["id"]: r["fold"] for r in again.collect()} == got
    for bad in (folds.filter("id <> 'case17'"), folds.withColumn("fold", F.when(F.col("id") == "case45", (F.col("fold") + 1) % 4).otherwise(F.col("fold")).cast("int"))):
        with pytest.raises(ContractError):
            S.validate_folds(members, bad, targets, NAMES, 4)
    with pytest.raises(ContractError, match="class_support"):
        S.validate_folds(members, folds, targets.withColumn("value", F.when(F.col("target") == "ACL", 0).otherwise(F.col("value"))), NAMES, 4)


def label_case(spark):
    """k is observed on one target and derived against it; l has an unknown and a zero-confidence verdict; m has nothing."""
    targets = spark.createDataFrame([("k", "ACL", 1), ("k", "MCL", None), ("l", "ACL", None), ("l", "MCL", None), ("m", "ACL", None), ("m", "MCL", None)], "id string, target string, value int")
    rows = [("k", "ACL", .1, .9, "NO"), ("k", "MCL", .72, .6, "YES"), ("l", "ACL", .5, .3, "UNK"), ("l", "MCL", .33, 0.0, "NO")]
    derived = spark.createDataFrame(rows, "id string, target string, score double, conf double, verdict string")
    folds = spark.createDataFrame([("k", "red", 2), ("l", "blue", 0), ("m", "green", 2)], "id string, group_id string, fold int")
    return targets, derived, folds


def test_fusion(spark):
    table = W.fuse_labels(*label_case(spark), "v1")
    got = {(r["id"], r["target"]): r for r in table.collect()}
    assert (got["k", "ACL"]["value"], got["k", "ACL"]["source"], got["k", "ACL"]["verdict"]) == (1, "observed", "NO")
    assert (got["k", "MCL"]["value"], got["k", "MCL"]["source"], got["k", "MCL"]["derived"]) == (1, "v1", .72)
    assert got["l", "ACL"]["value"] is None and got["l", "ACL"]["mask"] is False and got["l", "ACL"]["derived"] == .5
    assert got["l", "MCL"]["mask"] is False and got["m", "MCL"]["source"] == "unknown" and got["m", "ACL"]["mask"] is False
    assert {r["id"] for r in S.training_partition(table, 0).collect()} == {"k"}
    with pytest.raises(ContractError):
        S.training_partition(table, 7)
    assert {r["heldout_fold"]: r["training_ids"] for r in S.training_counts(table).collect()} == {0: 1, 2: 0}
    sup = {(r["id"], r["target"]): (r["y"], r["weight"]) for r in W.supervision(table, .5).collect()}
    assert sup["k", "ACL"] == (1, 1) and sup["k", "MCL"] == (1, .5) and sup["l", "ACL"] == (0, 0) and sup["l", "MCL"] == (0, 0)
    soft = {(r["id"], r["target"]): r["y"] for r in W.soft_targets(W.supervision(table, .5), .5).collect()}
    assert soft["k", "MCL"] == .72 and soft["k", "ACL"] == 1
    gold = W.supervision(table, 0.0).filter("weight > 0").select("id", "target").collect()
    assert [tuple(r) for r in gold] == [("k", "ACL")]


@pytest.mark.parametrize("col,value", [("score", -.1), ("score", 1.1), ("score", float("inf")), ("score", float("nan")), ("conf", -.1), ("conf", 1.1), ("verdict", "MAYBE"), ("verdict", None), ("id", "foreign"), ("id", " k"), ("id", "")])
def test_fusion_rejects_derived(spark, col, value):
    targets, derived, folds = label_case(spark)
    hit = (F.col("id") == "k") & (F.col("target") == "ACL")
    with pytest.raises(ContractError):
        W.fuse_labels(targets, derived.withColumn(col, F.when(hit, F.lit(value)).otherwise(F.col(col))), folds, "v1")


def test_fusion_rejects_folds_and_zero_confidence(spark):
    targets, derived, folds = label_case(spark)
    for bad in (folds.filter("id <> 'k'"), folds.withColumn("group_id", F.lit("red")), folds.withColumn("fold", F.lit(None).cast("int")), folds.union(folds)):
        with pytest.raises(ContractError):
            W.fuse_labels(targets, derived, bad, "v1")
    table = W.fuse_labels(targets, derived.withColumn("conf", F.lit(0.0)), folds, "v1")
    assert table.filter("mask and observed is null").count() == 0


def test_cross_entropy_and_evidence(spark):
    rows = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 0.0, .25), (3.0, 0.0, 0.0), (900.0, 1.0, 1.0)], "logit double, y double, weight double")
    assert W.masked_bce(rows).first()["loss"] == pytest.approx(1.25 * np.log(2) / 4)
    text = spark.createDataFrame([("a", "no tear seen")], "id string, text string")
    sha = hashlib.sha256(b"no tear seen").hexdigest()
    good = spark.createDataFrame([("a", 3, 7, "tear", sha)], "id string, start int, end int, evidence string, text_sha256 string")
    enforce(W.check_evidence_spans(good, text))
    with pytest.raises(ContractError, match="evidence"):
        enforce(W.check_evidence_spans(good.withColumn("start", F.lit(2)), text))


def test_schedules_match_hashlib(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    def anchor(e, i, p):
        return int.from_bytes(hashlib.sha256(f"{S.SEED}:{e}:{i}:{p}".encode()).digest()[:8], "little") % 10
    got = {(r["epoch"], r["id"], r["plane"]): r["window"] for r in S.window_schedule(ids).collect()}
    assert len(got) == 54 and all(w == anchor(*k) for k, w in got.items())
    for r in S.multi_window_schedule(ids).collect():
        e, i, p = r["epoch"], r["id"], r["plane"]
        rest = sorted((w for w in range(10) if w != anchor(e, i, p)), key=lambda w: hashlib.sha256(f"multi-window-v1:{S.SEED}:{e}:{i}:{p}:{w}".encode()).digest())
        assert r["windows"] == sorted([anchor(e, i, p), *rest[:2]])
    enforce(S.check_schedule(S.all_window_schedule(ids), 10, ids, 6, 3))
    with pytest.raises(ContractError):
        enforce(S.check_schedule(S.all_window_schedule(ids), 3, ids, 6, 3))


def headers_of(spark, rows):
    return spark.createDataFrame(rows, "series string, slice string, orientation array<double>, position array<double>, instance string")


ACROSS = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]  # slices stack along z


def test_slice_order(spark):
    """By position along the normal; by instance where a position is missing or repeated; not at all otherwise."""
    stacked = [("z", f"f{i}", ACROSS, [7.0, -2.0, z], "1") for i, z in enumerate([4.0, -1.5, 2.5, 9.0])]
    holes = [("h", f"f{i}", ACROSS, p, str(n)) for i, (p, n) in enumerate([(None, 10), ([0.0, 0.0, 5.0], 30), ([0.0, 0.0, 6.0], 20)])]
    turned = [("t", "f0", ACROSS, [0.0, 0.0, 1.0], "1"), ("t", "f1", [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 2.0], "2")]
    same = [("s", f"f{i}", ACROSS, [0.0, 0.0, 2e-5 * i], str(n)) for i, n in enumerate([5, 4, 9])]
    bare = [("b", f"f{i}", None, None, "3") for i in range(3)]
    got = {(r["series"], r["slice"]): r for r in X.order_slices(headers_of(spark, stacked + holes + turned + same + bare)).collect()}
    assert [got["z", f"f{i}"]["pos"] for i in range(4)] == [2, 0, 1, 3] and [got["z", f"f{i}"]["position"] for i in range(4)] == [4.0, -1.5, 2.5, 9.0]
    assert [got["h", f"f{i}"]["pos"] for i in range(3)] == [0, 2, 1] and got["h", "f0"]["method"] == "InstanceNumber" and got["h", "f0"]["reason"]
    assert got["t", "f1"]["method"] == "rejected" and got["t", "f1"]["pos"] is None
    assert [got["s", f"f{i}"]["pos"] for i in range(3)] == [1, 0, 2] and got["s", "f2"]["reason"] == "duplicate slice positions"
    assert got["b", "f2"]["method"] == "rejected"


@pytest.mark.parametrize("n,count,lo,hi,want", [(9, 3, 0, 1, [0, 4, 8]), (9, 1, 0, 1, [4]), (2, 5, 0, 1, [0, 0, 0, 1, 1]), (21, 12, .2, .8, [4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16])])
def test_even_sample(spark, n, count, lo, hi, want):
    stack = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("pos"), F.lit(n).cast("bigint").alias("n"))
    assert [r["pos"] for r in X.even_sample(stack, count, float(lo), float(hi)).orderBy("sample").collect()] == want


def test_series_choice_windows_fill_quality(spark):
    series = spark.createDataFrame([("s", "b", "sagittal", "1", "1"), ("s", "a", "SAGITTAL", "1.0", "True"), ("s", "c", "Sagittal", "0", "1"), ("s", "z", "Axial", None, None)], "id string, series_id string, plane string, fluid string, fat string")
    got = {r["plane"]: r["series_id"] for r in X.select_series(spark.createDataFrame([("s",)], "id string"), series).collect()}
    assert got == {"Sagittal": "a", "Coronal": None, "Axial": "z"}
    samples = spark.createDataFrame([("s", i, p, i in (1, 4), f"v{i}") for i, p in enumerate([0, 2, 4, 6, 8])] + [("dead", 0, 0, False, "x")], "series string, sample int, pos long, ok boolean, v string")
    filled = X.fill_nearest(samples, "v", 5).orderBy("sample").collect()
    assert [(r["v"], r["repeated"]) for r in filled] == [("v1", True), ("v1", False), ("v1", True), ("v4", True), ("v4", False)]
    windows = X.neighbor_windows(samples.filter("series = 's'"), "v").orderBy("window").collect()
    assert [r["items"] for r in windows] == [["v0", "v1", "v2"], ["v1", "v2", "v3"], ["v2", "v3", "v4"]]


def test_count_features_and_profiles(spark):
    parents = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "id string")
    rows = [("p1", "Coronal", 0, 1), ("p1", "Coronal", 0, 0), ("p1", "Axial", 1, 1), ("p3", "Sagittal", None, 1), ("p3", "Curved", 0, None)]
    series = spark.createDataFrame(rows, "id string, plane string, fluid int, fat int")
    counted = G.count_features(parents, series)
    got = {r["id"]: [r[c] for c in G.count_names(G.CATEGORIES)] for r in counted.collect()}
    assert got == {"p1": [3, 1, 2, 0, 2, 1, 1, 2], "p2": [0] * 8, "p3": [2, 0, 0, 1, 1, 0, 0, 1]}
    gram = {(r["a"], r["b"]): r["gram"] for r in P.feature_gram(counted, ["total", "plane_Coronal"]).collect()}
    assert gram == {("total", "total"): 13, ("total", "plane_Coronal"): 6, ("plane_Coronal", "plane_Coronal"): 4}
    wide = P.wide_gram(G.as_array(counted, ["total", "plane_Coronal"]))
    assert wide.tolist() == [[13, 6], [6, 4]] and P.gram_rank(wide) == 2


def test_slots_and_pixels_reject(spark):
    """A repeated or unknown place, another width, a hole: errors wherever vectors are packed."""
    ids = spark.createDataFrame([("a",)], "id string")
    rows = [("a", "Axial", 0, [1.0, 2.0]), ("a", "Axial", 1, [3.0, 4.0])]
    good = spark.createDataFrame(rows, "id string, plane string, window int, vec array<float>")
    more = lambda *r: good.union(spark.createDataFrame([r], good.schema))
    assert G.mean_pool_windows(good).first()["vec"] == [2, 3]
    for bad in (more("a", "Axial", 1, [9.0, 9.0]), more("a", "Axial", 10, [1.0, 1.0]), more("a", "Axial", 2, [1.0]), more("a", "Axial", 2, [1.0, float("nan")]), more("a", "Axial", 2, None)):
        with pytest.raises(Exception, match="repeated|unknown|differ"):
            G.mean_pool_windows(bad).collect()
    for bad in (good, good.limit(1).withColumn("plane", F.lit("Oblique")), good.filter("window = 0").withColumn("vec", F.array(F.lit(1.0)).cast("array<float>"))):
        with pytest.raises(Exception, match="repeated|unknown"):
            G.assemble_slots(ids, bad.drop("window"), 2).collect()
    for value in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="finite"):
            G.clip_scale(spark.createDataFrame([("i", 0, 1.0), ("i", 1, value)], "image string, pixel long, value double")).collect()


def test_slots_pooling_scaling_encoding(spark):
    vectors = spark.createDataFrame([("a", "Axial", 0, [1.0, 2.0]), ("a", "Axial", 3, [3.0, 6.0]), ("b", "Sagittal", 9, [5.0, 5.0])], "id string, plane string, window int, vec array<float>")
    pooled = G.mean_pool_windows(vectors)
    rows = {r["id"]: r["x"] for r in G.assemble_slots(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), pooled, 2).collect()}
    assert rows == {"a": [0, 0, 0, 0, 2, 4, 0, 0, 1], "b": [5, 5, 0, 0, 0, 0, 1, 0, 0], "c": [0] * 9}
    values = np.random.default_rng(0).normal(size=500)
    pixels = spark.createDataFrame([("i", k, float(v)) for k, v in enumerate(values)] + [("flat", 0, 3.0), ("flat", 1, 3.0)], "image string, pixel long, value double")
    got = {(r["image"], r["pixel"]): r["scaled"] for r in G.clip_scale(pixels).collect()}
    lo, hi = np.percentile(values, [1, 99])
    assert np.allclose([got["i", k] for k in range(500)], np.clip((values - lo) / (hi - lo), 0, 1)) and got["flat", 0] == 0
    sizes = []
    out = G.encode_batches(vectors, lambda b: b * 2, 2, col="vec", batch=2).collect()
    assert sorted(tuple(r["vec"]) for r in out) == [(2, 4), (6, 12), (10, 10)] and not sizes
    with pytest.raises(Exception, match="finite vectors"):
        G.encode_batches(vectors, lambda b: b[:, :1], 2, col="vec").collect()
    sha = {r["sha"] for r in vectors.select(G.pixel_hash(F.col("vec")).alias("sha")).collect()}
    assert hashlib.sha256(np.array([1, 2], "<f4").tobytes()).hexdigest() in sha


def test_attention_matches_numpy(spark):
    rng = np.random.default_rng(1)
    params = {"proj": rng.normal(size=(4, 3)), "proj_bias": rng.normal(size=4), "slot": rng.normal(size=(30, 4)), "query": rng.normal(size=(2, 4)), "out": rng.normal(size=(2, 4)), "out_bias": rng.normal(size=2)}
    data = [("a", p, w, rng.normal(size=3).tolist()) for p in (0, 2) for w in range(10)] + [("b", 1, 4, rng.normal(size=3).tolist())]
    got = {(r["id"], r["target"]): r["logit"] for r in G.attention_pool(spark.createDataFrame(data, "id string, plane int, window int, vec array<double>"), params).collect()}
    for i in "ab":
        rows = [(p * 10 + w, np.array(v)) for k, p, w, v in data if k == i]
        h = np.stack([v @ params["proj"].T + params["proj_bias"] + params["slot"][s] for s, v in rows])
        for t in range(2):
            a = np.exp(h @ params["query"][t] / 2)
            assert got[i, t] == pytest.approx((a / a.sum()) @ (h @ params["out"][t]) + params["out_bias"][t])
