import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators import checks as C
from evalloom.operators import provenance as K
from evalloom.plans.jobs import metadata_audit
from evalloom.sources import io
from evalloom.streaming.audit import append_audit_stream, progress


def found(checks):
    return {(r["check"], r["subject"]): r["violations"] for r in checks.collect() if r["violations"]}


def test_key_check_names_each_fault(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("",), (" \t",), (" b",)], "id string")
    assert found(C.check_key(df, ["id"], "t")) == {("null_key", "t"): 1, ("blank_key", "t"): 2, ("padded_key", "t"): 1, ("duplicate_key", "t"): 1}
    assert found(C.check_key(df.filter("false"), ["id"], "t")) == {("empty", "t"): 1}
    with pytest.raises(C.ContractError, match="null_key"):
        C.enforce(C.check_key(df, ["id"], "t"))


def test_set_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,), (4,)], "k long")
    assert found(C.check_set_equal(a, b, ["k"], "s")) == {("missing_right", "s"): 1, ("missing_left", "s"): 2}
    assert found(C.check_subset(a, b, ["k"], "s")) == {("orphan_key", "s"): 1}
    assert found(C.check_disjoint(a, b, ["k"], "s")) == {("shared_key", "s"): 1}


@pytest.mark.parametrize("value,bad", [(0.0, False), (1.0, False), (-0.1, True), (1.1, True), (float("nan"), True), (float("inf"), True), (None, True)])
def test_probability(spark, value, bad):
    df = spark.createDataFrame([(value,)], "p double")
    assert bool(found(C.check_probability(df, ["p"]))) is bad


def test_text_is_no_probability_and_cells(spark):
    df = spark.createDataFrame([("0.5", 2, 0.5, "MAYBE", "x" * 64), ("1", None, -1.0, None, "a" * 64)], "p string, b int, n double, e string, d string")
    assert found(C.check_probability(df, ["p"])) == {("probability:p", "table"): 2}
    assert found(C.check_binary_or_null(df, ["b"])) == {("binary:b", "table"): 1}
    assert found(C.check_binary_or_null(df, ["b"], nullable=False)) == {("binary:b", "table"): 2}
    assert found(C.check_count(df, ["n"])) == {("count:n", "table"): 2}
    assert found(C.check_enum(df, "e", ["YES"])) == {("enum:e", "table"): 2}
    assert found(C.check_digest(df, ["d"])) == {("digest:d", "table"): 1}


def test_schema_dependency_categories_order_vector(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0)], "g long, c string, f int")
    wanted = T.StructType([T.StructField("c", T.StringType()), T.StructField("g", T.LongType()), T.StructField("f", T.IntegerType())])
    assert found(C.check_schema(df, wanted)) == {("schema", "table"): 2}
    assert found(C.check_schema(df, df.schema)) == {}
    assert found(C.check_fd(df, "g", "f")) == {("crosses:f", "table"): 1}
    assert found(C.check_complete_categories(df, "g", "c", ["a", "b"])) == {("incomplete_categories", "table"): 1}
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_idx long, id string")
    b = spark.createDataFrame([(0, "y"), (1, "x"), (2, "z")], "row_idx long, id string")
    assert found(C.check_same_order(a, b, "id", "o")) == {("order", "o"): 3}
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, float("nan")],), ([1.0, 70000.0],), (None,)], "v array<double>")
    assert found(C.check_vector(v, "v", 2)) == {("vector", "table"): 4}


def star(spark):
    """Five parents with two questions each, seven children, two parents of another split and their children, a template."""
    answers = {"p1": (1, 0), "p2": (1, 1), "p3": (None, 0), "p4": (None, None), "p5": (0, None)}
    cells = [(i, q, v) for i, vs in answers.items() for q, v in zip(("wet", "cold"), vs)]
    kids = [("p1", "k1", "Top", 1, 0), ("p1", "k2", "Side", 0, 0), ("p2", "k3", "Top", 1, 1), ("p3", "k4", "Front", 0, 1), ("p3", "k5", "Front", 0, 1), ("p5", "k6", "Top", 1, 1), ("p5", "k7", None, 0, 0)]
    child = "id string, series_id string, plane string, fluid int, fat int"
    return {
        "texts": spark.createDataFrame([("p1", "rain"), ("p2", " "), ("p3", None), ("p4", "snow"), ("p5", "sun")], "id string, text string"),
        "targets": spark.createDataFrame(cells, "id string, target string, value int"), "series": spark.createDataFrame(kids, child),
        "test": spark.createDataFrame([("q1",), ("q2",)], "id string"), "n_targets": 2,
        "test_series": spark.createDataFrame([("q1", "k8", "Top", 1, 1)], child),
        "sample": spark.createDataFrame([("q1", 0.5, 0.5), ("q2", 0.5, 0.5)], "id string, wet double, cold double"),
    }


def test_metadata_audit(spark):
    given = star(spark)
    got = {(r["section"], r["metric"], r["key"]): r["value"] for r in metadata_audit(**given).collect()}
    assert [got["completeness", m, ""] for m in ("fully_labeled", "partially_labeled", "unlabeled")] == [2, 2, 1]
    assert [got["targets", m, "wet"] for m in ("observed", "positive", "negative")] == [3, 2, 1] and got["targets", "unknown", "cold"] == 2
    assert got["texts", "nonblank", ""] == 3 and got["series", "n", "plane|Top"] == 3


@pytest.mark.parametrize("name,change,told", [
    ("targets", lambda df: df.withColumn("value", F.lit(2)), "binary"),
    ("targets", lambda df: df.filter("id <> 'p1'"), "missing"),
    ("test", lambda df: df.union(df.sparkSession.createDataFrame([("p4",)])), "shared_key"),
    ("series", lambda df: df.withColumn("id", F.when(F.col("series_id") == "k4", "gone").otherwise(F.col("id"))), "orphan_key"),
    ("test_series", lambda df: df.withColumn("id", F.lit("p1")), "orphan_key"),
    ("test_series", lambda df: df.withColumn("series_id", F.lit("k1")), "shared_key"),
    ("sample", lambda df: df.filter("id = 'q1'"), "missing"),
])
def test_metadata_audit_fails_closed(spark, name, change, told):
    given = star(spark)
    with pytest.raises(C.ContractError, match=told):
        metadata_audit(**given | {name: change(given[name])})


def test_csv_contract_and_projection(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,text\n001,"line one\nline ""two"""\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    assert [tuple(r) for r in io.read_contract(spark, str(path), schema, "csv").collect()] == [("001", 'line one\nline "two"')]
    other = T.StructType([T.StructField("uid", T.StringType()), T.StructField("text", T.StringType())])
    with pytest.raises(C.ContractError):
        io.read_contract(spark, str(path), other, "csv")
    with pytest.raises(Exception):
        io.read_contract(spark, str(tmp_path / "absent"), schema)
    spark.range(3).select("id", F.lit("x").alias("text")).write.parquet(str(tmp_path / "p"))
    plan = io.read_columns(spark, str(tmp_path / "p"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_manifest_inventory_and_vectors(spark, tmp_path):
    root = tmp_path / "train_series" / "s1" / "u1"
    root.mkdir(parents=True)
    (root / "a.dcm").write_bytes(b"abc")
    (root / "b.dcm").write_bytes(b"")
    (root / "c.txt").write_bytes(b"x" * 3_000_000)
    rows = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in io.file_manifest(spark, str(tmp_path)).collect()}
    assert rows == {n: (hashlib.sha256(v).hexdigest(), len(v)) for n, v in {"a.dcm": b"abc", "b.dcm": b"", "c.txt": b"x" * 3_000_000}.items()}
    assert [r["bytes"] for r in io.file_manifest(spark, f"file://{tmp_path}", "b.*").collect()] == [0]
    selected = spark.createDataFrame([("train", "s1", "u1"), ("train", "s1", "u2"), ("train", "s2", None)], "split string, id string, series_id string")
    assert sorted(r["state"] for r in io.series_inventory(spark, str(tmp_path), selected).collect()) == ["found", "no_dicom_files", "no_matching_series"]
    vectors = spark.createDataFrame([("a", "Axial", 0, [1.0, 2.0]), ("b", "Axial", 1, [0.0, 1.0])], "id string, plane string, window int, vec array<float>")
    io.write_vectors(vectors, str(tmp_path / "v"))
    assert io.read_vectors(spark, str(tmp_path / "v"), 2, vectors).count() == 2
    with pytest.raises(C.ContractError):
        io.read_vectors(spark, str(tmp_path / "v"), 3)
    with pytest.raises(C.ContractError):
        io.read_vectors(spark, str(tmp_path / "v"), 2, spark.createDataFrame([("c",)], "id string"))
    with pytest.raises(Exception):
        io.write_vectors(vectors, str(tmp_path / "v"))


def test_listing_goes_on_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("evalloom.sources.files.SPLIT_FOLDERS", 3)
    for i in range(5):
        for j in range(2):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f").write_bytes(bytes([i, j]))
        (tmp_path / f"d{i}" / "g").write_bytes(b"")
    (tmp_path / "top").write_bytes(b"t")
    rows = {r["path"].removeprefix(f"{tmp_path}/"): (r["bytes"], r["sha256"]) for r in io.file_manifest(spark, str(tmp_path)).collect()}
    want = {p.relative_to(tmp_path).as_posix(): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*") if p.is_file()}
    assert rows == want and len(rows) == 16
    with pytest.raises(Exception, match="absent"):
        io.file_manifest(spark, str(tmp_path / "absent")).collect()


def test_json_lists(spark):
    df = spark.createDataFrame([(1, '["a", null, "b\\"c"]'), (2, "[]"), (3, '{"a": 1}'), (4, "[1]"), (5, None)], "id long, j string")
    assert found(io.check_json_list(df, "j")) == {("json_list", "j"): 3}
    good = df.filter("id < 3")
    assert sorted(r["value"] for r in io.explode_json_list(good, "j", ["id"]).collect()) == ["a", 'b"c']


def test_fingerprint_freeze_and_allowlist(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 3).cast("string").alias("t"))
    assert K.fingerprint_of(df) == K.fingerprint_of(df.repartition(9, "t").orderBy(F.desc("id")))
    assert K.fingerprint_of(df) != K.fingerprint_of(df.withColumn("t", F.when(F.col("id") == 5, "x").otherwise(F.col("t"))))
    path = str(tmp_path / "frozen")
    first = K.freeze_once(df, path, {"a": "1"})
    again = K.freeze_once(df.withColumn("t", F.lit("other")), path, {"a": "1"})
    assert sorted(first.collect()) == sorted(again.collect())
    with pytest.raises(C.ContractError, match="other inputs"):
        K.freeze_once(df, path, {"a": "2"})
    df.limit(3).write.mode("overwrite").parquet(path + "/data")
    with pytest.raises(C.ContractError, match="changed"):
        K.freeze_once(df, path, {"a": "1"})
    with pytest.raises(C.ContractError):
        K.project_allowlist(df, ["id"])


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    rows = spark.range(60).select("id", (F.col("id") % 7).alias("v"))
    rows.repartition(5).write.parquet(source)
    done = append_audit_stream(spark, source, rows.schema, lambda b: b.withColumn("big", F.col("v") > 3), out, log, max_files=2)
    assert sorted(r["id"] for r in done.collect()) == list(range(60))
    assert progress(spark, out).count() >= 2
    rows.withColumn("id", F.col("id") + 100).coalesce(1).write.mode("append").parquet(source)
    done = append_audit_stream(spark, source, rows.schema, lambda b: b.withColumn("big", F.col("v") > 3), out, log, max_files=2)
    assert done.count() == 120 and done.filter("big").count() == 2 * sum(i % 7 > 3 for i in range(60))
