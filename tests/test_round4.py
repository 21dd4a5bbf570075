"""What the findings of round 4 asked for: documents without a text, with a blank one, or with characters whose lower case depends on the engine."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evalloom.operators import linkage, splits
from evalloom.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
UNUSUAL = "ﬁ ＲΣ İ ẞ\u000bΣ"


def _folder(spark, path, **cells):
    """The given tables, with some cells of the documents replaced."""
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", f"{path}/{name}")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumns({c: F.expr(v).cast(docs.schema[c].dataType) for c, v in cells.items()}).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def without_text(spark, tmp_path_factory):
    """Ten documents of 200 have no text, five of them no length either; five are blank, five have unusual characters."""
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    text = f"CASE WHEN doc_id % 20 = 7 THEN NULL WHEN doc_id % 40 = 8 THEN ' \\n ' WHEN doc_id % 40 = 9 THEN concat(text, '{UNUSUAL}') ELSE text END"
    size = f"CASE WHEN doc_id % 40 = 7 THEN NULL WHEN doc_id % 40 = 27 THEN 0 WHEN doc_id % 40 = 8 THEN 3 WHEN doc_id % 40 = 9 THEN n_chars + {len(UNUSUAL)} ELSE n_chars END"
    return _folder(spark, tmp_path_factory.mktemp("without"), text=text, n_chars=size)


def _same(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        path = f"{sf}/{table}"
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, sf)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) > 0 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_f1_to_f6_features_without_text(spark, tmp_path):
    """An empty text was divided by its length, and a missing one left gaps, so that every fit over the documents failed."""
    from evalloom.queries.features import document_features

    rows = [(1, "ab\nC", "en", 4), (2, "", "es", 0), (3, None, "fr", 0), (4, None, "de", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: r["x"] for r in document_features(spark, str(tmp_path)).collect()}
    assert got == {1: [0.004, 2.0, 0.5, 1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0, 0.0, 1.0, 0.0], 3: [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 4: [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]}


@pytest.mark.parametrize("name", ["fitted_heads", "reduced_heads", "cross_validated", "recipe_comparison"])
def test_f2_to_f6_fits_without_text(spark, without_text, name):
    assert QUERIES[name](spark, without_text).count() >= 2


@needs_tables
@pytest.mark.parametrize("name", ["text_group_key", "grouped_folds", "gold_supervision", "soft_targets", "training_counts", "training_rows", "weighted_supervision"])
def test_f9_to_f14_keys_and_folds_are_those_of_the_sql(spark, without_text, name):
    """Blank texts share a key, missing ones have none and so no fold; their place among the groups is kept."""
    _same(spark, without_text, name)


def test_f11_lower_case_of_each_character(spark):
    con = duckdb.connect()
    texts = ["ΑΣ Σ", "İI", "ẞß", " a \t\r\n\f b\u000b ", " x　", "ＲﬁǅΚK", "", "  ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["group_id"] for r in linkage.text_group_key(rows, plain=True).collect()}
    sql = r"SELECT sha256(trim(regexp_replace(replace(lower(?), 'ß', 'ss'), '\s+', ' ', 'g')))"
    assert got == {i: con.execute(sql, [t]).fetchall()[0][0] for i, t in enumerate(texts)}


def test_f11_rows_without_a_group_take_a_place_and_no_fold(spark):
    """The nine rows without a group come first by size, so the single ones go to the folds from the second on."""
    members = spark.range(15).select("id", F.when(F.col("id") < 6, F.col("id").cast("string")).alias("group_id"))
    strata = spark.createDataFrame([], "id bigint, value int")
    got = splits.grouped_stratified_folds(members, strata, 3, 42).collect()
    assert sorted(r["id"] for r in got) == list(range(6)) and sorted(r["fold"] for r in got) == [0, 0, 1, 1, 2, 2]
    assert sorted(r["id"] for r in splits.greedy_stratified_folds(members, strata, 3, 42).collect()) == list(range(6))


@needs_tables
@pytest.mark.parametrize("name", ["validated_folds", "duplicate_groups", "hash_sample", "cell_checks"])
def test_f11_what_reads_the_keys(spark, without_text, name):
    _same(spark, without_text, name)


@needs_tables
@pytest.mark.parametrize("name", ["fused_labels", "label_source_report"])
def test_f8_fused_labels_of_documents_with_a_key(spark, without_text, name):
    """The checks hold the folds against the documents that have a key, not against all."""
    _same(spark, without_text, name)


@needs_tables
def test_f7_unknown_lengths_are_no_differences(spark, without_text):
    _same(spark, without_text, "cross_checks")


@needs_tables
@pytest.mark.parametrize("name", ["key_overlap_audit", "link_components"])
def test_f15_unknown_parts_make_no_key(spark, without_text, name):
    _same(spark, without_text, name)


@needs_tables
def test_f16_documents_of_unknown_length(spark, without_text):
    _same(spark, without_text, "revised_split")
