"""Text keys, duplicates, components and leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage as L
from .base import FOLDS, TARGETS, documents, folds, groups, members, query, table, targets


@query("SELECT id, group_id FROM groups", uses="groups")
def text_group_key(spark, sf):
    return groups(spark, sf)


@query("""
    WITH m AS (SELECT g.group_id, g.id, max((t.value IS NOT NULL)::INT) AS labeled FROM groups g JOIN targets t ON t.id = g.id GROUP BY g.group_id, g.id),
    s AS (SELECT group_id, count(*) AS n, min(labeled) AS lo, max(labeled) AS hi FROM m GROUP BY group_id),
    c AS (SELECT group_id, max((hi > lo)::INT) AS conflict FROM (SELECT g.group_id, t.target, max(t.value) AS hi, min(t.value) AS lo
          FROM groups g JOIN targets t ON t.id = g.id GROUP BY g.group_id, t.target) GROUP BY group_id)
    SELECT count(*) FILTER (WHERE n > 1) AS duplicate_groups, COALESCE(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS ids_in_duplicate_groups,
           max(n) AS largest_group, count(*) FILTER (WHERE lo <> hi) AS groups_mixing_labeled, count(*) FILTER (WHERE conflict = 1) AS groups_conflicting
    FROM s JOIN c USING (group_id)""", uses="groups targets")
def duplicate_groups(spark, sf):
    return L.duplicate_groups(members(spark, sf), targets(spark, sf), TARGETS)


def joined(*parts: str | F.Column) -> F.Column:
    """``a:b:c``, and NULL where a part is unknown: what is not known links no documents."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(cols[0], *[x for c in cols[1:] for x in (F.lit(":"), c.cast("string"))])


def link_keys(spark, sf):
    """Documents share a key by normalized text, or by language, source and length."""
    docs = table(spark, sf, "documents")
    shape = joined("lang", "source", "n_chars")
    return groups(spark, sf).select(F.lit("text").alias("kind"), "id", F.col("group_id").alias("key")).unionByName(
        docs.select(F.lit("shape").alias("kind"), F.col("doc_id").alias("id"), F.sha2(shape, 256).alias("key"))
    )


LINK_KEYS = """
    SELECT 'text' AS kind, id, group_id AS key FROM groups
    UNION ALL SELECT 'shape', doc_id, sha256(lang || ':' || source || ':' || n_chars) FROM documents"""


@query(f"""
    WITH RECURSIVE k AS ({LINK_KEYS}), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.kind = b.kind AND a.key = b.key),
    reach(id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.label FROM reach r JOIN e ON e.a = r.id WHERE r.label < e.b)
    SELECT id, min(label) AS component FROM reach GROUP BY id""", uses="groups")
def link_components(spark, sf):
    return L.link_components(documents(spark, sf), link_keys(spark, sf))


def audit_ids(spark, sf):
    """Documents with their split: German ones stand for the test side; gold means labeled."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("g"))
    rows = docs.join(folds(spark, sf).select("id", "fold"), "id").join(gold, "id", "left")
    test = F.col("lang") == "de"
    return rows.select("id", F.when(test, "test").otherwise("train").alias("split"), F.when(~test, F.col("fold")).alias("fold"), (F.col("g").isNotNull() & ~test).alias("gold"))


def audit_keys(spark, sf):
    docs = table(spark, sf, "documents")
    size = F.when(F.col("n_chars") < 40, F.lit("")).otherwise(F.sha2(joined("source", F.floor(F.col("n_chars") / 64)), 256))
    head = F.when(F.col("lang") != "fr", F.sha2(F.col("source"), 256))
    return link_keys(spark, sf).unionByName(docs.select(F.lit("size").alias("kind"), F.col("doc_id").alias("id"), size.alias("key"))).unionByName(
        docs.select(F.lit("size").alias("kind"), F.col("doc_id").alias("id"), head.alias("key"))
    )


_METRICS = [
    "unique_keys", "multi_study_groups", "largest_group_studies", "cross_fold_groups", "cross_fold_groups_touching_gold", "cross_fold_gold_to_gold_groups",
    "train_test_groups", "studies_with_key", "studies_with_multiple_keys", "cross_fold_train_studies", "cross_fold_gold_studies", "train_test_studies",
    "train_test_gold_studies", "fold_0_studies_with_key", "fold_1_studies_with_key", "fold_2_studies_with_key",
]


@query(f"""
    WITH ids AS (SELECT d.doc_id AS id, lang = 'de' AS test, CASE WHEN lang <> 'de' THEN fold END AS fold, l.doc_id IS NOT NULL AND lang <> 'de' AS gold
                 FROM documents d JOIN folds f ON f.id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
    k AS (SELECT DISTINCT kind, id, key FROM ({LINK_KEYS}
          UNION ALL SELECT 'size', doc_id, CASE WHEN n_chars < 40 THEN '' ELSE sha256(source || ':' || (n_chars // 64)) END FROM documents
          UNION ALL SELECT 'size', doc_id, CASE WHEN lang <> 'fr' THEN sha256(source) END FROM documents) WHERE key IS NOT NULL AND key <> ''),
    u AS (SELECT k.*, i.test, i.fold, i.gold FROM k JOIN ids i ON i.id = k.id),
    g AS (SELECT kind, key, count(*) AS n, count(DISTINCT fold) > 1 AS cross_, count(DISTINCT CASE WHEN gold THEN fold END) > 1 AS gcross,
                 bool_or(gold) AS has_gold, bool_or(test) AND bool_or(NOT test) AS tt FROM u GROUP BY kind, key),
    a AS (SELECT kind, count(*) AS unique_keys, count(*) FILTER (WHERE n > 1) AS multi_study_groups, max(n) AS largest_group_studies,
                 count(*) FILTER (WHERE cross_) AS cross_fold_groups, count(*) FILTER (WHERE cross_ AND has_gold) AS cross_fold_groups_touching_gold,
                 count(*) FILTER (WHERE gcross) AS cross_fold_gold_to_gold_groups, count(*) FILTER (WHERE tt) AS train_test_groups FROM g GROUP BY kind),
    s AS (SELECT u.kind, u.id, count(*) AS k, bool_or(NOT u.test) AS train, bool_or(u.gold) AS gold, max(u.fold) AS fold, bool_or(g.cross_) AS cross_, bool_or(g.tt) AS tt
          FROM u JOIN g ON g.kind = u.kind AND g.key = u.key GROUP BY u.kind, u.id),
    b AS (SELECT kind, count(*) AS studies_with_key, count(*) FILTER (WHERE k > 1) AS studies_with_multiple_keys,
                 count(*) FILTER (WHERE cross_ AND train) AS cross_fold_train_studies, count(*) FILTER (WHERE cross_ AND gold) AS cross_fold_gold_studies,
                 count(*) FILTER (WHERE tt) AS train_test_studies, count(*) FILTER (WHERE tt AND gold) AS train_test_gold_studies,
                 count(*) FILTER (WHERE fold = 0) AS fold_0_studies_with_key, count(*) FILTER (WHERE fold = 1) AS fold_1_studies_with_key,
                 count(*) FILTER (WHERE fold = 2) AS fold_2_studies_with_key FROM s GROUP BY kind)
    SELECT kind, metric, value FROM (SELECT * FROM a JOIN b USING (kind)) UNPIVOT (value FOR metric IN ({', '.join(_METRICS)}))""", uses="groups folds")
def key_overlap_audit(spark, sf):
    return L.key_overlap_audit(audit_keys(spark, sf), audit_ids(spark, sf), FOLDS)


HEADER_FIELDS = {"patient": ["o_custkey"], "issuer": ["o_orderpriority"], "pair": ["o_custkey", "o_orderpriority"]}
_PATIENT = """sha256('["' || o_custkey || '"]')"""


@query(f"""
    SELECT o_orderkey, {_PATIENT} AS patient, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE sha256('["' || o_orderpriority || '"]') END AS issuer,
           CASE WHEN o_orderpriority = '5-LOW' THEN sha256('["' || o_custkey || '", ""]') ELSE sha256('["' || o_custkey || '", "' || o_orderpriority || '"]') END AS pair
    FROM orders""")
def pseudonymized_keys(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"))
    return L.pseudonymize(rows, HEADER_FIELDS, {"pair": "o_custkey"}).select("o_orderkey", "patient", "issuer", "pair")


@query("""
    SELECT 'keys_without_issuer' AS metric, count(*) AS value FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT 'ids_with_multiple_issuers', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderpriority <> '5-LOW'
      GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1)""")
def identifier_reliability(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"))
    return L.identifier_reliability(L.pseudonymize(rows, HEADER_FIELDS), "patient", "pair", "issuer")


@query("""
    WITH c AS (SELECT id, min(id) OVER (PARTITION BY key) AS component FROM (SELECT doc_id AS id, source || ':' || (n_chars // 16) AS key FROM documents)),
    x AS (SELECT f.id, f.group_id, f.n_chars % 3 AS fold, c.component, f.lang = 'es' AS gold FROM (
            SELECT g.id, g.group_id, d.n_chars, d.lang FROM groups g JOIN documents d ON d.doc_id = g.id) f JOIN c ON c.id = f.id),
    h AS (SELECT component, COALESCE(min(fold) FILTER (WHERE gold), min(fold)) AS home FROM x GROUP BY component)
    SELECT x.id, x.group_id, x.fold::INT AS fold, h.home::INT AS revised_fold, x.fold <> h.home AS moved FROM x JOIN h ON h.component = x.component
""", uses="groups")
def revised_split(spark, sf):
    """Lengths and sources link documents by chance, so at size some components hold Spanish rows of several folds; they go to the least of these."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "source", "lang")
    split = groups(spark, sf).join(docs, "id").select("id", "group_id", (F.col("n_chars") % 3).cast("int").alias("fold"))
    key = F.coalesce(joined("source", F.floor(F.col("n_chars") / 16)), F.lit(""))  # unknown ones stand together
    keyed = docs.select("id", key.alias("key"))
    parts = keyed.join(keyed.groupBy("key").agg(F.min("id").alias("component")), "key").select("id", "component")
    return L.revise_split(split, parts, docs.filter("lang = 'es'"), move_gold=True)


@query("""
    WITH c AS (SELECT e.label AS key, i.pos, e.embedding[i.pos] AS x FROM embeddings e CROSS JOIN range(1, 65) i(pos))
    SELECT key, max(n) AS members, round(max(d), 5) AS max_abs_diff, max(d) = 0 AS identical FROM (
      SELECT key, pos, count(*) AS n, (max(x) - min(x))::DOUBLE AS d FROM c GROUP BY key, pos) GROUP BY key HAVING max(n) > 1""")
def vector_duplicates(spark, sf):
    e = table(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = L.vector_duplicate_check(vectors, e.select(F.col("vec_id").alias("id"), F.col("label").alias("key")))
    return out.withColumn("max_abs_diff", F.round(F.col("max_abs_diff").cast("double"), 5))
