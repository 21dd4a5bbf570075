"""Secret scans over an incremental ledger of blobs.

Every version of a path is addressed by the SHA-256 of its text. A ledger table holds the findings of each
(blob, rule set, rule version) that was ever scanned, also of those without any. A run keeps one copy of each blob,
drops the pairs that the ledger knows, scans the rest, appends them, and joins the findings of all blobs back to their
paths. Copies cost one hash each; a new rule version scans all blobs once more, a new document version only itself.

Blobs are made distinct with map-side aggregates, so a blob that a third of the paths share reaches the shuffle a few
times. The append is one Parquet job in a folder of its own; a run that dies leaves no half-written entry behind.

Defined results: null text counts as empty and has no findings; repeated rows each get the findings of their blob; an empty table
scans nothing; further columns of the documents are not carried.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_chunks, text_of

Span = tuple[str, int, int]


def _all(kind: str, pattern: str, accept: Callable[[re.Match], bool] = lambda m: True, flags: int = 0) -> Callable[[str], Iterator[Span]]:
    found = re.compile(pattern, flags)
    return lambda text: ((kind, *m.span()) for m in found.finditer(text) if accept(m))


@dataclass(frozen=True)
class RuleSet:
    """Named finders with a version; a change of a finder needs a new version."""

    name: str
    version: int
    kinds: tuple[str, ...]

    def scan(self, text: str) -> list[Span]:
        return [s for find in FINDERS[self.name, self.version] for s in find(text)]


#: Patterns of each rule set and version; kinds in the order in which they are listed.
FINDERS: dict[tuple[str, int], list[Callable[[str], Iterable[Span]]]] = {
    ("base", 1): [
        _all("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6, re.I | re.A),
        _all("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
        _all("hex", r"[0-9a-f]{24,}"),
    ],
    ("vendor", 1): [
        _all("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
        _all("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
        _all("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ],
}
BASE = RuleSet("base", 1, ("assign", "access", "hex"))
VENDOR = RuleSet("vendor", 1, ("private_key", "code_host", "web_token"))
SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob string, rules string, version int, spans {SPANS}"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger's rows, or None before its first entry."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def addressed(docs: DataFrame, path_col: str = "doc_id") -> DataFrame:
    """``(path, blob, text)``: the blob is the SHA-256 of the UTF-8 text."""
    rows = docs.select(F.col(path_col).alias("path"), text_of().alias("text"))
    return rows.select("path", F.sha2("text", 256).alias("blob"), "text")


def scan_blobs(blobs: DataFrame, rules: list[RuleSet]) -> DataFrame:
    """Ledger rows of ``blobs(blob, text, todo)``; ``todo`` names the positions of the rule sets to apply."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"blob": [], "rules": [], "version": [], "spans": []}
        for blob, text, todo in zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "todo")), strict=True):
            for r in (rules[i] for i in todo):
                spans = [{"kind": k, "start": a, "end": b} for k, a, b in r.scan(text)]
                for c, v in zip(out, (blob, r.name, r.version, spans), strict=True):
                    out[c].append(v)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        types = {"blob": pa.string(), "rules": pa.string(), "version": pa.int32(), "spans": kind}
        return pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in out.items()], names=list(out))

    return map_chunks(blobs.select("blob", "text", "todo"), run, LEDGER)


def update_ledger(docs: DataFrame, folder: str, rules: list[RuleSet], path_col: str = "doc_id") -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it, and return its rows for ``rules``."""
    spark = docs.sparkSession
    blobs = addressed(docs, path_col).drop("path").dropDuplicates(["blob"])
    every = F.array(*[F.lit(i) for i in range(len(rules))])
    known = read_ledger(spark, folder)
    if known is not None:
        case = F.coalesce(*[F.when((F.col("rules") == r.name) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)])
        seen = known.select("blob", case.alias("i")).filter("i IS NOT NULL").groupBy("blob").agg(F.collect_set("i").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<int>"))))
        blobs = blobs.filter(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", every)
    scan_blobs(blobs, rules).write.parquet(f"{folder.rstrip('/')}/{uuid.uuid4().hex}")
    wanted = [(F.col("rules") == r.name) & (F.col("version") == r.version) for r in rules]
    keep = wanted[0]
    for w in wanted[1:]:
        keep = keep | w
    return read_ledger(spark, folder).filter(keep)


def findings(docs: DataFrame, folder: str, rules: list[RuleSet], path_col: str = "doc_id") -> DataFrame:
    """``(path, blob, spans)`` for every row of ``docs``; spans of all rule sets by start, then kind as listed."""
    ledger = update_ledger(docs, folder, rules, path_col)
    order = F.create_map(*[x for i, k in enumerate(k for r in rules for k in r.kinds) for x in (F.lit(k), F.lit(i))])
    rows = ledger.filter(F.size("spans") > 0).select("blob", "rules", "version", "spans").dropDuplicates(["blob", "rules", "version"])
    rows = rows.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # a row for each rule set
    key = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    sorted_ = F.transform(F.sort_array(key), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    paths = addressed(docs, path_col).select("path", "blob")
    return paths.join(rows.select("blob", sorted_.alias("spans")), "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame, folder: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, for every document."""
    rows = findings(docs, folder, [BASE, VENDOR])
    base = rows.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE.kinds)))
    counts = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in BASE.kinds]
    return base.select(F.col("path").alias("doc_id"), *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
