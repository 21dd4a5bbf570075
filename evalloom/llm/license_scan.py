"""License scans by ordered signature rules, with DataFrame functions alone.

A signature is a regular expression over the lower-case words of a text, joined by one space; one of its words, the anchor, is written
``<word>`` and occurs in every match. Keyword prefilter: a text is split once, the places of anchors are found by a set lookup of each word, and only
the words within ``REACH`` of such a place are joined with the rules of that anchor; before its expression is tried, a rule's second
keyword must be in those words too. So most words meet no rule, and no rule meets a whole text.

Detections overlap: "released under the GNU Lesser General Public License, version 3" also holds shorter signatures. A detection
goes when another one contains it whose level is more telling, or equal and the other is longer, or, on the same words, listed earlier. All earlier
detections in the order (start, longest first, level, rule) start no later, so a running maximum of their ends for each level decides. Base phrases
are reported wherever they stand, contained or not.

The rule table is built from families of licenses, forms of naming them and their versions; its size is fixed, so it is broadcast. Detections, not
texts, are shuffled, by hashes of (doc_id, text).

Defined results: null and empty texts have no words, no labels and the score 0; a text of any length is scanned whole; of rules that match the same
words at the same level the first listed wins; repeated rows each get their result; an empty table gives an empty table; further columns are not carried.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, saved, text_of
from .decontaminate import words_of

REACH = 24  # words on each side of an anchor that an expression can span

# Names of licenses with the anchor in angle brackets, and their versions.
LICENSE = "licen[sc]e"
FAMILIES: list[tuple[str, str, list[str]]] = [
    ("apache", f"<apache>(?: software)?(?: {LICENSE})?", ["1.0", "1.1", "2.0"]),
    ("mit", f"mit <{LICENSE}>", []),
    ("isc", f"isc <{LICENSE}>", []),
    ("zlib", f"zlib(?: libpng)? <{LICENSE}>", []),
    ("unlicense", "(?:the )?<unlicense>", []),
    ("bsd-0-clause", f"(?:zero|0) clause <bsd>(?: {LICENSE})?", []),
    ("bsd-2-clause", f"(?:(?:two|2) clause|simplified|freebsd) <bsd>(?: {LICENSE})?", []),
    ("bsd-3-clause", f"(?:(?:three|3) clause|new|modified|revised) <bsd>(?: {LICENSE})?", []),
    ("bsd-4-clause", f"(?:(?:four|4) clause|original) <bsd>(?: {LICENSE})?", []),
    ("bsd", f"<bsd>(?: style)? {LICENSE}", []),
    ("gpl", f"(?:gnu )?general public <{LICENSE}>", ["1", "2", "3"]),
    ("gpl", "(?:gnu )?<gpl>", ["1", "2", "3"]),
    ("lgpl", f"(?:gnu )?lesser general public <{LICENSE}>", ["2.1", "3"]),
    ("lgpl", f"(?:gnu )?library general public <{LICENSE}>", ["2"]),
    ("lgpl", "(?:gnu )?<lgpl>", ["2", "2.1", "3"]),
    ("agpl", f"(?:gnu )?affero general public <{LICENSE}>", ["1", "3"]),
    ("agpl", "(?:gnu )?<agpl>", ["1", "3"]),
    ("gfdl", f"(?:gnu )?free documentation <{LICENSE}>", ["1.1", "1.2", "1.3"]),
    ("mpl", f"mozilla public <{LICENSE}>", ["1.0", "1.1", "2.0"]),
    ("mpl", "<mpl>", ["1.0", "1.1", "2.0"]),
    ("epl", f"eclipse public <{LICENSE}>", ["1.0", "2.0"]),
    ("epl", "<epl>", ["1.0", "2.0"]),
    ("cpl", f"common public <{LICENSE}>", ["1.0"]),
    ("cddl", f"common development and distribution <{LICENSE}>", ["1.0", "1.1"]),
    ("cddl", "<cddl>", ["1.0", "1.1"]),
    ("eupl", f"european union public <{LICENSE}>", ["1.0", "1.1", "1.2"]),
    ("eupl", "<eupl>", ["1.0", "1.1", "1.2"]),
    ("artistic", f"artistic <{LICENSE}>", ["1.0", "2.0"]),
    ("bsl", f"boost software <{LICENSE}>", ["1.0"]),
    ("busl", f"business source <{LICENSE}>", ["1.1"]),
    ("afl", f"academic free <{LICENSE}>", ["2.1", "3.0"]),
    ("osl", f"open software <{LICENSE}>", ["1.0", "2.1", "3.0"]),
    ("ofl", f"(?:sil )?open font <{LICENSE}>", ["1.0", "1.1"]),
    ("psf", f"python(?: software foundation)? <{LICENSE}>", ["2"]),
    ("php", f"php <{LICENSE}>", ["3.0", "3.01"]),
    ("postgresql", f"postgresql <{LICENSE}>", []),
    ("openssl", f"openssl <{LICENSE}>", []),
    ("ms-pl", f"microsoft public <{LICENSE}>", []),
    ("ms-rl", f"microsoft reciprocal <{LICENSE}>", []),
    ("sspl", f"server side public <{LICENSE}>", ["1"]),
    ("sspl", "<sspl>", ["1"]),
    ("elastic", f"elastic <{LICENSE}>", ["1.0", "2.0"]),
    ("odbl", f"open database <{LICENSE}>", ["1.0"]),
    ("wtfpl", "<wtfpl>", ["1", "2"]),
    ("cc0", "<cc0>", ["1.0"]),
    ("cc0", "creative <commons> zero", ["1.0"]),
]
COMMONS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
COMMONS_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativ)e?s?(?: works)?"}
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: (label, signature, second keyword) of notices that name no license.
NOTICES: list[tuple[str, str, str]] = [
    ("mit-text", "permission is hereby <granted> free of charge to any person obtaining a copy", "obtaining"),
    ("isc-text", "permission to use copy modify and or <distribute> this software for any purpose", "purpose"),
    ("bsd-text", "<redistribution> and use in source and binary forms with or without modification", "binary"),
    ("gpl-text", "this program is free software you can <redistribute> it and or modify it", "program"),
    ("mpl-text", f"this source code form is subject to the terms of the mozilla public <{LICENSE}>", "mozilla"),
    ("no-warranty", "provided as is without (?:any )?<warranty> of any kind", "without"),
    ("public-domain", "(?:in|into|to) the public <domain>", "public"),
    ("proprietary", "<proprietary> and confidential", "confidential"),
    ("proprietary", "confidential and <proprietary>", "confidential"),
    ("no-redistribution", "<unauthori[sz]ed> (?:copying|reproduction|distribution|use)", "un"),
    ("copyright", "<copyright> c [0-9]+", " c "),
]
#: (label, phrase) that are found wherever their words stand.
BASE: list[tuple[str, str]] = [("cc-by", "<cc> by"), ("gpl", "general public <license>"), ("reserved", "all rights <reserved>")]

UNDER = "(?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"
VERSION = "(?: version| v)?"
LATER = "(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later"
#: How telling each level is, the most telling first.
CONFIDENCE = [1.0, 0.99, 0.95, 0.9, 0.7, 0.6, 0.5]
SPDX, STATED_VERSION, VERSIONED, STATED, NAMED, NOTICE, PHRASE = range(7)


def _needs(name: str, otherwise: str) -> str:
    """A second keyword: for names around the common anchor their longest plain word, else that of the form."""
    if f"<{LICENSE}>" not in name:
        return otherwise
    plain = re.sub(r"\(\?:[^()]*\)\??", " ", name.replace(f"<{LICENSE}>", "")).split()
    return max(plain, key=len)


def signatures() -> list[tuple[int, str, int, bool, str, str, str]]:
    """Rules ``(rule, label, level, base, keyword, needs, pattern)`` in order; expressions are matched between spaces."""
    made: list[tuple[str, int, bool, str, str]] = []  # label, level, base, needs, pattern

    def family(label: str, name: str, versions: list[str]) -> None:
        for v in versions:
            number = f"v?{v.replace('.', ' ')}"
            if v.endswith(".0"):
                number = f"{number[:-2]}(?: 0)?"
            if "gpl" in label:
                made.append((f"{label}-{v}-or-later", STATED_VERSION, False, _needs(name, "later"), f"(?:{UNDER})?{name}{VERSION} {number}{LATER}"))
            made.append((f"{label}-{v}", STATED_VERSION, False, _needs(name, "under"), f"{UNDER}{name}{VERSION} {number}"))
            made.append((f"{label}-{v}", VERSIONED, False, _needs(name, v.split(".")[0]), f"{name}{VERSION} {number}"))
        made.append((label, STATED, False, _needs(name, "under"), UNDER + name))
        whole = name.replace(f"(?: {LICENSE})?", f" {LICENSE}")
        if LICENSE in whole:  # a bare abbreviation tells nothing
            made.append((label, NAMED, False, _needs(name, "licen"), whole))

    for label, name, versions in FAMILIES:
        family(label, name, versions)
    for label in sorted({f[0] for f in FAMILIES}):
        for v in sorted({v for f in FAMILIES if f[0] == label for v in f[2]}) or [""]:
            words = label.split("-") + (v.split(".") if v else [])
            made.append((f"{label}-{v}" if v else label, SPDX, False, words[0], f"<spdx> {LICENSE} identifier {' '.join(words)}"))
    for short in COMMONS:
        parts = short.split("-")
        label, words = f"cc-{short}", " ".join(COMMONS_WORDS[p] for p in parts)
        family(label, f"<cc> {' '.join(parts)}", COMMONS_VERSIONS)
        family(label, f"creative <commons> {words}(?: international| unported)?(?: public)?(?: {LICENSE})?", COMMONS_VERSIONS)
        made.append((label, NAMED, False, "by", f"<cc> {' '.join(parts)}"))
        made.append((label, STATED, False, "licenses", f"<creativecommons> org licenses {' '.join(parts)}"))
    made += [(label, NOTICE, False, needs, pattern) for label, pattern, needs in NOTICES]
    made += [(label, PHRASE, True, "", pattern) for label, pattern in BASE]
    rules = []
    for i, (label, level, base, needs, pattern) in enumerate(made):
        anchor = pattern[pattern.index("<") + 1 : pattern.index(">")]
        spelled = re.split(r"\[(.)(.)\]", anchor)  # one word, or two spellings of it
        for word in [anchor] if len(spelled) == 1 else [spelled[0] + c + spelled[3] for c in spelled[1:3]]:
            rules.append((i, label, level, base, word, needs, f" ({pattern}) "))
    return rules


def rule_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({i}, '{label}', {level}, {str(base).lower()}, '{word}', '{needs}', '{pattern}')" for i, label, level, base, word, needs, pattern in signatures())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, label, level, base, keyword, needs, pattern)")


def contexts(docs: DataFrame, keywords: list[str]) -> DataFrame:
    """``(doc_id, key_a, key_b, n_words, near)``; ``near`` lists place, keyword and the words around it, the keyword in brackets."""
    text = text_of()
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), text), words_of(text).alias("w"))
    listed = ", ".join(f"'{k}'" for k in sorted(keywords))
    rows = rows.withColumn("at", F.expr(f"filter(transform(w, (x, i) -> if(x IN ({listed}), i, -1)), i -> i >= 0)"))
    around = f"""concat(' ', array_join(concat(slice(w, greatest(i - {REACH}, 0) + 1, least(i, {REACH})), array(concat('<', get(w, i), '>')), slice(w, i + 2, {REACH})), ' '), ' ')"""
    near = F.expr(f"transform(at, i -> struct(i AS at, get(w, i) AS keyword, {around} AS words))")
    return rows.select("doc_id", "key_a", "key_b", F.size("w").cast("long").alias("n_words"), near.alias("near"))


def detections(near: DataFrame) -> DataFrame:
    """``(key_a, key_b, start, end, rule, label, level, base, kept)`` of the rows of ``contexts``, each once; ``kept`` tells what no other contains."""
    rules, key = F.broadcast(rule_table(near.sparkSession)), ["key_a", "key_b"]
    met = near.select(*key, F.inline("near")).join(rules, "keyword").filter("contains(words, needs)")
    met = met.withColumn("m", F.expr("regexp_extract(words, pattern, 1)")).filter("m <> ''")
    start = F.col("at") - (F.size(F.split(F.substring_index("m", "<", 1), " ")) - 1)
    spans = met.select(*key, start.cast("long").alias("start"), (start + F.size(F.split("m", " "))).cast("long").alias("end"), "rule", "label", "level", "base").distinct()
    before = Window.partitionBy(*key).orderBy("start", F.desc("end"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    contained = F.lit(False)
    for level in range(len(CONFIDENCE)):
        reach = F.max(F.when(F.col("level") <= level, F.col("end"))).over(before)
        contained = F.when(F.col("level") == level, F.coalesce(reach >= F.col("end"), F.lit(False))).otherwise(contained)
    return spans.select("*", (~contained | F.col("base")).alias("kept"))


def scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The saved rows of ``contexts``, and ``detections`` of them."""
    near = saved(contexts(docs, sorted({r[4] for r in signatures()})))
    return near, detections(near.filter(F.size("near") > 0))


def license_digests(docs: DataFrame) -> DataFrame:
    """Word count, base phrases, labels and score of every document; the score is that of its most telling detection."""
    near, found = scanned(docs)
    key, base = ["key_a", "key_b"], F.col("base")
    sure = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("level") + 1)
    told = found.filter("kept").groupBy(*key).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(sure).alias("score"),
    )
    rows = near.select("doc_id", *key, "n_words").join(told, key, "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
