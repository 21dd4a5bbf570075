"""Text rules for keys and profiles."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"
SPACES = r"(?U)[\s\x1c-\x1f]+"
# Characters that NFKC leaves alone in any company and whose casefold is the lower case, but for the sharp s: of Latin, Cyrillic, kana and Han.
BEYOND = (
    r"\u00a1\u00a7\u00ab\u00bb\u00bf-\u012f\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u045f"
    r"\u2013\u2014\u2018-\u201f\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
)
PLAIN = rf"^[\x00-\x7f[{BEYOND}]]*$"  # nested, so that most characters are found at the first test
FOLDED = 256  # texts that are Python strings at once
CYRILLIC = r"[Ѐ-ӿ]"
CJK = r"[一-鿿]"
NON_ASCII = r"[^\x00-\x7f]"
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"  # what SQL's trim takes off
MISSING_TEXT = "missing-report:"
DIGEST = "^[0-9a-f]{64}$"


def _fold_unicode(text: Column) -> Column:
    """NFKC and casefold, which the JVM side lacks. A closure, so workers need no install of this package."""

    def fold(texts: pa.Array) -> pa.Array:
        parts = [
            pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts.slice(i, FOLDED).to_pylist()], pa.string())
            for i in range(0, len(texts), FOLDED)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(fold, T.StringType())(text)


def is_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(BLANK), F.lit(True))


def normalized(text: Column) -> Column:
    """NFKC, casefold, collapsed whitespace. Only texts with other than ``PLAIN`` characters visit Python."""
    folded = F.coalesce(_fold_unicode(F.when(~text.rlike(PLAIN), text)), F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def lowered(text: Column) -> Column:
    """Each character's own lower case, ss for the sharp s, one blank for a run of ASCII white space, none at the ends: the key rule that SQL can state. NULL stays NULL."""
    alone = F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3"))  # else one becomes two characters, the other hangs on its place
    return F.trim(F.regexp_replace(F.replace(F.lower(alone), F.lit("ß"), F.lit("ss")), r"[\t\n\f\r ]+", " "), F.lit(SEPARATORS))


def length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))
