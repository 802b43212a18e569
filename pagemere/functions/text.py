"""Text kernel: folding, quotation normal form, labels.  Plain Python functions, and Arrow-batched UDFs of them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagemere.sources.shared import small_batches

# Quotation marks and dashes that compare alike; note references; marks cut off a quotation's ends.
_ALIKE = str.maketrans("“”„«»‘’‚‹›–—‐‑", "\"\"\"\"\"'''''----")
_SUPERSCRIPT = re.compile("[⁰¹²³⁴-⁹]+")
QUOTE_MARKS = " \"'“”«»"
_BROKEN = re.compile(r"([^\W\d_])[-‐‑]\s*\n\s*([^\W\d_])")


def normalize(text: str) -> str:
    """NFC; no soft hyphens or superscripts; words broken at a line end are joined; lines and blanks become one blank."""
    t = _SUPERSCRIPT.sub("", unicodedata.normalize("NFC", text).replace("\u00ad", ""))
    t = re.sub(r"\s*\n\s*", " ", _BROKEN.sub(r"\1\2", t))
    return re.sub(r"[ \t\u00a0]+", " ", t).strip()


def key(text: str) -> str:
    """Form for comparing, of the same length: a letter whose lower case is longer stays."""
    t = text.translate(_ALIKE)
    if "\u0130" not in t and "\u03a3" not in t:
        return t.lower()
    # the one letter whose lower case is longer, and the one whose lower case hangs on its place
    return "".join(x if len(x := c.lower()) == 1 else c for c in t)


def fold(text: str, mode: str = "a") -> str:
    """Accents and case removed, in one of six ways that are not the same.

    a: NFKD, combining marks dropped, case-folded; b: the same but lower-cased, marks by category M; c: lower-cased,
    then NFKD; d: NFD, only U+0300-U+036F dropped, lower-cased; e: as a, other than a-z, 0-9 and blank to blank;
    f: as a, runs of others to one hyphen, none at the ends.
    """
    if mode == "d":
        return "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f").lower()
    if mode == "c":
        return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    parts = unicodedata.normalize("NFKD", text)
    if mode == "b":
        return "".join(c for c in parts if unicodedata.category(c)[0] != "M").lower()
    t = "".join(c for c in parts if not unicodedata.combining(c)).casefold()
    if mode == "e":
        return re.sub(r"[^a-z0-9 ]", " ", t)
    return re.sub(r"[^a-z0-9]+", "-", t).strip("-") if mode == "f" else t


def bound_batches() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        small_batches(spark)


def let(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _column(f):
    bound_batches()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def folded(c: Column, mode: str = "a") -> Column:
    return _column(lambda t: fold(t, mode))(c)


def normalized(c: Column) -> Column:
    return _column(normalize)(c)


def keyed(c: Column) -> Column:
    return _column(lambda t: key(normalize(t)))(c)


def quotation(c: Column) -> Column:
    """A captured passage as it is kept: no soft hyphens or note numbers, broken words joined, lines and blanks one blank.

    Not the matcher's ``normalize``: characters aren't composed, and any letter joins.
    """
    out = F.regexp_replace(F.replace(c, F.lit("\u00ad"), F.lit("")), "[\u2070\u00b9\u00b2\u00b3\u2074-\u2079]+", "")
    out = F.regexp_replace(out, r"(\p{L})[-\u2010\u2011]\s*\n\s*(\p{L})", "$1$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\s*\n\s*", " "), "[ \t\u00a0]+", " "), r"^\s+|\s+$", "")


def file_key(c: Column) -> Column:
    """A file name composed, trimmed and case-folded; for comparing only."""
    return _column(lambda t: unicodedata.normalize("NFC", t).strip().casefold())(c)


def word_forms(query: str) -> list[str]:
    """Java patterns, one a form: forms are parted by commas, folded, at least two letters, and begin a word."""
    out: list[str] = []
    for part in query.split(","):
        t = re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", fold(part))).strip()
        if len(t) >= 2 and t not in out:
            out.append(t)
    return [r"(?<![\p{L}\p{N}_])" + t.replace(" ", r"\s+") for t in out]


def percent_label(matched: Column, length: Column) -> Column:
    """``close (96%)``, half to even."""
    return F.concat(F.lit("close ("), F.bround(matched * 100 / length, 0).cast("int").cast("string"), F.lit("%)"))


def _weighted(x: Column, n: int, weight) -> Column:
    """Sum over the first n characters of digit times weight(place from 0); null where one isn't a digit."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0), lambda s, i: s + x.substr(i + 1, F.lit(1)).try_cast("int") * weight(i))


def isbn13(c: Column) -> Column:
    """Canonical ISBN-13 of a valid ISBN-10 or -13, else null; X only in the last place of ten."""
    return let(F.upper(F.regexp_replace(c, r"[^\dXx]", "")), _isbn13)


def _isbn13(raw: Column) -> Column:
    def three(i):
        return 1 + 2 * F.pmod(i, F.lit(2))

    def whole(body: Column) -> Column:
        check = F.pmod(10 - F.pmod(_weighted(body, 12, three), F.lit(10)), F.lit(10))
        return F.concat(body, check.cast("string"))

    last = F.when(F.substring(raw, 10, 1) == "X", 10).otherwise(F.substring(raw, 10, 1).try_cast("int"))
    good10 = (F.length(raw) == 10) & (F.pmod(_weighted(raw, 9, lambda i: 10 - i) + last, F.lit(11)) == 0)
    good13 = (F.length(raw) == 13) & (F.pmod(_weighted(raw, 13, three), F.lit(10)) == 0)
    return F.when(good13, raw).when(good10, let(F.concat(F.lit("978"), F.substring(raw, 1, 9)), whole))


def uninvert(name: Column) -> Column:
    """``Last, First`` to ``First Last`` where there is exactly one comma."""
    parts = F.split(name, ",")
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(name)
