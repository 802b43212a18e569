"""Citations as Column expressions: bibliography in three styles, footnote, short note, italic runs, page marks.

``with_container`` gives works the columns that a citation reads; a container's come with the prefix ``c_``.  A citation
is an array of pieces of which the missing are left out with their punctuation, joined.  Italics stand between asterisks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemere.functions.text import uninvert

from .rules import blank

# Styles; kinds whose titles are quoted; words that a short title drops or stops before.
CHICAGO, CHICAGO_18, MLA = "chicago", "chicago18", "mla"
QUOTED = ("essay", "chapter", "poem")
LEADING = ("the", "a", "an", "el", "la", "los", "las", "lo", "un", "una")
BREAKS = tuple("de del en e y o u el la los las por para con sobre entre a al of in and or the on for to from at as an".split())
_TEXTS = ("title", "subtitle", "author", "editor", "translator", "edition", "volume", "series", "publisher", "place", "kind")
_NUMBERS = ("year", "original_year", "first_page", "last_page")


def with_container(works: DataFrame) -> DataFrame:
    """Works with every column that a citation may read, null where the table has none, and their container's."""
    lacking = {n: F.lit(None).cast("string" if n in _TEXTS else "int") for n in (*_TEXTS, *_NUMBERS) if n not in works.columns}
    w = works.withColumns(lacking)
    c = w.select(F.col("id").alias("c_id"), *(F.col(n).alias(f"c_{n}") for n in (*_TEXTS, *_NUMBERS)))
    return w.join(c, F.col("container_id") == F.col("c_id"), "left")


def _has(name: str) -> Column:
    return F.col(name).isNotNull()


def _text(*parts: Column | str) -> Column:
    """The parts as one text; null if one of them is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _join(parts: list[Column], between: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), between)


def _stop(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"[.!?]$"), t).otherwise(_text(t, "."))


def _comma(c: Column) -> Column:
    return _text(F.regexp_replace(F.trim(c), ",$", ""), ",")


def _full_title(prefix: str = "") -> Column:
    return F.concat_ws(": ", F.col(f"{prefix}title"), blank(F.col(f"{prefix}subtitle")))


def _title(end: str = "", quoted_end: str | None = None) -> Column:
    """A quoted title has its mark inside the quotation marks."""
    inside = end if quoted_end is None else quoted_end
    return F.when(F.col("kind").isin(*QUOTED), _text('"', _full_title(), inside, '"')).otherwise(_text("*", _full_title(), "*", end))


def _people(lead: str, name: str, end: str) -> Column:
    return _text(lead, uninvert(blank(F.col(name))), end)


def _imprint(style: str) -> Column:
    """House and year of the container alone where there is one; only the 17th edition of Chicago prints the place."""
    own = {n: F.when(_has("c_id"), F.col(f"c_{n}")).otherwise(F.col(n)) for n in ("place", "publisher", "year")}
    publisher = blank(own["publisher"])
    house = F.coalesce(F.concat_ws(": ", blank(own["place"]), publisher), F.lit("")) if style == CHICAGO else publisher
    return _join([house, own["year"].cast("string")], ", ")


def _either(essay: Column, own: Column) -> Column:
    return F.when(_has("c_id"), essay).otherwise(own)


def _span() -> Column:
    return F.concat_ws("–", F.col("first_page").cast("string"), F.when(_has("first_page"), F.col("last_page").cast("string")))


def _nobody(role: str) -> Column:
    return F.coalesce(_stop(blank(F.col("author"))), _text(blank(F.col("editor")), role))


def _chicago(style: str) -> Column:
    film = [_text(blank(F.col("author")), ", dir."), _text("*", _full_title(), "*."), _text(F.col("year"), ".")]
    house = F.nullif(_imprint(style), F.lit(""))
    parts = [
        _nobody(", ed."),
        _title("."),
        _text(F.col("original_year"), "."),
        F.when(_has("c_id"), _text("In *", _full_title("c_"), "*,")),
        _either(_people("edited by ", "c_editor", ","), _people("Translated by ", "translator", ".")),
        _either(_people("translated by ", "c_translator", ","), F.when(blank(F.col("author")).isNotNull(), _people("Edited by ", "editor", "."))),
        _either(_text(F.nullif(_span(), F.lit("")), "."), _stop(blank(F.col("edition")))),
        _either(_stop(blank(F.col("c_volume"))), _stop(blank(F.col("volume")))),
        F.when(~_has("c_id"), _stop(blank(F.col("series")))),
        _text(house, "."),
        F.coalesce(_text("Accessed ", blank(F.col("accessed")), ". ", blank(F.col("url")), "."), _text(blank(F.col("url")), ".")),
    ]
    return F.when(F.col("kind") == "film", _join(film, " ")).otherwise(_join(parts, " "))


def _mla() -> Column:
    film = [_text("*", _full_title(), "*."), _people("Directed by ", "author", ","), _text(F.col("year"), ".")]
    parts = [
        _nobody(", editor."),
        _title("."),
        F.when(_has("c_id"), _text("*", _full_title("c_"), "*,")),
        _either(_people("edited by ", "c_editor", ","), _people("Translated by ", "translator", ",")),
        _either(_people("translated by ", "c_translator", ","), F.when(blank(F.col("author")).isNotNull(), _people("edited by ", "editor", ","))),
        _either(_comma(blank(F.col("c_edition"))), _comma(blank(F.col("edition")))),
        _either(_comma(blank(F.col("c_volume"))), _comma(blank(F.col("volume")))),
        _text(F.nullif(_imprint(MLA), F.lit("")), ","),
        F.when(_has("c_id"), _text("pp. ", F.nullif(_span(), F.lit("")), ",")),
    ]
    online = [_text(blank(F.col("url")), "."), F.when(blank(F.col("url")).isNotNull(), _text("Accessed ", blank(F.col("accessed")), "."))]
    return F.when(F.col("kind") == "film", _join(film, " ")).otherwise(_join([F.regexp_replace(_join(parts, " "), ",$", "."), *online], " "))


def bibliography(style: str = CHICAGO) -> Column:
    return _mla() if style == MLA else _chicago(style)


def _ending(head: Column, page: Column) -> Column:
    return F.coalesce(_text(head, ", ", page, "."), _text(head, "."))


def footnote(page: Column, style: str = CHICAGO) -> Column:
    """Names as spoken, imprint in brackets, the page at the end if there is one."""
    inside = F.concat_ws("", _title("", ","), _text(" in *", _full_title("c_"), "*"))
    parts = [
        F.coalesce(uninvert(blank(F.col("author"))), _people("", "editor", ", ed.")),
        _either(inside, _title()),
        _either(_people("trans. ", "c_translator", ""), _people("trans. ", "translator", "")),
        F.when(~_has("c_id"), F.trim("edition")),
        _text("(", F.nullif(_imprint(style), F.lit("")), ")"),
    ]
    return _ending(_join(parts, ", "), page)


def short_title(title: Column) -> Column:
    """Without a leading article; of more than four words those before the first small word after the second, else four."""
    words = F.split(F.trim(title), r"\s+")
    words = F.when((F.size(words) > 1) & F.lower(words[0]).isin(*LEADING), F.slice(words, 2, 10_000)).otherwise(words)
    small = F.array_position(F.transform(words, lambda w, i: (i >= 2) & F.lower(w).isin(*BREAKS)), F.lit(True))
    kept = F.when(F.size(words) <= 4, F.size(words)).when(small > 0, (small - 1).cast("int")).otherwise(4)
    return F.array_join(F.slice(words, 1, kept), " ")


def short_note(page: Column) -> Column:
    """Surname, short title, page: for every note after the first."""
    name = F.trim(F.coalesce(blank(F.col("author")), blank(F.col("editor"))))
    who = F.when(name.contains(","), F.trim(F.split(name, ",")[0])).otherwise(F.element_at(F.split(name, r"\s+"), -1))
    short = short_title(F.col("title"))
    title = F.when(F.col("kind").isin(*QUOTED), _text('"', short, '"')).otherwise(_text("*", short, "*"))
    return _ending(F.concat_ws(", ", who, title), page)


def mark_page(citation: Column, page: Column) -> Column:
    """An asterisk before the last full stop, only where the citation ends with the page."""
    tail = _text(", ", page, ".")
    return F.when(citation.endswith(tail), _text(F.substring(citation, 1, F.length(citation) - 1), "*.")).otherwise(citation)


def html(citation: Column) -> Column:
    """Italic runs as elements, the rest escaped."""
    safe = F.replace(F.replace(F.replace(citation, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, r"\*([^*]+)\*", "<i>$1</i>")


def plain(citation: Column) -> Column:
    return F.replace(citation, F.lit("*"), F.lit(""))
