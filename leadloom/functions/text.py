"""Normalisation of text, domains, phone numbers and e-mail addresses, as column expressions.

Arguments are columns or names; a null counts as an empty string, as the results do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def _text(x: ColumnOrName) -> Column:
    return F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))


def normalize_text(x: ColumnOrName) -> Column:
    """Control characters become spaces, runs of white space one space, ends are trimmed."""
    spaced = F.regexp_replace(_text(x), r"[\x00-\x1f\x7f]", " ")
    return F.btrim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def normalize_form(x: ColumnOrName) -> Column:
    """The lighter form for intake fields: trimmed, white space collapsed."""
    return F.btrim(F.regexp_replace(_text(x), r"(?U)\s+", " "))


def first_filled(*xs: ColumnOrName) -> Column:
    """The first value that isn't null or empty; blanks count as filled. Else an empty string."""
    return F.coalesce(*[F.nullif(_text(x), F.lit("")) for x in xs], F.lit(""))


def slugify(x: ColumnOrName) -> Column:
    kept = F.regexp_replace(F.lower(_text(x)), r"[^a-z0-9\s.-]", "")
    dashed = F.regexp_replace(F.regexp_replace(F.btrim(kept), r"\s+", "-"), r"-+", "-")
    return F.regexp_replace(dashed, r"^-|-$", "")


def normalize_domain(x: ColumnOrName) -> Column:
    """Host without www.; what isn't a URL loses scheme, www., path and port as text."""
    raw = F.lower(normalize_text(x))
    url = F.when(raw.startswith("http://") | raw.startswith("https://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.try_parse_url(url, F.lit("HOST"))
    bare = F.regexp_replace(F.regexp_replace(raw, r"^https?://", ""), r"^www\.", "")
    fallback = F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return F.when(raw == "", F.lit("")).otherwise(F.coalesce(F.regexp_replace(host, r"^www\.", ""), fallback))


def normalize_phone(x: ColumnOrName) -> Column:
    raw = F.regexp_replace(normalize_text(x), r"[^0-9+]", "")
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    n = F.length(digits)
    plus = F.concat(F.lit("+"), digits)
    return F.when(raw.startswith("+"), raw).when((n == 11) & digits.startswith("1"), plus).when(n == 10, F.concat(F.lit("+1"), digits)).when(n.between(8, 15), plus).otherwise(digits)


def normalize_email(x: ColumnOrName) -> Column:
    return F.lower(normalize_text(x))


def is_email(x: ColumnOrName) -> Column:
    return _text(x).rlike(EMAIL)


def html_escape(x: ColumnOrName) -> Column:
    out = _text(x)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def visible_text(html: ColumnOrName) -> Column:
    """Without comments, style, script and tags; white space collapsed."""
    out = _text(html)
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<style[^>]*>.*?</style>", r"(?is)<script[^>]*>.*?</script>", r"(?s)<[^>]+>", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.btrim(out)


def matched_keywords(text: ColumnOrName, keywords: list[str], fold: bool = False) -> Column:
    """Keywords that the lower-cased text contains, in the list's order. Unless `fold`,
    keywords are not lower-cased, so those with capitals never match."""
    words = F.array(*map(F.lit, keywords))
    found = lambda low: F.filter(words, lambda k: F.contains(low, F.lower(k) if fold else k))
    # The text is lower-cased once, as the only element of an array.
    return F.element_at(F.transform(F.array(F.lower(_text(text))), found), 1)


def filled_count(*xs: ColumnOrName) -> Column:
    """How many of the values are neither null nor empty."""
    return F.size(F.array_compact(F.array(*[F.nullif(_text(x), F.lit("")) for x in xs])))


def hvac_type(text: ColumnOrName) -> Column:
    low = F.lower(_text(text))
    return F.when(low.rlike(r"\b(commercial|industrial|contractor)\b"), "commercial").when(low.rlike(r"\b(residential|home|household)\b"), "residential").otherwise("both")


#: Words that show an emergency service.
EMERGENCY = ["24 hour", "24hr", "emergency", "urgent", "same day"]


def emergency_service(text: ColumnOrName, flag: Column | None = None) -> Column:
    low = F.lower(_text(text))
    found = F.exists(F.array(*map(F.lit, EMERGENCY)), lambda k: F.contains(low, k))
    return found if flag is None else found | F.coalesce(flag, F.lit(False))


def service_list(x: ColumnOrName) -> Column:
    return F.when(_text(x) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(_text(x), ","), lambda s: F.btrim(s)))
