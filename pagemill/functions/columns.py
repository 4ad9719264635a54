"""Scalar text functions as Column expressions: no Python worker, inside whole-stage code generation where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dom import WHITE as WHITE_CHARS
from .text import ENTITIES

#: CJK ranges (each character a word) and Unicode white space, as regular-expression classes.
CJK = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}"
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MONTHS = "January February March April May June July August September October November December".split()


def strip_tags(html: Column) -> Column:
    """Tags become a space each; a stray ``>`` too; an unclosed ``<`` takes the rest along."""
    return F.replace(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ">"), "<[^>]*$", ""), F.lit(">"), F.lit(" "))


def decode_entities(text: Column) -> Column:
    """Known entities as characters; nested replacement with ``&amp;`` last, so nothing is decoded twice.

    Numeric references are decoded by :func:`pagemill.functions.text.decode_entities`, which has no Column form.
    """
    for name, char in ENTITIES.items():
        if name != "amp":
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def count_words(text: Column) -> Column:
    """Runs of non-space characters; each CJK character is a word.

    Most texts have no space beyond ASCII and no character from U+1680 on; a simple class, which is
    several times faster, counts the same words there.
    """
    rare = F.regexp_like(text, F.lit(r"[\x{85}\x{A0}\x{1680}-\x{10FFFF}]"))
    return F.when(rare, F.regexp_count(text, F.lit(f"[{CJK}]|[^{WHITE}{CJK}]+"))).otherwise(F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_CHARS))


def non_empty(text: Column) -> Column:
    return F.nullif(trim(text), F.lit(""))


def html_escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def preview(text: Column, limit: int = 80) -> Column:
    """White space collapsed, cut at ``limit`` characters.

    Where the beginning of the text already has more than ``limit``, the rest is not looked at.
    """
    flat, start = collapse(text), collapse(F.substring(text, 1, 4 * limit))
    cut = lambda t: F.concat(F.substring(t, 1, limit), F.lit("..."))
    return F.when(F.length(start) > limit, cut(start)).when(F.length(flat) > limit, cut(flat)).otherwise(flat)


def first_paragraph(text: Column, limit: int = 100) -> Column:
    return F.substring(trim(F.substring_index(trim(text), "\n\n", 1)), 1, limit)


def count_commas(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD``, ``Month D, YYYY`` or ``D Month YYYY`` as ``YYYY-MM-DD``; plausible numbers, no calendar check."""
    names = "|".join(MONTHS)
    month = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{k:02}"))])
    iso, english, plain = r"\A\d{4}-\d{2}-\d{2}\z", rf"(?s)\A({names})\s*,?\s*(\d{{1,2}}),?\s+(\d{{4}}).*", rf"(?s)\A(\d{{1,2}})\s+({names})\s+(\d{{4}}).*"
    shaped = F.when(F.regexp_like(text, F.lit(iso)), text)
    shaped = shaped.when(F.regexp_like(text, F.lit(english)), F.regexp_replace(text, english, "$3-$1-$2"))
    shaped = shaped.when(F.regexp_like(text, F.lit(plain)), F.regexp_replace(text, plain, "$3-$2-$1"))

    def made(parts: Column) -> Column:
        year, day = parts[0], F.lpad(parts[2], 2, "0")
        number = F.coalesce(F.try_element_at(month, parts[1]), parts[1])
        good = day.cast("int").between(1, 31) & year.cast("int").between(1900, 2100) & number.cast("int").between(1, 12)
        return F.when(good, F.concat_ws("-", year, number, day))

    return F.get(F.transform(F.array(F.split(shaped, "-")), made), F.lit(0))  # the parts are made once


def unix_day(seconds: Column) -> Column:
    """Day of a Unix time, in UTC whatever the session's time zone; years have four digits or as many as they need, without a plus."""
    by = lambda a, n: F.call_function("div", a, F.lit(n)) - F.when(a % n < 0, 1).otherwise(0)
    days = by(F.floor(seconds), 86400)
    cycle = by(days, 146_097)  # the calendar repeats after 400 years of so many days
    date = F.date_add(F.to_date(F.lit("1970-01-01")), (days - cycle * 146_097).cast("int"))
    year = F.year(date) + cycle * 400
    return F.concat(F.when(year.between(1000, 9999), year.cast("string")).otherwise(F.format_string("%04d", year)), F.date_format(date, "-MM-dd"))


def percent_encode(text: Column) -> Column:
    """All bytes but ``A-Za-z0-9-_.~`` as ``%XX``."""
    coded = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return coded


def url_host(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def url_origin(url: Column) -> Column:
    """``scheme://host[:port]``, null if there is no host."""
    scheme = F.lower(F.regexp_extract(url, r"(?i)\A(https?)://", 1))
    port = F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#@]*@)?[^/?#:\s]+(:\d+)", 1)
    plain = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    host = url_host(url)
    return F.when(host.isNotNull(), F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(port)))


def site_of_domain(domain: Column) -> Column:
    """Name of a site from its host: ``www.`` or a two-letter label goes, the first label gets a capital."""
    name = F.split_part(F.regexp_replace(domain, r"\A(?:www|[a-z]{2})\.", ""), F.lit("."), F.lit(1))
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1_000_000))


def keywords(raw: Column) -> Column:
    """A comma list as an array of trimmed, non-blank parts."""
    return F.filter(F.transform(F.split(raw, ","), trim), lambda x: x != "")


def is_unsafe_uri(uri: Column) -> Column:
    low = trim(F.lower(uri))
    kind = trim(F.split_part(trim(F.split_part(F.substring(low, 6, 1_000_000), F.lit(","), F.lit(1))), F.lit(";"), F.lit(1)))
    safe = kind.isin("image/png", "image/jpeg", "image/gif", "image/webp", "image/avif")
    return F.startswith(low, F.lit("javascript:")) | (F.startswith(low, F.lit("data:")) & ~safe)


def is_hidden(style: Column, classes: Column, hidden: Column, aria_hidden: Column, inert: Column) -> Column:
    """Hidden by inline style, attribute or class; the arguments are attribute values, null where absent."""
    by_style = F.regexp_like(F.lower(F.coalesce(style, F.lit(""))), F.lit("display: ?none|visibility: ?hidden|opacity: ?0"))
    names = F.split(F.coalesce(classes, F.lit("")), r"\s+")
    shown = F.exists(names, lambda c: F.regexp_like(c, F.lit("(?:sm|md|lg|xl):(?:block|flex)")))
    by_class = ~shown & F.arrays_overlap(names, F.array(F.lit("hidden"), F.lit(":hidden"), F.lit("invisible")))
    return by_style | hidden.isNotNull() | F.coalesce(aria_hidden == "true", F.lit(False)) | inert.isNotNull() | by_class
