"""Expressions over page source. Small fixed patterns, applied to whole pages."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrules.functions.text import extract_all, strip

# Names of characters, by Python's table of the HTML standard; a fixed blank becomes a plain one.
ENTITIES = {**name2codepoint, "apos": 0x27, "nbsp": 0x20}
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAK = r"(?i)<br\s*/?>"
TAG = r"(?s)<[^>]*>"
TITLE = r"(?is)<h1\b[^>]*>(.*?)</h1>"
DATE = r'(?is)<p\b[^>]*id="date_text"[^>]*>(.*?)</p>'
# Where content blocks and what nests in them begin and end.
EDGE = r"(?i)(?=</?(?:article|div)\b)"
CONTENT = r"""(?is)^<(?:article\b|div\b[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?par(?:\s[^"]*)?"|'(?:[^']*\s)?par(?:\s[^']*)?'))"""
ENTRY = r"(?is)<(?:li|dt)\b[^>]*>(.*?)</(?:li|dt)>"
HREF = r'(?i)href="([^"]*)"'


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def visible(html: Column) -> Column:
    """Without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, "")


def to_text(html: Column) -> Column:
    """Line breaks kept, tags removed, named and numbered characters replaced once."""
    return characters(F.regexp_replace(F.regexp_replace(html, BREAK, "\n"), TAG, ""))


def characters(text: Column) -> Column:
    """``&name;``, ``&#n;`` and ``&#xn;`` as the characters they stand for; others stay."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def first(part: Column) -> Column:
        number = F.regexp_extract(part, r"^#([0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        code = (
            F.when(number != "", number.cast("int"))
            .when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("int"))
            .otherwise(names[F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)])
        )
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(known, F.concat(char, F.regexp_replace(part, "^[^;]*;", ""))).otherwise(
            F.concat(F.lit("&"), part)
        )

    def replaced(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(first(part))), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), replaced(F.split(t, "&"))).otherwise(t))


def page_title(page: Column) -> Column:
    return strip(to_text(F.regexp_extract(page, TITLE, 1)))


def page_date(page: Column) -> Column:
    """What follows the last `` : `` in the date line; null when there is none."""
    line = strip(to_text(F.regexp_extract(page, DATE, 1)))
    return F.when(line != "", F.element_at(F.split(line, " : "), -1))


def page_body(page: Column) -> Column:
    """All content blocks, joined. A block ends where its own tag closes: blocks nest in it.

    The fold notes the numbers of the pieces that are inside; these are joined once.
    """

    def state(depth: Column, kept: Column) -> Column:
        return F.struct(depth.cast("int").alias("depth"), kept.alias("kept"))

    def blocks(pieces: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            piece = F.get(pieces, k)
            more = F.concat(s["kept"], F.array(k))
            opens, closes = piece.rlike(r"(?i)^<(?:article|div)\b"), piece.startswith("</")
            return (
                F.when((s["depth"] == 0) & piece.rlike(CONTENT), state(F.lit(1), more))
                .when(s["depth"] == 0, s)
                .when(opens, state(s["depth"] + 1, more))
                .when(closes & (s["depth"] == 1), state(F.lit(0), s["kept"]))
                .when(closes, state(s["depth"] - 1, more))
                .otherwise(state(s["depth"], more))
            )

        start = state(F.lit(0), F.array().cast("array<int>"))
        numbers = F.sequence(F.lit(0), F.size(pieces) - 1)
        inside = F.aggregate(numbers, start, step, lambda s: s["kept"])
        return F.array_join(F.transform(inside, lambda k: F.get(pieces, k)), "")

    return strip(to_text(let(F.split(page, EDGE), blocks)))


def article(html: Column) -> Column:
    """title, date and body of a page as one struct."""
    return let(visible(html), lambda page: F.struct(
        page_title(page).alias("title"), page_date(page).alias("date"), page_body(page).alias("body")
    ))


def entry_links(html: Column) -> Column:
    """The first link of every list entry that has one."""
    links = F.transform(extract_all(html, ENTRY, 1), lambda e: F.regexp_extract(e, HREF, 1))
    return F.filter(links, lambda link: link != "")
