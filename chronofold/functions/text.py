"""Text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# White space as page text has it: Java's \s leaves out the non-breaking and
# other Unicode spaces.
SPACES = r"\s ﻿  -     　"
WS = f"[{SPACES}]"
# ASCII word edges, so an accented letter next to a word does not count as part of it.
EDGE_L, EDGE_R = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def where_held(c: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """`change` of the texts that hold a mark without which it changes nothing; patterns need not go through the others."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def group(c: Column, pattern: str, index: int) -> Column:
    """Group of the first match; null when there is no match or it is empty."""
    got = F.regexp_extract(c, pattern, index)
    return F.when(got != "", got)


def trim_all(c: Column) -> Column:
    return sub(c, rf"^{WS}+|{WS}+\z")


def decode_entities(c: Column) -> Column:
    """The five XML entities, the ampersand first: &amp;lt; opens fully to <."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def escape_field(c: Column) -> Column:
    c = F.replace(c, F.lit("\t"), F.lit("\\t"))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.replace(c, F.lit("\r"), F.lit(""))


def unescape_field(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))


def slug(title: Column) -> Column:
    return sub(sub(F.lower(title), "[^a-z0-9]+", "-"), r"^-|-\z")


def leading_int(c: Column) -> Column:
    """Integer at the start of a text, or null."""
    return F.regexp_extract(c, rf"^{WS}*([-+]?\d+)", 1).try_cast("int")


def leading_float(c: Column) -> Column:
    """Decimal number at the start of a text, or null."""
    return F.regexp_extract(c, rf"^{WS}*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def strict_number(c: Column) -> Column:
    """The whole text as a number, or null."""
    return F.when(F.regexp_like(c, F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\z")), c.try_cast("double"))


def percent_encode(c: Column) -> Column:
    """Percent-encode a path part; space as %20 and ! ' ( ) * ~ left bare."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def citation_url(url: Column, title: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), percent_encode(title)))


def citation_label(label: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(F.lit("Wikipedia"))


def _drop_refs(c: Column, by: str) -> Column:
    # A self-closing tag goes first: read as an opener it would eat the text
    # up to some later closing tag.
    c = sub(c, r"(?i)<ref(?![0-9A-Za-z_])[^>]*/>", by)
    return sub(c, r"(?i)<ref(?![0-9A-Za-z_])[^>]*>[\s\S]*?</ref>", by)


def template_depth(c: Column) -> Column:
    """How deep double braces are nested; a closing pair too many counts for nothing."""
    marks = F.regexp_extract_all(c, F.lit(r"\{\{|\}\}"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, m: Column) -> Column:
        now = F.when(m == "{{", s["now"] + 1).otherwise(F.greatest(s["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, step)["most"]


def _drop_templates(c: Column, by: str) -> Column:
    """Without templates, however deep: each pass takes the innermost ones, as many passes as a text is deep."""
    def strip(t: Column) -> Column:
        passes = F.sequence(F.lit(1), template_depth(t))
        return F.when(F.contains(t, F.lit("{{")), F.aggregate(passes, t, lambda s, _: sub(s, r"\{\{[^{}]*\}\}", by))).otherwise(t)

    return let(c, strip)


def strip_citations(c: Column) -> Column:
    """Prose with references, templates and files turned to spaces."""
    c = where_held(c, "&", lambda t: sub(t, "(?i)&nbsp;", " "))
    c = _drop_templates(where_held(c, "<", lambda t: _drop_refs(t, " ")), " ")
    return where_held(c, "[[", lambda t: sub(t, rf"(?i)\[\[{WS}*(?:File|Image){WS}*:[^\]]*\]\]", " "))


def description(wikitext: Column, opening: int | None = None, most: int | None = None) -> Column:
    """First sentence of the first real prose line, `most` characters of it if given.  A line without the end of a
    sentence is taken whole, or its first `opening` characters."""
    def links(t: Column) -> Column:
        t = sub(t, rf"(?i)\[\[{WS}*(?:File|Image){WS}*:[^\]]*\]\]")
        t = sub(t, rf"\[https?://[^{SPACES}\]]+{WS}+([^\]]+)\]", "$1")
        t = sub(t, r"\[https?://[^\]]*\]")
        return sub(t, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")

    c = where_held(wikitext, "<", lambda t: sub(_drop_refs(t, ""), "<[^>]+>"))
    c = where_held(_drop_templates(c, ""), "[", links)
    c = where_held(c, "''", lambda t: sub(t, "'{2,3}"))
    c = where_held(c, "==", lambda t: sub(t, "==+[^=]+=+"))
    c = where_held(c, "[[", lambda t: sub(t, r"(?i)\[\[Category:[^\]]*\]\]"))
    c = let(c, lambda t: F.when(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), sub(t, "[ \\t]{2,}", " ")).otherwise(t))
    # Trimming makes no line longer, so the short ones need none.
    lines = F.transform(F.filter(F.split(c, "\n"), lambda x: F.length(x) > 40),
                        lambda x: sub(sub(x, rf"^[{SPACES},;()\[\]]+"), rf"{WS}+\z"))
    prose = F.filter(lines, lambda x: (F.length(x) > 40) & ~F.substring(x, 1, 1).isin("*", "|", "{"))
    first = F.get(prose, F.lit(0))
    cut = lambda t, n: t if n is None else F.substring(t, 1, n)
    sentence = F.coalesce(group(first, r"^([^.!?]+[.!?])", 1), cut(first, opening))
    return F.coalesce(cut(trim_all(sentence), most), F.lit(""))


def with_suffixes(slugs: Column) -> Column:
    """Make the slugs of one article unique: in order, each takes the fewest
    '-x' that give a slug not used before."""

    def step(used: Column, s: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.size(used)), lambda n: F.concat(s, F.repeat(F.lit("-x"), n)))
        return F.concat(used, F.slice(F.filter(tries, lambda t: ~F.array_contains(used, t)), 1, 1))

    return F.aggregate(slugs, F.array().cast("array<string>"), step)
