"""Text functions as Column expressions: tokenizers, headings, captions, tables, page selections."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and their base letters, from their decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xE0, 0x180)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accented()
# What begins a heading line, and what begins a caption.
HEADING = r"(?i)^(chapter|section|article|part|appendix|stormwater|zoning|[0-9]+(?:\.[0-9]+)*)\b"
CAPTION = r"(?i)^(figure|fig\.?|table|diagram|exhibit|chart|map|photo|illustration|plate|drawing)\s*[0-9]+([.:\-\x{2013}]|\s|$)"
LONGEST_HEADING, LONGEST_CAPTION = 120, 500


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def index_tokens(text: Column) -> Column:
    """Keyword tokens: letters and digits, case and accents folded; everything else separates."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def hashing_tokens(text: Column) -> Column:
    """ASCII words of the hashing embedder."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def heading_line(text: Column) -> Column:
    """First short line that looks like a heading, or null."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.trim(l))
    return F.get(F.filter(lines, lambda l: (F.length(l) > 0) & (F.length(l) < LONGEST_HEADING) & l.rlike(HEADING)), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines or after a line that ends a sentence; blank parts are left out."""
    parts = F.transform(F.split(text, r"\n\s*\n|(?<=\.)\s*\n"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def is_caption(text: Column) -> Column:
    return F.trim(F.get(F.split(text, "\n"), F.lit(0))).rlike(CAPTION) & (F.length(text) <= LONGEST_CAPTION)


def windows(words: Column, size: int, overlap: int) -> Column:
    """Array of word arrays: windows of `size` words that share `overlap` words; the last one reaches the end."""
    overlap = max(0, min(overlap, size - 1))
    step = size - overlap
    last = F.greatest(F.ceil((F.size(words) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * step + 1, size))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a table: pipes escaped, line ends as spaces, every row padded or cut to the header's width."""
    width = F.size(F.get(rows, F.lit(0)))
    cell = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " "))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, row)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def page_selection(spec: Column) -> Column:
    """Pages of "1-5,8": sorted, without repeats; reversed ranges give none."""
    part = lambda p: F.when(p.contains("-"), F.struct(F.trim(F.substring_index(p, "-", 1)).cast("int").alias("a"), F.trim(F.substring_index(p, "-", -1)).cast("int").alias("b"))).otherwise(F.struct(F.trim(p).cast("int").alias("a"), F.trim(p).cast("int").alias("b")))
    ranges = F.filter(F.transform(F.split(spec, ","), part), lambda r: r["a"] <= r["b"])
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["a"], r["b"])))))


def compact(text: Column, limit: int) -> Column:
    """White space collapsed, cut to `limit` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def _matcher(regex: str):
    return lambda s: s.rlike(regex)


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path, one of its segments or a folder above it matches one of the shell patterns."""
    import fnmatch

    hit = F.lit(False)
    for pattern in patterns:
        regex = "^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"
        hit = hit | path.rlike(regex) | F.exists(F.split(path, "/"), _matcher(regex))
        if pattern.endswith("/**"):
            hit = hit | path.startswith(pattern[:-2])
    return hit
