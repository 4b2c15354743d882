"""Problem 2: bring text written with look-alike characters to one consistent form.

The form is NFC, besides that invisible characters are gone, and what only looks like plainer text (wide and narrow
forms, joined letters, positional forms, other spaces and hyphens, letters of other scripts standing in for Latin ones)
is that text. Compatibility characters that look different (superscripts, fractions, symbols) stay.

Quick-check properties, derived from the Unicode data for every character, say what may be unstable: NFC_QC No or Maybe,
a combining class, a decomposition of a look-alike kind, an invisible kind. They make one character class for the JVM,
which tells the texts that hold any such character; only these reach Python. There the unstable segments are isolated
with their boundary context (the last stable starter before them; the next stable starter ends them), normalised alone
and spliced back into the text, which is otherwise left alone.

Defined results: null stays null, the empty text stays empty, a text without unstable characters comes back unchanged
(the same bytes), whatever its length. The form of a form is the form itself. Repeated rows are treated alike and row
order does not matter.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import cut_lineage

# Characters without a visible shape that aren't format characters by category.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u2065\u3164\uffa0" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
# Format characters that are visible signs.
VISIBLE_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
# Hyphens other than the plain one.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# Single letters of other scripts (and two Latin ones) drawn like a plain Latin letter.
LOOKALIKE = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i", "\u0458": "j", "\u0455": "s",
    "\u0501": "d", "\u04bb": "h", "\u0475": "v", "\u051b": "q", "\u051d": "w", "\u04cf": "l", "\u0451": "\u00eb", "\u0457": "\u00ef",
    "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K", "\u041c": "M", "\u041d": "H", "\u041e": "O", "\u0420": "P", "\u0421": "C", "\u0422": "T",
    "\u0423": "Y", "\u0425": "X", "\u0406": "I", "\u0408": "J", "\u0405": "S", "\u0474": "V", "\u051a": "Q", "\u051c": "W",
    "\u03bf": "o", "\u03bd": "v", "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u0396": "Z", "\u0397": "H", "\u0399": "I", "\u039a": "K", "\u039c": "M",
    "\u039d": "N", "\u039f": "O", "\u03a1": "P", "\u03a4": "T", "\u03a5": "Y", "\u03a7": "X", "\u03f2": "c", "\u03f3": "j",
    "\u0585": "o", "\u057d": "u", "\u0570": "h", "\u0555": "O", "\u054f": "S",
}
LATIN_TWINS = {"\u0261": "g", "\u0251": "a"}
#: Kinds of compatibility decompositions whose two sides look the same.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Code points with decompositions, combining classes or format characters are below the first or in the second.
_ASSIGNED = [range(0x80, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200)]


def _plainer(c: str) -> str | None:
    """The plainer text that a character looks like, or None."""
    if c in INVISIBLE or (unicodedata.category(c) == "Cf" and c not in VISIBLE_FORMAT):
        return ""
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) == "Zs":
        return " "
    if c in LATIN_TWINS:
        return LATIN_TWINS[c]
    kind = unicodedata.decomposition(c).split(" ")[0]
    if not kind.startswith("<"):
        return None
    plain = unicodedata.normalize("NFKC", c)
    letters = unicodedata.category(c)[0] == "L" and len(plain) > 1
    joined = kind == "<compat>" and plain.isalpha() and (letters or "ROMAN NUMERAL" in unicodedata.name(c, "") or "RADICAL" in unicodedata.name(c, ""))
    return plain if joined or (kind in SAME_LOOK and " " not in plain) else None


def _properties() -> tuple[dict[str, str], set[str]]:
    """Character to plainer text, and all characters that the quick check finds unstable."""
    table: dict[str, str] = {}
    unstable: set[str] = set()
    for c in (chr(i) for r in _ASSIGNED for i in r if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i < 0xD7A4 and not 0x3400 <= i < 0xA000):
        if unicodedata.combining(c):
            unstable.add(c)
        decomposed = unicodedata.decomposition(c)
        if decomposed and decomposed[0] != "<":
            if unicodedata.normalize("NFC", c) != c:  # NFC_QC No
                unstable.add(c)
            elif " " in decomposed:  # what a character composes with is NFC_QC Maybe
                unstable.add(chr(int(decomposed.split()[1], 16)))
        if (plain := _plainer(c)) is not None and plain != c:
            table[c] = plain
    unstable |= {chr(i) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for i in r}  # Hangul vowels and finals: Maybe
    for c, plain in table.items():  # a plainer text may have something plainer
        while (again := "".join(table.get(x, x) for x in plain)) != plain:
            plain = again
        table[c] = plain
    return table, unstable | table.keys()


def _ranges(chars: set[str], gap: int) -> list[tuple[int, int]]:
    """Ranges that cover all the characters; those at most `gap` apart are one."""
    out: list[list[int]] = []
    for i in sorted(map(ord, chars)):
        if out and i - out[-1][1] <= gap:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a, b) for a, b in out]


TABLE, UNSTABLE = _properties()
_TRANSLATE = str.maketrans(TABLE)
_SEGMENT = re.compile("(?s).?[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _ranges(UNSTABLE, 1)) + "]+")
_FOREIGN = re.compile("[" + "".join(LOOKALIKE) + "]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")

#: The quick check as a Java character class: no match means that the text is in the consistent form. Below U+3000 it has
#: the characters themselves (gaps of up to 3), above it ranges with wider gaps: what they add is judged in Python.
_CHECKED = UNSTABLE | set(LOOKALIKE)
QUICK_CHECK = (
    "[[^\\x{0}-\\x{9f}]&&["
    + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in [*_ranges({c for c in _CHECKED if ord(c) < 0x370}, 3), *_ranges({c for c in _CHECKED if 0x370 <= ord(c) < 0x2000}, 255), *_ranges({c for c in _CHECKED if 0x2000 <= ord(c) < 0x3000}, 3), *_ranges({c for c in _CHECKED if ord(c) >= 0x3000}, 4095)])
    + "]]"
)


def _script(word: str) -> str:
    """Script of the first foreign letter of a word, by its Unicode name."""
    for c in word:
        if not _LATIN.match(c):
            return unicodedata.name(c, "? ").split(" ", 1)[0]
    return "LATIN"


def _plain_letters(text: str) -> str:
    """Replace letters of other scripts that stand in for Latin ones.

    A foreign letter counts where its word also has Latin letters, or where the whole word is drawn with such letters
    and neither neighbour is a genuine word of the same script.
    """
    words = list(_WORD.finditer(text))
    genuine = [bool(not _LATIN.search(w := m[0]) and any(c not in LOOKALIKE for c in w)) for m in words]
    out, end = [], 0
    for i, m in enumerate(words):
        w = m[0]
        if not _FOREIGN.search(w) or genuine[i]:
            continue
        if not _LATIN.search(w):
            own = _script(w)
            if any(genuine[j] and _script(words[j][0]) == own for j in (i - 1, i + 1) if 0 <= j < len(words)):
                continue
        out += [text[end : m.start()], "".join(LOOKALIKE.get(c, c) for c in w)]
        end = m.end()
    return "".join(out) + text[end:] if out else text


def _normalized(m: re.Match) -> str:
    return unicodedata.normalize("NFC", m[0].translate(_TRANSLATE))


def canonical_text(text: str | None) -> str | None:
    """The consistent form of one text."""
    if text is None or text.isascii():
        return text
    out = _SEGMENT.sub(_normalized, text)
    while _FOREIGN.search(out) and (plain := _plain_letters(out)) != out:
        out = _SEGMENT.sub(_normalized, plain)  # a replaced letter may be the base of an accent; every turn has fewer foreign letters
    return out


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical_text(t) for t in texts], dtype=object)


def needs_check(text: Column) -> Column:
    """Quick check: true where the text may change."""
    return F.coalesce((F.octet_length(text) != F.length(text)) & text.rlike(QUICK_CHECK), F.lit(False))


def canonical(text: Column) -> Column:
    """The consistent form of a text column; texts that pass the quick check never leave the JVM."""
    return F.coalesce(_canonical(F.when(needs_check(text), text)), text)


def canonicalize(df: DataFrame, column: str = "text", into: str | None = None) -> DataFrame:
    """df with `column` (or the new column `into`) in the consistent form; other columns stay as they are."""
    return df.withColumn(into or column, canonical(F.col(column)))


def canonicalize_once(df: DataFrame, column: str = "text") -> DataFrame:
    """As canonicalize, for a result that is read several times: rows that pass the quick check stay a plain scan, the
    few others are normalised once and kept in the checkpoint folder."""
    check = needs_check(F.col(column))
    return df.where(~check).unionByName(cut_lineage(df.where(check).withColumn(column, _canonical(F.col(column)))))


def unstable_rows(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text differs from its consistent form, with that form in `canonical_text`.

    Only rows that fail the quick check are sent to Python at all.
    """
    checked = df.where(needs_check(F.col(column))).withColumn("canonical_text", _canonical(F.col(column)))
    return checked.where(F.col("canonical_text") != F.col(column))
