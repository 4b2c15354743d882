"""Problem 1: find and repair noise in text from scanned pages.

Word counts over all pages, blocks and chunks are the lexicon. Its frequent words (at least `share` of all words, so at
most 1 / share of them) go to the executors as a symmetric-delete index; every rarer word looks up its candidates there,
and a weighted edit distance with confusion pairs keeps those that scanning may have turned into it. A word is misread
if such a candidate is `RATIO` times as frequent as itself. For the repair, bigram counts choose among several
candidates.

Running heads: lines at the edge of pages (after the site's own lines, problem 5, are taken away), of any case and length,
that agree with the archive's title or recur on its pages, up to a few misread letters. What recurs in as many archives
as a line of problem 5 does is none. Page labels: lines there in one of the usual forms
whose number keeps its distance to the page number, alone or on the line of the head. Hyphenation: a letter, a hyphen or
a sign standing for one, a line end and a letter.

Defined results: null and empty texts have no defect. Rows stored again are judged like their first copy. An archive
that is missing from `archives` has no title and no site; columns beyond the named ones are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import site_lines
from siltstone.llm.canonical import canonicalize_once
from siltstone.llm.lexicon import SymmetricDeleteIndex, ranked
from siltstone.session import broadcast_if_small, cut_lineage

RATIO, SHARE, NAME_SHARE, LEAST_COUNT = 10.0, 1e-5, 1e-3, 5
BROKEN = r"\n(?<=\p{L}[-\x{ac}\x{ad}\x{2010}\x{2011}][ \t]{0,9}\n)[ \t]*\p{L}"
NUMBER = r"(?<![\p{L}\p{N}])(?=[0-9OIlSBZ.,]*[0-9])(?=[0-9.,]*[OIlSBZ])[0-9OIlSBZ]+(?:[.,][0-9OIlSBZ]+)*(?![\p{L}\p{N}])"
#: A word with letters and digits that isn't a number with its unit.
MIXED = (
    r"(?i)(?<![\p{L}\p{Nd}])(?!\p{Nd}+(?:st|nd|rd|th|m|mm|cm|km|ft|kg|in|x|h|a)(?![\p{L}\p{Nd}]))(?:\p{Nd}++\p{L}|\p{L}++\p{Nd})"
)
#: Lines that count as the top or bottom of a page, blank ones and the site's own apart.
EDGE = 3
#: Pages on which a head recurs at least, if it is always in capitals or has the beginning of the archive's title in it
#: (its first NAMING characters). Any other line has to be the outermost one on one page more and on most of the archive's
#: later pages, or of the even or odd ones among them, since heads may alternate.
RECURS, NAMING, MOST_PAGES = 2, 8, 0.5
#: Share of an archive's pages that a form needs for misread spellings to be looked for, so an archive has few such forms.
MAIN_SHARE, MISREAD_SHARE = 0.05, 0.15
#: What either of them needs, cheap to look for.
ODD = r"[0-9](?:\p{L}|(?<=\p{L}.)|(?<=[OIlSBZ][.,].)|[.,][OIlSBZ])"
#: A line that may be a page label, alone or beside a head.
LABEL_LIKE = r"^[\sPpageofOIlSBZ0-9\[\]~\x{2013}\x{2014}./ivxlcIVXLC-]+$|\S\s{2,}\S"


# ---- words ----------------------------------------------------------------------------------------------------------


def joined_lines(text: Column) -> Column:
    """Text with the words that a line end breaks put together."""
    return F.when(text.rlike(BROKEN), F.regexp_replace(text, r"(\p{L})[-\x{ac}\x{ad}][ \t]*\n[ \t]*(\p{L})", "$1$2")).otherwise(text)


#: Words of letters, put together over line ends; those of one or two letters only count as the start of a broken word.
_SIGN = r"[-\x{ac}\x{ad}][ \t]*+\n[ \t]*+"
WORD = rf"(?:\p{{L}}{{3,}}+|\p{{L}}{{1,2}}+(?={_SIGN}\p{{L}}))(?:{_SIGN}\p{{L}}++)*+"


def spellings(texts: DataFrame) -> DataFrame:
    """spelled, k: words as they stand in the texts (a broken one with its break) and their counts."""
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("spelled")).groupBy("spelled").agg(F.count("*").alias("k"))


def word_of(spelled: Column) -> Column:
    """The word of a spelling: put together and lower-cased."""
    return F.lower(F.when(F.contains(spelled, F.lit("\n")), F.regexp_replace(spelled, _SIGN, "")).otherwise(spelled))


def word_counts(spelled: DataFrame) -> DataFrame:
    """word, n, n_lower (how often it is written in lower case) from spellings."""
    whole = F.when(F.contains("spelled", F.lit("\n")), F.regexp_replace("spelled", _SIGN, "")).otherwise(F.col("spelled"))
    words = spelled.select(whole.alias("whole"), "k").withColumn("word", F.lower("whole"))
    return words.groupBy("word").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("word") == F.col("whole"), F.col("k")).otherwise(0)).alias("n_lower"))


_AS_LETTER = str.maketrans("0156892", "olsbbgz")
_AS_DIGIT = set("oilsbzgq")


def _mixed(word: str, lexicon: dict) -> list[str] | None:
    """Candidates of a word with letters and digits; None if it is no misread one (4th, 10m)."""
    if re.fullmatch(r"\d+(st|nd|rd|th|m|mm|cm|km|ft|kg|in|x|h|a)", word):
        return None
    if all(c.isdigit() or c in _AS_DIGIT for c in word) and sum(map(str.isdigit, word)) * 2 >= len(word):
        return [word.translate(str.maketrans("oilsbzgq", "01158299"))]
    plain = word.translate(_AS_LETTER)
    return [w for w in (plain, word.translate(str.maketrans("0156892", "oisbbgz"))) if w in lexicon] or [plain]


def frequent_words(counts: DataFrame, share: float = SHARE) -> dict[str, tuple[int, bool]]:
    """Word to its count and whether it is written in lower case, for words that are at least `share` of all.

    There are at most 1 / share of them, however much text there is.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, total * share)
    # Names are rarely written in lower case; only those words that are much more frequent than any name are taken then.
    lower = (F.col("n_lower") >= least) & (F.col("n_lower") >= 0.2 * F.col("n"))
    common = lower | (F.col("n") >= total * NAME_SHARE)
    return {r.word: (r.n, r.lower) for r in counts.withColumn("lower", lower).where((F.col("n") >= least) & common & (F.length("word") >= 3)).toLocalIterator()}


def misread_words(counts: DataFrame, share: float = SHARE, ratio: float = RATIO) -> DataFrame:
    """word, candidates (best first) of the words taken to be misread."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast(frequent_words(counts, share))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = None
        for pdf in batches:
            index = index or SymmetricDeleteIndex(shared.value)
            words, found = [], []
            for word, n, n_lower in zip(pdf["word"], pdf["n"], pdf["n_lower"]):
                own = ranked(index, word, n, ratio, 2 * n_lower < n)
                if own:
                    words.append(word)
                    found.append(own)
            yield pd.DataFrame({"word": pd.Series(words, dtype=object), "candidates": pd.Series(found, dtype=object)})

    return counts.where(F.length("word").between(3, 40)).mapInPandas(look_up, "word string, candidates array<string>")


# ---- edges of pages -------------------------------------------------------------------------------------------------

_D = "[0-9OIlSBZo]"
_ROMAN = "[ivxlcIVXLC]+"
_LABEL = [
    ("of", rf"[Pp]age\s+({_D}+)\s+of\s+{_D}+"),
    ("page", rf"[Pp]age\s+({_D}+)"),
    ("p", rf"[Pp]\.\s*({_D}+)"),
    ("box", rf"\[\s*({_D}+)\s*\]"),
    ("tilde", rf"~\s*({_D}+)\s*~"),
    ("dash", rf"[-–—]\s+({_D}+)\s+[-–—]"),
    ("slash", rf"({_D}+)/{_D}+"),
    ("part", rf"{_D}+-({_D}+)"),
    ("bare", rf"({_D}+)"),
    ("roman", rf"({_ROMAN})"),
]
_WHOLE = [(k, re.compile(p)) for k, p in _LABEL]
_ENDS = [(k, re.compile(rf"(?:(?P<a>{p.replace('(', '(?:', 1)})\s{{2,}}(?P<rest>.+)|(?P<rest2>.+?)\s{{2,}}(?P<b>{p.replace('(', '(?:', 1)}))"), re.compile(p)) for k, p in _LABEL]
_NUMERALS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _number(s: str, kind: str) -> int:
    if kind == "roman":
        total, values = 0, [_NUMERALS[c] for c in s.lower()]
        for i, v in enumerate(values):
            total += -v if i + 1 < len(values) and values[i + 1] > v else v
        return total
    return int(s.translate(str.maketrans("OoIlSBZ", "0011582")))


def parse_edge(line: str) -> tuple[str, str | None, int | None, bool]:
    """(text of a possible head, form of a page label or None, its number, whether the label has misread digits)."""
    s = line.strip()
    for kind, pattern in _WHOLE:
        if m := pattern.fullmatch(s):
            if kind != "roman" and not any(map(str.isdigit, m[1])) and kind in ("bare", "slash", "part"):
                continue
            return "", kind, _number(m[1], kind), kind != "roman" and not m[1].isdigit()
    for kind, pattern, inner in _ENDS:
        if m := pattern.fullmatch(s):
            label = m["a"] or m["b"]
            digits = inner.fullmatch(label)[1]
            if kind != "roman" and not any(map(str.isdigit, digits)):
                continue
            return (m["rest"] or m["rest2"]).strip(), kind, _number(digits, kind), kind != "roman" and not digits.isdigit()
    return s, None, None, False


@F.pandas_udf(T.StructType([T.StructField("head", T.StringType()), T.StructField("form", T.StringType()), T.StructField("number", T.LongType()), T.StructField("misread", T.BooleanType())]))
def _parsed(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_edge(s) if s is not None else ("", None, None, False) for s in lines], columns=["head", "form", "number", "misread"]).astype({"number": "Int64"})


def head_key(text: Column) -> Column:
    """Letters and digits of a head; case is kept, since a title on the opening page is written like one."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def _edges(texts: DataFrame, bad: DataFrame, archives: DataFrame, with_lines: bool) -> DataFrame:
    """record_kind, row_id, archive_id, page_number, n_lines, depth (0 outermost), key, capitals, form, number, misread (and
    line) of lines at the top and bottom, without blank lines and the site's own. Any line counts that has a label or
    eight letters; key is the head's letters and digits, null without eight letters."""
    of_archive = broadcast_if_small(cut_lineage(site_lines.sites(archives)))
    owned = texts.where("text <> ''").join(of_archive, "archive_id", "left").join(bad, "site", "left")
    split = F.split("text", "\n", -1)
    keys = F.transform(F.split(site_lines.word_lines(F.col("text")), "\n", -1), lambda l: F.replace(l, F.lit(" "), F.lit("")))
    paired = F.zip_with(split, keys, lambda l, k: F.struct(F.trim(l).alias("line"), k.alias("key")))
    of_site = lambda e: F.coalesce(F.array_contains(F.col("bad"), F.xxhash64(e["key"])), F.lit(False))
    lines = F.filter(paired, lambda e: (e["line"] != "") & ~of_site(e))
    # Lines are made once, inside the array that is exploded: a filter on what it gives can't be pushed below, where it would
    # repeat them.
    ends = lambda x: F.when(F.size(x) <= 2 * EDGE, x).otherwise(F.concat(F.slice(x, 1, EDGE), F.slice(x, -EDGE, EDGE)))
    n_ends = lambda x: F.least(F.size(x), F.lit(2 * EDGE))
    placed = lambda x: F.transform(ends(x), lambda e, i: F.struct(F.size(x).alias("n_lines"), F.least(i, n_ends(x) - 1 - i).alias("depth"), e["line"].alias("line"), e["key"].alias("key")))
    edges = owned.select("record_kind", "row_id", "archive_id", "page_number", F.explode(F.flatten(F.transform(F.array(lines), placed))).alias("e"))
    line = F.col("e.line")
    edges = edges.withColumn("like", line.rlike(LABEL_LIKE)).where(~F.contains(line, F.lit("|")) & (F.col("like") | (F.length("e.key") >= 8)))
    edges = edges.withColumn("p", _parsed.asNondeterministic()(F.when(F.col("like"), line)))  # else a filter would repeat it
    plain = F.col("p.form").isNull()
    own = F.when(plain, F.upper("e.key")).otherwise(head_key(F.col("p.head")))
    head = F.when(plain, line).otherwise(F.col("p.head"))
    key = F.when((F.length(own) >= 8) & own.rlike(r"(?:\p{N}*+\p{L}){8}"), own)
    out = edges.select("record_kind", "row_id", "archive_id", "page_number", "e.n_lines", "e.depth", key.alias("key"), (F.upper(head) == head).alias("capitals"), "p.form", "p.number", "p.misread", (F.length(F.col("p.head")) > 0).alias("on_head"), *([line.alias("line")] if with_lines else []))
    return out.where("key is not null or form is not null")


EXPLICIT = ["of", "page", "p", "box", "tilde", "dash"]


def heads_and_labels(texts: DataFrame, archives: DataFrame, stored: DataFrame, with_lines: bool = False) -> DataFrame:
    """record_kind, row_id, defect (and line) for running heads, page labels and misread ones.

    texts: in the consistent form; stored: as they are stored, for the lines of the sites.
    """
    bad = broadcast_if_small(cut_lineage(site_lines.excessive_keys(stored, archives).groupBy("site").agg(F.collect_set("key_hash").alias("bad"))), 10_000)
    edges = cut_lineage(_edges(texts, bad, archives, with_lines))
    columns = lambda defect: ["record_kind", "row_id", F.lit(defect).alias("defect"), *(["line"] if with_lines else [])]
    pages = edges.where("record_kind = 'page'")

    # Labels: the form and the distance to the page number that most pages of the archive agree on.
    numbered = pages.where("form is not null").withColumn("distance", F.col("number") - F.col("page_number"))
    votes = numbered.select("archive_id", "distance", "page_number").distinct().groupBy("archive_id", "distance").agg(F.count("*").alias("votes"))
    usual = votes.groupBy("archive_id").agg(F.max_by("distance", F.struct("votes", -F.abs("distance"), "distance")).alias("usual"), F.max("votes").alias("votes"))
    labelled = edges.where("form is not null").join(broadcast_if_small(cut_lineage(usual)), "archive_id", "left").withColumn("fits", F.coalesce((F.col("number") - F.col("page_number") == F.col("usual")) & (F.col("votes") >= 2), F.lit(False)))
    explicit = F.col("form").isin(EXPLICIT)
    sure = F.when(F.col("record_kind") == "block", (F.col("n_lines") == 1) & (explicit | F.col("fits"))).otherwise(F.col("fits") | (explicit & (F.col("depth") <= 1)))
    on_head = F.col("on_head") & (explicit | F.col("fits"))
    labels = labelled.where(sure | on_head)
    found = [labels.select(*columns("page_number")), labels.where("misread").select(*columns("misread"))]

    # Heads: the archive's title, and lines that recur at the edges of its pages but are none of several archives' lines.
    is_even = lambda c: F.when(F.col(c) % 2 == 0, 1)
    numbers = texts.where("record_kind = 'page'").select("archive_id", "page_number").distinct()
    opening = numbers.groupBy("archive_id").agg(F.min("page_number").alias("opening"), F.count("*").alias("all_pages"), F.count(is_even("page_number")).alias("even_pages"))
    opening = broadcast_if_small(cut_lineage(opening))
    later = edges.where("key is not null").join(opening, "archive_id", "left").where(F.col("page_number") != F.coalesce("opening", F.lit(-1))).withColumn("key_hash", F.xxhash64("key"))
    titles = archives.groupBy("archive_id").agg(F.min(F.get_json_object("archive_metadata", "$.title")).alias("title")).where("title is not null")
    titles = titles.select("archive_id", head_key(F.col("title")).alias("title_key")).where(F.length("title_key") >= 8)
    # Pages stored again count once: first one row for each page with a key, then their number. Hashes stand for the keys.
    per_page = later.where("record_kind = 'page'").groupBy("archive_id", "key_hash", "page_number").agg(F.min("depth").alias("depth"), F.min("capitals").alias("capitals"))
    outer = F.when(F.col("depth") == 0, 1)
    recurring = per_page.groupBy("archive_id", "key_hash").agg(F.count("*").alias("weight"), F.min("capitals").alias("capitals"), F.count(outer).alias("outer"), F.count(F.when(outer == 1, is_even("page_number"))).alias("even")).where(F.col("weight") >= RECURS)
    recurring = cut_lineage(recurring)  # few of all lines
    in_archives = recurring.groupBy("key_hash").agg(F.count("*").alias("n_archives")).where(F.col("n_archives") < site_lines.MIN_ARCHIVES)
    spelled = later.join(broadcast_if_small(recurring.select("archive_id", "key_hash")), ["archive_id", "key_hash"], "left_semi").groupBy("archive_id", "key_hash").agg(F.min("key").alias("key"))
    often = recurring.join(in_archives, "key_hash").join(spelled, ["archive_id", "key_hash"]).join(titles, "archive_id", "left").join(opening, "archive_id")
    apart = F.col("capitals") | F.coalesce(F.contains("key", F.substring("title_key", 1, NAMING)), F.lit(False))
    share = lambda own, pages: own > F.greatest(pages, F.lit(1)) * MOST_PAGES
    odd, odd_pages = F.col("outer") - F.col("even"), F.col("all_pages") - F.col("even_pages")
    mostly = (F.col("outer") > RECURS) & (share(F.col("outer"), F.col("all_pages") - 1) | share(F.col("even"), F.col("even_pages")) | share(odd, odd_pages))
    forms = often.where(apart | mostly).select("archive_id", "key", "weight", (F.col("weight") >= F.col("all_pages") * MAIN_SHARE).alias("main"))
    named = titles.select("archive_id", F.col("title_key").alias("key"), F.lit(1 << 20).cast("long").alias("weight"), F.lit(True).alias("main"))
    all_forms = cut_lineage(forms.unionByName(named).groupBy("archive_id", "key").agg(F.max("weight").alias("weight"), F.max("main").alias("main")))
    # A form near a more frequent main one is a misread spelling of it. A page has 2 EDGE lines at most, each of which
    # counts for one form, so there are at most 2 EDGE / MAIN_SHARE main forms in an archive.
    main = all_forms.where("main").groupBy("archive_id").agg(F.sort_array(F.collect_list(F.struct("weight", "key")), asc=False).alias("forms"))
    most = lambda f: F.greatest(F.lit(1), F.floor(F.length(f["key"]) * MISREAD_SHARE).cast("int"))
    near = lambda f: (F.abs(F.length(f["key"]) - F.length("key")) <= most(f)) & (F.levenshtein(f["key"], F.col("key")) <= most(f))
    known = broadcast_if_small(cut_lineage(all_forms.select("archive_id", F.xxhash64("key").alias("key_hash"), F.lit(True).alias("known"))))
    joined = later.join(broadcast_if_small(cut_lineage(main), 50_000), "archive_id", "left").join(known, ["archive_id", "key_hash"], "left").withColumn("form_key", F.get(F.filter("forms", near), F.lit(0))["key"])
    matched = joined.where("form_key is not null or known")
    found += [matched.select(*columns("running_head")), matched.where("form_key <> key").select(*columns("misread"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


# ---- the operator ---------------------------------------------------------------------------------------------------


def in_form(texts: DataFrame) -> DataFrame:
    return canonicalize_once(texts)


def defects(texts: DataFrame, archives: DataFrame, more_texts: DataFrame) -> DataFrame:
    """record_kind, row_id, defect: one row for each defect that a text has.

    texts: record_kind, row_id, archive_id, page_number, text of pages and blocks; more_texts: further texts (`text`)
    that count for the lexicon.
    """
    # Soft hyphens are not in the consistent form: what they break is seen in the text as it is stored.
    plain = in_form(texts.withColumn("broken", F.col("text").rlike(BROKEN)))
    spelled = cut_lineage(spellings(plain.select("text").unionByName(in_form(more_texts.select("text")))))
    misread = misread_words(cut_lineage(word_counts(spelled)))
    number = F.col("text").rlike(ODD) & (F.col("text").rlike(NUMBER) | F.col("text").rlike(MIXED))
    # One pass over the texts: their words, and a marker for what a pattern found, meet the misread words and the markers.
    # Misread words are spellings of frequent words with up to two confusions, hence bounded by the lexicon.
    flags = F.filter(F.array(F.when(F.col("broken"), F.lit("\u0000hyphenation")), F.when(number, F.lit("\u0000misread"))), lambda f: f.isNotNull())
    bad = spelled.select("spelled", word_of(F.col("spelled")).alias("word")).join(F.broadcast(misread.select("word")), "word", "left_semi").select("spelled", F.lit("misread").alias("defect"))
    marks = texts.sparkSession.createDataFrame([("\u0000hyphenation", "hyphenation"), ("\u0000misread", "misread")], "spelled string, defect string")
    tokens = plain.select("record_kind", "row_id", F.explode(F.concat(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), flags)).alias("spelled"))
    words = tokens.join(F.broadcast(bad.unionByName(marks)), "spelled").select("record_kind", "row_id", "defect")
    return words.unionByName(heads_and_labels(plain, archives, texts)).distinct()



# ---- repair ---------------------------------------------------------------------------------------------------------

_STARTS = re.compile(r"(?:\||[-o\u2022*] |\(\w{1,3}\) |\d+[.)] |\u00bb |>> |Chapter \d|\d+\.\d+ |(?:Table|Figure) \d+\.\d+\. )")
_HEADING = re.compile(r"(?:Chapter \d|\d+\.\d+ )")
_LETTERS = re.compile(r"[^\W\d_]+$"), re.compile(r"^[^\W\d_]+")
_TOKEN = re.compile(r"\d*[^\W\d_](?:[^\W_])*")
_NUMBER = re.compile(NUMBER.replace(r"\p{L}\p{N}", "A-Za-z0-9\u00c0-\u024f"))


def join_words(first: str, sign: str, rest: str, frequent: dict) -> str:
    """Put a word together that a line end breaks: a compound keeps its hyphen where both parts are words and the whole isn't."""
    a, b = _LETTERS[0].search(first), _LETTERS[1].search(rest)
    if not a or not b or sign != "-" or (a[0] + b[0]).lower() in frequent:
        return first + rest
    return f"{first}-{rest}" if a[0].lower() in frequent and b[0].lower() in frequent else first + rest


def flowing(text: str, drop: set[str], frequent: dict) -> str:
    """Text as continuous paragraphs, parted by blank lines, without the lines to drop.

    A line goes on in the next one if it ends in a hyphen or if the next word didn't fit the width of the text.
    """
    lines = [line.strip() for line in text.split("\n")]
    lines = [line for line in lines if line not in drop]
    widths = sorted(len(line) for line in lines if len(line) >= 40)
    width = widths[len(widths) * 3 // 4] if widths else 0
    paragraphs: list[str] = []
    now, last = "", ""
    for line in lines:
        broken = len(last) > 1 and last[-1] in "-\u00ac\u00ad" and last[-2].isalpha() and line[:1].isalpha()
        goes_on = broken or (last and line and not _STARTS.match(line) and not _HEADING.match(last) and len(last) + 1 + len(line.split(" ", 1)[0]) > width - 2 and width)
        if not goes_on:
            if now:
                paragraphs.append(now)
            now = line
        elif broken:
            now = join_words(now[:-1], now[-1], line, frequent)
        else:
            now = f"{now} {line}"
        last = line
    if now:
        paragraphs.append(now)
    return "\n\n".join(paragraphs)


def respelled(text: str, fixes: dict[str, list[str]], bigrams: dict[tuple[str, str], int], frequent: dict) -> str:
    """Text with its misread words and numbers replaced; among several candidates the neighbouring words decide."""
    found = list(_TOKEN.finditer(text))

    def choose(i: int) -> str:
        word = found[i][0]
        options = _mixed(word.lower(), frequent) if any(map(str.isdigit, word)) else fixes.get(word.lower())
        if not options:
            return word
        best = options[0]
        if len(options) > 1:
            before, after = (found[j][0].lower() if 0 <= j < len(found) else "" for j in (i - 1, i + 1))
            # Options come by distance and frequency; a place further down costs as much as e times the context.
            best = max(options, key=lambda w: math.log1p(bigrams.get((before, w), 0) + bigrams.get((w, after), 0)) - options.index(w))
        return best.upper() if sum(map(str.isupper, word)) > 1 and not any(map(str.islower, word)) else best.capitalize() if word[0].isupper() or (word[0].isdigit() and i and text[found[i].start() - 2 : found[i].start()] == ". ") else best

    out, end = [], 0
    for i, m in enumerate(found):
        out += [text[end : m.start()], choose(i)]
        end = m.end()
    return _NUMBER.sub(lambda m: m[0].translate(str.maketrans("OIlSBZ", "011582")), "".join(out) + text[end:])


def _bigrams(texts: DataFrame, misread: DataFrame, share: float) -> dict[tuple[str, str], int]:
    """Counts of neighbouring words of which one is among several candidates. Those below `share` are left out, so at most 1 / share remain."""
    wanted = misread.where(F.size("candidates") > 1).select(F.explode("candidates").alias("w")).distinct()
    tokens = F.regexp_extract_all(F.lower(joined_lines(F.col("text"))), F.lit(r"\p{Nd}*+\p{L}[\p{L}\p{Nd}]*+"), F.lit(0))
    pairs = texts.select(tokens.alias("t")).select(F.explode(F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p")).select("p.a", "p.b")
    either = pairs.join(wanted, (F.col("a") == F.col("w")), "left_semi").unionByName(pairs.join(wanted, F.col("b") == F.col("w"), "left_semi"))
    counted = either.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {(r.a, r.b): r.n for r in counted.where(F.col("n") >= max(2, total * share)).toLocalIterator()}


def repaired(texts: DataFrame, archives: DataFrame, more_texts: DataFrame, share: float = SHARE) -> DataFrame:
    """record_kind, row_id, text: every text as continuous paragraphs, spelled correctly, without heads and page labels.

    The lines of the site (problem 5) stay; a text that is only a head or a label becomes empty.
    """
    plain = in_form(texts)
    everything = plain.select("text").unionByName(in_form(more_texts.select("text")))
    spelled = cut_lineage(spellings(everything))
    counts = cut_lineage(word_counts(spelled))
    misread = cut_lineage(misread_words(counts, share))
    shared = texts.sparkSession.sparkContext.broadcast((frequent_words(counts, share), _bigrams(everything, misread, share)))
    bad = spelled.select("spelled", word_of(F.col("spelled")).alias("word")).join(F.broadcast(misread), "word")
    tokens = plain.select("record_kind", "row_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("spelled"))
    fixes = tokens.join(F.broadcast(bad), "spelled").groupBy("record_kind", "row_id").agg(F.collect_list(F.struct("word", "candidates")).alias("fixes"))
    drops = heads_and_labels(plain, archives, texts, with_lines=True).where("defect <> 'misread'").groupBy("record_kind", "row_id").agg(F.collect_set("line").alias("drops"))
    joined = plain.select("record_kind", "row_id", "text").join(fixes, ["record_kind", "row_id"], "left").join(drops, ["record_kind", "row_id"], "left")

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, bigrams = shared.value
        for pdf in batches:
            out = []
            for text, fix, drop in zip(pdf["text"], pdf["fixes"], pdf["drops"]):
                table = {f["word"]: list(f["candidates"]) for f in fix} if fix is not None else {}
                if text is None:
                    out.append(None)
                    continue
                out.append(respelled(flowing(text, set(drop) if drop is not None else set(), frequent), table, bigrams, frequent))
            yield pd.DataFrame({"record_kind": pdf["record_kind"], "row_id": pdf["row_id"], "text": pd.Series(out, dtype=object, index=pdf.index)})

    return joined.mapInPandas(repair, "record_kind string, row_id bigint, text string")
