"""Problem 8: find text that was decoded with a wrong character encoding, and restore it.

All white-space-separated words with a character outside ASCII are counted over the whole table first. On the different
words, Python tries every chain of wrong steps (a text's UTF-8 bytes read as another code page, once or twice, or bytes
of one code page read as another) backwards. A smoothed character trigram model, counted over the words that no UTF-8
chain improves, scores the word as it stands and every candidate; the likeliest candidate is accepted if it gains more
than a margin. The margin is validated on documents held out from the model: at most `false_rate` of the clean words
there, by occurrence, may reach it. Words with the replacement character are affected but can't be restored.

The driver holds only the trigram counts, whose number the alphabet bounds, and the margin.

Defined results: null and empty texts are never affected; a text without affected words is not in the result; repeated
rows are judged alike. With too few words to train on (fewer than MIN_WORDS), the margin is its least value.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut_lineage

WORD = r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*"
LOST = "\ufffd"
LEAST_MARGIN, FALSE_RATE, MIN_WORDS, HELD_OUT = 2.0, 0.0005, 50, 5
# Code pages that a text's UTF-8 bytes may have been read as, and pairs (read as, written in).
UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "iso8859_15", "cp1250", "cp866")
SINGLE_BYTE = (("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"))


def _byte_of(codec: str) -> dict[str, int]:
    """Character to byte of a code page, for the bytes above ASCII; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
        if codec in ("cp1252", "cp1251", "cp1250"):
            out.setdefault(chr(b), b) if b < 0xA0 or codec == "cp1252" else None
    return out


def _utf8_chain(codec: str) -> Callable[[str], str]:
    """Undo `UTF-8 read as codec` wherever characters of a word stand for the bytes of one UTF-8 character."""
    byte = _byte_of(codec)
    of = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in byte.items() if lo <= b <= hi) + "]"
    cont = of(0x80, 0xBF)
    found = re.compile(f"{of(0xC2, 0xDF)}{cont}|{of(0xE0, 0xEF)}{cont}{{2}}|{of(0xF0, 0xF4)}{cont}{{3}}")

    def one(m: re.Match) -> str:
        try:
            return bytes(byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return lambda w: found.sub(one, w)


def _single_chain(read_as: str, written_in: str) -> Callable[[str], str]:
    byte = _byte_of(read_as)
    table = {}
    for c, b in byte.items():
        try:
            table[c] = bytes([b]).decode(written_in)
        except UnicodeDecodeError:
            pass

    def undo(w: str) -> str:
        return w.translate(str.maketrans(table)) if all(c in table or ord(c) < 128 for c in w) else w

    return undo


_UTF8 = {f"utf8>{c}": _utf8_chain(c) for c in UTF8_READ_AS}
_SINGLE = {f"{w}>{r}": _single_chain(r, w) for r, w in SINGLE_BYTE}


def candidates(word: str) -> dict[str, str]:
    """Repaired form to chain, over all chains of one step and of two UTF-8 steps."""
    out: dict[str, str] = {}
    for name, undo in _UTF8.items():
        if (once := undo(word)) != word:
            out.setdefault(once, name)
            for again, redo in _UTF8.items():
                if (twice := redo(once)) != once:
                    out.setdefault(twice, f"{name},{again}")
    for name, undo in _SINGLE.items():
        if (once := undo(word)) != word:
            out.setdefault(once, name)
    return out


def utf8_candidates(word: str) -> list[str]:
    return [c for undo in _UTF8.values() if (c := undo(word)) != word]


def _shape(word: str) -> str:
    """The word as the model sees it: digits alike, with its ends marked."""
    return "^^" + re.sub(r"[0-9]", "0", word) + "$"


class TrigramModel:
    """Interpolated trigram model; every order backs off to the next with the same prior weight."""

    def __init__(self, counts: dict[str, float], prior: float = 1.0):
        self.c3, self.prior = counts, prior
        self.c2, self.c1, self.h2, self.h1 = Counter(), Counter(), Counter(), Counter()
        for g, n in counts.items():
            self.c2[g[1:]] += n
            self.c1[g[2]] += n
            self.h2[g[:2]] += n
            self.h1[g[1]] += n
        self.total = sum(self.c1.values())

    def score(self, word: str) -> float:
        s, out, a = _shape(word), 0.0, self.prior
        for i in range(2, len(s)):
            g = s[i - 2 : i + 1]
            p = (self.c1[g[2]] + 0.01) / (self.total + 100.0)
            p = (self.c2[g[1:]] + a * p) / (self.h1[g[1]] + a)
            p = (self.c3.get(g, 0) + a * p) / (self.h2[g[:2]] + a)
            out += math.log(p)
        return out


def words_of(documents: DataFrame) -> DataFrame:
    """doc_id, word: the different words of each document that have a character outside ASCII."""
    return documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for pdf in batches:
        for word, n in zip(pdf["word"], pdf["n"]):
            s = _shape(word)
            for i in range(2, len(s)):
                counts[s[i - 2 : i + 1]] += n
    yield pd.DataFrame({"gram": list(counts.keys()), "n": list(counts.values())})


def train(words: DataFrame) -> TrigramModel:
    """Model over `word`, each weighted by `n`. Counts are added up per partition first."""
    grams = words.select("word", "n").mapInPandas(_trigrams, "gram string, n double")
    return TrigramModel({r.gram: r.n for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator()})


def clean_words(vocabulary: DataFrame, margin: float = LEAST_MARGIN) -> DataFrame:
    """The words to train on: those that no UTF-8 chain fits, and those that a model over the former prefers as they are."""

    def of(judge: Callable[[str, list[str]], bool]) -> Callable:
        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[[LOST not in w and judge(w, utf8_candidates(w)) for w in pdf["word"]]]

        return keep

    sure = vocabulary.mapInPandas(of(lambda w, found: not found), vocabulary.schema)
    first = vocabulary.sparkSession.sparkContext.broadcast(train(sure.withColumn("n", F.col("n_train"))))


    def fits(w: str, found: list[str]) -> bool:
        model = first.value
        known = [c for c in found if all(x in model.c1 for x in _shape(c)[2:])]
        return not known or max(map(model.score, known)) - model.score(w) <= margin

    return vocabulary.mapInPandas(of(fits), vocabulary.schema)


def score_words(vocabulary: DataFrame, model: TrigramModel) -> DataFrame:
    """word, n_train, n_held, gain, chain, repaired: the likeliest candidate of every word that has one."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)
    columns = ["word", "n_train", "n_held", "gain", "chain", "repaired"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            rows = []
            for word, n_train, n_held in zip(pdf["word"], pdf["n_train"], pdf["n_held"]):
                if LOST in word:
                    rows.append((word, n_train, n_held, math.inf, "lost", word))
                elif found := candidates(word):
                    now = model.score(word)
                    best, gain = max(((c, model.score(c) - now) for c in found), key=lambda x: x[1])
                    rows.append((word, n_train, n_held, gain, found[best], best))
            yield pd.DataFrame(rows, columns=columns)

    return vocabulary.mapInPandas(score, "word string, n_train bigint, n_held bigint, gain double, chain string, repaired string")


def garbled_words(documents: DataFrame, least_margin: float = LEAST_MARGIN, false_rate: float = FALSE_RATE) -> DataFrame:
    """word, chain, repaired of every word taken to be wrongly decoded."""
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    counts = words_of(documents).groupBy("word").agg(F.count(F.when(~held, True)).alias("n_train"), F.count(F.when(held, True)).alias("n_held"))
    vocabulary = cut_lineage(counts)
    clean = cut_lineage(clean_words(vocabulary))
    trial = score_words(clean.where("n_held > 0"), train(clean.withColumn("n", F.col("n_train"))))
    # Words of held-out documents that are not just a rare twin of a frequent word: none of them should be accepted.
    twin = clean.select(F.col("word").alias("repaired"), F.col("n_train").alias("n_repaired"))
    genuine = trial.join(twin, "repaired", "left").where(F.coalesce("n_repaired", F.lit(0)) < 10 * (F.col("n_train") + F.col("n_held")))
    found = genuine.agg(F.sum("n_held").alias("k"), F.percentile("gain", 1 - false_rate, F.col("n_held")).alias("q")).first()
    margin = max(least_margin, found.q) if (found.k or 0) >= MIN_WORDS else least_margin
    model = train(clean.withColumn("n", F.col("n_train") + F.col("n_held")))
    return score_words(vocabulary, model).where(F.col("gain") > F.lit(margin)).select("word", "chain", "repaired")


def affected(documents: DataFrame, garbled: DataFrame | None = None) -> DataFrame:
    """doc_id of every document with a wrongly decoded stretch."""
    garbled = garbled_words(documents) if garbled is None else garbled
    return words_of(documents).join(garbled.select("word"), "word").select("doc_id").distinct()


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, chains, restorable (nothing was lost), text of every affected document, its garbled words replaced."""
    garbled = garbled_words(documents)
    per_doc = words_of(documents).join(garbled, "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "repaired")).alias("swaps"), F.array_sort(F.collect_set("chain")).alias("chains"))
    joined = documents.select("doc_id", "text").join(per_doc, "doc_id")

    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(WORD)
        for pdf in batches:
            texts = []
            for text, swaps in zip(pdf["text"], pdf["swaps"]):
                table = {s["word"]: s["repaired"] for s in swaps}
                texts.append(word.sub(lambda m: table.get(m[0], m[0]), text))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "chains": [",".join(c) for c in pdf["chains"]], "restorable": ["lost" not in list(c) for c in pdf["chains"]], "text": texts})

    return joined.mapInPandas(swap, "doc_id bigint, chains string, restorable boolean, text string")
