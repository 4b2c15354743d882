"""Spelling repair of misrecognised words: frequency lexicon, symmetric-delete index, weighted edit distance, bigrams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

# What scanning makes of letters, as (printed, read).
CONFUSIONS = (
    ("a", "o"), ("o", "a"), ("c", "e"), ("e", "c"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("i", "l"), ("l", "i"), ("g", "q"), ("q", "g"),
    ("m", "rn"), ("rn", "m"), ("w", "vv"), ("u", "ii"), ("d", "cl"), ("cl", "d"), ("in", "m"), ("m", "in"), ("li", "h"), ("h", "li"), ("ni", "m"), ("ri", "n"), ("n", "ri"), ("ti", "h"), ("nn", "rm"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("b", "8"), ("g", "9"), ("z", "2"), ("fi", "h"), ("k", "lc"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("e", "o"), ("o", "e"),
    ("n", "m"), ("m", "n"), ("r", "p"), ("e", "f"), ("d", "o"), ("c", "g"), ("h", "n"), ("n", "h"), ("s", "8"), ("y", "v"), ("i", "j"), ("j", "i"), ("t", "l"), ("l", "t"),
)
#: Cost of a plain edit is 1; the pairs that differ least on paper cost least.
SURE, LIKELY, PLAIN, MOST = 0.3, 0.62, 1.0, 0.65
_SURE = {
    ("a", "o"), ("e", "c"), ("t", "f"), ("h", "b"), ("i", "l"), ("g", "q"), ("m", "rn"), ("w", "vv"), ("u", "ii"), ("d", "cl"), ("in", "m"), ("li", "h"), ("cl", "d"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("b", "8"), ("g", "9"), ("z", "2"),
}
COST = {pair: SURE if pair in _SURE else LIKELY for pair in CONFUSIONS}
PREFIX, DISTANCE = 7, 2


def deletes(word: str, prefix: int = PREFIX, distance: int = DISTANCE) -> set[str]:
    """The prefix of a word without up to `distance` of its characters."""
    head = word[:prefix]
    out = {head}
    for k in range(1, min(distance, len(head) - 1) + 1):
        for gone in combinations(range(len(head)), k):
            out.add("".join(c for i, c in enumerate(head) if i not in gone))
    return out


def weighted_distance(printed: str, read: str, most: float = MOST) -> float:
    """Least cost of turning the printed word into the read one; inf beyond `most`."""
    rows, inf = len(printed), float("inf")
    best = [[inf] * (len(read) + 1) for _ in range(rows + 1)]
    best[0][0] = 0.0
    for i in range(rows + 1):
        row = best[i]
        for j in range(len(read) + 1):
            now = row[j]
            if now > most:
                continue
            if i < rows and j < len(read):
                cost = now if printed[i] == read[j] else now + PLAIN
                if cost < best[i + 1][j + 1]:
                    best[i + 1][j + 1] = cost
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= rows and j + b <= len(read) and (c := COST.get((printed[i : i + a], read[j : j + b]))) is not None and now + c < best[i + a][j + b]:
                        best[i + a][j + b] = now + c
    return best[rows][len(read)] if best[rows][len(read)] <= most else inf


class SymmetricDeleteIndex:
    """Candidates for a word: lexicon words that agree with it after up to two deletes in either prefix."""

    def __init__(self, lexicon: dict[str, tuple[int, bool]]):
        """lexicon: word to its count and whether it is an ordinary word (written in lower case)."""
        self.count = {w: n for w, (n, _) in lexicon.items()}
        self.ordinary = {w for w, (_, lower) in lexicon.items() if lower}
        self.words: dict[str, list[str]] = {}
        for word in lexicon:
            for d in deletes(word):
                self.words.setdefault(d, []).append(word)

    def candidates(self, read: str, ratio: float) -> Iterator[tuple[str, float]]:
        """(word, distance) of all lexicon words within the weighted distance. `ratio` is the least count."""
        seen: set[str] = set()
        for d in deletes(read):
            for word in self.words.get(d, ()):
                if word not in seen and word != read and abs(len(word) - len(read)) <= DISTANCE and self.count[word] >= ratio:
                    seen.add(word)
                    if (cost := weighted_distance(word, read)) <= MOST:
                        yield word, cost


def ranked(index: SymmetricDeleteIndex, read: str, count: int, ratio: float, name: bool = False) -> list[str]:
    """Candidates of a read word that are `ratio` times as frequent, nearest and most frequent first.

    What is mostly capitalised may be a name: there, and for words that are only seen in names, sure pairs alone count.
    """
    found: Iterable[tuple[str, float]] = index.candidates(read, ratio * count)
    kept = [(w, c) for w, c in found if c < LIKELY - 0.01 or (not name and w in index.ordinary)]
    return [w for w, _ in sorted(kept, key=lambda x: (round(x[1], 2), -index.count[x[0]], x[0]))]
