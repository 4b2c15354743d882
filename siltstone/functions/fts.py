"""Parser of keyword expressions: words, "phrases", prefix*, ^initial, AND, OR, NOT, parentheses.

What the grammar doesn't allow (stray punctuation, an empty string, an open quote) is invalid and makes the caller fall
back to the prefix query. NEAR groups and column filters count as invalid.
"""

from __future__ import annotations

import json
import re
import unicodedata

_PART = re.compile(r'\s+|"((?:[^"]|"")*)"|([\w]+)|([()^*])')


def _tokens(text: str) -> list[str]:
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", folded)


def parse(query: str | None) -> tuple[list[dict], str] | None:
    """(phrases, expression as JSON of nested lists) or None if invalid. Phrases: tokens, prefix, initial."""
    parts, at = [], 0
    for m in _PART.finditer(query or ""):
        if m.start() != at:
            return None
        at = m.end()
        if m[1] is not None:
            parts.append(("phrase", m[1].replace('""', '"')))
        elif m[2] is not None:
            parts.append((m[2], None) if m[2] in ("AND", "OR", "NOT") else ("near", None) if m[2] == "NEAR" else ("phrase", m[2]))
        elif m[3]:
            parts.append((m[3], None))
    if at != len(query or "") or not parts or any(p[0] == "near" for p in parts):
        return None
    phrases: list[dict] = []
    pos = 0

    def peek() -> str:
        return parts[pos][0] if pos < len(parts) else ""

    def phrase():
        nonlocal pos
        initial = peek() == "^"
        pos += initial
        if peek() != "phrase":
            raise SyntaxError
        tokens = _tokens(parts[pos][1])
        pos += 1
        prefix = peek() == "*"
        pos += prefix
        if not tokens:
            return ["none"]
        phrases.append({"tokens": tokens, "prefix": prefix, "initial": initial})
        return len(phrases) - 1

    def atom():
        """A parenthesis, or phrases side by side: all of them, before any operator applies."""
        nonlocal pos
        if peek() == "(":
            pos += 1
            out = either()
            if peek() != ")":
                raise SyntaxError
            pos += 1
            return out
        out = [phrase()]
        while peek() in ("phrase", "^"):
            out.append(phrase())
        return out[0] if len(out) == 1 else ["and", *out]

    def unlike():
        nonlocal pos
        out = atom()
        while peek() == "NOT":
            pos += 1
            out = ["not", out, atom()]
        return out

    def both():
        nonlocal pos
        out = [unlike()]
        while peek() == "AND":
            pos += 1
            out.append(unlike())
        return out[0] if len(out) == 1 else ["and", *out]

    def either():
        nonlocal pos
        out = [both()]
        while peek() == "OR":
            pos += 1
            out.append(both())
        return out[0] if len(out) == 1 else ["or", *out]

    try:
        tree = either()
    except SyntaxError:
        return None
    return (phrases, json.dumps(tree)) if pos == len(parts) and phrases else None


def prefix_query(query: str | None) -> tuple[list[dict], str]:
    """The fallback: every word as a prefix, any of them."""
    words = [_tokens(w) for w in re.findall(r"\w+", query or "")]
    phrases = [{"tokens": w, "prefix": True, "initial": False} for w in words if w]
    return phrases, json.dumps(["or", *range(len(phrases))])


def holds(expression: str, matched: set[int]) -> bool:
    def of(t) -> bool:
        if isinstance(t, int):
            return t in matched
        if t[0] == "not":
            return of(t[1]) and not of(t[2])
        return t[0] != "none" and (all if t[0] == "and" else any)(map(of, t[1:]))

    return of(json.loads(expression))
