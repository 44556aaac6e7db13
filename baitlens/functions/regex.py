"""Regular expressions: Unicode-aware classes written for the JVM matcher.

The JVM classes ``\\w \\d \\s \\b`` are ASCII-only by default; feature definitions mean the Unicode ones.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

_CLASSES = {"w": WORD, "d": DIGIT, "s": SPACE}


#: A letter, a digit or a class of them that must occur.
_WORD_AHEAD = re.compile(r"([A-Za-z0-9]|\[(?:[A-Za-z0-9](?:-[A-Za-z0-9])?)+\])(?![?*{|])")
_SPECIAL = set("\\()[]{}.*+?^$")


def _with_first_letters(body: str) -> str:
    """A choice of plain words is guarded by its first letters, so most positions fail after one test."""
    words = body.split("|")
    if len(words) < 2 or any(not w or _SPECIAL & set(w) for w in words):
        return body
    first = "".join(dict.fromkeys(w[0] for w in words))
    return f"(?=[{first}])(?:{body})"


def unicode_pattern(pattern: str) -> str:
    """Rewrite shorthand classes to Unicode ranges, fold case on Unicode, treat only ``\\n`` as line end."""
    out: list[str] = []
    inside = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt.lower() in _CLASSES:
                body = _CLASSES[nxt.lower()]
                negated = nxt.isupper()
                out.append(body if inside and not negated else f"[{'^' if negated else ''}{body}]")
            elif nxt == "b" and not inside:
                ahead = _WORD_AHEAD.match(pattern, i + 2)
                # a word character must follow, so only the side before is looked at, and only where it fits
                out.append(f"(?={ahead[1]})(?<![{WORD}])" if ahead else BOUNDARY)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if inside:
            inside = ch != "]"
            out.append("\\" + ch if ch in "[&" else ch)
        else:
            inside = ch == "["
            out.append(ch)
        i += 1
    flags, body = "(?d)", "".join(out)
    if body.startswith("(?i)"):
        flags, body = "(?iud)", body[len("(?i)"):]
    return flags + _with_first_letters(body)
