"""Token patterns for texts of Latin letters and common punctuation, with Unicode's classes spelled out so that `re` runs them.

The characters admitted have had their classes since early Unicode versions, so libraries of any age agree on them.
"""

from __future__ import annotations

import re
import unicodedata

_ADMITTED = [*range(0x250), *range(0x2013, 0x2027), 0x20AC]
#: Finds a character that isn't admitted.
beyond = re.compile("[^\\x00-\u024f\u2013-\u2026\u20ac]").search
_CLASSES = {
    r"\p{L}": "".join(re.escape(chr(c)) for c in _ADMITTED if unicodedata.category(chr(c))[0] == "L"),
    r"\p{N}": "".join(re.escape(chr(c)) for c in _ADMITTED if unicodedata.category(chr(c))[0] == "N"),
    r"\s": re.escape("\t\n\x0b\x0c\r \x85\xa0"),
}


def spelled(pattern: str) -> re.Pattern | None:
    r"""The pattern without \p{L}, \p{N}, \s and \S; None if it has other classes or flags."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{[^}]*\}|\\.|\[\^?|\]|\(\?.|.", pattern, re.S):
        if part in _CLASSES:
            part = _CLASSES[part] if inside else f"[{_CLASSES[part]}]"
        elif part == r"\S" and not inside:
            part = f"[^{_CLASSES[chr(92) + 's']}]"
        elif part[0] == "\\" and part[1].isalnum() or part[:2] == "(?" and part[2] not in ":=!":
            return None
        elif part[0] == "[":
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
    return re.compile("".join(out))
