"""Search patterns: users write ECMAScript regular expressions (no ``u`` flag), Spark runs Java's.

``java_pattern`` walks over a pattern once, knowing escapes, classes and quantifiers, and writes the same expression
in Java's dialect. What the users' dialect does not have is refused.
"""

from __future__ import annotations

import re


class InvalidPattern(ValueError):
    """A regular expression that does not compile."""


# Fixed values of the two dialects.
_SPACE = r"\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE_ENDS = r"\n\r\u2028\u2029"
_NAME = re.compile(r"<([A-Za-z_$][\w$]*)>")
_SAME = frozenset("dDwWfnrt")
_GROUP = re.compile(r"\(\?(?::|=|!|<=|<!|<[A-Za-z_$][\w$]*>)")
_COUNT = re.compile(r"\{\d+(?:,\d*)?\}")
_HEX = {"x": re.compile(r"[0-9A-Fa-f]{2}"), "u": re.compile(r"[0-9A-Fa-f]{4}")}


def _java_name(name: str) -> str:
    """A group's name in letters and digits alone, which Java asks for; different names stay different."""
    return "g" + "".join(c if c.isascii() and c.isalnum() and c != "Z" else f"Z{ord(c):x}Z" for c in name)


def _escape(pattern: str, k: int, inside: bool) -> tuple[str, int]:
    """(Java's form of the escape at k, the place after it)."""
    if k + 1 == len(pattern):
        raise InvalidPattern(pattern)
    c = pattern[k + 1]
    if c in _SAME:
        return "\\" + c, k + 2
    if c == "s":
        return (_SPACE if inside else f"[{_SPACE}]"), k + 2
    if c == "S":
        return f"[^{_SPACE}]", k + 2
    if c == "v":
        return r"\x0B", k + 2
    if c in "bB" and not (inside and c == "B"):
        return (r"\x08" if inside else "\\" + c), k + 2
    if c in _HEX and (digits := _HEX[c].match(pattern, k + 2)):
        return f"\\{c}{digits.group()}", digits.end()
    if c == "c" and k + 2 < len(pattern) and pattern[k + 2].isascii() and pattern[k + 2].isalpha():
        return f"\\x{ord(pattern[k + 2]) % 32:02x}", k + 3
    if c == "0" and not pattern[k + 2 : k + 3].isdigit():
        return r"\x00", k + 2
    if c == "k" and not inside and (name := _NAME.match(pattern, k + 2)):
        return f"\\k<{_java_name(name.group(1))}>", name.end()
    if c.isascii() and c.isdigit() and not inside:
        return "\\" + c, k + 2  # a back reference
    return (c if c.isascii() and c.isalnum() or not c.isascii() else "\\" + c), k + 2  # a plain character


def _class(pattern: str, k: int) -> tuple[str, int]:
    """(Java's form of the class that opens at k, the place after it)."""
    negated = pattern.startswith("[^", k)
    at, out = k + 1 + negated, []
    while at < len(pattern) and pattern[at] != "]":
        if pattern[at] == "\\":
            text, at = _escape(pattern, at, inside=True)
        else:
            text, at = ("\\" + pattern[at] if pattern[at] in "[&^" else pattern[at]), at + 1
        out.append(text)
    if at == len(pattern):
        raise InvalidPattern(pattern)
    if not out:
        return (r"[\s\S]" if negated else "(?!)"), at + 1
    return f"[{'^' if negated else ''}{''.join(out)}]", at + 1


def java_pattern(pattern: str) -> str:
    """The pattern in Java's dialect: ``$`` is the end of the text, a class holds no class, no possessive quantifiers or inline flags."""
    out: list[str] = []
    k, atom = 0, False  # whether a quantifier may follow
    while k < len(pattern):
        c, quantified = pattern[k], None
        if c == "\\":
            text, end = _escape(pattern, k, inside=False)
            atom = pattern[k + 1] not in "bB"
        elif c == "[":
            (text, end), atom = _class(pattern, k), True
        elif c == "(":
            opened = _GROUP.match(pattern, k)
            if pattern.startswith("(?", k) and not opened:
                raise InvalidPattern(pattern)
            text, atom = (opened.group() if opened else "("), False
            end = k + len(text)
            if named := _NAME.match(text, 2):
                text = f"(?<{_java_name(named.group(1))}>"
        elif c in "*+?" or c == "{" and (quantified := _COUNT.match(pattern, k)):
            if not atom:
                raise InvalidPattern(pattern)
            text = quantified.group() if quantified else c
            end, atom = k + len(text), False
            if pattern.startswith("?", end):
                text, end = text + "?", end + 1
        elif c == "$":
            text, end, atom = r"\z", k + 1, False
        elif c == ".":
            text, end, atom = f"[^{_LINE_ENDS}]", k + 1, True
        elif c in "^|":
            text, end, atom = c, k + 1, False
        elif c == ")":
            text, end, atom = c, k + 1, True
        else:
            text, end, atom = ("\\" + c if c in "{}]" else c), k + 1, True
        out.append(text)
        k = end
    return "".join(out)
