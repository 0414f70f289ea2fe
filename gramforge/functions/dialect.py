"""RE2 patterns for the regular expressions of the JVM.

A pattern is read once, token by token; what the two engines understand differently is spelled out so that it means the
same, and what RE2 refuses is refused.
"""

from __future__ import annotations

import re

MAX_REPEAT = 1000
POSIX = {"alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}", "graph": "\\p{Graph}", "lower": "\\p{Lower}", "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\s", "upper": "\\p{Upper}", "word": "\\w", "xdigit": "\\p{XDigit}"}
_BORDER = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"
_NO_BORDER = "(?:(?<=\\w)(?=\\w)|(?<!\\w)(?!\\w))"
_SPACE = "\\t\\n\\f\\r "  # \s without the vertical tab


class BadPattern(ValueError):
    """The pattern is not valid RE2."""


def _escape(p: str, i: int, in_class: bool) -> tuple[str, int]:
    """The escape at p[i] and the place behind it."""
    if i + 1 >= len(p):
        raise BadPattern("trailing \\")
    c = p[i + 1]
    if c == "s":
        return (_SPACE if in_class else f"[{_SPACE}]"), i + 2
    if c == "S":
        return f"[^{_SPACE}]", i + 2
    if c in "dDwW":
        return "\\" + c, i + 2
    if c == "v":
        return "\\x0B", i + 2
    if c in "aftnr":
        return {"a": "\\x07"}.get(c, "\\" + c), i + 2
    if c in "pP":
        m = re.compile(r"\{(\^?)([A-Za-z_]+)\}|([A-Z])").match(p, i + 2)
        if not m:
            raise BadPattern("bad character class")
        negated = (c == "P") != (m[1] == "^")
        name = m[2] or m[3]
        if name == "Any":
            return ("[^\\x{0}-\\x{10FFFF}]" if negated else "[\\x{0}-\\x{10FFFF}]"), m.end()
        return ("\\P" if negated else "\\p") + "{" + (name if len(name) < 3 else "Is" + name) + "}", m.end()
    if c == "x":
        m = re.compile(r"\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2})").match(p, i + 2)
        if not m or int(m[1] or m[2], 16) > 0x10FFFF:
            raise BadPattern("bad \\x")
        return "\\x{" + (m[1] or m[2]) + "}", m.end()
    if c in "01234567":
        m = re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(p, i + 1)
        if not m:
            raise BadPattern("backreference")
        return "\\x{" + format(int(m[0], 8), "x") + "}", m.end()
    if not in_class and c in "bBAz":
        return {"b": _BORDER, "B": _NO_BORDER, "A": "\\A", "z": "\\z"}[c], i + 2
    if c.isascii() and c.isalnum():
        raise BadPattern(f"invalid escape \\{c}")
    return ("\\" + c if c.isascii() else c), i + 2


def _class(p: str, i: int) -> tuple[str, int]:
    """The bracket expression at p[i]."""
    out, i, first = "[", i + 1, True
    if p[i : i + 1] == "^":
        out, i = "[^", i + 1
    last = None  # the last single character, for ranges
    while True:
        if i >= len(p):
            raise BadPattern("missing ]")
        c = p[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if p.startswith("[:", i) and ":]" in p[i + 2 :]:
            end = p.index(":]", i)
            name = p[i + 2 : end]
            if name.removeprefix("^") not in POSIX:
                raise BadPattern("invalid character class range")
            known = POSIX[name.removeprefix("^")]
            out += (known[:1] + known[1].swapcase() + known[2:]) if name.startswith("^") else known
            i, last = end + 2, None
        elif c == "\\":
            text, i = _escape(p, i, True)
            out, last = out + text, None
        elif c == "-":
            if last is not None and i + 1 < len(p) and p[i + 1] not in "]\\[" and p[i + 1] < last:
                raise BadPattern("invalid character class range")
            out, i, last = out + ("-" if last is not None and p[i + 1 : i + 2] not in ("", "]") else "\\-"), i + 1, None
        else:
            out, i, last = out + ("\\" + c if c in "[&~^]#" else c), i + 1, c


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark's rlike and regexp functions. Raises BadPattern."""
    out, i, open_, may_repeat, n = [], 0, 0, False, len(pattern)
    names: set[str] = set()
    # how often what was read last is repeated by the counts in it, and the most of that in each open group
    times, most = 1, [1]
    while i < n:
        c = pattern[i]
        if c not in "*+?{":
            times = 1
        if c == "\\":
            if pattern.startswith("\\Q", i):
                end = pattern.find("\\E", i + 2)
                text = pattern[i + 2 : n if end < 0 else end]
                out.append(re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII) if text else "")
                i, may_repeat = (n if end < 0 else end + 2), may_repeat or bool(text)
                continue
            if pattern.startswith("\\C", i):
                raise BadPattern("\\C is not supported here")
            text, i = _escape(pattern, i, False)
            out.append(text)
            may_repeat = True
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
            may_repeat = True
        elif c == "(":
            open_ += 1
            may_repeat = False
            if pattern.startswith("(?", i):
                m = re.compile(r"\(\?P<([A-Za-z_]\w*)>|\(\?([imsU]*(?:-[imsU]+)?)([:)])", re.ASCII).match(pattern, i)
                if not m:
                    raise BadPattern("invalid group")
                if m[1]:
                    # the JVM has no underscore in names, and no name twice
                    out.append("(" if "_" in m[1] or m[1] in names else f"(?<{m[1]}>")
                    names.add(m[1])
                else:
                    if "U" in m[2]:
                        raise BadPattern("the flag U is not supported here")
                    # case is Unicode's, so the JVM's u goes wherever i goes
                    out.append(f"(?{m[2].replace('i', 'iu')}{m[3]}")
                    if m[3] == ")":
                        open_ -= 1
                i = m.end()
            else:
                out.append("(")
                i += 1
            if open_ == len(most):
                most.append(1)
        elif c == ")":
            open_ -= 1
            if open_ < 0:
                raise BadPattern("unexpected )")
            out.append(")")
            i, may_repeat, times = i + 1, True, most.pop()
            most[-1] = max(most[-1], times)
        elif c == "|":
            out.append("|")
            i, may_repeat = i + 1, False
        elif c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            if not may_repeat:
                raise BadPattern("no argument for repetition operator")
            m = re.compile(r"[*+?]|\{(\d+)(?:(,)(\d*))?\}").match(pattern, i)
            if m[1] and (int(m[1]) > MAX_REPEAT or m[3] and (int(m[3]) > MAX_REPEAT or int(m[3]) < int(m[1]))):
                raise BadPattern("bad repetition operator")
            if m[1]:
                count = int(m[3] or m[1])
                times *= max(1, count)
                if times > MAX_REPEAT and count > 1:
                    raise BadPattern("bad repetition operator")
                most[-1] = max(most[-1], times)
            text, i = m[0], m.end()
            if pattern.startswith("?", i):
                text, i = text + "?", i + 1
            if i < n and (pattern[i] in "*+?" or re.match(r"\{\d+(,\d*)?\}", pattern[i:])):
                raise BadPattern("bad repetition operator")
            out.append(text)
            may_repeat = False
        else:
            out.append("\\" + c if c in "{}]" else c)
            i, may_repeat, times = i + 1, True, 1
    if open_:
        raise BadPattern("missing )")
    return ("(?diu)" if ignore_case else "(?d)") + "".join(out)
