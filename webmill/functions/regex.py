"""Patterns in the web's syntax as Java has them, so that a pattern can be checked once, on the driver, and never fails in a task."""

from __future__ import annotations

import re

from pyspark import SparkContext

from webmill.functions.patterns import BOUND, WS

_QUANTIFIER = re.compile(r"[*+?]|\{[0-9]+(?:,[0-9]*)?\}")
_GROUP = re.compile(r"\((?:\?(?:[:=!]|<[=!]|<([A-Za-z_$][A-Za-z0-9_$]*)>))?")
_NOT_BOUND = BOUND.replace("(?:", "(?!", 1)
_DOT = r"[^\n\r\u2028\u2029]"
_OUTSIDE = {"s": f"[{WS}]", "S": f"[^{WS}]", "b": BOUND, "B": _NOT_BOUND, "v": r"\x0B"}
_INSIDE = {"s": WS, "b": r"\x08", "B": "B", "v": r"\x0B"}


def _escape(text: str, i: int, inside: bool, groups: int, names: dict[str, str]) -> tuple[str, int] | None:
    """What the escape at i becomes, and where it ends. A letter without a meaning stands for itself."""
    if i + 1 >= len(text):
        return None
    c = text[i + 1]
    known = _INSIDE if inside else _OUTSIDE
    if c in known:
        return known[c], i + 2
    if inside and c == "S":
        return f"[^{WS}]", i + 2
    if c in "dDwWnrtf":
        return "\\" + c, i + 2
    for pattern in (r"c[A-Za-z]", r"x[0-9A-Fa-f]{2}", r"u[0-9A-Fa-f]{4}"):
        if m := re.compile(pattern).match(text, i + 1):
            return "\\" + m[0], m.end()
    if c == "k" and not inside and names:
        m = re.compile(r"<([^>]*)>").match(text, i + 2)
        return (rf"\k<{names[m[1]]}>", m.end()) if m and m[1] in names else None
    if m := re.compile("[0-9]+").match(text, i + 1):
        if not inside and m[0][0] != "0" and int(m[0]) <= groups:
            return f"(?:\\{m[0]})", m.end()
        octal = re.compile("[0-3]?[0-7]{1,2}").match(text, i + 1)
        return (rf"\x{int(octal[0], 8):02x}", octal.end()) if octal else (c, i + 2)
    return (c if c.isalnum() else "\\" + c), i + 2


def _class(text: str, i: int, groups: int, names: dict[str, str]) -> tuple[str, int] | None:
    """The class at i, with what is plain in it written so that it is plain in Java as well."""
    if text.startswith("[^]", i):
        return r"[\s\S]", i + 3
    if text.startswith("[]", i):
        return "(?!)", i + 2
    out, i = "[", i + 1
    if text.startswith("^", i):
        out, i = "[^", i + 1
    while i < len(text):
        c = text[i]
        if c == "]":
            return out + "]", i + 1
        if c == "\\":
            got = _escape(text, i, True, groups, names)
            if got is None:
                return None
            part, i = got
        else:
            part, i = ("\\" + c if c in "[&^" else c), i + 1
        out += part
    return None


def java(pattern: str) -> str | None:
    """The pattern for Java, or None where the web's syntax does not take it. Braces that make no quantifier, and signs
    that mean something in a class in Java only, stand for themselves; $ is the end of the text alone."""
    groups, names, level, i, out = 0, {}, 0, 0, []
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<([A-Za-z_$][A-Za-z0-9_$]*)>", pattern, re.S):
        if m[0][0] == "(":
            groups += 1
            if m[1]:
                if m[1] in names:
                    return None
                names[m[1]] = f"g{groups}"
    can_repeat = False
    while i < len(pattern):
        c = pattern[i]
        quantifier = _QUANTIFIER.match(pattern, i)
        if quantifier:
            if not can_repeat:
                return None
            out.append(quantifier[0])
            i = quantifier.end()
            if pattern.startswith("?", i):
                out.append("?")
                i += 1
            can_repeat = False
            continue
        can_repeat = True
        if c == "\\":
            got = _escape(pattern, i, False, groups, names)
        elif c == "[":
            got = _class(pattern, i, groups, names)
        elif c == "(":
            m = _GROUP.match(pattern, i)
            if not m or (m[0] == "(" and pattern.startswith("(?", i)):
                return None
            level += 1
            can_repeat = False
            got = (f"(?<{names[m[1]]}>" if m[1] else m[0]), m.end()
        elif c == ")":
            level -= 1
            if level < 0:
                return None
            got = c, i + 1
        elif c in "|^$":
            can_repeat = False
            got = {"$": r"\z"}.get(c, c), i + 1
        else:
            got = {".": _DOT, "{": r"\{", "}": r"\}", "]": r"\]"}.get(c, c), i + 1
        if got is None:
            return None
        out.append(got[0])
        i = got[1]
    return None if level else "".join(out)


def checked(pattern: str) -> str | None:
    """java(), if Java compiles it: of what the web takes it refuses lookbehinds without a limit to their length."""
    made = java(pattern)
    sc = SparkContext._active_spark_context
    if made is None or sc is None:
        return made
    from py4j.protocol import Py4JJavaError

    try:
        sc._jvm.java.util.regex.Pattern.compile(made)
    except Py4JJavaError:
        return None
    return made
