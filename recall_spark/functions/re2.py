"""Patterns in RE2's syntax as patterns for Java, which runs them.

RE2 has no lookaround, back references or possessive quantifiers: a pattern that has them is no
pattern. What both have but read differently is rewritten: ``$`` is the end of the text only, a line
ends at a newline only, ``\\s`` lacks the vertical tab, names of groups are written otherwise, and a
bracket inside a class is itself.
"""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
#: Escapes that Java reads as something that RE2 doesn't have.
_FOREIGN = set("123456789kGZhHRXNVu") | {"c"}


def _escape(pattern: str, at: int, inside: bool) -> tuple[str, int] | None:
    """The escape at ``at`` for Java, and where it ends; none if RE2 has no such escape."""
    c = pattern[at + 1 : at + 2]
    if not c or c in _FOREIGN or (c in "eECL" and c != "C"):
        return None
    if c == "s":
        return (_SPACE if inside else f"[{_SPACE}]"), at + 2
    if c == "S" and not inside:
        return f"[^{_SPACE}]", at + 2
    if c == "v":
        return r"\x0B", at + 2
    if c == "C":
        return "(?s:.)", at + 2
    if c in "pP":
        m = re.compile(r"\\[pP](?:\{(\^?)(\w+)\}|(\w))").match(pattern, at)
        if not m:
            return None
        name, sign = m[2] or m[3], c if not m[1] else "Pp"["Pp".index(c) - 1]
        return (rf"\{sign}{{{name}}}" if len(name) <= 2 else rf"\{sign}{{Is{name}}}"), m.end()
    if c == "Q":
        end = pattern.find(r"\E", at)
        end = len(pattern) if end < 0 else end
        return "".join(rf"\{x}" if not x.isalnum() and x.isascii() else x for x in pattern[at + 2 : end]), min(len(pattern), end + 2)
    return pattern[at : at + 2], at + 2


def to_java(pattern: str) -> str | None:
    """A pattern for Java's engine that finds what RE2 finds, or none if RE2 would refuse it.

    What neither can compile is left to Java's compiler to refuse.
    """
    out, at, depth = [], 0, 0
    lines = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            got = _escape(pattern, at, depth > 0)
            if got is None:
                return None
            text, at = got
            out.append(text)
            continue
        if depth:
            posix = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, at)
            if posix:
                name = {"word": "w"}.get(posix[2])
                out.append((rf"\{'W' if posix[1] else 'w'}") if name else rf"\{'P' if posix[1] else 'p'}{{{posix[2].capitalize() if posix[2] != 'xdigit' else 'XDigit'}}}")
                at = posix.end()
                continue
            if c == "]" and at > first:
                depth = 0
            out.append(rf"\{c}" if c in "[&" or (c == "]" and depth) else c)
        elif c == "[":
            depth, first = 1, at + (2 if pattern[at + 1 : at + 2] == "^" else 1)
            out.append(pattern[at:first])
            at = first
            continue
        elif c == "(" and pattern.startswith("(?", at):
            m = re.compile(r"\(\?(?:P?<[A-Za-z_]\w*>|([imsU]*)(-[imsU]+)?([:)]))").match(pattern, at)
            if not m:
                return None
            if m[3]:
                flags = f"{m[1].replace('U', '')}{(m[2] or '').replace('U', '')}".rstrip("-")
                out.append(f"(?{flags.replace('i', 'iu', 1) if '-' not in flags else flags}{m[3]}" if flags else "(?:" if m[3] == ":" else "")
            else:
                out.append("(")
            at = m.end()
            continue
        elif c == "$" and not lines:
            out.append(r"\z")
        elif c in "*+?" and out and pattern[at + 1 : at + 2] == "+":
            return None
        elif c == "}" and pattern[at + 1 : at + 2] == "+" and re.search(r"\{\d+(,\d*)?\}$", pattern[: at + 1]):
            return None
        else:
            out.append(c)
        at += 1
    # A line ends at a newline only.
    return None if depth else "(?d)" + "".join(out)
