"""Regular expressions with linear-time-engine meaning on the JVM.

Patterns are written in RE2 syntax: ASCII ``\\b \\w \\d \\s``, ``$`` at the very
end only, ``(?P<name>)`` groups, neither look-around nor back-references.
``java_pattern`` rewrites one into java.util.regex so that it means the same.
"""

from __future__ import annotations

import re
import warnings

_WORD = "[0-9A-Za-z_]"
_AT_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NOT_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_SPACE = r"\t\n\f\r "
#: POSIX class names, by their Java names.
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}


class PatternError(ValueError):
    """The pattern is not one of the language."""


def quote(text: str) -> str:
    """A pattern for the text itself."""
    return re.sub(r"[^0-9A-Za-z_\s\x80-\U0010ffff]", lambda m: "\\" + m[0], text)


class _Rewriter:
    def __init__(self, pattern: str, multiline: bool):
        self.s, self.at, self.out = pattern, 0, []
        self.multiline = [multiline]

    def fail(self, why: str):
        raise PatternError(f"{why} in {self.s!r}")

    def escape(self, in_class: bool) -> str:
        s, i = self.s, self.at
        if i + 1 >= len(s):
            self.fail("trailing backslash")
        c = s[i + 1]
        self.at = i + 2
        if c in "bB" and not in_class:
            return _AT_BOUNDARY if c == "b" else _NOT_BOUNDARY
        if c in "123456789" or c in "kgGRXNhHZ":
            self.fail(f"\\{c} is not supported")
        if c == "C":
            self.fail("\\C is not supported")
        if c == "s":
            return _SPACE if in_class else f"[{_SPACE}]"
        if c == "S":
            return f"[^{_SPACE}]"
        if c == "v":
            return r"\x0B"
        if c == "Q":
            end = s.find("\\E", self.at)
            text = s[self.at : end if end >= 0 else len(s)]
            self.at = end + 2 if end >= 0 else len(s)
            return quote(text)
        if c in "pP":
            m = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(s, self.at)
            if not m:
                self.fail("malformed \\p")
            self.at = m.end()
            name, c = m[2] or m[3], ("P" if c == "p" else "p") if m[1] else c
            return f"\\{c}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if c == "x":
            m = re.compile(r"\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}").match(s, self.at)
            if not m:
                self.fail("malformed \\x")
            self.at = m.end()
            return "\\x" + m[0]
        if c == "0":
            m = re.compile(r"[0-7]{0,2}").match(s, self.at)
            self.at = m.end()
            return "\\0" + (m[0] or "0")
        if c == "E":
            return ""
        return "\\" + c

    def char_class(self) -> str:
        s = self.s
        out = ["["]
        self.at += 1
        if self.at < len(s) and s[self.at] == "^":
            out.append("^")
            self.at += 1
        first = True
        while True:
            if self.at >= len(s):
                self.fail("missing ]")
            c = s[self.at]
            if c == "]" and not first:
                self.at += 1
                return "".join(out) + "]"
            first = False
            if c == "[":
                m = re.compile(r"\[:(\^?)(\w+):\]").match(s, self.at)
                if m:
                    if m[2] not in _POSIX:
                        self.fail(f"unknown class {m[0]}")
                    name = _POSIX[m[2]]
                    out.append((("\\P" if name[1] == "p" else "\\" + name[1].upper()) + name[2:]) if m[1] else name)
                    self.at = m.end()
                else:
                    out.append("\\[")
                    self.at += 1
            elif c == "\\":
                out.append(self.escape(True))
            else:
                out.append("\\" + c if c in "&]" else c)
                self.at += 1

    def run(self) -> str:
        s = self.s
        while self.at < len(s):
            c = s[self.at]
            if c == "\\":
                self.out.append(self.escape(False))
            elif c == "[":
                self.out.append(self.char_class())
            elif c == "(":
                self.multiline.append(self.multiline[-1])
                if s.startswith("(?", self.at):
                    self.group()
                else:
                    self.out.append("(")
                    self.at += 1
            elif c == ")":
                if len(self.multiline) < 2:
                    self.fail("unexpected )")
                self.multiline.pop()
                self.out.append(")")
                self.at += 1
            elif c == "^":
                self.out.append(r"(?:^|(?<=\n))" if self.multiline[-1] else r"\A")
                self.at += 1
            elif c == "$":
                self.out.append(r"(?=\n|\z)" if self.multiline[-1] else r"\z")
                self.at += 1
            else:
                if c in "*+?}" and s.startswith("+", self.at + 1):
                    self.fail("possessive repetition")
                self.out.append(c)
                self.at += 1
        if len(self.multiline) > 1:
            self.fail("missing )")
        return "".join(self.out)

    def group(self) -> None:
        m = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|(:)|([imsU]*)(?:-([imsU]+))?([:)]))").match(self.s, self.at)
        if not m:
            self.fail("look-around or unknown group")
        self.at = m.end()
        if m[1]:
            self.out.append(f"(?<{m[1].replace('_', 'u')}>")  # Java allows letters and digits only
        elif m[2]:
            self.out.append("(?:")
        else:
            on, off = m[3] or "", m[4] or ""
            if "U" in on + off:
                self.fail("ungreedy flag")
            if m[5] == ")":
                self.multiline.pop()
            self.multiline[-1] = ("m" in on or self.multiline[-1]) and "m" not in off
            keep = "".join(x + ("u" if x == "i" else "") for x in on if x != "m")
            gone = "".join(x for x in off if x != "m")
            self.out.append(f"(?{keep}{'-' + gone if gone else ''}{m[5]}" if keep or gone else "" if m[5] == ")" else "(?:")


def java_pattern(
    pattern: str, *, literal: bool = False, ignore_case: bool = False, word: bool = False, whole_line: bool = False, multiline: bool = False, dot_all: bool = False
) -> str:
    """The java.util.regex form of a pattern with its options."""
    body = quote(pattern) if literal else _Rewriter(pattern, multiline).run()
    if word:
        body = f"{_AT_BOUNDARY}(?:{body}){_AT_BOUNDARY}"
    if whole_line:
        body = f"(?:^|(?<=\\n))(?:{body})(?=\\n|\\z)" if multiline else f"\\A(?:{body})\\z"
    return f"(?d{'iu' if ignore_case else ''}{'s' if dot_all else ''}){body}"


def may_match_empty(pattern: str, literal: bool = False) -> bool:
    """Whether the pattern can match nothing at all; True if that cannot be told."""
    if literal:
        return not pattern
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            from re import _parser

            text = re.sub(r"\\z", r"\\Z", re.sub(r"\[\[:\^?\w+:\]\]", "[a]", pattern))
            text = re.sub(r"\\[pP](\{\^?\w+\}|\w)", "a", text)
            return _parser.parse(text).getwidth()[0] == 0
    except Exception:  # noqa: BLE001  Python's own syntax differs in places
        return True


def required_literal(pattern: str) -> str | None:
    """A text that every match holds, to filter by before the pattern runs."""
    if re.search(r"[|()\[\]{}?*\\]|\(\?", pattern):
        return None
    parts = re.split(r"[.^$+]", re.sub(r".\+", "+", pattern))
    best = max(parts, key=len, default="")
    return best if len(best) >= 2 else None


def glob_pattern(glob: str) -> str:
    """A shell glob over one path component as a Java pattern: * and ? stop at /."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + (3 if glob[i + 1 : i + 2] in ("^", "!") else 2))
            if end < 0:
                raise PatternError(f"missing ] in {glob!r}")
            inner = glob[i + 1 : end]
            negate = inner[:1] in ("^", "!")
            inner = re.sub(r"([\[&\]])", r"\\\1", inner[1:] if negate else inner)
            out.append(f"[{'^' if negate else ''}{inner}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(quote(glob[i]))
        else:
            out.append(quote(c))
        i += 1
    return "^" + "".join(out) + r"\z"
