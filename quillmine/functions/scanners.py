"""Declarations of source files, by language, with the span of each.

Python goes through its own parser; brace languages through a scanner that
blanks comments and strings first and then matches braces, so that neither a
brace in a string nor a keyword in a comment counts. Used one file at a time by
the symbol table function.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from concurrent.futures import Executor, Future
from functools import lru_cache

import numpy as np

#: name, kind, start_line, start_col, end_line, end_col, signature, doc, type
Found = tuple

_TOKENS = {
    "go": r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|`[^`]*(?:`|\Z)|' + r"'(?:\\.|[^'\\\n])*'",
    "javascript": r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*(?:`|\Z)',
    "rust": r'//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)".*?"\1|"(?:\\.|[^"\\])*"|' + r"'(?:\\.[^']*|[^'\\\n])'",
}
_TOKENS["typescript"] = _TOKENS["java"] = _TOKENS["javascript"]
_TOKENS["c"] = _TOKENS["cpp"] = r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"

_ID = r"[A-Za-z_$][\w$]*"
#: (kind, pattern with a group `name`, whether a body in braces follows)
_RULES = {
    "go": [
        ("method", r"^func[ \t]*\([^)]*\)[ \t]*(?P<name>\w+)", True),
        ("function", r"^func[ \t]+(?P<name>\w+)", True),
        ("struct", r"^(?:type[ \t]+|[ \t]+)(?P<name>\w+)(?:\[[^\]\n]*\])?[ \t]+struct\b", True),
        ("interface", r"^(?:type[ \t]+|[ \t]+)(?P<name>\w+)(?:\[[^\]\n]*\])?[ \t]+interface\b", True),
        ("type", r"^type[ \t]+(?P<name>\w+)[ \t]+=?[ \t]*(?!struct\b|interface\b)[\w\[\]*.(]", False),
        ("variable", r"^var[ \t]+(?P<name>\w+)", False),
        ("constant", r"^const[ \t]+(?P<name>\w+)", False),
    ],
    "javascript": [
        ("function", rf"\bfunction[ \t]*\*?[ \t]*(?P<name>{_ID})[ \t]*\(", True),
        ("class", rf"\bclass[ \t]+(?P<name>{_ID})", True),
    ],
    "typescript": [
        ("function", rf"\bfunction[ \t]*\*?[ \t]*(?P<name>{_ID})[ \t]*[(<]", True),
        ("class", rf"\bclass[ \t]+(?P<name>{_ID})", True),
        ("interface", rf"\binterface[ \t]+(?P<name>{_ID})", True),
        ("type", rf"\btype[ \t]+(?P<name>{_ID})(?:<[^=\n]*>)?[ \t]*=", False),
        ("enum", rf"\benum[ \t]+(?P<name>{_ID})", True),
    ],
    "rust": [
        ("function", r"\bfn[ \t]+(?P<name>\w+)", True),
        ("struct", r"\bstruct[ \t]+(?P<name>\w+)", True),
        ("enum", r"\benum[ \t]+(?P<name>\w+)", True),
        ("trait", r"\btrait[ \t]+(?P<name>\w+)", True),
    ],
    "java": [
        ("class", r"\bclass[ \t]+(?P<name>\w+)", True),
        ("interface", r"\binterface[ \t]+(?P<name>\w+)", True),
        ("enum", r"\benum[ \t]+(?P<name>\w+)", True),
        ("method", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized)[ \t]+)+[\w<>\[\], .?]+[ \t]+(?P<name>\w+)[ \t]*\(", True),
    ],
    "c": [
        ("struct", r"\bstruct[ \t]+(?P<name>\w+)\s*\{", True),
        ("function", r"^(?!(?:return|else|if|while|for|switch|typedef)\b)[\w*][\w \t*]*[ \t*](?P<name>\w+)[ \t]*\([^;{}]*\)\s*\{", True),
    ],
}
#: More kinds, on request: (kind, pattern, whether a body follows, the kind of the
#: innermost symbol around it, "" for none, None for any).
DETAILS = {
    "go": [
        ("import", r'^import[ \t]+(?:[\w.]+[ \t]+)?"(?P<name>[^"\n]+)"', False, ""),
        ("field", r"^[ \t]+(?P<name>[A-Za-z_]\w*)[ \t]+[\w\[\]*.]+", False, "struct"),
    ],
    "javascript": [
        ("method", rf"^[ \t]*(?:(?:static|async|get|set)[ \t]+)*\*?[ \t]*(?P<name>#?{_ID})[ \t]*\([^)]*\)[^;{{}}\n]*\{{", True, "class"),
        ("field", rf"^[ \t]*(?:static[ \t]+)?(?P<name>#?{_ID})[ \t]*(?::[^=;\n]+)?[=;]", False, "class"),
        ("import", r"""^import\b[^'"\n]*['"](?P<name>[^'"\n]+)['"]""", False, ""),
        ("function", rf"^(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name>{_ID})[^=\n]*=[ \t]*(?:async[ \t]+)?(?:function\b|\([^)\n]*\)[^=\n]*=>|{_ID}[ \t]*=>)", False, ""),
        ("constant", rf"^(?:export[ \t]+)?const[ \t]+(?P<name>{_ID})", False, ""),
        ("variable", rf"^(?:export[ \t]+)?(?:let|var)[ \t]+(?P<name>{_ID})", False, ""),
    ],
    "rust": [
        ("impl", r"^[ \t]*impl\b(?:[ \t]*<[^>\n]*>)?[ \t]+(?:[\w:<>]+[ \t]+for[ \t]+)?(?P<name>\w+)", True, None),
        ("module", r"^[ \t]*(?:pub[ \t]+)?mod[ \t]+(?P<name>\w+)", True, None),
        ("constant", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:const|static)[ \t]+(?:mut[ \t]+)?(?P<name>\w+)[ \t]*:", False, None),
        ("type", r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?type[ \t]+(?P<name>\w+)", False, None),
        ("import", r"^[ \t]*(?:pub[ \t]+)?use[ \t]+(?P<name>[^;\n]+)", False, ""),
    ],
}
DETAILS["typescript"] = [
    ("method", rf"^[ \t]*(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)[ \t]+)*(?P<name>#?{_ID})[ \t]*(?:<[^>\n]*>)?\([^)]*\)[^;{{}}\n]*\{{", True, "class"),
    ("field", rf"^[ \t]*(?:(?:public|private|protected|static|readonly|declare)[ \t]+)*(?P<name>#?{_ID})[?!]?[ \t]*(?::[^=;\n]+)?[=;]", False, "class"),
    ("module", rf"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?namespace[ \t]+(?P<name>{_ID})", True, None),
    *DETAILS["javascript"][2:],
]
#: Words that stand before a parenthesis in a class body's methods.
_NO_METHOD = frozenset("if for while switch catch function return with".split())
_OPENS = frozenset("function method class struct interface enum trait impl module namespace package".split())
_RULES["cpp"] = [*_RULES["c"], ("class", r"\bclass[ \t]+(?P<name>\w+)[^;{]*\{", True)]
_BLOCK = re.compile(r"^(var|const|type)[ \t]*\(", re.M)


#: What declarations, details and errors ask of a file one after the other, for the last few files.
_held = lru_cache(maxsize=4)


@_held
def blanked(source: str, language: str) -> str:
    """The source with comments and strings as spaces, newlines kept."""
    return re.sub(_TOKENS[language], lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


_BRACKET = re.compile(r"[()\[\]{}]")
_HEAD_ENDS = re.compile(r"[(\[{};\n]")
#: What may begin a line that goes on with a declaration's head.
_GOES_ON = re.compile(r"\s*(\{|->|where\b|:|extends\b|implements\b|throws\b)")


class Bodies:
    """Where the brackets of a source close, found in one pass with a stack."""

    def __init__(self, code: str):
        self.code = code
        #: the partner of each bracket, whatever its form, and of each brace among braces
        self.partner: dict[int, int] = {}
        self.brace: dict[int, int] = {}
        every, braces = [], []
        for m in _BRACKET.finditer(code):
            c, i = m[0], m.start()
            if c in "([{":
                every.append(i)
                if c == "{":
                    braces.append(i)
                continue
            if every:
                self.partner[every.pop()] = i
            if c == "}" and braces:
                self.brace[braces.pop()] = i

    def end(self, at: int) -> int:
        """The place after the declaration that begins before `at`: its closing brace, or
        the line's end."""
        code, i = self.code, at
        while m := _HEAD_ENDS.search(code, i):
            c, i = m[0], m.start()
            if c in "([":
                i = self.partner.get(i, len(code))
            elif c == ";":
                return i + 1
            elif c == "{":
                return self.brace.get(i, len(code) - 1) + 1
            elif c == "}" or not _GOES_ON.match(code, i + 1):
                return i
            i += 1
        return len(code)


@_held
def _bodies(code: str) -> Bodies:
    return Bodies(code)


@_held
def _positions(source: str) -> Callable[[int], tuple[int, int]]:
    """From a place in the source to its line and column in bytes."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    plain = source.isascii()
    if not plain:
        code = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), "<u4")
        size = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
        bytes_to = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])

    def at(offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, offset) - 1
        return line + 1, (offset - starts[line] if plain else int(bytes_to[offset] - bytes_to[starts[line]])) + 1

    return at


def _comment_above(lines: list[str], line: int) -> str | None:
    """The // comments directly above, joined; blank lines between are skipped."""
    out, i = [], line - 2
    while i >= 0 and (not lines[i].strip() or lines[i].strip().startswith("//")):
        if lines[i].strip():
            out.append(lines[i].strip()[2:].strip())
        i -= 1
    return " ".join(reversed(out)) or None


def _braced(source: str, language: str) -> Iterator[Found]:
    code, at, lines = blanked(source, language), _positions(source), source.split("\n")
    bodies = _bodies(code)
    seen: set[tuple[int, str]] = set()
    for kind, pattern, body in _RULES[language]:
        for m in re.finditer(pattern, code, re.M):
            name_at = m.start("name")
            if (name_at, m["name"]) in seen:
                continue
            seen.add((name_at, m["name"]))
            whole = m.start() + len(m[0]) - len(m[0].lstrip())
            only_name = language == "go" and kind not in ("function", "method")
            end = m.end("name") if only_name else bodies.end(m.end("name")) if body else code.find("\n", m.end()) % (len(code) + 1)
            start = name_at if only_name else whole
            head = source[whole : code.find("\n", whole) % (len(code) + 1)].rstrip(" {")
            yield (m["name"], kind, *at(start), *at(end), head.strip(), _comment_above(lines, at(start)[0]) if language == "go" else None, None)
    if language == "go":
        for m in _BLOCK.finditer(code):
            end = code.find("\n)", m.end())
            kind = {"var": "variable", "const": "constant", "type": "type"}[m[1]]
            for s in re.finditer(r"^[ \t]+(?P<name>\w+)(?=[ \t,=\n])", code[m.end() : end if end >= 0 else len(code)], re.M):
                place = m.end() + s.start("name")
                if (place, s["name"]) not in seen and not (kind == "type" and re.match(r"[ \t]+(struct|interface)\b", code[m.end() + s.end() :])):
                    seen.add((place, s["name"]))
                    yield (s["name"], kind, *at(place), *at(place + len(s["name"])), s[0].strip(), None, None)


class Around:
    """The innermost symbol that opens a scope around places, which are asked for in
    rising order."""

    def __init__(self, found: list[Found]):
        self.waiting = sorted((f for f in found if f[1] in _OPENS), key=lambda f: (f[2], f[3]), reverse=True)
        self.open: list[Found] = []

    def at(self, place: tuple[int, int]) -> Found | None:
        while self.waiting and (self.waiting[-1][2], self.waiting[-1][3]) <= place:
            self.open.append(self.waiting.pop())
        while self.open and (self.open[-1][4], self.open[-1][5]) <= place:
            self.open.pop()
        return self.open[-1] if self.open else None

    def add(self, f: Found) -> None:
        """A symbol at the place asked for last."""
        if f[1] in _OPENS:
            self.open.append(f)


def _details(source: str, language: str, plain: list[Found]) -> Iterator[Found]:
    # imports are named by strings, which are blanks in the code
    code, at = blanked(source, language), _positions(source)
    bodies = _bodies(code)
    seen, found = {(f[2], f[0]) for f in plain}, list(plain)
    if language == "go":  # a struct's own span is its name
        for m in re.finditer(r"\b(\w+)(?:\[[^\]\n]*\])?[ \t]+struct[ \t]*\{", code):
            found.append((m[1], "struct", *at(m.end()), *at(bodies.end(m.end() - 1)), "", None, None))
    for kind, pattern, body, parent in DETAILS.get(language, ()):
        around = Around(found)
        for m in re.finditer(pattern, source if kind == "import" else code, re.M):
            whole = m.start() + len(m[0]) - len(m[0].lstrip())
            line, col = at(whole)
            name = m["name"].strip()
            if code[whole] == " " or (line, name) in seen or kind == "method" and name in _NO_METHOD:
                continue
            outer = around.at((line, col))
            if parent is not None and (outer[1] if outer else "") != parent:
                continue
            end = bodies.end(m.end() - 1 if m[0].endswith("{") else m.end("name")) if body else code.find("\n", m.end()) % (len(code) + 1)
            seen.add((line, name))
            out = (name, kind, line, col, *at(end), source[whole : code.find("\n", whole) % (len(code) + 1)].rstrip(" {"), None, None)
            found.append(out)
            around.add(out)
            yield out


@_held
def _parsed(source: str) -> ast.Module | Exception:
    """The tree of a source, or why there is none."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return e.with_traceback(None)


def _python(source: str, details: bool) -> Iterator[Found]:
    tree = _parsed(source)
    if isinstance(tree, Exception):
        at = _positions(source)
        for kind, pattern in (("function", r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)"), ("class", r"^[ \t]*class[ \t]+(?P<name>\w+)")):
            for m in re.finditer(pattern, source, re.M):
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                yield (m["name"], kind, *at(start), *at(m.end()), m[0].strip(), None, None)
        return
    lines = source.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            head = lines[node.lineno - 1].strip().rstrip(":")
            yield (node.name, kind, node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1, head, ast.get_docstring(node), None)
    for node in tree.body if details else ():
        place = (node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1, lines[node.lineno - 1].strip(), None, None)
        if isinstance(node, ast.Import | ast.ImportFrom):
            base = "." * node.level + (node.module or "") if isinstance(node, ast.ImportFrom) else ""
            for alias in node.names:
                yield (f"{base}.{alias.name}".lstrip(".") if base else alias.name, "import", *place)
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name):
                yield (t.id, "constant" if t.id.isupper() else "variable", *place)


def declarations(source: str | None, language: str | None, details: bool = False) -> list[Found]:
    if not source or language is None:
        return []
    if language == "python":
        found = list(_python(source, details))
    else:
        found = list(_braced(source, language)) if language in _RULES else []
        if details and language in _TOKENS:
            found += _details(source, language, found)
    return sorted(found, key=lambda f: (f[2], f[3], f[0]))


def described(source: str | None, language: str | None, details: bool = False, parser: Callable[[str], list[Found]] | None = None) -> list[tuple]:
    """(name, kind, type, start_line, start_col, end_line, end_col, signature, doc,
    scope, properties): declarations with the name of the innermost symbol around
    them and what their heads say."""
    if parser is not None:
        found = sorted(parser(source), key=lambda f: (f[2], f[3], f[0])) if source else []
    else:
        found = declarations(source, language, details)
    out, opened = [], []
    for f in found:  # by place: whoever is open and has not ended is around
        name, kind, line, col, end_line, end_col, head, doc, typed = f
        while opened and (opened[-1][4], opened[-1][5]) <= (line, col):
            opened.pop()
        around = opened[-1][0] if opened else None
        properties = [("async", "true")] if re.match(r"(?:export\s+)?(?:default\s+)?(?:static\s+)?(?:pub\s+)?async\b", head) else []
        if language == "go" and kind == "method" and (m := re.match(r"func\s*\(\s*\w*\s*\*?\s*(\w+)", head)):
            properties.append(("receiver", m[1]))
        if kind in ("method", "field") and re.match(r"(?:\w+\s+)*?static\b", head):
            properties.append(("static", "true"))
        out.append((name, kind, typed, line, col, end_line, end_col, head, doc, around, properties))
        if kind in _OPENS and (end_line, end_col) > (line, col):
            opened.append(f)
    return out


def described_later(pool: Executor, source: str, language: str) -> Future:
    """described(), by a pool's thread or process."""
    return pool.submit(described, source, language)


def syntax_errors(source: str | None, language: str | None) -> list[tuple[int, int, str]]:
    """(line, column, message) of what does not parse: Python's own verdict, and
    brackets that do not match elsewhere."""
    if not source or language is None:
        return []
    if language == "python":
        e = _parsed(source)
        if isinstance(e, SyntaxError):
            return [(e.lineno or 1, e.offset or 1, e.msg)]
        return [(1, 1, str(e))] if isinstance(e, Exception) else []
    if language not in _TOKENS:
        return []
    code, at, stack, out = blanked(source, language), _positions(source), [], []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            stack.append((m[0], m.start()))
        elif stack and "([{".index(stack[-1][0]) == ")]}".index(m[0]):
            stack.pop()
        else:
            out.append((*at(m.start()), f"unexpected {m[0]}"))
    return out + [(*at(p), f"unclosed {c}") for c, p in stack]
