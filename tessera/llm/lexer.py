"""Functions and their comments in source files: a string- and comment-aware lexer that matches braces."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class Function(NamedTuple):
    name: str
    start: int  # character offsets
    end: int
    comment: str | None


# Lexical forms of the languages with braces.
_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_STRING = r'"(?:\\[\s\S]|[^"\\\n])*"?'
_TOKENS = {
    "rust": re.compile(rf"(?P<c>{_COMMENT})|(?P<s>r(#+)\"[\s\S]*?\"\3|{_STRING}|'(?:\\[^\n]{{1,9}}?|[^'\\\n])')|[{{}}();]"),
    "go": re.compile(rf"(?P<c>{_COMMENT})|(?P<s>{_STRING}|`[^`]*`?|'(?:\\.|[^'\\\n])*'?)|[{{}}();]"),
    "csharp": re.compile(rf"(?P<c>{_COMMENT})|(?P<s>@\"(?:\"\"|[^\"])*\"?|\"\"\"[\s\S]*?\"\"\"|{_STRING}|'(?:\\.|[^'\\\n])*'?)|[{{}}();]"),
    "javascript": re.compile(rf"(?P<c>{_COMMENT})|(?P<s>{_STRING}|'(?:\\[\s\S]|[^'\\\n])*'?|`(?:\\[\s\S]|[^`\\])*`?)|[{{}}();]"),
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_OTHER = re.compile(rf"(?P<c>{_COMMENT})|(?P<s>\"\"\"[\s\S]*?\"\"\"|{_STRING}|'(?:\\.|[^'\\\n])*'?)|[{{}}();]")
_PYTHON = re.compile(r"(?P<c>#[^\n]*)|(?P<s>[rRbBuUfF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?))")
_DEF = re.compile(r"^([ \t]*)((?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\()", re.M)
_NO_NAMES = set("if for while switch catch return with do else match loop unsafe foreach using lock fixed synchronized when select try new await typeof sizeof function".split())
_CONTROL = set("if for while switch catch return else match loop unsafe foreach using lock synchronized when select try do case throw await yield defer go".split())
_HEADER = re.compile(
    r"(?:\b(?:fn|func|function)\b\s*\*?\s*(?:\([^()]*\)\s*)?(?P<a>[A-Za-z_$][\w$]*)"
    r"|(?P<b>[A-Za-z_$#~][\w$]*)\s*[:=]\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*|\([^()]*\)\s*(?::[^=]*)?=>|[\w$]+\s*=>)"
    r"|(?P<d>[A-Za-z_$#~][\w$]*)\s*(?:<[^<>(){}]*(?:<[^<>(){}]*>[^<>(){}]*)*>)?\s*\((?=[\s\S]*\)))")
_TYPE = re.compile(r"\b(?:class|struct|enum|interface|trait|impl|namespace|module|record|union|extern|mod)\b[^()]*$")
_ATTRIBUTES = re.compile(r"(?:\s*(?:#!?\[[^\]]*\]|@[\w.]+(?:\([^()]*\))?(?!\w)|\[[\w.]+(?:\([^()]*\))?\]))*\s*")


def _name(header: str) -> tuple[str | None, int, bool]:
    """(name, place where the declaration begins, whether it is a function that is assigned) of what precedes a brace."""
    nothing = None, 0, False
    begin = _ATTRIBUTES.match(header).end()
    m = _HEADER.search(header, begin)
    if not m or _TYPE.search(header, header.rfind("\n", 0, m.start()) + 1):
        return nothing
    name = m.group("a") or m.group("b") or m.group("d")
    if name in _NO_NAMES and not m.group("a"):
        return nothing
    # where a statement needs no semicolon, the declaration begins in the line of its name
    line = header.rfind("\n", 0, m.start()) + 1
    begin = max(begin, line + len(header[line:]) - len(header[line:].lstrip()))
    first = re.match(r"[\s(!}]*(\w+)", header[begin:])
    if first and first.group(1) in _CONTROL or re.match(r"[^(]*[^=!<>]=[^=>]", header[begin:m.end()]) and not m.group("b"):
        return nothing
    return name, begin, bool(m.group("b"))


def _braced(text: str, tokens: re.Pattern) -> list[Function]:
    found: list[Function] = []
    stack: list[tuple] = []  # of open braces: (paren depth outside, name, start, comment, whether it is assigned)
    parens, segment = 0, 0
    comments: list[tuple[int, int]] = []
    for m in tokens.finditer(text):
        a, b = m.span()
        if m.lastgroup == "c":
            if parens == 0 and "\n" in text[segment:a] and not text[text.rfind("\n", 0, a) + 1:a].strip():
                if text[segment:a].strip():
                    comments = []  # what stands before ended with its line
                segment = a
            if not text[segment:a].strip():
                if comments and text.count("\n", comments[-1][1], a) > 1:
                    comments = []
                comments.append((a, b))
                segment = b
            continue
        if m.lastgroup == "s":
            continue
        ch = text[a]
        if ch == "(":
            parens += 1
        elif ch == ")":
            parens = max(0, parens - 1)
        elif ch == ";":
            if parens == 0:
                segment, comments = b, []
        elif ch == "{":
            header = text[segment:a]
            name, start, assigned = _name(header) if len(header) < 4000 and ("(" in header or "=>" in header) else (None, 0, False)
            start += segment
            near = name and comments and not re.search(r"\n[ \t\r]*\n", text[comments[-1][1]:start])
            comment = "\n".join(text[x:y] for x, y in comments) if near else None
            stack.append((parens, name, start, comment, assigned))
            parens, segment, comments = 0, b, []
        else:
            segment, comments = b, []
            if stack:
                parens, name, start, comment, assigned = stack.pop()
                if name:
                    b += assigned and text[b:b + 1] == ";"
                    found.append(Function(name, start, b, comment))
            else:
                parens = 0
    return found


def _indented(text: str) -> list[Function]:
    """Python: a body ends at the next line that is indented no more, strings and comments aside."""
    # in a text of the same length, strings are filled and their line ends hidden, so each line is a logical line
    blank = _PYTHON.sub(lambda m: "_" * len(m.group()) if m.lastgroup == "s" else " " * len(m.group()), text)
    lines = [0, *(m.end() for m in re.finditer(r"\n", blank))]
    indents: list[int | None] = []
    depth = 0
    for k, at in enumerate(lines):
        line = blank[at: lines[k + 1] if k + 1 < len(lines) else len(blank)]
        body = line.strip()
        indents.append(None if not body or depth > 0 else len(line) - len(line.lstrip()))  # lines inside brackets go on
        depth = max(0, depth + sum(map(body.count, "([{")) - sum(map(body.count, ")]}")))
    out = []
    for m in _DEF.finditer(blank):
        k = bisect.bisect_right(lines, m.start()) - 1
        indent = len(m.group(1))
        end = len(text)
        for j in range(k + 1, len(lines)):
            if indents[j] is not None and indents[j] <= indent:
                end = lines[j]
                break
        start = m.start(2)
        code = text[start:start + len(blank[start:end].rstrip())]
        inner = re.match(r"[^\n]*?:\s*\n?\s*", blank[m.start(2):end])
        comment = None
        if inner:
            doc = _PYTHON.match(text, start + inner.end())
            if doc and doc.lastgroup == "s" and ('"""' in doc.group()[:5] or "'''" in doc.group()[:5]):
                comment = doc.group()
        if comment is None:
            j, above = k - 1, []
            while j >= 0 and text[lines[j]:lines[j + 1]].strip().startswith("#"):
                above.insert(0, text[lines[j]:lines[j + 1]].strip())
                j -= 1
            comment = "\n".join(above) or None
        out.append(Function(m.group(3), start, start + len(code), comment))
    return out


#: Language by file name ending; the spelling that the lexer uses.
ENDINGS = {"py": "python", "pyi": "python", "rs": "rust", "go": "go", "cs": "csharp", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
           "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "kt": "kotlin", "swift": "swift", "php": "php", "scala": "scala", "dart": "dart"}


def language_of(path: str | None) -> str:
    return ENDINGS.get((path or "").rsplit(".", 1)[-1].lower(), "")


def functions(text: str, language: str) -> list[Function]:
    """All functions and methods with a body, each with the comment right in front of it (Python: its docstring)."""
    return _indented(text) if language == "python" else _braced(text, _TOKENS.get(language, _OTHER))
