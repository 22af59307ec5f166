"""Signs in a source text that nobody wrote it by hand for its project."""

from __future__ import annotations

import re

# How generators, bundlers and foreign projects mark their files.
_GENERATED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?\s?generated (?:file|code|by|from|source)\b|\bautomatically (?:generated|created|produced)\b|\bauto generated (?:file|code)\b|\bautogenerated file\b"
    r"|\b(?:code|file|source|class|this|module) (?:is |was |has been )?(?:generated|produced|emitted|created) (?:by|from|with|using|automatically)\b|\bgenerated (?:by|from|with|using|code|file|source)\b|\bdo not (?:edit|modify|change|touch)\b"
    r"|\bproduced from \S+ (?:by|with)\b|\bmachine[- ](?:written|generated|made)\b|\bchanges (?:will|may) be (?:lost|overwritten)\b|\boutput of\b.{0,60}\b(?:emit|gen|compiler)|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bgénéré automatiquement\b|\bgenerado automáticamente\b|自動生成|自动生成", re.I)
_BY_HAND = re.compile(r"\b(?:written|edited|maintained|made) by hand\b|\bhand-?written\b|\bedit freely\b|\bnot (?:auto-?)?generated\b|\bno longer generated\b", re.I)
_IMPORTED = re.compile(
    r"\b(?:imported|copied|taken|vendored|mirrored|borrowed|backported) (?:unchanged |verbatim |unmodified |directly )?from\b|\bsee UPSTREAM\b|\bupstream (?:version|release|source|commit)\b|\bthird[- ]party\b.{0,40}\b(?:code|source|library|file|copy)\b", re.I)
_OWNER = re.compile(
    r"copyright (?:\(c\) |© )?(?:\d{4}(?:\s*[-–,]\s*\d{4})* )?(?:by )?(?:the )?(?P<a>[\w./-]+?)(?: contributors| authors| project| developers| team|[.,\s]|$)"
    r"|part of (?:the )?(?P<b>[\w./-]+?)(?: project| library| package|[.,\s]|$)|(?:file|code|module) belongs to (?:the )?(?P<c>[\w./-]+?)[.,\s]"
    r"|\(c\) (?:\d{4}(?:\s*[-–,]\s*\d{4})* )?(?:the )?(?P<d>[\w./-]+?) (?:contributors|authors|project|developers|team)\b", re.I)
_BANNER = re.compile(r"^/\*!\s*(?P<n>[\w.-]+) v?\d+(?:\.\d+)*\b")
# A comment where code could stand: to the end of its line, or to its closing mark.
_LEADING = re.compile(
    r"\s*(?:/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|--\[\[[\s\S]*?(?:\]\]|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\(\*[\s\S]*?(?:\*\)|\Z)|\{-[\s\S]*?(?:-\}|\Z)"
    r"|(?://|#(?!include|define|pragma|if|endif)|--|;)[^\n]*)")
_TRAILING = re.compile(r"\s*(?://|/\*|\*|#(?!include|define|pragma|if|endif)|--|;|<!--|\"\"\"|''')")
_CLOSING = re.compile(r"[\s})\];,]*")
_DATA = re.compile(r"^[\s\[\](){},;:\"'0-9a-fA-FxXuULl.+\\/=_-]*$")
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]*(?!\w)")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{40,}|(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){8,}|[0-9a-fA-F]{32,}")
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_NAMES = re.compile(r"[A-Za-z_$][\w$]*")


def own_names(path: str) -> set[str]:
    """Names by which a file's own project may be called: its first folder, below monorepo/ also the second."""
    parts = [p.lower() for p in path.split("/")]
    names = {parts[0]}
    if len(parts) > 2:
        names |= {"/".join(parts[:2])}
        if parts[0] == "monorepo":
            names |= {parts[1]}
    return names | {"monorepo"}


def comments(text: str) -> tuple[list[str], list[str]]:
    """The lines of the comments that a text begins with, however many, and of those that it ends with, closing brackets
    aside."""
    at, head = 0, []
    while m := _LEADING.match(text, at):
        head += m.group().split("\n")
        at = m.end()
    tail, end = [], len(text)
    while end > at:
        start = text.rfind("\n", at, end)
        start = at if start < 0 else start + 1
        line = text[start:end].rstrip()
        if line.endswith("*/"):
            start = max(at, text.rfind("/*", at, end))
            if text[text.rfind("\n", 0, start) + 1:start].strip():
                break  # code stands in front of it
            tail += text[start:end].split("\n")
        elif _TRAILING.match(line):
            tail.append(line)
        elif not _CLOSING.fullmatch(line):
            break
        end = max(at, start - 1)
    return [x.strip() for x in head if x.strip()], [x.strip() for x in tail if x.strip()]


def data_share(text: str) -> float:
    """The share of a text's characters, blanks aside, that are embedded data: numbers with their separators, long
    encoded strings, and table rows of quoted values."""
    total = data = 0
    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        total += len(s)
        if len(s) > 16 and _DATA.match(s) and (len(_NUMBER.findall(s)) >= 3 or _BLOB.search(s)):
            data += len(s)
            continue
        blob = sum(len(b) for b in _BLOB.findall(s))
        if blob * 2 > len(s):
            data += len(s)
            continue
        quoted = sum(map(len, _QUOTED.findall(s)))
        rest = _QUOTED.sub("", s)
        if len(s) > 16 and (quoted + len(rest) - len(_NAMES.sub("", _NUMBER.sub("", rest)))) and re.fullmatch(r"[\s\[\](){},;:]*", _NUMBER.sub("", rest)) and (quoted * 2 > len(s) or len(_NUMBER.findall(rest)) >= 2):
            data += len(s)
    return data / total if total else 0.0


#: Characters from which nobody types a line of code.
LONG_LINE = 400


def minified(text: str) -> bool:
    """Most of the text stands in lines longer than LONG_LINE that hardly have blanks."""
    long_ = [x for x in text.splitlines() if len(x) > LONG_LINE]
    size = sum(map(len, long_))
    if size * 2 <= len(text):
        return False
    code = "".join(long_)
    return _NUMBER.sub("", code).count(" ") < 0.1 * size and len(_NAMES.findall(code)) > 20 and data_share(text) < 0.5


_HEADS = set("if for while switch catch elif with match return".split())
_OPENS = ("{", ":", "=>", "=")


def declared_name(line: str) -> str | None:
    """The name in front of the last brackets of a line that opens a body, None where there is none."""
    s = line.rstrip()
    if not s.endswith(_OPENS):
        return None
    close = s.rfind(")")
    open_ = s.rfind("(", 0, close)
    if close < 0 or open_ < 0 or "{" in s[close:-1] or "}" in s[close:]:
        return None
    if ")" in s[open_ + 1:close]:
        return None
    head = s[:open_].rstrip()
    if head.endswith(">") and "<" in head:
        head = head[: head.rfind("<")].rstrip()
    k = len(head)
    while k and (head[k - 1].isalnum() or head[k - 1] in "_$"):
        k -= 1
    name = head[k:].lstrip("0123456789")
    return name if name and name not in _HEADS else None


def accessors(text: str) -> float:
    """The share of numbered stubs among the functions that a text declares, 0 for fewer than six: their names end in
    running numbers."""
    names = [n for n in map(declared_name, text.splitlines()) if n]
    return sum(n[-1].isdigit() for n in names) / len(names) if len(names) >= 6 else 0.0


def signs(path: str, text: str) -> dict:
    """generated, by_hand, imported, foreign (the name of another project in the header), banner, minified, data (share
    of embedded data), stubs (share of numbered stubs among the functions)."""
    head, tail = comments(text)
    top = " ".join(head)
    own = own_names(path)
    foreign = None
    for m in _OWNER.finditer(top):
        name = next(g for g in m.groups() if g).lower().rstrip(".,")
        if name not in own and name.split("/")[-1] not in own and not name.isdigit() and len(name) > 2:
            foreign = name
            break
    banner = _BANNER.match(text.lstrip())
    return {
        "generated": any(map(_GENERATED.search, head + tail)) and not any(map(_BY_HAND.search, head)), "by_hand": bool(_BY_HAND.search(top)), "imported": bool(_IMPORTED.search(top)), "foreign": foreign,
        "banner": bool(banner and banner.group("n").lower() not in own), "minified": minified(text), "data": data_share(text), "stubs": accessors(text),
    }
