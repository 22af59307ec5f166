"""The share of a text that is links, tags, lists or repeated keywords, judged line by line."""

from __future__ import annotations

import functools
import re
from collections import Counter

#: Words of running text that are looked at together for repetition.
WINDOW = 40
#: Words up to which the text of a link is no text of its own.
LINK_WORDS = 25

# Bounded by what may stand inside them, not by length: each start ends at the next bracket or tag, so none is quadratic.
_MD = re.compile(r"!?\[(?P<text>[^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))+\)")
_ANCHOR = re.compile(r"<a\b[^<>]*>(?P<text>[^<]*(?:<(?!/?a\b)[^<]*)*)</a>", re.I)
_URL = re.compile(r"(?:https?://|www\.)[^\s)>\]\"'|]+", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]+;")
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_]+(?:['’][^\W_]+)?")
_TAG = re.compile(r"(?<!\w)#\w+")
_LIST_MARK = re.compile(r"^\s*(?:[-*+•>]+|\d{1,4}[.)]|#{1,6}(?=\s))\s*")
_END = re.compile(r"[.!?。！？:;]['\")\]»”]*\s*$")
_SEPARATOR = re.compile(r"\s*[,;|>»·•/、，]\s+|\s+[-–—]\s+|\s*[、，|»·•]\s*|\s>\s")
_CODE = re.compile(r"[{};]\s*$|\s[-+*/:]?=\s|\w\([^)]*\)")
_PRICE = re.compile(r"[$€£¥]\s?\d|\d\s?(?:€|USD|EUR|GBP|円|元)")
_PAUSE = re.compile(r"[.,;:?。、，！？](?:\s|$|\w)|(?<!!)!\s\w")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")

_MARKS = ",;|>/»·•、，–—-"
_ONE_DIGIT = str.maketrans("123456789", "000000000")


def _words(s: str) -> list[str]:
    return _WORD.findall(s.lower())


@functools.lru_cache(maxsize=1 << 16)
def _stem(w: str) -> str:
    return w[:-1] if len(w) > 3 and w.endswith("s") else w


def repetition(words: list[str]) -> tuple[float, float]:
    """(share of distinct words, share of the words that the commonest pair covers)."""
    n = len(words)
    if n < 2:
        return 1.0, 0.0
    return len(set(words)) / n, 2 * max(Counter(zip(words, words[1:])).values()) / n


def _cjk(words: list[str]) -> int:
    """How many of the words are single characters of scripts without blanks."""
    return sum(len(w) == 1 and w > "\u2fff" for w in words)


def _length(words: list[str]) -> float:
    """A number of words in which three such characters count as one."""
    return len(words) - _cjk(words) * 2 / 3 if words and max(words) > "\u2fff" else len(words)


def _stuffed(words: list[str], paused: bool) -> bool:
    """Whether stems repeat as keywords do. paused: the text has the pauses of sentences."""
    n = len(words)
    if n < 8:
        return False
    distinct = len(set(words))  # a pair that comes m times leaves n - m distinct words (if it is one word twice), else n - 2 (m - 1)
    if distinct > n - 3 or distinct > max(0.925 * n, 0.85 * n + 2) + 1e-9:  # no pair comes three times and covers 0.15
        return False
    unique, top = repetition(words)
    if top * n < 6:  # a pair that comes twice proves nothing
        top = 0.0
    if max(words) > "\u2fff" and _cjk(words) * 2 > n:
        return top >= 0.3 or unique <= 0.3 or not paused and (top >= 0.15 or unique <= 0.5)
    if not paused:
        return top >= 0.2 or unique <= (0.6 if n >= 20 else 0.45)
    return top >= 0.3 or unique <= 0.33


def _unlinked(pattern: re.Pattern, line: str) -> tuple[list[str], str]:
    """(the links of a form, the line without them); of a link with more than LINK_WORDS words its own text stays."""
    links = []

    def text(m: re.Match) -> str:
        links.append(m.group())
        own = m.group("text")
        return f" {own} " if len(own) > 2 * LINK_WORDS and _length(_words(_MARKUP.sub(" ", own))) > LINK_WORDS else " "

    return links, pattern.sub(text, line)


def lines_of(text: str) -> list[list]:
    """[size, kind] of each non-blank line; kinds: link, tag, item (a list of labels), repeat, code, text. Long running
    text is judged in pieces of about WINDOW words, so a line may give several."""
    out: list[list] = []
    code = False
    raw = text.splitlines()
    plain = [x.strip().lower().translate(_ONE_DIGIT) for x in raw]
    often = Counter(p for p in plain if p)
    for line, norm in zip(raw, plain):
        s = line.strip()
        if not s:
            continue
        if s.startswith("```") or s.startswith("~~~"):
            code = not code
            out.append([len(s), "code"])
            continue
        if code or (s.startswith("|") and s.endswith("|") and s.count("|") > 2 and not _URL.search(s)):
            out.append([len(s), "code"])
            continue
        links, rest = [], s
        if "](" in rest:
            links, rest = _unlinked(_MD, rest)
            if "](" in rest:  # an image inside a link
                rest = _unlinked(_MD, rest)[1]
        if "<" in rest:
            more, rest = _unlinked(_ANCHOR, rest)
            links += more
        if "://" in rest or "www." in rest.lower():
            links += _URL.findall(rest)
            rest = _URL.sub(" ", rest)
        if "<" in rest or "&" in rest:
            rest = _MARKUP.sub(" ", rest)
        body = _LIST_MARK.sub("", rest).strip()
        own = _words(body)
        size, n = len(s), _length(own)
        if links and n <= 3 * len(links):
            out.append([size, "link"])
            continue
        line_stems = list(map(_stem, own))
        tags = _TAG.findall(rest) if "#" in rest else ()
        if len(tags) >= 3 and n <= 2 * sum(len(_words(t.replace("_", " "))) for t in tags):
            out.append([size, "tag"])
            continue
        if not n:
            out.append([size, "text"])
            continue
        if _CODE.search(body):
            out.append([size, "repeat" if n >= 20 and _stuffed(line_stems, True) else "text"])
            continue
        items = [i for i in _SEPARATOR.split(body) if i.strip()] if sum(map(body.count, _MARKS)) >= 5 else ()
        if len(items) >= 6 and n <= 4.5 * len(items) and max(_length(_words(i)) for i in items) <= 9 and not re.search(r"[.!?。！？]\s+\S", body):
            out.append([size, "item"])
            continue
        if n <= 12 and often[norm] >= 3 and (n <= 6 or not _END.search(body)):
            out.append([size, "repeat"])
            continue
        if n <= 16 and _PRICE.search(body) and not re.search(r"[.!?。]\s+\S|[.。]$", body) or n <= 6 and not _END.search(body) and not line.startswith("#"):
            out.append([size, "label"])  # settled below, by its neighbours
            continue
        pieces = max(1, round(n / WINDOW))
        low = body.lower()
        starts = [m.start() for m in _WORD.finditer(low)] if pieces > 1 else []
        for k in range(pieces):
            a, b = k * len(own) // pieces, (k + 1) * len(own) // pieces
            piece = low[starts[a] if k else 0:starts[b] if k < pieces - 1 else len(low)]
            paused = len(_PAUSE.findall(piece)) * 3 * WINDOW > _length(own[a:b]) * 2 if b - a >= 8 else True
            out.append([size / pieces, "repeat" if _stuffed(line_stems[a:b], paused) else "text"])
    # short lines without end are labels where several lines of lists stand together
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and out[j][1] in ("label", "repeat", "item"):
            j += 1
        for k in range(i, j):
            if out[k][1] == "label":
                out[k][1] = "item" if j - i >= 4 else "text"
        i = max(j, i + 1)
    return out


def spam_share(text: str | None) -> float:
    """The share of a text's characters that stand in links, tags, lists of labels or repeated keywords; 0 for null and
    blank texts."""
    parts = lines_of(text or "")
    total = sum(n for n, _ in parts)
    return sum(n for n, kind in parts if kind in ("link", "tag", "item", "repeat")) / total if total else 0.0
