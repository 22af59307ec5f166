"""Content and link features of whole pages: words, links and layout, without judging any line."""

from __future__ import annotations

import re
from collections import Counter

_LINK = re.compile(r"\]\([^()\s]+|(?:https?://|www\.)[^\s)>\]\"'|]+|<a\b[^<>]*")
_HOST = re.compile(r"(?:https?://|www\.)([^\s/)>\]\"'|?#:]+)")
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]{1,3}|[^\W_]+")
_LIST_MARK = re.compile(r"^[ \t]*(?:[-*+•>]|\d+[.)])", re.M)

_UPPER, _DIGITS, _SEPARATORS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b",;|>/"
_MORE_SEPARATORS = "»·•、，–"
_NO_WORD = bytes(i if i < 128 and chr(i).isalnum() else 32 for i in range(256))
#: Words whose variety is measured together.
WINDOW = 40

PAGE_FEATURES = ("link_chars", "links", "unique", "variety", "top_word", "top_pair", "pairs_again", "short_words", "in_sentences", "separators", "tags", "prices", "digits", "upper", "markup",
                 "line_words", "short_lines", "marked_lines", "new_lines", "size")


def page_features(text: str | None) -> list[float]:
    """PAGE_FEATURES of a text: shares of characters, words or lines, or numbers a word. All 0 without any word or link.

    link_chars: characters that stand in addresses; links, tags (#), prices (currency signs), separators, markup (<): a
    word. unique: distinct words; variety: the same, averaged over windows of WINDOW words; top_word, top_pair: words
    that the commonest word or pair covers; pairs_again: pairs that come three times or more. short_words: words of at
    most three letters; in_sentences: words that stand between two ends of sentences or lines with at least six others.
    line_words: words a line; short_lines: lines of at most six words; marked_lines: lines with a list mark; new_lines:
    distinct lines; size: words.
    """
    t = text or ""
    low = t.lower()
    links = _LINK.findall(low) if "](" in low or "://" in low or "www." in low or "<a" in low else []
    bare = _LINK.sub(" ", low) if links else low
    words = bare.encode().translate(_NO_WORD).split() if bare.isascii() else _WORD.findall(bare)
    n = len(words)
    if not n and not links:
        return [0.0] * len(PAGE_FEATURES)
    chars, k = len(t), max(1, n)
    raw = t.encode("utf-8", "replace")
    among = lambda signs: len(raw) - len(raw.translate(None, signs))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in low.split("\n") if x and not x.isspace()]
    sizes = [x.strip().count(" ") + 1 for x in lines]
    ended = low if low.isascii() else low.replace("。", ". ").replace("！", ". ").replace("？", ". ")
    parts = [x.strip().count(" ") + 1 for x in ended.replace("! ", ". ").replace("? ", ". ").replace("\n", ". ").split(". ")]
    windows = range(0, max(1, n - WINDOW // 2), WINDOW)
    return [
        sum(map(len, links)) / chars, 10 * len(links) / k, len(counts) / k, sum(len(set(words[i:i + WINDOW])) / max(1, len(words[i:i + WINDOW])) for i in windows) / len(windows),
        max(counts.values(), default=0) / k, 2 * max(pairs.values(), default=0) / k, sum([c for c in pairs.values() if c > 2]) / k, sum([c for w, c in counts.items() if len(w) < 4 and w[-1:].isascii()]) / k,
        sum([p for p in parts if p > 6]) / max(1, sum(parts)), 10 * (among(_SEPARATORS) + (0 if t.isascii() else sum(map(t.count, _MORE_SEPARATORS)))) / k, 10 * t.count("#") / k, 10 * sum(map(t.count, "$€£¥")) / k,
        among(_DIGITS) / chars, among(_UPPER) / chars, 10 * t.count("<") / k, n / len(lines), sum([s < 7 for s in sizes]) / len(sizes), len(_LIST_MARK.findall(t)) / len(lines), len(set(lines)) / len(lines), float(n),
    ]


def host(text: str | None) -> str | None:
    """The host that the text links to most often (of several the first by name), None without links."""
    low = (text or "").lower()
    found = Counter(h.rstrip(".") for h in _HOST.findall(low)) if "://" in low or "www." in low else None
    return min(found, key=lambda h: (-found[h], h)) if found else None
