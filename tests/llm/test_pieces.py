"""Pieces of a long line are judged by their own pauses; the early exit of the repetition test changes nothing."""

import random

import pytest

from tessera.llm import features as f

PROSE = ("The river rises in the hills, where small streams meet; it then turns south. Farmers have used its water for centuries, "
         "and old mills still stand along the banks. In spring, when snow melts, it floods the meadows. Birds return, and so do people. ")
WORDS = ("cheap", "flights", "hotel", "deals", "paris", "london", "rome", "booking", "last", "minute", "travel", "offers", "summer", "beach", "city", "family")


def _dump(n):
    r = random.Random(1)
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_dump_behind_prose_in_one_line():
    line = PROSE * 4 + _dump(400)
    assert len(line.splitlines()) == 1
    assert f.spam_share(line) > 0.5
    assert f.spam_share(PROSE.strip()) == 0.0


def test_cjk_pair_that_comes_three_times():
    assert f._stuffed([chr(0x4E00 + i) if i not in (10, 11, 20, 21, 30, 31) else chr(0x6000 + i % 2) for i in range(40)], False)


def _without_exit(words, paused):
    n = len(words)
    if n < 8:
        return False
    unique, top = f.repetition(words)
    top = 0.0 if top * n < 6 else top
    if max(words) > "⿿" and f._cjk(words) * 2 > n:
        return top >= 0.3 or unique <= 0.3 or not paused and (top >= 0.15 or unique <= 0.5)
    if not paused:
        return top >= 0.2 or unique <= (0.6 if n >= 20 else 0.45)
    return top >= 0.3 or unique <= 0.33


@pytest.mark.parametrize("base", [0x61, 0x4E00])
def test_exit_changes_nothing(base):
    r = random.Random(2)
    for _ in range(20_000):
        n = r.randint(8, 60)
        words = [chr(base + i) if base > 0x2FFF else f"w{i}" for i in r.sample(range(400), n)]
        for _ in range(r.randint(0, 12)):  # repeats of a word, of a pair and of one word twice
            i, j = r.randrange(n - 1), r.randrange(n - 1)
            k = r.randrange(3)
            words[j] = words[i]
            if k:
                words[j + 1] = words[i + 1] if k == 1 else words[i]
        for paused in (False, True):
            assert f._stuffed(words, paused) == _without_exit(words, paused)


def test_no_length_switches_a_rule_off():
    long_ = "x" * 400
    assert f.spam_share(f"[{PROSE.strip()}](http://x.example/a)") == 0.0  # a link with much text of its own is no link line
    assert f.spam_share(f"[{long_}](http://x.example/{long_ * 3})") == 1.0
    assert f.spam_share(f'<a href="http://x.example/{long_ * 3}">{long_}</a>') == 1.0
    assert f.spam_share("\n".join([f"Buy {long_} now"] * 8)) == 1.0  # repeated, however long


@pytest.mark.parametrize("text", ["[" * 50_000, "](" * 50_000, "<a>" * 50_000, "<a" * 50_000, "<" * 50_000, "[x](" * 30_000, "#" * 50_000, "http://" * 20_000, "a" * 300_000, ", " * 50_000])
def test_long_broken_texts_take_no_square_time(text):
    import time

    from tessera.llm.pages import host, page_features

    start = time.time()
    f.spam_share(text), page_features(text), host(text)
    assert time.time() - start < 5
