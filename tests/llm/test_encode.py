import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import encode

settings.register_profile("quick", max_examples=50, deadline=None)
settings.load_profile("quick")
SCHEMA = "doc_id bigint, text string, ids string, block string, words string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in texts], SCHEMA)


ODD = ["", None, " ", "\n\n  x", "a  b\t\tc \n", "it's we'll I'd 'S 'stop", "<|endoftext|> and <|endoftext|>", "e\u0301 \u200d \u00a0\u2003x \u3000 \x1c\x1d \x85 \x00\x07", "👩‍👩‍👧 ملف עברית", "日本語 と中文", "x" * 5000, "a b " * 3000,
       "١٢٣ ²½ 12.5e3", "\r\n\r\n", "  \u2028 \u2029", "can't 'tis 'Re're", "\ufeffbom", "a\u00adb"]


def test_against_the_tokenizer(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_CHARS", 200)
    rng = random.Random(0)
    alphabet = "abc  \n\t.,'1é日👍\u200d\u0301\u2003ß"
    texts = list(enumerate([*ODD, *["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(300)]]))
    got = {r.doc_id: r.ids for r in encode.encode(docs(spark, texts)).collect()}
    assert got == {i: tokenizer(t or "") for i, t in texts}


@given(st.text(max_size=60))
def test_words_join_to_the_text_and_encode_alone(text):
    import regex

    words = regex.findall(encode.PATTERN, text)
    assert "".join(words) == text
    enc = encode.encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")
    assert [i for w in words for i in enc.encode_ordinary(w)] == enc.encode_ordinary(text)


def test_round_trip(spark):
    texts = list(enumerate(ODD))
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(docs(spark, texts))).collect()}
    assert back == {i: t or "" for i, t in texts}


def test_repeated_rows_null_ids_and_empty_table(spark):
    got = encode.encode(docs(spark, [(1, "a b"), (1, "a b"), (None, "c"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert encode.encode(docs(spark, [])).count() == 0


def test_words_meet_their_blocks_in_groups(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_CHARS", 20)
    monkeypatch.setattr(encode, "GROUP_BLOCKS", 2)
    texts = [(i, f"the the word{i % 3} the {'x' * i}") for i in range(40)] + [(99, None)]
    got = {r.doc_id: r.ids for r in encode.encode(docs(spark, texts)).collect()}
    assert got == {i: tokenizer(t or "") for i, t in texts}
    assert {r.doc_id: (r.block, r.tokens) for r in encode.lengths(docs(spark, texts), "block").collect()} == {i: ("clash", len(v)) for i, v in got.items()}


def block_groups(spark, monkeypatch, build):
    """Rows of the row groups of the blocks that build(documents) writes, over 12 blocks in one task, and its rows."""
    from pathlib import Path
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    from tessera import session

    monkeypatch.setattr(encode, "BLOCK_ROWS", 3, raising=False)
    monkeypatch.setattr(encode, "spread", lambda df: df)
    before = len(session._written)
    found = sorted(map(tuple, build(docs(spark, [(i, f"word{i} " * 45_000) for i in range(12)]).coalesce(1)).collect()))
    blocks = next(p for _, p in session._written[before:] if "/blocks-" in p)
    files = [pq.ParquetFile(f).metadata for f in Path(urlparse(blocks).path).glob("*.parquet")]
    return [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)], found


def test_row_groups_of_blocks_are_bounded(spark, monkeypatch):
    """A reader holds a row group's arrays at once; a task with many blocks wrote them all into one."""
    groups, found = block_groups(spark, monkeypatch, lambda d: encode.encode(d.select("doc_id", "text")))
    assert sum(groups) == 12 and max(groups) <= 3
    assert [i for i, _ in found] == list(range(12)) and all(ids for _, ids in found)


def test_row_groups_of_lengths_are_bounded(spark, monkeypatch):
    groups, found = block_groups(spark, monkeypatch, lambda d: encode.lengths(d.withColumnRenamed("block", "source"), "source"))
    assert sum(groups) == 12 and max(groups) <= 3
    assert [(i, s) for i, s, _ in found] == [(i, "clash") for i in range(12)] and all(n > 0 for *_, n in found)
