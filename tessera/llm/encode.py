"""Encoding of whole corpora with a public tokenizer, through a table of distinct words."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, spread

#: Where the driver finds the vocabulary files; executors get them from the session.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern by which byte_bpe_50k parts a text into words, in front of its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that share one block dictionary; a longer text has a block of its own.
BLOCK_CHARS = 500_000
#: Blocks in a row group of their table: a reader takes a whole group into memory, however many blocks a task has made.
BLOCK_ROWS = 16
#: Blocks whose dictionaries are joined together: a word comes at most so often under one key, however common it is.
GROUP_BLOCKS = 4096


@functools.cache
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def encoder(vocabulary: str):
    """The encoder of a rank file, once for each Python worker. It knows no special tokens: their strings are text."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks: the documents with their words as numbers, and the block's distinct words in order."""
    import regex
    from pyspark import TaskContext

    words_of = regex.compile(PATTERN).findall
    block = TaskContext.get().partitionId() << 32
    ids, carried, numbers, sizes, known, chars = [], [], [], [], _Numbers(), 0

    def flush() -> pa.RecordBatch:
        docs = pa.StructArray.from_arrays([
            pa.array(ids, pa.int64()),
            pa.array(carried, pa.string()),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(numbers) if numbers else [], pa.int32())),
        ], names=["doc_id", "carried", "idx"])
        return pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), docs),
            pa.array([list(known)], pa.list_(pa.string())),
        ], names=["block", "docs", "words"])

    for b in batches:
        for i, text, more in zip(*(c.to_pylist() for c in b.columns)):
            text = text or ""
            if ids and chars + len(text) > BLOCK_CHARS:
                yield flush()
                block += 1
                ids, carried, numbers, sizes, known, chars = [], [], [], [], _Numbers(), 0
            found = np.fromiter(map(known.__getitem__, words_of(text)), np.int32)
            ids.append(i)
            carried.append(more)
            numbers.append(found)
            sizes.append(len(found))
            chars += len(text)
    if ids:
        yield flush()


def _encode_words(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = encoder(SparkFiles.get(name))
        for b in batches:
            words = b.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([enc.encode_ordinary(w) for w in words.to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _placed(documents: DataFrame, carry: str | None, value: str, vocabulary: str) -> DataFrame:
    """(docs, table) of blocks: the block's documents with their words as numbers, and by number what an expression over
    a word's ids gives."""
    documents.sparkSession.sparkContext.addFile(vocabulary)  # a file that is known already is not sent again
    more = F.col(carry) if carry else F.lit(None)
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), more.cast("string").alias("carried"))
    blocks = cut(spread(texts).mapInArrow(_blocks, "block bigint, docs array<struct<doc_id:bigint,carried:string,idx:array<int>>>, words array<string>"), "blocks", BLOCK_ROWS)
    groups = -(-blocks.count() // GROUP_BLOCKS)  # one number
    words = blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(max(1, groups))).alias("group"), F.posexplode("words").alias("no", "word"))
    encoded = words.select("word").distinct().mapInArrow(_encode_words(os.path.basename(vocabulary)), "word string, ids array<int>").select("word", F.expr(value).alias("v"))
    if groups > 1:  # a common word first meets its groups, then in each of them its blocks
        near, key = words.select("group", "word").distinct().join(encoded, "word"), ["group", "word"]
    else:
        near, key = encoded, ["word"]
    tables = words.join(near, key).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("no", "v"))).alias("pairs"))
    tables = tables.select("block", F.transform("pairs", lambda p: p["v"]).alias("table"))
    return blocks.select("block", "docs").join(tables, "block", "left").select("docs", "table")


def encode(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids) of each row of documents (doc_id, text): the token ids of the whole text, without special tokens.

    Defined results: null and empty texts have an empty list; strings that look like special tokens are ordinary text;
    repeated rows and null ids stay as they are; an empty table gives no rows; other columns are not touched.

    Scale: each task parts its texts into words and numbers them by a dictionary of its block, so a word is shuffled once
    a block, not once a place. Each distinct word of the corpus is encoded once. Words come back to their blocks through
    groups of GROUP_BLOCKS blocks, so the commonest word has at most that many rows under one key and the table of
    groups at most one row a group. Blocks and their words meet again by block; ids are put in place by position.
    Nothing is broadcast.
    """
    put = F.transform("docs", lambda d: F.struct(
        d["doc_id"].alias("doc_id"), F.flatten(F.transform(d["idx"], lambda i: F.get("table", i))).alias("ids")))
    return _placed(documents, None, "ids", vocabulary).select(F.inline(put))


def lengths(documents: DataFrame, carry: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, carry, tokens) of each row of documents (doc_id, text, carry): the number of token ids of the whole text.
    Null and empty texts have 0. Results and scale are those of encode(); only the numbers of ids are shuffled, and the
    carried column goes along, so nothing is joined by doc_id."""
    number = lambda d: F.aggregate(d["idx"], F.lit(0).cast("bigint"), lambda a, i: a + F.get("table", i))
    put = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["carried"].alias(carry), number(d).alias("tokens")))
    return _placed(documents, carry, "CAST(size(ids) AS BIGINT)", vocabulary).select(F.inline(put))


def pieces(spark, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, hex) of each token: its bytes in hexadecimal. As many rows as the vocabulary has, about 50,000."""
    return spark.createDataFrame([(i, b.hex()) for b, i in ranks(vocabulary).items()], "id int, hex string")


def decode(encoded: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, text) from unique (doc_id, ids), by a join of ids with their pieces. An empty list gives an empty text.
    The pieces are broadcast: their number is that of the vocabulary, whatever the corpus."""
    at = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    joined = at.join(F.broadcast(pieces(encoded.sparkSession, vocabulary)), "id", "left")
    parts = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("parts"))
    return parts.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "utf-8").alias("text"))
