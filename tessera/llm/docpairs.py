"""Functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.describe import description, metadata_text
from tessera.llm.lexer import functions, language_of
from tessera.session import spread

#: Spellings of language names.
LANGUAGES = {"py": "python", "python3": "python", "js": "javascript", "node": "javascript", "ts": "typescript", "golang": "go", "c#": "csharp", "cs": "csharp", "rs": "rust", "c++": "cpp"}


def _lexer(with_code: bool):
    names = ["file_id", "start_byte", "code", "comment"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for file_id, path, text in zip(*(c.to_pylist() for c in b.columns)):
                if not text:
                    continue
                ascii_ = text.isascii()
                at, seen = 0, 0
                for f in sorted(functions(text, language_of(path)), key=lambda f: f.start):
                    if ascii_:
                        at = f.start
                    else:
                        at += len(text[seen:f.start].encode())
                        seen = f.start
                    rows.append((file_id, at, text[f.start:f.end] if with_code else None, f.comment))
                    size += len(f.comment or "") + (f.end - f.start if with_code else 0)
                if size > 4_000_000:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    return run


def lexed_functions(source_texts: DataFrame, with_code: bool = True) -> DataFrame:
    """(file_id, start_byte, code, comment) of each function and method with a body in the texts (file_id, path, content);
    start_byte counts in the UTF-8 text. Without with_code, code is null and not handed on. Null and empty texts and
    unknown languages without braces give none."""
    texts = source_texts.select("file_id", F.col("path").cast("string"), F.col("content").cast("string")).where("file_id IS NOT NULL AND content IS NOT NULL")
    return spread(texts).mapInArrow(_lexer(with_code), "file_id string, start_byte int, code string, comment string")


def _letters(text: str) -> str:
    return "".join(filter(str.isalnum, text))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The description of each symbol: of the comment that the lexer attached to its code, else of the documentation that
    the symbol's row gives. Symbols whose row gives none, or whose documentation is no description, are left out."""
    names = ["symbol_id", "file_id", "language", "name", "kind", "documentation", "description", "code", "comment", "agrees"]
    types = [pa.string()] * 9 + [pa.bool_()]
    for b in batches:
        rows = []
        cols = (b.column(c).to_pylist() for c in ("symbol_id", "file_id", "language", "path", "name", "kind", "doc_comment", "metadata_json", "code", "comment"))
        for symbol_id, file_id, language, path, name, kind, given, meta, code, comment in zip(*cols):
            doc = given if given and given.strip() else metadata_text(meta)
            if not doc:
                continue
            said = description(name, kind, comment or doc)
            if said is None:
                continue
            agrees = None if not comment else _letters(comment) == _letters(doc)
            rows.append((symbol_id, file_id, LANGUAGES.get(language, language) if language else language_of(path) or None, name, kind, doc, said, code, comment, agrees))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def documented_functions(symbols: DataFrame, source_texts: DataFrame, with_code: bool = True) -> DataFrame:
    """One row for each function, method or constructor whose documentation is a description: symbol_id, file_id,
    language (one spelling for each; by the file name where it is null), name, kind, documentation as the symbol gives
    it, description (the describing lines without marks), code, comment (what the lexer found in front of the code, or
    inside it where the language puts it there), and agrees: whether that comment has the letters of the documentation.

    A symbol is documented where its row gives documentation: doc_comment or, where that is null or blank, the
    documentation text in metadata_json. What is judged is the comment that the lexer attached to the function at the
    symbol's place; where the file has no text, the text no such function or the function no comment, it is the given
    documentation. Code and comment are null then.

    Defined results: repeated rows of a symbol count once, a null value giving way to the copy's; broken metadata holds
    no documentation; an empty table gives no rows; rows with a null symbol_id are left out; other columns are not touched.

    Scale: symbols are narrowed to callables with some documentation before the shuffle by id. Files are lexed where they
    are read, and code meets its symbol by file and byte, so a file with very many symbols is no hot key; symbols without
    a place are spread by their id. Without with_code no code is shuffled.
    """
    callable_ = F.lower(F.trim("kind")).isin("function", "method", "constructor")
    has = (F.trim("doc_comment") != "") | F.col("metadata_json").rlike("(?i)doc|comment|descri|summary|remarks")
    s = symbols.where(callable_ & F.col("symbol_id").isNotNull() & F.coalesce(has, F.lit(False)))
    values = {"file_id": F.col("file_id"), "language": F.lower(F.trim("language")), "name": F.col("name"), "kind": F.lower(F.trim("kind")), "start_byte": F.col("start_byte"), "path": F.col("path"),
              "doc_comment": F.when(F.trim("doc_comment") != "", F.col("doc_comment")), "metadata_json": F.col("metadata_json")}
    s = s.groupBy("symbol_id").agg(*[F.max(v).alias(k) for k, v in values.items()])
    nowhere = (-1 - F.pmod(F.xxhash64("symbol_id"), F.lit(1 << 20))).cast("int")
    s = s.withColumn("start_byte", F.coalesce("start_byte", nowhere)).withColumn("file_id", F.coalesce("file_id", F.lit("")))
    code = lexed_functions(source_texts, with_code).groupBy("file_id", "start_byte").agg(F.max(F.struct("code", "comment")).alias("f"))
    j = s.join(code, ["file_id", "start_byte"], "left").select("symbol_id", "file_id", "language", "path", "name", "kind", "doc_comment", "metadata_json", "f.code", "f.comment")
    return j.mapInArrow(_describe, "symbol_id string, file_id string, language string, name string, kind string, documentation string, description string, code string, comment string, agrees boolean")
