"""Source files that nobody wrote by hand: generated, minified, vendored, or mostly embedded data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.evidence import signs
from tessera.session import cut, spread

# File name endings of programming languages, and names by which attribute files commonly mark copies and
# generated files.
CODE = set("py pyi pyx rs go cs js jsx mjs cjs ts tsx mts java c h cc cpp cxx hh hpp hxx m mm kt kts swift scala rb php pl pm lua r jl nim zig d dart ex exs erl hs ml mli fs fsx vb clj cljs groovy gd "
           "vue svelte qml sh bash ps1 psm1 bat sql asm s f f90 pas ada v vhd sv cu cl glsl hlsl wgsl cr elm lisp el scm tcl coffee razor cshtml sol tf proto".split())
DIRS = set("vendor vendors vendored third_party third-party thirdparty 3rdparty external externals extern deps node_modules bower_components jspm_packages godeps pods carthage site-packages "
           "generated generated-sources generated_sources autogen auto_generated gen __generated__ obj".split())
NAMES = [re.compile(p) for p in (
    r"\.min\.\w+$", r"[-.]bundle\.\w+$", r"_pb2(?:_grpc)?\.pyi?$", r"\.pb\.(?:go|cc|h|c|swift|dart)$", r"\.generated\.\w+$", r"\.g\.(?:cs|dart|i\.cs)$", r"\.designer\.cs$", r"\.gen\.\w+$", r"[a-z]Proto\.java$",
    r"OuterClass\.java$", r"Grpc\.java$", r"(?:^|[-.])chunk-[0-9a-f]{6,}\.\w+$", r"-[0-9a-f]{8,}\.(?:js|mjs|css)$", r"\.tab\.[ch]$", r"^lex\.yy\.c$", r"^(?:moc|ui|qrc)_\w+\.(?:cpp|h|py)$", r"\.freezed\.dart$", r"_string\.go$|^zz_generated")]

#: Bytes from which a source file that was not indexed cannot have been typed: a sign like those in a text.
HAND_BYTES = 1_000_000
#: Shares of a text that make it embedded data, or a list of numbered stubs.
DATA_SHARE, STUB_SHARE = 0.5, 0.8
#: Mining: pseudo-observations, the expected rate of commonly marked names, and what a name must reach; names that are
#: not commonly marked also need so many files, and repositories in which they are.
PRIOR, KNOWN_RATE, KNOWN_LEAST, OTHER_LEAST, OTHER_FILES, OTHER_REPOSITORIES = 10.0, 0.9, 0.5, 0.75, 8, 2


def ending(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def patterns(path: str) -> list[tuple[str, bool]]:
    """(pattern, whether it is commonly marked) that a path is an instance of: names of its folders below the project's
    own, and shapes of its file name."""
    parts = path.split("/")
    skip = 2 if parts[0].lower() == "monorepo" else 1
    out = {(f"{d}/", d in DIRS) for d in map(str.lower, parts[skip:-1])}
    name = parts[-1]
    stem = name.rsplit(".", 1)[0]
    for k, p in enumerate(NAMES):
        if p.search(name):
            out.add((f"name {k}", True))
    if "." in stem:
        out.add((f"*.{stem.rsplit('.', 1)[1].lower()}.{ending(path)}", False))
    for form, p in (("*_{}", r"_([a-zA-Z]+)$"), ("*{}", r"[a-z]([A-Z][a-z]+)$"), ("{}_*", r"^([a-zA-Z]+)[-_.]")):
        m = re.search(p, stem)
        if m:
            out.add((form.format(m.group(1)), False))
    return sorted(out)


# --- attribute files -------------------------------------------------------------------------------------------------


def glob_regex(folder: str, glob: str) -> str:
    """The regular expression of a glob in an attribute file of a folder: without a separator it names a file at any
    depth, else a path from the folder; `*` and `?` stop at separators, `**` does not."""
    anchored = "/" in glob.rstrip("/")
    g, out, i = glob.strip("/"), "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("/**", i) and i + 3 == len(g):
            out, i = out + "/.*", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[" and "]" in g[i + 2:]:
            j = g.index("]", i + 2)
            inner = g[i + 1:j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        else:
            out, i = out + re.sub(r"([^\w/])", r"\\\1", g[i]), i + 1
    base = re.sub(r"([^\w/])", r"\\\1", folder)
    return "^" + (base + "/" if base else "") + ("" if anchored else "(?:.*/)?") + out + "$"


def attribute_rules(path: str, text: str) -> list[tuple[str, int, int, str, bool | None, str]]:
    """(folder, depth of the folder, line number, 'generated' or 'vendored', value, regex) of an attribute file; a value
    of None takes an earlier one back. A line `[attr]name words...` defines a name; where a later line sets it, its words
    are set too."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    out, macros = [], {}
    for n, line in enumerate(text.splitlines()):
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("[attr]"):
            name, *words = s[6:].split()[:1] + s[6:].split()[1:] or [""]
            macros[name] = [w for word in words for w in (word, *macros.get(word, ()))]
            continue
        m = re.match(r'"((?:\\.|[^"\\])*)"\s*(.*)$', s) or re.match(r"(\S+)\s*(.*)$", s)
        given = m.group(2).split()
        for word in [w for word in given for w in (word, *macros.get(word, ()))]:
            k = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", word)
            if k:
                value = None if k.group(1) == "!" else k.group(1) == "" and (k.group(3) or "true").lower() not in ("false", "0", "no", "off")
                out.append((folder, folder.count("/") + bool(folder), n, k.group(2), value, glob_regex(folder, m.group(1))))
    return out


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    for b in batches:
        rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in attribute_rules(p, t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["folder", "depth", "line", "kind", "value", "regex"])


def rules_of(attribute_files: DataFrame) -> DataFrame:
    """The rules of attribute files (path, content)."""
    return attribute_files.select("path", "content").mapInArrow(_rules, "folder string, depth int, line int, kind string, value boolean, regex string")


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, marked) of the paths that rules decide: of each attribute the deepest folder's last matching line holds; a
    path marked by one of the two is marked, one that is only unmarked is not."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hits = paths.select("path", F.explode(above).alias("folder")).join(rules, "folder").where(F.expr("path RLIKE regex"))
    each = hits.groupBy("path", "kind").agg(F.max_by("value", F.struct("depth", "line")).alias("value"))
    return each.where("value IS NOT NULL").groupBy("path").agg(F.bool_or("value").alias("marked"))


def repository(path: Column) -> Column:
    """The folder of a path's project: its first folder, below monorepo/ the second too; '' for a file outside of any."""
    parts = F.split(path, "/")
    n = F.when(F.lower(F.get(parts, F.lit(0))) == "monorepo", 2).otherwise(1)
    return F.array_join(F.slice(parts, 1, F.least(n, F.size(parts) - 1)), "/")


# --- evidence and mining ---------------------------------------------------------------------------------------------


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found, by_hand = [], []
        for path, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            s = signs(path, text)
            solid = s["minified"] or s["data"] > DATA_SHARE
            found.append(bool(solid or not s["by_hand"] and (s["generated"] or s["imported"] or s["foreign"] or s["banner"] or s["stubs"] > STUB_SHARE)))
            by_hand.append(s["by_hand"])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(found), pa.array(by_hand)], names=["file_id", "digest", "evident", "by_hand"])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["path", "repository", "label", "pattern", "known"], [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]
    for b in batches:
        rows = [(p, r, e, k, known) for p, r, e in zip(*(c.to_pylist() for c in b.columns)) for k, known in patterns(p)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def mined_patterns(named: DataFrame, base: float) -> DataFrame:
    """(pattern) of the names that stand for files which nobody wrote by hand, from labelled files (repository, label,
    pattern, known); label is null where nothing is known of a file. Every name needs a file that is labelled so. Names
    that attribute files commonly mark are expected to hold and need few; others must be found in several repositories,
    in nearly all of their files. Counted by repository first, so a name that a repository is full of is no hot group."""
    by_repository = named.groupBy("pattern", "known", "repository").agg(F.count("label").alias("n"), F.count_if("label").alias("hits"))
    seen = by_repository.groupBy("pattern", "known").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("repositories")).where("hits > 0")
    expected = F.when(F.col("known"), F.lit(KNOWN_RATE)).otherwise(F.lit(base))
    rate = (F.col("hits") + PRIOR * expected) / (F.col("n") + PRIOR)
    other = (F.col("n") >= OTHER_FILES) & (F.col("repositories") >= OTHER_REPOSITORIES) & (F.col("hits") / F.col("n") >= 0.9) & (rate >= OTHER_LEAST)
    return seen.where(F.when(F.col("known"), rate >= KNOWN_LEAST).otherwise(other)).select("pattern")


def judged_files(files: DataFrame, source_texts: DataFrame, skipped_files: DataFrame) -> DataFrame:
    """One row for each path of a programming language in files (file_id, path) and skipped_files (path, content_bytes):
    path, not_by_hand, and why: declared, evident (by its text), size, by_name, copy (null where it is by hand).

    Attribute files among the texts decide first. Else the text is looked at: marks of generators, headers of other
    projects, minified code, embedded data, numbered stubs; of a file that was not indexed, whether it is too large to be
    typed. Declarations and these findings are the labels from which it is mined which folder names and file name shapes
    stand for such files. In repositories that declare nothing those names decide where the text says nothing (a copy
    without header) or is missing. A text that also stands under such a folder is a copy.

    Defined results: repeated paths count once (with their greatest size); null paths are left out; null sizes say
    nothing; a file that says it is written by hand is by hand unless it is minified or data; empty tables give no rows.

    Scale: each text is read once where it lies and leaves only flags and a digest; names are counted by repository with
    partial aggregation.
    """
    known = files.where("path IS NOT NULL").select("path", "file_id", F.lit(None).cast("bigint").alias("bytes"))
    all_ = known.unionByName(skipped_files.where("path IS NOT NULL").select("path", F.lit(None).cast("string").alias("file_id"), F.col("content_bytes").cast("bigint").alias("bytes")))
    all_ = all_.groupBy("path").agg(F.max("file_id").alias("file_id"), F.max("bytes").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    code = all_.where(F.lower(F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, "\\."), -1))).isin(*sorted(CODE)))
    texts = source_texts.where("file_id IS NOT NULL AND content IS NOT NULL AND path IS NOT NULL").select("file_id", "path", "content", F.md5("content").alias("digest"))
    looks = spread(texts).mapInArrow(_look, "file_id string, digest string, evident boolean, by_hand boolean").groupBy("file_id").agg(
        F.max("digest").alias("digest"), F.max("evident").alias("evident"), F.max("by_hand").alias("by_hand"))
    large = F.when(F.col("bytes") >= HAND_BYTES, True)
    facts = code.join(looks, "file_id", "left").select(
        "path", repository(F.col("path")).alias("repository"), "digest", "evident", F.coalesce("by_hand", F.lit(False)).alias("by_hand"), F.when(F.col("evident").isNull(), large).alias("large"))

    attributes = source_texts.where(((F.col("path") == ".gitattributes") | F.endswith("path", F.lit("/.gitattributes"))) & F.col("content").isNotNull())
    if attributes.isEmpty():
        facts = facts.withColumn("marked", F.lit(None).cast("boolean")).withColumn("declares", F.lit(False))
    else:
        rules = cut(rules_of(attributes), "rules")
        # rules above a repository's folder hold for all repositories below it
        owner = repository(F.concat("folder", F.lit("/x")))
        owners = rules.select(F.when(F.col("folder").isin("", "monorepo"), F.col("folder")).otherwise(owner).alias("above")).distinct()
        over = F.array_distinct(F.array(F.lit(""), F.regexp_extract("repository", "^[^/]*", 0), F.col("repository")))
        declares = facts.select("repository").distinct().select("repository", F.explode(over).alias("above")).join(owners, "above", "left_semi").select("repository").distinct()
        facts = facts.join(declared(code.select("path"), rules), "path", "left").join(declares.withColumn("declares", F.lit(True)), "repository", "left")
    facts = cut(facts.withColumn("label", F.coalesce("marked", "evident", "large")), "facts")

    named = facts.select("path", "repository", "label").mapInArrow(_patterns, "path string, repository string, label boolean, pattern string, known boolean")
    base = facts.agg(F.coalesce(F.avg(F.col("label").cast("double")), F.lit(0.0))).first()[0]  # one number
    by_name = named.join(mined_patterns(named, base), "pattern").groupBy("path").agg(
        F.bool_or("known").alias("by_known"), F.bool_or(~F.col("known")).alias("by_other"), F.bool_or(F.col("known") & F.endswith("pattern", F.lit("/"))).alias("in_folder"))
    by_name = by_name.join(facts.where("NOT coalesce(declares, false)").select("path"), "path", "left_semi")
    j = cut(facts.join(by_name, "path", "left"), "named")
    copied = j.where("in_folder AND digest IS NOT NULL AND NOT by_hand").select("digest").distinct().withColumn("copied", F.lit(True))
    j = j.join(copied, "digest", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = (F.when(F.col("marked"), "declared").when(~F.col("marked"), None).when(yes("evident"), "evident").when(F.col("by_hand"), None).when(yes("large"), "size")
           .when(yes("by_known") | (yes("by_other") & F.col("evident").isNull()), "by_name").when(yes("copied"), "copy"))
    return j.select("path", why.isNotNull().alias("not_by_hand"), why.alias("why"))
