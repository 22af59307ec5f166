"""Names, kinds and languages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal those of the fact format.
CALLABLE = ("function", "method", "constructor")
CONTAINER = ("class", "struct", "enum", "interface", "trait", "record", "union", "module", "namespace")
LOW_SIGNAL = ("import", "field", "property", "variable", "parameter", "module", "namespace")
HIDDEN = ("private", "protected", "fileprivate")
TYPES = ("class", "struct", "interface", "trait", "record", "enum", "union", "type")
ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "golang": "go", "c#": "csharp"}
FAMILIES = {"javascript": "js", "typescript": "js", "tsx": "js", "jsx": "js", "vue": "js", "java": "jvm", "kotlin": "jvm",
            "csharp": "dotnet", "vbnet": "dotnet", "razor": "dotnet", "c": "c", "cpp": "c"}

# Function words that a search leaves out as long as a content word remains.
STOP_WORDS = tuple(
    "was were been being has have had do does did so not no whether when what which who whom where why how another other one two same than then its their them they we you your our can could should would will may "
    "might must also only just if else each every all any some such because while until since never always still yet more most very much many about between without within through again here there these those both "
    "either neither nor but too via per already instead rather ever once itself".split())


def content_words(terms: Column) -> Column:
    """Words without the stop words; all of them where nothing else is left."""
    rest = F.array_except(terms, F.array(*map(F.lit, STOP_WORDS)))
    return F.when(F.size(rest) > 0, rest).otherwise(terms)


def language(column: Column) -> Column:
    """One spelling of a language; null stays null."""
    plain = F.lower(F.trim(column))
    out = plain
    for a, b in ALIASES.items():
        out = F.when(plain == a, b).otherwise(out)
    return out


def family(lang: Column) -> Column:
    """The family of a language; calls do not cross families."""
    pairs = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, lang), lang)


def plain_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.lit(False))


def last_segment(name: Column) -> Column:
    """What follows the last `::` or `.`."""
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def name_is(name: Column, query: Column) -> Column:
    """Equal, or ending in `.query`."""
    return (name == query) | F.endswith(name, F.concat(F.lit("."), query))


def display_kind(kind: Column, lang: Column, name: Column) -> Column:
    """The kind that is shown: html classes are elements, sql classes tables, markdown modules sections and imports links,
    and self./this./cls. properties attributes (not in F#)."""
    return (F.when((lang == "html") & (kind == "class"), "element").when((lang == "sql") & (kind == "class"), "table")
            .when((lang == "markdown") & (kind == "module"), "section").when((lang == "markdown") & (kind == "import"), "link")
            .when((kind == "property") & name.rlike(r"^(self|this|cls)\.") & ~F.coalesce(lang == "fsharp", F.lit(False)), "attribute").otherwise(kind))


def tokens(name: Column) -> Column:
    """Lower-case words of an identifier: camel humps, snake parts and runs of digits."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\x00-\x7F]+)"), 1), F.lower)


def is_test_path(path: Column) -> Column:
    """Paths of tests: in folders test, tests, __tests__ or autotests, or with a test's file name."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return F.coalesce(p.rlike(r"(^|/)(test|tests|__tests__|autotests)/") | name.rlike(r"^test_.*\.(py|rb)$") | name.rlike(r"_test\.|\.test\.|\.spec\.|^tests?\.rs$|^tst_")
                      | name.rlike(r"Tests\.cs$"), F.lit(False))


def is_test_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^(test_|Test[A-Z_]|test[A-Z])"), F.lit(False))


def in_path(path: Column, scope: str) -> Column:
    """A path equals a filter or lies below it; slashes and ASCII case do not matter."""
    from tessera.functions.paths import normal_path

    want = normal_path(F.lit(scope.rstrip("/\\")))
    return (normal_path(path) == want) | F.startswith(normal_path(path), F.concat(want, F.lit("/")))


def glob_pattern(glob: str) -> str:
    """The regular expression of a GLOB as SQLite has it: * and ? stand for any characters, [...] for one of some, case
    matters."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif close > 0:
            inner = glob[i + 1:close].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "^" else inner) + "]", close
        else:
            out += c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c
        i += 1
    return f"^{out}$"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_pattern(pattern))


def like(text: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE as SQLite has it: ASCII case does not matter, letters beyond ASCII must be equal."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
            out += _either(c)
        elif c == "%":
            out += "[\\s\\S]*"
        elif c == "_":
            out += "[\\s\\S]"
        else:
            out += _either(c)
        i += 1
    return text.rlike(f"^{out}$")


def _either(c: str) -> str:
    if c.isascii() and c.isalpha():
        return f"[{c.lower()}{c.upper()}]"
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def anonymous_class_name(signature: Column, creator: Column) -> Column:
    """The name that is shown for a class without one: by the type that it creates and the symbol that creates it."""
    made = F.nullif(F.regexp_extract(signature, r"\bnew\s+([A-Za-z_$][\w$.]*)", 1), F.lit(""))
    made = F.coalesce(made, F.nullif(F.regexp_extract(signature, r"\bobject\s*:\s*([A-Za-z_$][\w$.]*)", 1), F.lit("")))
    return F.concat(F.lit("<anonymous"), F.coalesce(F.concat(F.lit(" "), made), F.lit("")), F.coalesce(F.concat(F.lit(" in "), creator), F.lit("")), F.lit(">"))


def name_anonymous_classes(symbols):
    """symbols with the classes that an extractor has named by their line (anonymous_class_L12) named by what they create
    and where; the names of those around them are taken first, so nested ones read the new names."""
    plain = F.coalesce(glob(F.col("name"), "anonymous_class_L[0-9]*") & (F.col("kind") == "class") & (F.get_json_object("metadata_json", "$.type") == "anonymous_class"), F.lit(False))
    todo = symbols.withColumn("_depth", F.when(plain, F.lit(1)))
    rest, out = todo.where("_depth IS NULL").drop("_depth"), todo.where("_depth IS NOT NULL").drop("_depth")
    done = rest
    for _ in range(8):  # one round for each class inside a class
        inner = out.join(out.select(F.col("symbol_id").alias("parent_symbol_id")), "parent_symbol_id", "left_semi")
        outer = out.join(inner.select("symbol_id"), "symbol_id", "left_anti")
        creators = done.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("_creator"))
        named = outer.join(creators, "parent_symbol_id", "left").withColumn("name", anonymous_class_name(F.coalesce("signature", F.lit("")), F.col("_creator"))).drop("_creator")
        done = done.unionByName(named.select(*rest.columns))
        out = inner.select(*rest.columns)
        if out.isEmpty():
            break
    return done


def is_generated_lambda(name: Column, lang: Column, kind: Column, signature: Column) -> Column:
    """Whether a function's name was made up for a lambda."""
    return F.coalesce(name.rlike(r"^lambda_\d+$") & (lang == "python") & (kind == "function") & F.startswith(signature, F.lit("lambda")), F.lit(False))
