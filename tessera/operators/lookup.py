"""Lookup and ranked search over symbols, for many queries at once."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import CALLABLE, CONTAINER, content_words, display_kind, tokens
from tessera.functions.stem import stems
from tessera.operators import ranked
from tessera.operators.walk import local_variables
from tessera.session import cut, spread

#: A term counts as carried by at most so many symbols.
DF_CAP = 20_000
#: Credits of a term by the strongest field that it stands in, and bonuses of whole names.
NAME_TOKEN, NAME_STEM, TEXT_HIT, NAME_PART = 3.0, 2.0, 1.0, 1.0
WHOLE_NAME, WHOLE_NAME_OTHER, ALL_WORDS = 100.0, 60.0, 60.0


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none for shorter texts."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def grams(text: Column, n: Column | int) -> Column:
    """Distinct runs of n characters; none for shorter texts."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def by_name(symbols: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query, symbol_id, match, place): symbols whose name equals a query, begins with it or contains it, in that order
    and then by name length, name and id, the first `limit` of each query. Case does not matter.

    Containment goes through an index of trigrams: a query is joined by its rarest trigram alone, and the hits are
    verified, so no query meets all names. Queries of one or two characters are joined with the runs of so many
    characters. Names are looked up once each, however many symbols bear them, and as each has a symbol, only the first
    `limit` names of a query are joined with theirs.
    """
    s = symbols.where("name IS NOT NULL").select("symbol_id", "name", F.lower("name").alias("low"))
    q = queries.where("query IS NOT NULL AND query <> ''").select("query", F.lower("query").alias("ql")).distinct()
    known = s.groupBy(F.col("low").alias("hit")).agg(F.min(F.struct(F.length("name").alias("size"), "name")).alias("first"))
    posting = known.select("hit", "first", F.explode(trigrams(F.col("hit"))).alias("gram"))
    df = posting.groupBy("gram").agg(F.count("*").alias("df"))
    rare = q.select("query", "ql", F.explode(trigrams(F.col("ql"))).alias("gram")).join(df, "gram")  # no hit without all of them, which is verified below
    rare = rare.groupBy("query", "ql").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    names = rare.join(posting, "gram").where(F.contains("hit", F.col("ql"))).select("query", "ql", "hit", "first")
    runs = known.select("hit", "first", F.explode(F.concat(grams(F.col("hit"), 1), grams(F.col("hit"), 2))).alias("gram"))
    short = q.where(F.length("ql") < 3).join(runs, F.col("ql") == F.col("gram")).select("query", "ql", "hit", "first")
    match = F.when(F.col("hit") == F.col("ql"), "exact").when(F.startswith("hit", F.col("ql")), "prefix").otherwise("contains")
    rank = F.when(match == "exact", 0).when(match == "prefix", 1).otherwise(2)
    top = names.unionByName(short).withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(rank, "first", "hit"))).where(F.col("rn") <= limit)
    j = top.drop("first").join(s, F.col("hit") == F.col("low"))
    w = Window.partitionBy("query").orderBy(rank, F.length("name"), "name", "symbol_id")
    return j.select("query", "symbol_id", match.alias("match"), F.row_number().over(w).alias("place")).where(F.col("place") <= limit)


def qualified(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, symbol_id, candidates) for names such as A::b or A.b: every segment but the last must be the name of the
    next enclosing symbol, however many there are. candidates says how many symbols fit; more than one is ambiguous."""
    parts = F.split("query", "::|\\.")
    q = queries.select("query", parts.alias("parts"), F.element_at(parts, -1).alias("name"), F.size(parts).alias("n")).where("n >= 2").distinct()
    longest = q.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]  # one number
    s = symbols.select("symbol_id", "name", "parent_symbol_id")
    j = q.join(s, "name").select("query", "parts", "n", "symbol_id", F.col("parent_symbol_id").alias("up"))
    p = symbols.select(F.col("symbol_id").alias("up"), F.col("name").alias("pname"), F.col("parent_symbol_id").alias("next"))
    for k in range(2, longest + 1):
        fits = (F.col("n") < k) | (F.try_element_at("parts", F.lit(-k)) == F.col("pname"))
        j = j.join(p, "up", "left").where(F.coalesce(fits, F.lit(False))).select("query", "parts", "n", "symbol_id", F.col("next").alias("up"))
    return j.select("query", "symbol_id", F.count("*").over(Window.partitionBy("query")).alias("candidates"))


def members(symbols: DataFrame) -> DataFrame:
    """(owner_id, symbol_id, place): the direct members of each container in source order."""
    boxes = symbols.where(F.col("kind").isin(*CONTAINER)).select(F.col("symbol_id").alias("owner_id"))
    m = symbols.select("symbol_id", F.col("parent_symbol_id").alias("owner_id"), "start_line", "start_byte").join(boxes, "owner_id")
    w = Window.partitionBy("owner_id").orderBy(F.col("start_line").asc_nulls_last(), F.col("start_byte").asc_nulls_last(), "symbol_id")
    return m.select("owner_id", "symbol_id", F.row_number().over(w).alias("place"))


def overloads(symbols: DataFrame) -> DataFrame:
    """(symbol_id, group_size): callables with others of the same name, file, kind and parent (no parent equals no parent)."""
    w = Window.partitionBy("name", "file_id", "kind", "parent_symbol_id")
    return symbols.where(F.col("kind").isin(*CALLABLE)).select("symbol_id", F.count("*").over(w).alias("group_size")).where("group_size > 1")


def _deletions(text: Column, edits: int) -> Column:
    """Distinct texts that are left when up to so many characters are taken out."""
    out = F.array(text)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda t: F.when(F.length(t) > 0, F.transform(
            F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array().cast("array<string>"))))))
    return out


def near_texts(known: DataFrame, want: DataFrame, edits: int = 2) -> DataFrame:
    """(want, known, distance): all distinct known texts within so many edits of each distinct wanted one, 0 for equal ones.

    Exact: an edit leaves a text that both have when each gives up one character, so short texts (fewer than
    3 x edits + 3 characters) meet in what deletions leave; of longer ones an edit touches at most three trigrams, so one
    of the wanted text's 3 x edits + 1 rarest is left; those that repeat so few trigrams that this says nothing meet all
    texts of about their length."""
    known, want = known.select("known").where("known IS NOT NULL").distinct(), want.select("want").where("want IS NOT NULL").distinct()
    bound = 3 * edits + 3  # from here on a text has 3 x edits + 1 places of trigrams
    short = want.where(F.length("want") < bound).select("want", F.explode(_deletions(F.col("want"), edits)).alias("rest"))
    short = short.join(known.where(F.length("known") < bound + edits).select("known", F.explode(_deletions(F.col("known"), edits)).alias("rest")), "rest").select("want", "known")
    gram = known.select("known", F.explode(trigrams(F.col("known"))).alias("gram"))
    df = gram.groupBy("gram").agg(F.count("*").alias("df"))
    long_ = want.where(F.length("want") >= bound)
    probe = long_.select("want", F.explode(trigrams(F.col("want"))).alias("gram")).join(df, "gram", "left")
    rare = F.row_number().over(Window.partitionBy("want").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    long = probe.withColumn("rn", rare).where(F.col("rn") <= 3 * edits + 1).join(gram, "gram").select("want", "known")
    few = long_.where(F.size(trigrams(F.col("want"))) <= 3 * edits)  # texts like aaaaaaaaaa
    few = few.select("want", F.explode(F.sequence(F.length("want") - edits, F.length("want") + edits)).alias("n")).join(known.select("known", F.length("known").alias("n")), "n").select("want", "known")
    pairs = short.unionByName(long).unionByName(few).where(F.abs(F.length("want") - F.length("known")) <= edits).distinct()
    return pairs.withColumn("distance", F.levenshtein("want", "known", edits)).where("distance >= 0")


def suggestions(names: DataFrame, asked: DataFrame, edits: int = 2, limit: int = 3) -> DataFrame:
    """(asked, name, distance): known names within so many edits of an asked one, case aside, nearest first, at most
    `limit`; of equally near ones those of definitions come before those of imports alone (names: name and, if there,
    kind). Every such name is found, short ones included (near_texts)."""
    imported = F.bool_and(F.coalesce(F.col("kind") == "import", F.lit(False))) if "kind" in names.columns else F.lit(False)
    known = names.where("name IS NOT NULL").groupBy("name").agg(imported.alias("imported")).withColumn("known", F.lower("name"))
    a = asked.where("asked IS NOT NULL").select("asked", F.lower("asked").alias("want")).distinct()
    j = a.join(near_texts(known, a, edits).where("distance > 0"), "want").join(known, "known")
    w = Window.partitionBy("asked").orderBy("distance", "imported", "name")
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("asked", "name", "distance")


def searchable(symbols: DataFrame) -> DataFrame:
    """The symbols that the full-text index holds: all but local variables."""
    return symbols.join(local_variables(symbols), "symbol_id", "left_anti")


def index_ready(metadata: DataFrame, rule: str) -> bool:
    """Whether the index was built by the rule that is in force, as the metadata (key, value) says."""
    return bool(metadata.where((F.col("key") == "fts_rule") & (F.col("value") == rule)).head(1))


def postings(symbols: DataFrame) -> DataFrame:
    """The full-text index: (term, symbol_id, field) of name tokens and of words in signature and documentation head
    (field 'name' or 'text')."""
    name = symbols.select("symbol_id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("term"), F.lit("name").alias("field"))
    text = F.concat_ws(" ", "signature", F.substring("doc_comment", 1, 640))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]+)"), 1), F.lower))
    body = symbols.select("symbol_id", F.explode(words).alias("term"), F.lit("text").alias("field"))
    return name.unionByName(body)


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df): symbols that carry a term in any field, capped."""
    return index.select("term", "symbol_id").distinct().groupBy("term").agg(F.least(F.count("*"), F.lit(DF_CAP)).alias("df"))


def search(symbols: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, symbol_id, score, place): ranked search for queries of several words.

    Stop words count only where a query has nothing else. Recall: symbols whose name carries the two rarest words of the query (its only word), found by one equi join on pairs
    of words. Rank: each query word counts once, by the strongest field it stands in (name token 3, text 1), times
    ln(1 + N / (df + 1)); plus 100 if the words are the whole name of a callable or container (60 for other kinds), plus
    60 if all words stand in the name. Ties go by name and id.
    """
    total = symbols.count()  # one number
    index = postings(symbols)
    df = document_frequency(index)
    q = queries.select("query", content_words(F.array_distinct(tokens(F.col("query")))).alias("terms")).where("size(terms) > 0").distinct()
    qt = q.select("query", F.explode("terms").alias("term")).join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = qt.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term"))), 1, 2).alias("r"))
    key = lambda a: F.array_join(F.array_sort(a), " ")
    rare = rare.select("query", key(F.transform("r", lambda x: x["term"])).alias("key"))
    words = F.array_distinct(tokens(F.col("name")))
    pairs = F.concat(words, F.flatten(F.transform(words, lambda a: F.transform(F.filter(words, lambda b: a < b), lambda b: F.concat_ws(" ", a, b)))))
    names = symbols.select("symbol_id", "name", "kind", words.alias("words"))
    hits = names.select("symbol_id", F.explode(pairs).alias("key")).join(rare, "key").select("query", "symbol_id").distinct()
    credit = index.groupBy("term", "symbol_id").agg(F.max(F.when(F.col("field") == "name", NAME_TOKEN).otherwise(TEXT_HIT)).alias("credit"))
    scored = hits.join(qt, "query").join(credit, ["term", "symbol_id"]).groupBy("query", "symbol_id").agg(F.sum(F.col("credit") * F.log1p(F.lit(total) / (F.col("df") + 1))).alias("terms_score"))
    j = scored.join(names, "symbol_id").join(q, "query")
    all_words = F.size(F.array_except("terms", "words")) == 0
    whole = all_words & (F.size("terms") == F.size("words"))
    strong = F.col("kind").isin(*CALLABLE, *CONTAINER)
    score = F.col("terms_score") + F.when(whole, F.when(strong, WHOLE_NAME).otherwise(WHOLE_NAME_OTHER)).otherwise(0.0) + F.when(all_words, ALL_WORDS).otherwise(0.0)
    j = j.select("query", "symbol_id", "name", F.round(score, 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "name", "symbol_id")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query", "symbol_id", "score", "place")


def credits(symbols: DataFrame, index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, symbol_id, credit) of each of the terms and each symbol that bears it in any way, by the strongest: a token of
    the name, a token of the same stem, a word of signature or documentation, a part of the name (terms of three or more
    characters, by their rarest trigram)."""
    t = terms.select("term").distinct()
    words = index.join(t, "term", "left_semi").select("term", "symbol_id", F.when(F.col("field") == "name", NAME_TOKEN).otherwise(TEXT_HIT).alias("credit"))
    stem = lambda c: F.element_at(stems(F.array(c)), 1)
    tokens_of = index.where("field = 'name'").select(F.col("term").alias("token"), "symbol_id")
    alike = tokens_of.select("token").distinct().select("token", stem(F.col("token")).alias("stem")).join(t.select("term", stem(F.col("term")).alias("stem")), "stem").where("token <> term")
    stemmed = tokens_of.join(alike, "token").select("term", "symbol_id", F.lit(NAME_STEM).alias("credit"))
    low = symbols.where("name IS NOT NULL").select("symbol_id", F.lower("name").alias("low"))
    grams = low.select("low").distinct().select("low", F.explode(trigrams(F.col("low"))).alias("gram"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    rare = t.select("term", F.explode(trigrams(F.col("term"))).alias("gram")).join(df, "gram").groupBy("term").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    parts = rare.join(grams, "gram").where(F.contains("low", "term")).select("term", "low").join(low, "low").select("term", "symbol_id", F.lit(NAME_PART).alias("credit"))
    return words.unionByName(stemmed).unionByName(parts).groupBy("term", "symbol_id").agg(F.max("credit").alias("credit"))


#: Bonus of a callable whose name, signature and documentation each support a query.
COVERAGE = 6.0


def field_hits(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, symbol_id, name_credit, sig, doc) of each of the terms and each symbol that bears it: the credit of its name
    (token, stem or part), and whether its signature and the head of its documentation hold it as a word."""
    t = terms.select("term").distinct()
    words = lambda c: F.explode(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]+)"), 1), F.lower)))
    name = credits(symbols.select("symbol_id", "name", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("doc_comment")),
                   symbols.select("symbol_id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("term"), F.lit("name").alias("field")), t)
    sig = symbols.select("symbol_id", words(F.col("signature")).alias("term")).join(t, "term", "left_semi")
    doc = symbols.select("symbol_id", words(F.substring("doc_comment", 1, 640)).alias("term")).join(t, "term", "left_semi")
    none, yes, no = F.lit(0.0), F.lit(1), F.lit(0)
    rows = (name.select("term", "symbol_id", F.col("credit").alias("name_credit"), no.alias("sig"), no.alias("doc"))
            .unionByName(sig.select("term", "symbol_id", none.alias("name_credit"), yes.alias("sig"), no.alias("doc")))
            .unionByName(doc.select("term", "symbol_id", none.alias("name_credit"), no.alias("sig"), yes.alias("doc"))))
    return rows.groupBy("term", "symbol_id").agg(*[F.max(c).alias(c) for c in ("name_credit", "sig", "doc")])


def search_all_fields(symbols: DataFrame, queries: DataFrame, limit: int = 10, members: bool = False) -> DataFrame:
    """(query, symbol_id, score, place): ranked search for queries of several words; stop words count only where a query
    has nothing else. symbols has each symbol once.

    Recall: every symbol that bears any word of the query in any way counts, so no bound of a branch loses one. Each
    word counts once, by the strongest field it stands in (token of the name 3, of the same stem 2, signature or
    documentation 1, part of the name 1), times ln(1 + N / (df + 1)). Then 100 if the words are the whole name of a
    callable or container (60 for other kinds), 60 if all words stand in the name, and COVERAGE for a callable whose name,
    signature and documentation each hold a word, together at least half of them.

    Of queries with several words, rows that bear one word alone leave once `limit` rows with more stand above them, but
    for those whose name holds the query's rarest word. Ties go by what the names alone earn, then names without a
    leading underscore come first, then by name and id. With members, direct members of the `limit` first types of each
    query that bear a word are scored too where their owner's name bears others: each such word counts 1.

    Scale: queries share their words, and a row can only be among the first of a query if it is among the first by the
    words that they have in common, as any other word moves a row up. So the first rows of each set of words are found
    once, in one pass over the symbols for SETS_TOGETHER sets of query words, and only these are scored for queries. With
    members, and for queries of more than MOST_WORDS words, whose subsets are too many, all rows are scored.
    """
    total = symbols.count()  # one number
    queries = cut(queries.select("query").distinct(), "asked")  # else each use would read again what they come from
    q = queries.select("query", content_words(F.array_distinct(tokens(F.col("query")))).alias("terms")).where("size(terms) > 0").distinct()
    if members:
        return _all_rows(symbols, q, total, limit, True)
    asked = q.select("query", F.array_sort("terms").alias("terms"))
    small = asked.where(F.size("terms") <= MOST_WORDS)
    sets = small.select("terms").distinct()
    number, long = sets.count(), q.where(F.size("terms") > MOST_WORDS)  # one number
    passes = -(-number // SETS_TOGETHER)
    found = [_first_rows(symbols, small.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == k), total, limit) for k in range(passes)]
    if not found or not long.isEmpty():
        found.append(_all_rows(symbols, long, total, limit, False))
    return functools.reduce(DataFrame.unionByName, found)


#: Sets of query words whose first rows are found in one pass, and the most words of a set (it has 2^words subsets).
SETS_TOGETHER, MOST_WORDS = 50_000, 8


def _ranked(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The first rows by key with their place: of key, symbol_id, name, kind, n (words of the query), terms_score, strength,
    matched, rare, in_name, in_sig, in_doc, all_words and whole."""
    strong = F.col("kind").isin(*CALLABLE, *CONTAINER)
    covered = F.col("kind").isin(*CALLABLE) & (F.col("in_name") + F.col("in_sig") + F.col("in_doc") == 3) & (2 * F.col("matched") >= F.col("n"))
    score = F.col("terms_score") + F.when(F.col("whole"), F.when(strong, WHOLE_NAME).otherwise(WHOLE_NAME_OTHER)).otherwise(0.0) + F.when(F.col("all_words"), ALL_WORDS).otherwise(0.0) + F.when(F.coalesce(covered, F.lit(False)), COVERAGE).otherwise(0.0)
    j = rows.select(key, "symbol_id", "name", "kind", "matched", "rare", "strength", "n", F.round(score, 6).alias("score"))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("strength").desc(), _hidden(), "name", "symbol_id")
    above = F.sum((F.col("matched") > 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = j.withColumn("above", F.coalesce(above, F.lit(0))).where((F.col("n") < 2) | (F.col("matched") > 1) | F.col("rare") | (F.col("above") < limit))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def _hidden() -> Column:
    return F.coalesce(F.startswith("name", F.lit("_")), F.lit(False))


def _first_rows(symbols: DataFrame, asked: DataFrame, total: int, limit: int) -> DataFrame:
    """search_all_fields() by the first rows of each set of words; asked: query and its sorted terms."""
    spark = symbols.sparkSession
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z]+)"), 1), F.lower))
    fields = spread(symbols.select("symbol_id", "name", "kind", "signature", "doc_comment")).select("symbol_id", "name", "kind", _hidden().alias("hidden"), F.coalesce(F.col("kind").isin(*CALLABLE), F.lit(False)).alias("callable"),
                            F.coalesce(F.col("kind").isin(*CALLABLE, *CONTAINER), F.lit(False)).alias("strong"), F.lower("name").alias("low"), F.array_distinct(tokens(F.col("name"))).alias("words"),
                            words(F.col("signature")).alias("sig"), words(F.substring("doc_comment", 1, 640)).alias("doc"))
    none = F.array().cast("array<string>")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    borne = fields.select(F.explode(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in ("words", "sig", "doc")]))).alias("term")).groupBy("term").agg(F.least(F.count("*"), F.lit(DF_CAP)).alias("df"))
    df = F.coalesce("df", F.lit(0))
    known = terms.join(borne, "term", "left").select("term", df.alias("df"), F.log1p(F.lit(total) / (df + 1)).alias("weight")).collect()  # words and sets of one pass
    dfs, weights = {r.term: r.df for r in known}, {r.term: r.weight for r in known}
    sets = [list(r.terms) for r in asked.select("terms").distinct().collect()]
    tree = ranked.Words(sets, weights)
    rare = [tree.terms.index(min(s, key=lambda t: (dfs[t], t))) for s in sets]
    lists = pa.table({
        "set": pa.array([i for i, *_ in tree.lists], pa.int32()), "list": pa.array([a for _, a, _ in tree.lists], pa.int32()), "own": pa.array([k for *_, k in tree.lists], pa.int32()),
        "nos": pa.array([tree.sets[i] for i, *_ in tree.lists], pa.list_(pa.int32())), "rarest": pa.array([rare[i] for i, *_ in tree.lists], pa.int32()),
        "weights": pa.array([[float(tree.weights[t]) for t in tree.sets[i]] for i, *_ in tree.lists], pa.list_(pa.float64()))})
    numbers = pa.table({"set": pa.array(range(len(sets)), pa.int32()), "terms": pa.array([sorted(s) for s in sets], pa.list_(pa.string()))})
    first = fields.mapInArrow(ranked.first_rows(tree, limit, (NAME_TOKEN, NAME_STEM, NAME_PART, TEXT_HIT), (WHOLE_NAME, WHOLE_NAME_OTHER, ALL_WORDS, COVERAGE)), ranked.SCHEMA)
    at = first.select("symbol_id", "name", "kind", "named", "hits", F.inline("at"))
    order = Window.partitionBy("list").orderBy(F.col("score").desc(), F.col("strength").desc(), _hidden(), "name", "symbol_id")
    top = at.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn", "score", "strength")
    word, name = lambda h: F.shiftright(h, 4), lambda h: F.shiftright(h, 2).bitwiseAND(3)
    credit = lambda h: F.element_at(F.array(*map(F.lit, (0.0, NAME_PART, NAME_STEM, NAME_TOKEN))), name(h) + 1)
    text = lambda h: F.when(h.bitwiseAND(3) > 0, TEXT_HIT).otherwise(0.0)
    weight = lambda h: F.element_at("weights", F.array_position("nos", word(h)).cast("int"))
    j = top.join(spark.createDataFrame(lists), "list").withColumn("mine", F.filter("hits", lambda h: F.array_contains("nos", word(h))))
    j = j.where(F.size("mine") == F.col("own"))  # the list of just the words that row and query have in common
    total_of = lambda f: F.aggregate("mine", F.lit(0.0), lambda a, h: a + f(h))
    any_of = lambda f: F.exists("mine", f).cast("int")
    j = j.withColumn("n", F.size("nos")).withColumn("all_words", (F.col("own") == F.col("n")) & F.forall("mine", lambda h: name(h) == 3))
    rows = j.select("set", "symbol_id", "name", "kind", "n", "all_words", total_of(lambda h: F.greatest(credit(h), text(h)) * weight(h)).alias("terms_score"), total_of(credit).alias("strength"), F.col("own").alias("matched"),
                    any_of(lambda h: name(h) > 0).alias("in_name"), any_of(lambda h: h.bitwiseAND(2) > 0).alias("in_sig"), any_of(lambda h: h.bitwiseAND(1) > 0).alias("in_doc"),
                    F.exists("mine", lambda h: (word(h) == F.col("rarest")) & (name(h) > 0)).alias("rare"), (F.col("all_words") & (F.col("n") == F.col("named"))).alias("whole"))
    best = _ranked(rows, "set", limit)
    return asked.join(spark.createDataFrame(numbers), "terms").join(best, "set").select("query", "symbol_id", "score", "place")


def _all_rows(symbols: DataFrame, q: DataFrame, total: int, limit: int, members: bool) -> DataFrame:
    """search_all_fields() over all rows; q: query and its terms."""
    df = document_frequency(postings(symbols))
    qt = q.select("query", F.explode("terms").alias("term")).join(df, "term", "left").select("query", "term", F.coalesce("df", F.lit(0)).alias("df"))
    qt = qt.withColumn("weight", F.log1p(F.lit(total) / (F.col("df") + 1)))
    rarest = qt.groupBy("query").agg(F.min_by("term", F.struct("df", "term")).alias("rare"))
    hits = qt.join(field_hits(symbols, qt), "term").select("query", "symbol_id", "term", "weight", "name_credit", "sig", "doc")
    credit = F.greatest("name_credit", F.when((F.col("sig") + F.col("doc")) > 0, TEXT_HIT).otherwise(0.0))
    names = symbols.select("symbol_id", "name", "kind", "parent_symbol_id", F.array_distinct(tokens(F.col("name"))).alias("words")) if "parent_symbol_id" in symbols.columns else \
        symbols.select("symbol_id", "name", "kind", F.lit(None).cast("string").alias("parent_symbol_id"), F.array_distinct(tokens(F.col("name"))).alias("words"))

    def rank(hits: DataFrame) -> DataFrame:
        g = hits.join(rarest, "query").groupBy("query", "symbol_id").agg(
            F.sum(F.col("credit") * F.col("weight")).alias("terms_score"), F.sum("name_credit").alias("strength"), F.count("*").alias("matched"), F.max(F.when(F.col("name_credit") > 0, 1).otherwise(0)).alias("in_name"),
            F.max("sig").alias("in_sig"), F.max("doc").alias("in_doc"), F.bool_or((F.col("term") == F.col("rare")) & (F.col("name_credit") > 0)).alias("rare"))
        j = g.join(names, "symbol_id").join(q, "query").withColumn("n", F.size("terms"))
        j = j.withColumn("all_words", F.coalesce(F.size(F.array_except("terms", "words")) == 0, F.lit(False)))
        return _ranked(j.withColumn("whole", F.col("all_words") & (F.col("n") == F.size("words"))), "query", limit)

    hits = hits.withColumn("credit", credit)
    top = rank(hits)
    if members:
        types = top.where(F.col("kind").isin(*CONTAINER)).select("query", F.col("symbol_id").alias("parent_symbol_id"))
        inside = types.join(names.select("symbol_id", "parent_symbol_id"), "parent_symbol_id")
        own = hits.select("query", "symbol_id", "term")
        bears = inside.join(own.select("query", "symbol_id").distinct(), ["query", "symbol_id"], "left_semi")
        owner = hits.where("name_credit > 0").select("query", F.col("symbol_id").alias("parent_symbol_id"), "term", "weight")
        weak = bears.join(owner, ["query", "parent_symbol_id"]).join(own, ["query", "symbol_id", "term"], "left_anti")
        weak = weak.groupBy("query", "symbol_id", "term", "weight").agg(F.lit(0.0).alias("name_credit"), F.lit(0).alias("sig"), F.lit(0).alias("doc"), F.lit(TEXT_HIT).alias("credit"))
        top = rank(hits.unionByName(weak))
    return top.select("query", "symbol_id", "score", "place")


def module_name(path: Column, lang: Column) -> Column:
    """The name by which code refers to a file as a module: its stem, or its folder's where the file stands for it
    (__init__.py, index.ts, mod.rs, and any Go file)."""
    stem = F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    above = F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]*$", 1)
    whole = stem.isin("__init__", "index", "mod") | F.coalesce(lang == "go", F.lit(False))
    return F.nullif(F.when(whole, above).otherwise(stem), F.lit(""))


def of_kind(symbols: DataFrame, kind: str) -> DataFrame:
    """The symbols of a kind, as it is stored or as it is shown."""
    return symbols.where((F.col("kind") == kind) | F.coalesce(display_kind(F.col("kind"), F.col("language"), F.col("name")) == kind, F.lit(False)))


def by_id(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """(asked, and the symbol's columns): the symbols of ids (asked); an id that is none is no name either and gives no row."""
    return symbols.join(ids.select("asked").where("asked IS NOT NULL").distinct(), F.col("symbol_id") == F.col("asked"))


def select(symbols: DataFrame, asked: DataFrame, files: DataFrame) -> DataFrame:
    """(asked, symbol_id, state): what selectors (asked: an id or a name, hash: that of the file as it was seen, or null)
    mean: an id, else the only symbol of that name; state is found, ambiguous, missing, or stale where the file (file_id,
    content_hash) has changed since."""
    ids = asked.join(symbols.select(F.col("symbol_id").alias("asked"), F.col("symbol_id").alias("by_id"), F.col("file_id").alias("f1")), "asked", "left")
    names = symbols.where("name IS NOT NULL").groupBy(F.col("name").alias("asked")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("by_name"), F.min("file_id").alias("f2"))
    j = ids.join(names, "asked", "left").withColumn("symbol_id", F.coalesce("by_id", F.when(F.col("n") == 1, F.col("by_name")))).withColumn("file_id", F.coalesce("f1", F.when(F.col("n") == 1, F.col("f2"))))
    j = j.join(files.select("file_id", "content_hash"), "file_id", "left")
    state = (F.when(F.col("by_id").isNull() & (F.col("n") > 1), "ambiguous").when(F.col("symbol_id").isNull(), "missing")
             .when(F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("content_hash")), "stale").otherwise("found"))
    return j.select("asked", "symbol_id", state.alias("state"))


def answer(symbols: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query, source, symbol_id, name, place): what a lookup answers. Names that equal, begin with or contain the query
    come first (source name), imports of one name folded into the first of them and local variables left out. A plain
    query that no name equals is also searched by its words (source search). A query without either gets names that are
    spelt nearly so (source suggestion, no id). Queries without any answer have no row."""
    s = searchable(symbols)
    names = by_name(s, queries, 4 * limit).join(s.select("symbol_id", "name", "kind"), "symbol_id")
    first = F.row_number().over(Window.partitionBy("query", "name").orderBy("place"))
    fold = names.withColumn("nth", F.when(F.col("kind") == "import", F.row_number().over(Window.partitionBy("query", "name", "kind").orderBy("place"))).otherwise(first * 0 + 1)).where("nth = 1")
    named = fold.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("rn") <= limit).select("query", F.lit("name").alias("source"), "symbol_id", "name", F.col("rn").alias("place"))
    exact = names.where("match = 'exact'").select("query").distinct()
    open_ = queries.where("query IS NOT NULL AND query <> ''").select("query").distinct().join(exact, "query", "left_anti")
    plain = open_.where(F.col("query").rlike(r"^[\w$ ]+$"))
    found = search_all_fields(s, plain, limit).join(s.select("symbol_id", "name"), "symbol_id").join(named.select("query", "symbol_id"), ["query", "symbol_id"], "left_anti")
    ranked = found.select("query", F.lit("search").alias("source"), "symbol_id", "name", "place")
    empty = open_.join(named.select("query").unionByName(ranked.select("query")).distinct(), "query", "left_anti")
    near = suggestions(s, empty.select(F.col("query").alias("asked")))
    close = near.select(F.col("asked").alias("query"), F.lit("suggestion").alias("source"), F.lit(None).cast("string").alias("symbol_id"), "name", F.row_number().over(Window.partitionBy("asked").orderBy("distance", "name")).alias("place"))
    return named.unionByName(ranked).unionByName(close)


def _file_stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))


def similar_files(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, path): files with the same stem as an asked path's file name, its ending aside."""
    return asked.select("asked", _file_stem(F.col("asked")).alias("stem")).join(files.select("path", _file_stem(F.col("path")).alias("stem")), "stem").where("asked <> path").select("asked", "path")


def near_files(files: DataFrame, asked: DataFrame, edits: int = 2) -> DataFrame:
    """(asked, path, distance): files whose stem is within so many edits of an asked path's, 0 for the same stem."""
    f = files.where("path IS NOT NULL").select("path", _file_stem(F.col("path")).alias("known"))
    a = asked.where("asked IS NOT NULL").select("asked", _file_stem(F.col("asked")).alias("want"))
    return a.join(near_texts(f, a, edits), "want").join(f, "known").where("asked <> path").select("asked", "path", "distance").distinct()


def routes(symbols_facts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, fact): route templates and dotted keys that have the shape of a query or end in it; parameters such as
    {id}, :id and <id> are alike."""
    shape = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}|:[A-Za-z_]\w*|<[^>]*>", "{}"), "/+$", ""))
    f = symbols_facts.select("fact", shape(F.col("fact")).alias("shape"))
    tails = f.select("fact", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("shape", "(?=[/.])"))), lambda i: F.array_join(F.slice(F.split("shape", "(?=[/.])"), i, 100), ""))).alias("tail"))
    tails = tails.select("fact", F.regexp_replace("tail", "^[/.]", "").alias("tail")).distinct()
    return queries.select("query", F.regexp_replace(shape(F.col("query")), "^[/.]", "").alias("tail")).join(tails, "tail").select("query", "fact").distinct()
