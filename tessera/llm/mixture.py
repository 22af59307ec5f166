"""Mixing of sources to target weights, by balanced sampling with the cube method."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.encode import lengths
from tessera.session import cut

#: Documents that one flight phase takes at a time; a source of any size is split into chunks of about so many.
CHUNK_DOCS = 50_000
#: Chunks whose open documents fly together before the landing.
CHUNKS_TOGETHER = 20_000
EPS = 1e-9


def _move(units: list[list], rng: random.Random) -> None:
    """One step of the flight phase on up to three units [probability, tokens, ...]: moves the probabilities along a
    vector of the null space of the constraints (sum of probabilities; sum of probability x tokens) until one is 0 or 1.
    With two units only the first constraint is kept, with one none: the landing."""
    if len(units) == 3:
        a, b, c = (u[1] for u in units)
        v = [b - c, c - a, a - b]
        if not any(v):
            v = [1.0, -1.0, 0.0]
    else:
        v = [1.0, -1.0][: len(units)]
    up = min((1 - u[0]) / d if d > 0 else u[0] / -d for u, d in zip(units, v) if d)
    down = min(u[0] / d if d > 0 else (1 - u[0]) / -d for u, d in zip(units, v) if d)
    step = up if rng.random() * (up + down) < down else -down
    for u, d in zip(units, v):
        u[0] += step * d
        if u[0] < EPS:
            u[0] = 0.0
        elif u[0] > 1 - EPS:
            u[0] = 1.0


def fly(units: list[list], rng: random.Random, land: bool) -> None:
    """Turns the probabilities of units [probability, tokens, ...] to 0 or 1, keeping their sum and their token total as
    far as possible. Without landing at most two stay fractional."""
    active: list[list] = []
    for u in units:
        if 0 < u[0] < 1:
            active.append(u)
        while len(active) == 3:
            _move(active, rng)
            active = [x for x in active if 0 < x[0] < 1]
    while land and active:
        _move(active, rng)
        active = [x for x in active if 0 < x[0] < 1]


def _flights(seed: int, level: int, land: bool = False):
    """mapInArrow over rows sorted by source, chunk and order: doc_id, source, chunk, tokens, base, p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "chunk", "tokens", "base", "p"]

        def flush(key, rows):
            units = [[r[5], float(r[3]), r] for r in rows]
            fly(units, random.Random(f"{seed}/{level}/{key[0]}/{key[1]}"), land)
            cols = list(zip(*[(*u[2][:5], u[0]) for u in units]))
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        now, held = None, []
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in names]):
                key = (r[1], r[2])
                if key != now and held:
                    yield flush(now, held)
                    held = []
                now = key
                held.append(r)
        if held:
            yield flush(now, held)

    return run


SCHEMA = "doc_id bigint, source string, chunk int, tokens bigint, base int, p double"


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source and tokens (of byte_bpe_50k; 0 for null and empty texts) of each document."""
    return lengths(documents, "source")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target source: target_share, max_repeats, documents, available_tokens, target_tokens (its share of the
    tokens of all documents), and rate: how often each of its documents must be used on average, at most max_repeats.

    Target rows without a source are left out; those of one source are added up; a null share is 0, null repeats are 1.
    """
    want = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one number
    j = want.join(have, "source", "left")
    j = j.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"),
                 F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), (F.col("target_share") * F.lit(total)).alias("target_tokens"))
    rate = F.when(F.col("available_tokens") > 0, F.least(F.col("target_tokens") / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return j.withColumn("rate", rate)


def mix(sizes: DataFrame, planned: DataFrame, seed: int = 0, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents of target sources, 0 copies included. Each document is used
    floor(rate) or floor(rate) + 1 times. Which ones get the additional copy is drawn by the cube method, so that each
    source's number of copies and its tokens match the plan up to one document or two.

    Flights run over chunks of about chunk_docs documents, at most two of which stay undecided in each. Those of
    CHUNKS_TOGETHER chunks fly again together, which leaves two for each such group; these are flown once more by source
    and landed there. So a source of 10^10 documents flies 200,000 chunks, then 20 groups of at most 40,000 open
    documents, and lands 20.
    """
    own = planned.select("source", "rate", F.greatest(F.ceil(F.col("documents") / chunk_docs), F.lit(1)).alias("chunks"))
    rows = sizes.join(own, "source")
    order = F.xxhash64(F.lit(seed), "doc_id")
    base = F.floor("rate").cast("int")
    rows = rows.select("doc_id", "source", F.pmod(order, F.col("chunks")).cast("int").alias("chunk"), "tokens", base.alias("base"), (F.col("rate") - base).alias("p"))
    sort = ["source", "chunk", F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"]
    fly_ = lambda df, *by: df.repartition(*by).sortWithinPartitions(*sort)
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    flown = cut(fly_(rows, "source", "chunk").mapInArrow(_flights(seed, 0), SCHEMA), "flights")
    together = flown.where(open_).withColumn("chunk", F.floor(F.col("chunk") / CHUNKS_TOGETHER).cast("int"))
    again = cut(fly_(together, "source", "chunk").mapInArrow(_flights(seed, 1), SCHEMA), "flights")
    landed = fly_(again.where(open_).withColumn("chunk", F.lit(-1)), "source").mapInArrow(_flights(seed, 2, land=True), SCHEMA)
    done = flown.where(~open_).unionByName(again.where(~open_)).unionByName(landed)
    return done.select("doc_id", "source", "tokens", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def report(planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """The plan with what the mixture reaches: mixture_tokens, mixture_copies, actual_share (of the tokens of the whole
    mixture), most_used, the greatest number of copies of one document, and reachable: false where the mixture stays below
    the target although it uses every token max_repeats times."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixture_tokens"), F.sum("copies").alias("mixture_copies"), F.max("copies").alias("most_used"))
    j = planned.join(got, "source", "left").fillna(0, ["mixture_tokens", "mixture_copies", "most_used"])
    whole = F.sum("mixture_tokens").over(Window.partitionBy(F.lit(1)))  # over the target sources only
    share = F.when(whole > 0, F.col("mixture_tokens") / whole).otherwise(0.0)
    used_up = F.col("mixture_tokens") == F.col("available_tokens") * F.col("max_repeats")
    short = F.col("mixture_tokens") < F.col("target_tokens")
    return j.withColumn("actual_share", share).withColumn("reachable", ~(short & used_up)).drop("rate")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mixed, report) for documents (doc_id, text, source) and targets (source, target_share, max_repeats).

    Defined results: a source that cannot reach its share is used max_repeats times as a whole; sources that are no
    targets, null ones included, are not used, but their tokens count for the total; a target without documents reaches
    0; documents of equal text are separate documents; empty tables give empty results.
    """
    sizes = cut(sized(documents), "sizes")
    planned = cut(plan(sizes, targets), "plan")
    mixed = mix(sizes, planned, seed)
    return mixed, report(planned, mixed)
