"""Parent-child links to full hierarchies: components, chains, depths, descendants and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: Largest component that one task solves as a whole; larger ones go the distributed way.
MAX_COMPONENT = 200_000
#: Rows that a contracting task holds at a time, at least.
CHUNK_ROWS = 200_000
#: Bytes of a file whose symbols are contracted together. A file larger than that is split, however many symbols it has.
WINDOW_BYTES = 200_000

RESULT = ("symbol_id string, component string, root_symbol_id string, depth int, chain array<string>, descendants bigint, "
          "cycle_symbol_id string, on_cycle boolean")


def nodes_of(symbols: DataFrame) -> DataFrame:
    """Each symbol once: symbol_id, parent (null where null or blank in all copies), and a place (file and byte window)
    that neighbours in the tree mostly share. Copies of a row agree but for nulls, so the greatest non-null value of
    each column is taken. Symbols without a place are spread by their id, so no group of them grows with the table."""
    parent = F.when(F.trim("parent_symbol_id") != "", F.col("parent_symbol_id"))
    spread_ = F.pmod(F.xxhash64("symbol_id"), F.lit(4096)).cast("int")
    one = symbols.where("symbol_id IS NOT NULL").groupBy("symbol_id").agg(
        F.max(parent).alias("parent"), F.max("file_id").alias("file_id"), F.floor(F.max("start_byte") / F.lit(WINDOW_BYTES)).cast("int").alias("window"))
    return one.select("symbol_id", "parent", F.coalesce("file_id", F.lit("")).alias("file_id"), F.when(F.col("file_id").isNotNull(), F.col("window")).alias("window")).withColumn(
        "window", F.coalesce("window", -1 - spread_))


def _tops(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row's parent row (-1: none here): the row at the end of the chain, and whether it lies on a circle. On
    circles the end is the circle's least row."""
    n = len(parent)
    self_ = np.arange(n)
    up = np.where(parent < 0, self_, parent)
    low = self_.copy()
    ended = parent < 0
    rounds = 0
    while True:
        low = np.minimum(low, low[up])
        up = up[up]
        rounds += 1
        if ended[up].all() or (1 << rounds) >= n:
            break
    circular = ~ended[up]
    return np.where(circular, low[up], up), circular


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place; emits each symbol with the top symbol of its chain, as far as the chunk goes, and for a top
    whose parent is not in the chunk that parent."""
    names = ["symbol_id", "parent", "label", "outer"]

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, parents = t["symbol_id"].to_numpy(), t["parent"].to_numpy()
        at = pd.Index(ids).get_indexer(pd.Index(parents))
        at[pd.isna(parents)] = -1
        top, _ = _tops(at)
        outer = np.where((at < 0), parents, None)
        yield from pa.Table.from_arrays([pa.array(x, pa.string()) for x in (ids, parents, ids[top], outer)], names=names).to_batches()

    held: list[pa.Table] = []
    size = 0
    for b in batches:
        t = pa.Table.from_batches([b])
        if size >= CHUNK_ROWS:
            f, w = b.column("file_id"), b.column("window")
            last = held[-1]
            key = (last["file_id"][-1].as_py(), last["window"][-1].as_py())
            same = 0
            while same < b.num_rows and (f[same].as_py(), w[same].as_py()) == key:
                same += 1
            if same < b.num_rows:
                yield from emit(pa.concat_tables([*held, t.slice(0, same)]))
                held, size, t = [], 0, t.slice(same)
        held.append(t)
        size += t.num_rows
    if held:
        yield from emit(pa.concat_tables(held))


def follow(edges: DataFrame, chains: bool = False) -> DataFrame:
    """Follows links (node, parent; each node once, parents possibly not nodes) to their ends by pointer doubling: node,
    top (the last parent, which is no node; or the least node of the circle that the chain runs into), circular, on_circle,
    and if asked for the chain of parents (null for circular ones).

    A round doubles the reach of all unfinished nodes by one join. While a node of depth d is unfinished, nodes of every
    lesser depth exist, so a round that finishes none leaves only circular ones; further rounds, until the reach covers
    their number, put every pointer on its circle.
    """
    state = edges.select("node", F.col("parent").alias("ptr"), F.least("node", "parent").alias("low"), F.lit(False).alias("done"),
                         *([F.array("parent").alias("chain")] if chains else []))
    state = cut(state, "follow")
    left, reach, only_circles = None, 1, False
    while True:
        b = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"), F.col("done").alias("done2"),
                         *([F.col("chain").alias("chain2")] if chains else []))
        active = state.where("NOT done").join(b, "ptr", "left")
        ends = F.col("ptr2").isNull()
        longer = F.lit(None) if only_circles else F.when(ends, F.col("chain")).otherwise(F.concat("chain", "chain2"))
        active = active.select(
            "node", F.coalesce("ptr2", "ptr").alias("ptr"), F.least("low", F.coalesce("low2", "low")).alias("low"), (ends | F.col("done2")).alias("done"),
            *([longer.cast("array<string>").alias("chain")] if chains else []))
        state = cut(state.where("done").unionByName(active), "follow")
        now = state.where("NOT done").count()
        reach *= 2
        only_circles = now == left
        if now == 0 or (only_circles and reach >= now):
            break
        left = now
    rest = ["chain"] if chains else []
    ended = state.where("done").select("node", F.col("ptr").alias("top"), F.lit(False).alias("circular"), F.lit(False).alias("on_circle"), *rest)
    if now == 0:
        return ended
    # every pointer is on a circle now, and every node of a circle is the pointer of another
    circular = state.where("NOT done")
    least = circular.select(F.col("node").alias("ptr"), F.col("low").alias("circle"))
    ring = circular.select(F.col("ptr").alias("node")).distinct().withColumn("on_circle", F.lit(True))
    around = circular.join(least, "ptr").join(ring, "node", "left").select(
        "node", F.col("circle").alias("top"), F.lit(True).alias("circular"), F.coalesce("on_circle", F.lit(False)).alias("on_circle"),
        *([F.lit(None).cast("array<string>").alias("chain")] if chains else []))
    return ended.unionByName(around)


def components(symbols: DataFrame) -> DataFrame:
    """symbol_id, parent and component of each symbol; a component is what parent links connect.

    Links inside a file window are contracted in one pass without joins. What remains, links between windows and files,
    is followed by pointer doubling over the contracted tops alone.
    """
    nodes = nodes_of(symbols).repartition("file_id", "window").sortWithinPartitions("file_id", "window")
    labelled = cut(nodes.mapInArrow(_contract, "symbol_id string, parent string, label string, outer string"), "labels")
    outer = labelled.where("outer IS NOT NULL").select("label", "outer")
    known = labelled.select(F.col("symbol_id").alias("outer"), F.col("label").alias("parent"))
    links = outer.join(known, "outer").select(F.col("label").alias("node"), "parent")
    joined = follow(links).select(F.col("node").alias("label"), "top")
    return labelled.join(joined, "label", "left").select("symbol_id", "parent", F.coalesce("top", "label").alias("component"))


WHITE, GREY, BLACK = 0, 1, 2
#: Ids that a solving task collects before it hands rows on.
FLUSH_IDS = 200_000


def solve(ids: list[str], parents: list[str | None]) -> Iterator[tuple]:
    """One component: (symbol_id, root, depth, chain from the root to the symbol, descendants, least id of the circle,
    on the circle) of each symbol, by iterative depth-first traversal with node colours. Rows come as nodes are left, so
    only the current line is held, however deep the tree."""
    n = len(ids)
    at = {s: i for i, s in enumerate(ids)}
    up = [at.get(p, -1) if p is not None else -1 for p in parents]
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(up):
        if p >= 0:
            children[p].append(i)
    colour = [WHITE] * n
    below = [0] * n
    for top in (i for i in range(n) if up[i] < 0):
        stack, line = [top], []
        while stack:
            v = stack[-1]
            if colour[v] == WHITE:
                colour[v] = GREY
                line.append(ids[v])
                stack.extend(children[v])
                continue
            stack.pop()
            if colour[v] == GREY:
                colour[v] = BLACK
                if up[v] >= 0:
                    below[up[v]] += below[v] + 1
                yield ids[v], ids[top], len(line) - 1, list(line), below[v], None, False
                line.pop()
    circle: list[str | None] = [None] * n
    for start in range(n):  # what no root reaches hangs on a circle
        if colour[start] != WHITE:
            continue
        trail, v = [], start
        while colour[v] == WHITE:
            colour[v] = GREY
            trail.append(v)
            v = up[v]
        ring: list[int] = []
        if colour[v] == GREY:  # a back edge
            ring = trail[trail.index(v):]
            least = min(ids[i] for i in ring)
        else:
            least = circle[v]
        on = set(ring)
        for i in trail:
            circle[i], colour[i] = least, BLACK
            yield ids[i], None, None, None, None, least, i in on


def _solve_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component."""
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split()[0] for c in RESULT.split(", ")]
    def flush(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def components():
        now, ids, parents = None, [], []
        for b in batches:
            for c, i, p in zip(b.column("component").to_pylist(), b.column("symbol_id").to_pylist(), b.column("parent").to_pylist()):
                if c != now and ids:
                    yield now, ids, parents
                    ids, parents = [], []
                now = c
                ids.append(i)
                parents.append(p)
        if ids:
            yield now, ids, parents

    out: list[tuple] = []
    size = 0
    for name, ids, parents in components():
        for r in solve(ids, parents):
            out.append((r[0], name, *r[1:]))
            size += 1 + len(r[3] or ())
            if size >= FLUSH_IDS:
                yield flush(out)
                out, size = [], 0
    if out:
        yield flush(out)


def _solve_wide(rows: DataFrame) -> DataFrame:
    """The same result for components too large for a task, by pointer doubling over all their links."""
    real = rows.join(rows.select(F.col("symbol_id").alias("parent")), "parent", "left_semi")
    found = follow(real.select(F.col("symbol_id").alias("node"), "parent"), chains=True)
    roots = rows.join(found.select(F.col("node").alias("symbol_id")), "symbol_id", "left_anti")
    solved = found.select(F.col("node").alias("symbol_id"), F.when(~F.col("circular"), F.col("top")).alias("root_symbol_id"),
                          F.when(~F.col("circular"), F.concat(F.reverse("chain"), F.array("node"))).alias("chain"),
                          F.when(F.col("circular"), F.col("top")).alias("cycle_symbol_id"),
                          F.col("on_circle").alias("on_cycle"))
    solved = cut(solved.unionByName(roots.select("symbol_id", F.col("symbol_id").alias("root_symbol_id"), F.array("symbol_id").alias("chain"),
                                                 F.lit(None).cast("string").alias("cycle_symbol_id"), F.lit(False).alias("on_cycle"))), "wide")
    counts = solved.select(F.explode("chain").alias("symbol_id")).groupBy("symbol_id").agg((F.count("*") - 1).alias("descendants"))
    return rows.select("symbol_id", "component").join(solved, "symbol_id").join(counts, "symbol_id", "left").select(
        "symbol_id", "component", "root_symbol_id", (F.size("chain") - 1).cast("int").alias("depth"), "chain", "descendants", "cycle_symbol_id", "on_cycle")


def hierarchy(symbols: DataFrame, max_component: int = MAX_COMPONENT) -> DataFrame:
    """For each symbol of a parent-link table (symbol_id, parent_symbol_id, file_id, start_byte): component, root, depth
    (0 for a root), chain (ids from the root to the symbol), number of descendants, and for a symbol whose chain never
    ends the least id of the circle that it runs into (then root, depth, chain and descendants are null) and whether it
    lies on that circle itself.

    Defined results: repeated rows of a symbol count once; a parent that is null, blank or not in the table makes the
    symbol a root; a symbol that is its own parent is a circle; rows with a null symbol_id are left out; an empty table
    gives no rows.

    Scale: components are found first; each is then co-located and solved by one traversal. A component of more than
    max_component symbols is solved by joins instead, so no task holds more than that many symbols of a component.
    """
    rows = components(symbols)
    if not _larger(rows, max_component):
        return _solve(rows)
    rows = cut(rows, "components")
    sizes = rows.groupBy("component").count().where(F.col("count") > max_component).select("component")
    return _solve(rows.join(sizes, "component", "left_anti")).unionByName(_solve_wide(rows.join(sizes, "component", "left_semi")))


def _larger(rows: DataFrame, max_component: int) -> bool:
    return bool(rows.groupBy("component").count().agg(F.max("count") > max_component).first()[0])


def _solve(rows: DataFrame) -> DataFrame:
    return rows.repartition("component").sortWithinPartitions("component").mapInArrow(_solve_components, RESULT)


def descendants(tree: DataFrame) -> DataFrame:
    """All (symbol_id, descendant_id, distance) of a hierarchy(); symbols on or below circles have none here."""
    n = F.size("chain")
    return tree.select(F.col("symbol_id").alias("descendant_id"), n.alias("n"), F.posexplode("chain").alias("pos", "symbol_id")).where(
        F.col("pos") < F.col("n") - 1).select("symbol_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).alias("distance"))
