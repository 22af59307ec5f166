"""First rows of ranked search: for every set of words that a query may have in common with a symbol, the symbols that come
first by these words alone. Whatever else a row bears only moves it up, so no other row can be among a query's first."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols that a task looks at together; entries that it holds before it keeps the first of each list alone, and that one step makes.
ROWS, HELD, STEP = 100_000, 1_000_000, 500_000
#: A list counts as more than the sum of its words where its rows can have the bonus of coverage, or be whole answers.
PLAIN, COVERED, WHOLE = range(3)


class Words:
    """The words of sets of words, and all subsets of the sets as a tree: a subset's parent lacks its last word."""

    def __init__(self, sets: list[list[str]], weights: dict[str, float]):
        self.terms = sorted({t for s in sets for t in s})
        self.weights = np.array([weights[t] for t in self.terms], np.float64)
        number = {t: k for k, t in enumerate(self.terms)}
        self.sets = [sorted(number[t] for t in s) for s in sets]
        node: dict[tuple, int] = {}
        self.lists: list[tuple[int, int, int]] = []  # set, list, words of the list
        for i, s in enumerate(self.sets):
            for k in range(1, len(s) + 1):
                kind = WHOLE if k == len(s) else COVERED if 2 * k >= len(s) else PLAIN
                for sub in combinations(s, k):
                    self.lists.append((i, 3 * node.setdefault(sub, len(node)) + kind, k))
        self.wanted = np.zeros(3 * len(node), bool)
        self.wanted[[a for _, a, _ in self.lists]] = True
        self.root = np.array([node[k,] for k in range(len(self.terms))], np.int64)
        keys = np.array([node[s[:-1]] * len(self.terms) + s[-1] for s in node if len(s) > 1], np.int64)
        nodes = np.array([n for s, n in node.items() if len(s) > 1], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _members(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and value of each item of a list column."""
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def first_rows(words: Words, limit: int, credits: tuple[float, float, float, float], bonuses: tuple[float, float, float, float]):
    """mapInArrow over symbol_id, name, kind, hidden, callable, strong, low, words, sig and doc, to the symbols that are
    among the first `limit` of any list, with the words that they bear and the lists: hits are numbers of words times 16,
    plus the name's credit (token 3, stem 2, part 1) times 4, 2 if in the signature and 1 if in the documentation."""
    token, stemmed, part, text = credits
    whole_strong, whole_other, all_words, coverage = bonuses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.functions.stem import stem

        terms, size = pa.array(words.terms, pa.string()), len(words.terms)
        by_stem, by_start = {}, {}
        for k, t in enumerate(words.terms):
            by_stem.setdefault(stem(t), []).append(k)
            if len(t) >= 3:
                by_start.setdefault(t[:3], []).append((t, k))
        alike: dict[str, list[int]] = {}
        worth = np.array([0.0, part, stemmed, token])

        def same_stem(t: str) -> list[int]:
            if t not in alike:
                if len(alike) > 1_000_000:
                    alike.clear()
                alike[t] = [k for k in by_stem.get(stem(t), ()) if words.terms[k] != t]
            return alike[t]

        def contained(low: str) -> list[int]:
            return list({k for i in range(len(low) - 2) for t, k in by_start.get(low[i:i + 3], ()) if low.startswith(t, i)})

        def spread(rows: np.ndarray, values: pa.Array, f) -> tuple[np.ndarray, np.ndarray]:
            """Row and word of what f gives for each value; f is asked once for equal values."""
            coded = values.dictionary_encode()
            found = [f(v) for v in coded.dictionary.to_pylist()]
            counts = np.array([len(x) for x in found], np.int64)
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.array([k for x in found for k in x], np.int64)
            each = counts[codes]
            return np.repeat(rows, each), flat[_ranges((np.cumsum(counts) - counts)[codes], each)]

        def exact(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            rows, values = _members(column)
            at = pc.fill_null(pc.index_in(values, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            return rows[at >= 0], at[at >= 0]

        def borne(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row, word and packed credit of each word that a row bears, by row and word."""
            tokens = t["words"]
            known = pc.is_valid(t["low"]).to_numpy(zero_copy_only=False)
            parts = [(*exact(tokens), 3, 0, 0), (*spread(*_members(tokens), same_stem), 2, 0, 0),
                     (*spread(np.flatnonzero(known), t["low"].drop_null(), contained), 1, 0, 0), (*exact(t["sig"]), 0, 1, 0), (*exact(t["doc"]), 0, 0, 1)]
            keys = np.concatenate([rows * size + at for rows, at, *_ in parts])
            if not len(keys):
                return keys, keys, keys
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            name, sig, doc = (np.maximum.reduceat(np.concatenate([np.full(len(p[0]), p[k], np.int64) for p in parts])[order], starts) for k in (2, 3, 4))
            return keys[starts] // size, keys[starts] % size, name * 4 + sig * 2 + doc

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            t = {c: whole[c].chunk(0) if whole[c].num_chunks else pa.array([], whole[c].type) for c in whole.column_names}
            n = whole.num_rows
            tie = np.empty(n, np.int64)
            tie[pc.sort_indices(whole, sort_keys=[("hidden", "ascending"), ("name", "ascending"), ("symbol_id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(n)
            callable_, strong = (t[c].to_numpy(zero_copy_only=False) for c in ("callable", "strong"))
            named = pc.fill_null(pc.list_value_length(t["words"]), 0).to_numpy(zero_copy_only=False)
            row, word, bits = borne(t)
            last = np.searchsorted(row, np.arange(n), side="right")
            credit = np.maximum(worth[bits >> 2], np.where(bits & 3, text, 0.0)) * words.weights[word]
            least = np.full(len(words.wanted), -np.inf)
            pool: list[tuple] = []

            def keep() -> None:
                lists, score, strength, rows = (np.concatenate(c) for c in zip(*pool))
                order = np.lexsort((tie[rows], -strength, -score, lists))
                lists, score, strength, rows = lists[order], score[order], strength[order], rows[order]
                starts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
                place = np.arange(len(lists)) - np.repeat(starts, np.diff(np.r_[starts, len(lists)]))
                full = place == limit - 1
                least[lists[full]] = score[full]
                first = place < limit
                pool[:] = [(lists[first], score[first], strength[first], rows[first])]

            def offer(k: int, pos, node, score, strength, seen, tokens) -> None:
                rows = row[pos]
                covered = np.where(callable_[rows] & (seen == 7), coverage, 0.0)
                bonus = np.where(tokens, all_words + np.where(named[rows] == k, np.where(strong[rows], whole_strong, whole_other), 0.0), 0.0)
                for kind, more in ((PLAIN, 0.0), (COVERED, covered), (WHOLE, covered + bonus)):
                    lists, total = 3 * node + kind, np.round(score + more, 6)
                    m = words.wanted[lists] & (total >= least[lists])
                    if m.any():
                        pool.append((lists[m], total[m], strength[m], rows[m]))
                if sum(len(p[0]) for p in pool) > HELD:
                    keep()

            def extend(k: int, pos, node, score, strength, seen, tokens) -> None:
                counts = last[row[pos]] - pos - 1
                ends, a = np.cumsum(counts), 0
                while a < len(pos):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, side="right")))
                    of, at = np.repeat(np.arange(a, b), counts[a:b]), _ranges(pos[a:b] + 1, counts[a:b])
                    a = b
                    key = node[of] * size + word[at]
                    j = np.minimum(np.searchsorted(words.keys, key), max(0, len(words.keys) - 1))
                    hit = words.keys[j] == key if len(words.keys) else np.zeros(len(key), bool)
                    of, at, j = of[hit], at[hit], j[hit]
                    if len(of):
                        more = (k + 1, at, words.nodes[j], score[of] + credit[at], strength[of] + worth[bits[at] >> 2], seen[of] | seen1[at], tokens[of] & tokens1[at])
                        offer(*more)
                        extend(*more)

            seen1, tokens1 = np.where(bits >> 2, 4, 0) | (bits & 3), (bits >> 2) == 3
            for a in range(0, len(row), STEP):
                pos = np.arange(a, min(a + STEP, len(row)))
                one = (1, pos, words.root[word[pos]], credit[pos], worth[bits[pos] >> 2], seen1[pos], tokens1[pos])
                offer(*one)
                extend(*one)
            if not pool:
                return
            keep()
            lists, score, strength, rows = pool[0]
            order = np.argsort(rows, kind="stable")
            mine, counts = np.unique(rows, return_counts=True)
            at = pa.StructArray.from_arrays([pa.array(lists[order], pa.int32()), pa.array(score[order]), pa.array(strength[order])], names=["list", "score", "strength"])
            first = np.searchsorted(row, mine)
            hits = last[mine] - first
            packed = word * 16 + bits
            out = pa.RecordBatch.from_arrays([
                *(t[c].take(pa.array(mine)) for c in ("symbol_id", "name", "kind")), pa.array(named[mine], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hits)], pa.int32()), pa.array(packed[_ranges(first, hits)], pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), at),
            ], names=["symbol_id", "name", "kind", "named", "hits", "at"])
            for a in range(0, out.num_rows, 10_000):
                yield out.slice(a, 10_000)

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


SCHEMA = "symbol_id string, name string, kind string, named int, hits array<int>, at array<struct<list:int,score:double,strength:double>>"
