"""Keyword-stuffed pages, link lists and lists of tags or products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.features import spam_share
from tessera.llm.pages import PAGE_FEATURES, host, page_features
from tessera.llm.trees import Bag
from tessera.session import cut, spread

#: Bound of the training sample: pages that are weakly labelled, drawn by a hash of doc_id; about so many, or all if fewer.
SAMPLE_ROWS = 12_000
#: Weak labels: shares of spam lines from which a page is labelled spam, and up to which it is not; others have no label.
SPAM_FROM, GOOD_TO = 0.6, 0.4
#: Pages that a host's spam rate is smoothed by, the weight of that rate in the log odds of its pages, and the most that it
#: moves them.
PRIOR_PAGES, HOST_WEIGHT, HOST_MOST = 20.0, 0.5, 1.5
#: Scores from which a page is looked at line by line.
CANDIDATE = 0.05
#: Predictions below this cannot become candidates, whatever their host.
_FLOOR = 1 / (1 + (1 - CANDIDATE) / CANDIDATE * math.exp(HOST_MOST)) * (1 - 1e-9)

_WIDTH = len(PAGE_FEATURES)


def _matrix(texts: list) -> np.ndarray:
    return np.array([page_features(t) for t in texts], float).reshape(len(texts), _WIDTH)


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        share = np.array([spam_share(t) for t in texts])
        x = pa.FixedSizeListArray.from_arrays(pa.array(_matrix(texts).reshape(-1)), _WIDTH).cast(pa.list_(pa.float64()))
        label = pa.array([1.0 if s >= SPAM_FROM else 0.0 if s <= GOOD_TO else None for s in share], pa.float64())
        yield pa.RecordBatch.from_arrays([b.column(0), x, label], names=["place", "x", "label"])


def _score(bag: Bag | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            if bag:
                p = bag.predict(_matrix(texts))
                share = [spam_share(t) if q >= _FLOOR else None for t, q in zip(texts, p)]
            else:
                share = [spam_share(t) for t in texts]
                p = np.array([float(s > 0.5) for s in share])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(share, pa.float64()), pa.array([host(t) for t in texts], pa.string())], names=["doc_id", "p", "share", "host"])

    return run


def train(texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Bag | None:
    """Bagged trees on the features of whole pages, from weak labels that are given line by line: spam where at least
    SPAM_FROM of the characters stand in lines that are links, tags, lists of labels or repeated keywords, no spam where
    at most GOOD_TO do. No feature is such a share. None where one of the labels does not occur."""
    rows = texts.count()  # one number
    place = F.xxhash64("doc_id", F.lit(17))
    drawn = texts.where(F.pmod(place, F.lit(1 << 30)) < int(min(1.0, sample_rows / max(1, rows)) * (1 << 30))).select(place.alias("place"), "text")
    got = drawn.mapInArrow(_label, "place bigint, x array<double>, label double").where("label IS NOT NULL").toArrow().combine_chunks()
    y = got["label"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), _WIDTH)
    order = np.lexsort((*x.T, got["place"].to_numpy()))  # the same trees, however the rows arrive
    return Bag().fit(x[order], y[order])


def spam_scores(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, host, page_score, score, share) of each row: the trees' prediction; the same moved by the spam rate of
    the host that the page links to most; and, where the score is at least CANDIDATE, the share of the text's characters
    that stand in links, tags, lists of labels or repeated keywords. The host is taken from the text, as the table has no
    addresses, so equal texts get equal scores.

    Defined results: null, empty and blank texts have no share of spam; repeated rows each get their row; an empty table
    gives none; other columns are not touched; without examples of both labels every page is looked at line by line.

    Scale: the sample is bounded by sample_rows; all else is measured where the text is read, and only numbers and hosts
    are written and shuffled. Every page is scored. Lines are judged in the same pass, where the score could reach
    CANDIDATE with any host, so no text is read again or shuffled. Hosts are counted with partial aggregation.
    """
    texts = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    scored = cut(texts.mapInArrow(_score(train(texts, sample_rows)), "doc_id bigint, p double, share double, host string"), "scored")
    base = scored.agg(F.coalesce(F.avg("p"), F.lit(0.0))).first()[0]  # one number
    hosts = scored.where("host IS NOT NULL").groupBy("host").agg(F.sum("p").alias("spam"), F.count("*").alias("pages"))
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    rate = (F.col("spam") + PRIOR_PAGES * base) / (F.col("pages") + PRIOR_PAGES)
    shift = F.greatest(F.lit(-HOST_MOST), F.least(F.lit(HOST_MOST), HOST_WEIGHT * (odds(rate) - odds(F.lit(base)))))
    moved = scored.where("host IS NOT NULL").join(hosts.select("host", shift.alias("shift")), "host")
    moved = moved.select("doc_id", "host", F.col("p").alias("page_score"), (1 / (1 + F.exp(-(odds(F.col("p")) + F.col("shift"))))).alias("score"), "share")
    alone = scored.where("host IS NULL").select("doc_id", "host", F.col("p").alias("page_score"), F.col("p").alias("score"), "share")
    both = moved.unionByName(alone)
    return both.withColumn("share", F.when(F.col("score") >= CANDIDATE, F.col("share")))


def spam_pages(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id of the spam pages: candidates by trees and hosts, of which more than half is spam line by line."""
    return spam_scores(documents, sample_rows).where(f"score >= {CANDIDATE} AND share > 0.5").select("doc_id").distinct()
