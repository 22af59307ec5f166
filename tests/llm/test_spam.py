import random

import numpy as np
import pytest

from tessera.llm import spam
from tessera.llm.features import spam_share
from tessera.llm.pages import PAGE_FEATURES, host, page_features
from tessera.llm.trees import Bag

PROSE = ["The reader keeps a copy of each record until the writer has confirmed it. ", "We measured the pass on a large tree and found that most of it went into hashing. ", "If nothing changed, the second run ends at once, which surprised nobody. ",
         "A table of contents would help here, but the tool does not write one. ", "Please open the window before you move the file, or its handle stays locked. ", "Why does the older build sort by path while this one sorts by size? ",
         "Half of the rows had no label, so they were counted under the empty one. ", "Only the import step still calls it; everything else goes through the cache now. ", "Thanks for looking into this, the first part works and the rest can wait. ",
         "An editor may touch any file at any moment, hence the check before each read. ", "To find a session, start from its last event and go back until the gap is long enough. ", "My first guess was a stale index, yet it turned out to be the clock of that machine. "]


def prose(rng, n):
    return "".join(rng.sample(PROSE, n)).replace("reader", f"reader {rng.randrange(99)}")


SPAM = {
    "keywords": "code search best code search code search free code search buy code search " * 6,
    "sentences": "If you need code search, our code search offers code search like no other code search. " * 8,
    "links": "\n".join(f"- [page {k}](https://x.example/{k})" for k in range(30)),
    "bare": "\n".join(f"{k}. http://x.example/{k}.html" for k in range(30)),
    "anchors": " | ".join(f'<a href="http://x.example/{k}">code {k}</a>' for k in range(30)),
    "tags": " ".join(f"#{w}" for w in ["code", "search", "index", "file"] * 12),
    "cloud": "Tags: " + ", ".join(f"warm queue ({k})" for k in range(40)),
    "nav": " > ".join(["Home", "Login", "Page 3", "Products", "Sitemap"] * 6),
    "navlines": "\n".join(["Home", "Login", "Page 3", "Products", "Sitemap"] * 6),
    "products": "\n".join(f"SKU-{k} fast code search pro ${k}.99 add to cart" for k in range(20)),
    "cjk": "代码搜索 免费下载 代码搜索 最佳工具 代码搜索 免费下载 " * 8,
}
GOOD = {
    "annotated": "\n".join(f"- [#{k}](https://x.example/{k}) The reader keeps a copy of each record until it is confirmed." for k in range(20)),
    "table": "| step | files | p50 ms |\n|---|---|---|\n" + "\n".join(f"| hash | {k} | {k}.5 |" for k in range(20)),
    "code": "```\n" + "if err != nil { return nil, err }\n" * 20 + "```\nThe check comes after each call.",
    "see also": "".join(PROSE * 3) + "\n\nSee also:\n" + "\n".join(f"- http://x.example/{k}" for k in range(5)),
    "one topic": "# record\n\n" + "A missing record is no error. Whenever somebody renames a record, its queue has to follow, and the reader looks twice. There are many ways to read a record, but only one of them needs the lock. Keep each record small: it is sent with every answer. Older builds wrote the record first, then the digest, which cost a pass.",
    "cjk": "索引在下一步开始之前会重新建立。监视任务在文件变化之后会变成空的。签名比较在名称重复的时候会写入日志。",
}


@pytest.mark.parametrize("name", SPAM)
def test_share_of_spam(name):
    assert spam_share(SPAM[name]) > 0.8


@pytest.mark.parametrize("name", GOOD)
def test_share_of_good_pages(name):
    assert spam_share(GOOD[name]) < 0.4


def test_features_of_nothing_and_hosts():
    assert page_features(None) == page_features(" \n") == page_features("?!") == [0.0] * len(PAGE_FEATURES) and spam_share(None) == spam_share(" \n") == 0
    assert host("see https://b.example/x http://a.example www.b.example/y") == "b.example" and host("none") is None and host(None) is None
    assert len(page_features("x " * 200_000)) == len(PAGE_FEATURES)


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    bag = Bag(seed=1).fit(x[:2000], y[:2000])
    assert ((bag.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def corpus(spark, n=240):
    rng, rows = random.Random(3), []
    kinds = list(SPAM)
    for k in range(n):
        bad = k % 6 == 0
        s = SPAM[kinds[k // 6 % len(kinds)]]
        rows.append((k, s + "\n\n" + prose(rng, 1) if bad else prose(rng, 3 + k % 5) + ("\n\n" + SPAM["links"][:60] if k % 4 == 0 else ""), "clash", bad))
    return rows, spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, p string")


def test_held_out_pages(spark):
    rows, df = corpus(spark)
    bad = {k for k, *_, b in rows if b}
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == bad
    assert {r.doc_id for r in spam.spam_pages(df, sample_rows=120).collect()} == bad  # half of the pages are held out


def test_trees_alone_on_held_out_pages():
    """Fitted on weak labels of half of the real texts; on the other half the trees, without any look at lines, agree."""
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test data")
    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    share = np.array([spam_share(t) for t in texts])
    x = spam._matrix(texts)
    known = (share >= spam.SPAM_FROM) | (share <= spam.GOOD_TO)
    half = np.arange(len(texts)) % 2 == 0
    bag = Bag().fit(x[half & known], (share > 0.5).astype(float)[half & known])
    p, y = bag.predict(x[~half]), share[~half] > 0.5
    hits = ((p > 0.5) & y).sum()
    assert 2 * hits / ((p > 0.5).sum() + y.sum()) >= 0.97
    assert (p[y] >= spam.CANDIDATE).mean() > 0.995 and ((p >= spam.CANDIDATE) != y).any()
    used = {n[0] for t in bag.trees for n in t.nodes if len(n) > 1}
    assert len(used) >= 10 and all(len({n[0] for n in t.nodes if len(n) > 1}) > 1 for t in bag.trees)


def test_hosts_move_their_pages(spark):
    """The same doubtful page links to a host of spam, to a host of good pages and to none."""
    link = "see http://{}.example/a for more"
    mixed = " ".join(f"#{w}" for w in ["code", "search", "index", "file"] * 4) + "\n\n" + prose(random.Random(9), 3)
    rows = [(k, SPAM["keywords"] + "\n" + link.format("bad")) for k in range(60)] + [(100 + k, prose(random.Random(k), 6) + "\n" + link.format("good")) for k in range(200)]
    rows += [(900, mixed + link.format("bad")), (901, mixed + link.format("good")), (902, mixed)]
    got = {r.doc_id: r for r in spam.spam_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[900].page_score == got[901].page_score and got[900].score > got[900].page_score > got[901].score
    assert got[902].score == got[902].page_score and got[902].host is None
    assert got[0].score > 0.5 > got[100].score and sum(r.score != r.page_score for r in got.values()) >= 260


def test_trees_say_more_than_the_weak_label(spark):
    """Pages without a weak label, between the two bounds, are scored like all others."""
    _, df = corpus(spark)
    half = SPAM["tags"][:200] + "\n\n" + "".join(PROSE)[:200]
    assert spam.GOOD_TO < spam_share(half) < spam.SPAM_FROM
    got = spam.spam_scores(df.unionByName(spark.createDataFrame([(2000, half, "")], df.schema))).where("doc_id = 2000").first()
    assert 0 < got.page_score < 1


def test_equal_texts_nulls_repeats_and_empty(spark):
    _, df = corpus(spark)
    more = spark.createDataFrame([(1000, SPAM["links"], None), (1001, SPAM["links"], None), (1002, None, None), (1003, "", None), (1003, "", None), (None, "x", None)], "doc_id bigint, text string, p string")
    got = spam.spam_scores(df.unionByName(more)).where("doc_id >= 1000").collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 5 and score[1000] == score[1001] > 0.5 and score[1002] < 0.5 and {r.share for r in got if r.doc_id == 1002} <= {None, 0.0}
    assert spam.spam_scores(df.limit(0)).count() == 0
    assert spam.spam_pages(more.where("doc_id = 1000")).count() == 1  # one label only
