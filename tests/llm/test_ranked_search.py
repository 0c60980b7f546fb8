import math
import random
import re
from collections import Counter, defaultdict

import pytest

from flowlake.llm import ranked_search as R
from tests.llm.conftest import AWKWARD


def terms(t):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            for w in re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def brute(docs, items, top=20):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += terms(t)
    out = []
    for i, ts in asked.items():
        rows = []
        for d, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in ts if t in c)
            if s > 0:
                rows.append((-s, d is None, d, s))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)] + ["Straße", "日本", "é"]
    text = lambda n: " ".join(vocab[min(int(rng.expovariate(1 / 30)), 302)] for _ in range(n))
    docs = [(i * 7 % 1009, text(rng.randint(1, 60))) for i in range(600)]
    docs += docs[:30] + [(None, text(20)), (5000, "W1, w2; Straße"), *((6000 + i, t) for i, t in enumerate(AWKWARD))]
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(3, "w1 w1 w299"), (None, "w250 w2"), (77, None), (78, "nowhere"), (79, "w0 " * 50)]
    return docs, items


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("short, run, postings", [(1 / 32, 2048, 4_000_000), (0, 16, 500), (1, 7, 4_000_000)])
def test_equals_brute_force(ready_spark, make_docs, corpus, monkeypatch, short, run, postings):
    monkeypatch.setattr(R, "SHORT", short)
    monkeypatch.setattr(R, "RUN", run)
    monkeypatch.setattr(R, "POSTINGS", postings)
    docs, items = corpus
    table = ready_spark.createDataFrame(items, "item_id long, text string").withColumn("rank", R.F.lit("clash"))
    out = R.ranked_search(make_docs(docs).repartition(3), table)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(out) == brute(docs, items)


def test_blocks_of_items_and_small_top(ready_spark, make_docs, corpus):
    docs, items = corpus
    table = ready_spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(R.ranked_search(make_docs(docs), table, top=3, block_terms=150)) == brute(docs, items, 3)


def test_empty_tables(ready_spark, make_docs):
    some = ready_spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for docs, items in (([], some), ([(1, None), (2, " ,")], some), ([(1, "a")], some.filter("false")), ([(1, "c")], some)):
        assert R.ranked_search(make_docs(docs), items).count() == 0


def test_skipping_leaves_documents_out(monkeypatch):
    """A rare term names the result; the frequent list is only probed there."""
    import numpy as np
    n = 20_000
    at = np.concatenate([np.arange(n), np.arange(0, n, 400)])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(50, np.int64)])
    part = R.Part(np.arange(n), np.zeros(n, np.int64), np.full(n, 10), at, term, np.ones(len(at), np.int64), np.array([1, 5000]), n, 10 * n)
    best, taken = R.Best(20, 1), []
    add = best.add
    monkeypatch.setattr(best, "add", lambda *x: (taken.append(len(x[0])), add(*x)))
    part.search(np.array([0, 1]), np.array([1, 1]), best)
    assert best.doc.tolist() == list(range(0, 8000, 400))
    assert taken[-1] < 60 and sum(taken) < 9000         # the frequent list alone names no more once 20 are found
