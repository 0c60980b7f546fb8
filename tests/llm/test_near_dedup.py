import random
import re

import pytest

from flowlake.llm import near_dedup as N
from tests.llm.conftest import AWKWARD


def brute(rows, t=85):
    sets, ids = {}, {}
    for i, (doc, text) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(ws[k:k + 3]) for k in range(len(ws) - 2)} if len(ws) >= 3 else ({tuple(ws)} if ws else set())
        ids[i] = doc
    root = {d: d for d in ids.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and None not in (ids[i], ids[j]):
                n = len(sets[i] & sets[j])
                if 100 * n >= t * len(sets[i] | sets[j]):
                    a, b = find(ids[i]), find(ids[j])
                    root[max(a, b)] = min(a, b)
    return sorted(((ids[i], len(sets[i]), None if ids[i] is None else (find(ids[i]) if sets[i] else ids[i])) for i in sets),
                  key=str)


def got(df):
    rows = N.near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def edited(rng, words, rate):
    return " ".join(rng.choice("abcdefgh") * 5 if rng.random() < rate else w for w in words)


def test_against_brute_force(make_docs):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(6):
        base = [f"w{g}_{rng.randint(0, 400)}" for _ in range(rng.choice((4, 30, 120, 300)))]
        rows += [edited(rng, base, rng.choice((0, 0.004, 0.01, 0.03))) for _ in range(14)]
    rows += [" ".join(passage + [f"q{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 60))]) for _ in range(40)]
    rows += AWKWARD[:6] * 2
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert got(make_docs(rows)) == brute(rows)


def test_large_group_of_edited_copies_and_hot_lists(make_docs, monkeypatch):
    monkeypatch.setattr(N, "SHORT", 8)          # take the block path on small lists
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = list(enumerate(edited(rng, base, rng.choice((0.0, 0.01, 0.02, 0.04, 0.06))) for _ in range(150)))
    assert got(make_docs(rows)) == brute(rows)


def test_awkward_rows(make_docs):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(20, AWKWARD[-1]), (None, "one two"), (7, "one two"), (30, "one two"), (30, "other words here now")]
    assert got(make_docs(rows)) == brute(rows)
    assert got(make_docs([])) == []


@pytest.mark.parametrize("n", [1, 60])
def test_long_chain_is_one_component(ready_spark, n):
    from flowlake.llm.common import Scratch
    from flowlake.llm.components import components
    links = ready_spark.range(n).selectExpr("id as a", "id + 1 as b")
    out = {r["node"]: r["comp"] for r in components(links, Scratch(ready_spark)).collect()}
    assert out == {i: 0 for i in range(n + 1)}
