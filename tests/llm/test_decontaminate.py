import hashlib
import random
import re

import pytest

from flowlake.llm import decontaminate as D
from tests.llm.conftest import AWKWARD


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    wins = {}
    for i, t in items:
        ws = words(t)
        n = min(13, len(ws))
        for k in range(len(ws) - n + 1) if n else ():
            wins.setdefault(tuple(ws[k:k + n]), set()).add(str(i))
    out = []
    for doc, t in rows:
        ws, hit, found = words(t), set(), set()
        for n in {len(w) for w in wins}:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k:k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[w]
        found.discard("None")               # an item without an id hits words, but is not counted or named
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def case(seed, vocabulary):
    rng = random.Random(seed)
    w = lambda n: [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]
    items = [(i, " ".join(w(rng.choice((1, 3, 12, 13, 14, 40))))) for i in range(12)]
    rows = []
    for i in range(60):
        ws = w(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            part = items[rng.randrange(12)][1].split()
            a = rng.randint(0, len(part) - 1)
            at = rng.randint(0, len(ws))
            ws[at:at] = part[a:] if rng.random() < 0.6 else part
        rows.append((i, ", ".join(ws).upper()))
    return rows, items


@pytest.mark.parametrize("seed,vocabulary,block", [(1, 2000, 10**6), (2, 6, 10**6), (3, 40, 60)])
def test_against_brute_force(make_docs, ready_spark, seed, vocabulary, block):
    rows, items = case(seed, vocabulary)
    bench = ready_spark.createDataFrame(items, "item_id long, text string")
    out = D.judge(make_docs(rows), bench, block_words=block).drop("hits").collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, items)


def test_awkward_rows(make_docs, ready_spark):
    rows = list(enumerate(AWKWARD)) + [(None, "a"), (3, "a")]
    items = [(1, "a"), (1, "a"), (2, None), (None, "one"), (4, ""), (5, "one two")]
    bench = ready_spark.createDataFrame(items, "item_id long, text string")
    # formerly the windows of an item without an id were left out; the contract hits a word inside any window
    want = brute(rows, items)
    assert sorted((tuple(r) for r in D.judge(make_docs(rows), bench).drop("hits").collect()), key=str) == want
    empty = D.judge(make_docs(rows), bench.limit(0)).collect()
    assert len(empty) == len(rows) and not any(r["contaminated"] for r in empty)
    assert D.judge(make_docs([]), bench).count() == 0


def test_drop_and_cut(make_docs, ready_spark):
    item = " ".join(f"b{i}" for i in range(20))
    clean = "fine words " * 300
    docs = make_docs([(1, f"start {item}. end"), (2, clean), (3, clean + item), (4, None)])
    bench = ready_spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {2: clean, 3: clean + item, 4: None}
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, bench, action="cut", max_span=15).collect()}
    assert cut == {1: "start  . end", 2: clean, 3: clean + " ", 4: None}


def test_repeated_words_stay_linear():
    import time
    n, began = 60_000, time.time()
    auto = D.SuffixAutomaton(13)
    ws = [b"a"] * n
    auto.add(ws)
    auto.mark("1", ws)
    got = list(auto.occurrences(ws))
    assert len(got) == n - 12 and got[0] == (0, 13, {"1"}) and got[-1] == (n - 13, n, {"1"}) and time.time() - began < 10


def test_packed_automaton_finds_what_the_built_one_finds():
    rng = random.Random(5)
    words = [b"a", b"b", b"c", b"d"]
    for n in range(40):
        block = [(rng.choice([None, "x", f"i{k}"]), [rng.choice(words) for _ in range(rng.randint(1, 12))]) for k in range(rng.randint(1, 8))]
        built = D.SuffixAutomaton(4)
        for _, ws in block:
            built.add(ws)
        for item, ws in block:
            built.mark(item, ws)
        text = [rng.choice([*words, b"other"]) for _ in range(120)]
        matcher = D.Matcher(block, 4)
        want = set()
        for item, ws in block:
            for i in range(max(1, len(ws) - 3)):
                run = ws[i:i + 4]
                want |= {(j, j + len(run), item) for j in range(len(text)) if text[j:j + len(run)] == run}
        got = [(a, b, x) for a, b, xs in matcher.occurrences(text) for x in xs]
        assert set(got) == want == {(a, b, x) for a, b, xs in built.occurrences(text) for x in xs}, n


def test_broadcast_automaton_is_small():
    import pickle
    rng = random.Random(6)
    block = [(str(k), [b"w%d" % int(2000 * rng.random() ** 3) for _ in range(100)]) for k in range(500)]
    assert len(pickle.dumps(D.Matcher(block, 13))) < 100 * 50_000   # bytes an item word
