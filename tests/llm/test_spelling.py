import random
import re
import zlib
from collections import Counter

from flowlake.llm import spelling as S
from flowlake.llm.common import Scratch
from tests.llm.conftest import AWKWARD

COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))
    out = {}
    for w in n:
        around = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        ok = best is not None and n[best] >= 2 * n[w]
        out[w] = [best if ok else None, None, n[w], len(around), n[best] if ok else None]
    for w in out:
        top = w
        while out[top][0] is not None:
            top = out[top][0]
        out[w][1] = top
    return sorted((w, *v) for w, v in out.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def test_equals_brute_force(make_docs):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)]

    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w[:k] + w[k + 1:], w[:k] + rng.choice("abÀ") + w[k:], w[:k] + rng.choice("abÿ") + w[k + 1:]])
    rows = [(i, rng.choice(" ,1ł").join(slip(rng.choice(base)).title() for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "aaaaa aaaaaa aaaaaaa " * 3), (7, rows[7][1]), *((1000 + i, t) for i, t in enumerate(AWKWARD))]
    assert rows_of(S.spelling_variants(make_docs(rows))) == brute(rows)


def test_long_words_and_runs_of_one_letter(make_docs):
    long = "".join(random.Random(5).choice("abcdef") for _ in range(20_000))
    forms = [long, long[:9000] + long[9001:], long[:50] + "z" + long[51:], "q" + long, long + long[-1]]
    rows = [(i, " ".join([*forms, "x" * (5 + i % 4), "mississippi", "missisippi"])) for i in range(12)] + [(99, long + " " + long)]
    assert rows_of(S.spelling_variants(make_docs(rows))) == brute(rows)


def test_empty_tables(make_docs):
    for rows in ([], [(1, None), (2, "")], [(1, "hello")]):
        out = S.spelling_variants(make_docs(rows))
        assert out.columns == COLS and out.count() == 0


def test_frontier_finds_every_pair_both_ways(ready_spark):
    words = ["abcde", "bbcde", "abcdf", "abcd", "abcdee", "xabcde", "vwxyz"]
    vocab = ready_spark.createDataFrame(list(enumerate(words)), "id long, word string")
    got = {tuple(r) for r in S.neighbours(vocab, Scratch(ready_spark)).collect()}
    want = {("abcde", w) for w in words[1:6]} | {("abcdf", "abcd"), ("abcd", "abcdee")} - {("abcd", "abcdee")}
    assert {p for p in got if p[1] in words} == want | {(b, a) for a, b in want}
