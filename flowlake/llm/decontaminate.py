"""Benchmark decontamination with a generalised suffix automaton over words.

Method.  The benchmark items, normalised to words, form one suffix automaton
(a state stands for all word runs that end at the same places of the items).
Training words are streamed through it; the longest match that ends at each
word decides whether one of the items' windows ends there.  Words inside a
window's occurrence are hit; a document with too large a share of hit words is
contaminated, and ``decontaminate`` drops it or cuts the hit spans out.

The benchmark is the stated query set: it goes to the tasks in blocks of
``BLOCK_WORDS`` words at most.  The driver builds a block's automaton once and
broadcasts it as flat arrays, and only one block's exists on the driver or in
a worker process at a time.  Each block is one pass over the documents; its
hits are intervals, united over the blocks.  The documents aren't shuffled.

Streaming every word through a Python automaton would be slow, so a run of
words is streamed only if all its neighbouring word pairs (by 64-bit hash)
occur in the block's items and the run is as long as the shortest window.  No
window can occur outside such runs, and inside them the automaton compares the
words themselves.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import words as W
from flowlake.llm.common import Scratch, own_columns, query, read

WINDOW = 13                     # consecutive item words
COVERAGE = 20                   # contaminated from 1 / 20 of the words on
BLOCK_WORDS = 1_000_000         # item words in one block: bounds the automaton


class Walk:
    """Reading words through a suffix automaton; ``step`` and ``found`` say how its states are kept."""

    window: int

    def step(self, state: int, word) -> int:
        """The state after ``word``, or -1."""
        raise NotImplementedError

    def found(self, state: int) -> set | None:
        """(length, item) of the windows that are runs of this state."""
        raise NotImplementedError

    def run(self, ws: list, most: int) -> Iterator[tuple[int, int]]:
        """For each word: the state and the length, ``most`` at most, of the longest match that ends there.

        A match is cut to ``most`` words as it grows, so a state's suffix links have ``most`` steps at most."""
        state = run = 0
        for w in ws:
            to = self.step(state, w)
            while to < 0 and state:
                state = self.link[state]
                run = min(run, self.length[state])
                to = self.step(state, w)
            if to >= 0:
                state, run = to, run + 1
            if run >= most:
                run = most
                while self.length[self.link[state]] >= most:
                    state = self.link[state]
            yield state, run

    def occurrences(self, ws: list) -> Iterator[tuple[int, int, set]]:
        """(start, end, items) of every window that occurs in ``ws``."""
        for i, (state, run) in enumerate(self.run(ws, self.window)):
            while state > 0:
                found = self.found(state)
                if found:
                    for n in {m for m, _ in found}:
                        if self.length[self.link[state]] < n <= min(run, self.length[state]):
                            yield i + 1 - n, i + 1, {x for m, x in found if m == n}
                state = self.link[state]
                run = min(run, self.length[state])


class PackedAutomaton(Walk):
    """A built automaton over the words 0 to ``words`` - 1, as flat arrays: transitions sorted by (state, word) and
    searched by bisection, the items of a marked state side by side.  It is what the tasks get."""

    def __init__(self, built: SuffixAutomaton, words: int):
        self.window, self.words = built.window, words
        n = sum(map(len, built.next))
        keys = np.fromiter((s * words + w for s, d in enumerate(built.next) for w in d), np.int64, n)
        to = np.fromiter((t for d in built.next for t in d.values()), np.int32, n)
        order = np.argsort(keys)
        self.keys, self.to = array("q", keys[order].tobytes()), array("i", to[order].tobytes())
        self.link, self.length = array("i", built.link), array("i", built.length)
        self.marked, self.first, self.runs, self.item = array("i"), array("i", [0]), array("i"), array("i")
        self.names: list = []
        code: dict = {}
        for s, items in enumerate(built.items):
            if items:
                self.marked.append(s)
                for m, x in items:
                    if x not in code:
                        code[x] = len(self.names)
                        self.names.append(x)
                    self.runs.append(m)
                    self.item.append(code[x])
                self.first.append(len(self.item))

    def step(self, state: int, word: int) -> int:
        k = state * self.words + word
        i = bisect_left(self.keys, k)
        return self.to[i] if i < len(self.keys) and self.keys[i] == k else -1

    def found(self, state: int) -> set | None:
        i = bisect_left(self.marked, state)
        if i == len(self.marked) or self.marked[i] != state:
            return None
        return {(self.runs[j], self.names[self.item[j]]) for j in range(self.first[i], self.first[i + 1])}


class SuffixAutomaton(Walk):
    """Generalised suffix automaton of word sequences; ``window`` marks what counts as an occurrence."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set | None] = [None]       # items whose window a state's run of that length is

    def step(self, state: int, word) -> int:
        return self.next[state].get(word, -1)

    def found(self, state: int) -> set | None:
        return self.items[state]

    def _clone(self, p: int, q: int, word) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.items.append(None)
        self.link[q] = c
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word) -> int:
        q = self.next[last].get(word)
        if q is not None:                           # the run is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.items.append(None)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return cur

    def add(self, ws: list) -> None:
        last = 0
        for w in ws:
            last = self._extend(last, w)

    def mark(self, item, ws: list) -> None:
        """After all ``add``: record the item at the states of its windows."""
        n = min(self.window, len(ws))
        for state, run in self.run(ws, n):
            if run == n:
                if self.items[state] is None:
                    self.items[state] = set()
                self.items[state].add((n, item))


class Matcher:
    """One block of items: its automaton over word numbers and the hashed word pairs that bound where it can match.

    Built once, on the driver; the tasks get its arrays by broadcast, one copy a worker process."""

    def __init__(self, block: list[tuple[str | None, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        for _, ws in block:
            for w in ws:
                self.ids.setdefault(w, len(self.ids))
        built = SuffixAutomaton(window)
        for _, ws in block:
            built.add([self.ids[w] for w in ws])
        for item, ws in block:
            built.mark(item, [self.ids[w] for w in ws])
        self.auto = PackedAutomaton(built, len(self.ids) + 1)  # the last number stands for all other words
        del built
        self.least = min(min(window, len(ws)) for _, ws in block)
        one, two = [], []
        for _, ws in block:
            h = _hash(ws)
            one.append(h)
            two.append(pairs(h))
        self.known = np.unique(np.concatenate(one))
        self.known2 = np.unique(np.concatenate(two))
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def occurrences(self, ws: list[bytes]) -> Iterator[tuple[int, int, set]]:
        other = len(self.ids)
        return self.auto.occurrences([self.ids.get(w, other) for w in ws])

    def runs(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Word runs (start, end) of one row each that may hold a window."""
        ok = self.bits[(h >> np.uint64(48)).astype(np.int64)]
        maybe = np.flatnonzero(ok)
        ok[maybe] = _member(h[maybe], self.known)
        joint = ok[:-1] & ok[1:]                    # joint[i]: words i and i + 1 stand side by side in an item
        cut = at[(at > 0) & (at < len(h))]
        joint[cut - 1] = False
        where = np.flatnonzero(joint)
        joint[where] = _member(pairs2(h[where], h[where + 1]), self.known2)
        if self.least == 1:
            alone = np.concatenate([ok, [False]])
            joint = np.concatenate([joint, [False]])[:len(ok)]
            left = np.concatenate([[False], joint[:-1]]) if len(ok) else joint
            for i in np.flatnonzero(alone[:len(ok)] & ~joint & ~left):
                yield int(i), int(i) + 1
        edge = np.diff(np.concatenate([[0], joint.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a + 1 >= max(self.least, 2):
                yield int(a), int(b) + 1


def _hash(ws: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(ws), dtype=np.uint8)
    s, e, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
    return W.hashes(data, s, e)


def pairs2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def pairs(h: np.ndarray) -> np.ndarray:
    return pairs2(h[:-1], h[1:])


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), dtype=bool)
    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[i] == x


def text_words(text: str | None) -> list[bytes]:
    low = W.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    s, e, _ = W.spans(low, np.array([0, len(low)]), W.ALNUM)
    b = low.tobytes()
    return [b[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks, read through the driver one at a time; items without words have no window."""
    block, n = [], 0
    for r in own_columns(benchmark, "item_id", "text").toLocalIterator():
        if ws := text_words(r["text"]):
            if block and n + len(ws) > block_words:
                yield block
                block, n = [], 0
            block.append((None if r["item_id"] is None else str(r["item_id"]), ws))
            n += len(ws)
    if block:
        yield block


def _unite(iv: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(iv):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pass(df: DataFrame, block, window: int) -> DataFrame:
    """Add the hits of one block: columns __text, __n, __iv (flat word intervals), __items."""
    shared = df.sparkSession.sparkContext.broadcast(Matcher(block, window))
    names = df.columns

    def run(batches):
        m = shared.value
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(names)}
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            iv: dict[int, list] = {}
            items: dict[int, set] = {}
            for first, data, offs in W.slices(t["__text"]):
                low = W.LOWER[data]
                s, e, at = W.spans(low, offs, W.ALNUM)
                n_words[first: first + len(offs) - 1] = np.diff(at)
                if len(s) == 0:
                    continue
                for a, b in m.runs(W.hashes(low, s, e), at):
                    ws = [low[x:y].tobytes() for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)]
                    row = int(np.searchsorted(at, a, side="right")) - 1
                    for x, y, found in m.occurrences(ws):
                        base = a - int(at[row])
                        iv.setdefault(first + row, []).append((base + x, base + y))
                        items.setdefault(first + row, set()).update(found - {None})
            t["__n"] = pa.array(n_words)
            old_iv, old_items = t["__iv"].to_pylist(), t["__items"].to_pylist()
            for i, found in iv.items():
                old = [(old_iv[i][k], old_iv[i][k + 1]) for k in range(0, len(old_iv[i]), 2)]
                old_iv[i] = [x for p in _unite(old + found) for x in p]
                old_items[i] = sorted(set(old_items[i]) | items[i])
            t["__iv"], t["__items"] = pa.array(old_iv, pa.list_(pa.int64())), pa.array(old_items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([t[n] for n in names], names)
    return df.mapInArrow(run, df.schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
         text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and __n (words), __iv (hit word intervals, flat:
    start, end, start, ...), __items (ids of items with occurring windows, as strings,
    sorted).  A null text has no words; an empty benchmark hits nothing."""
    df = docs.withColumns({"__text": F.col(f"`{text_col}`"), "__n": F.lit(0).cast("long"),
                           "__iv": F.array().cast("array<bigint>"), "__items": F.array().cast("array<string>")})
    sc, kept = None, None
    for i, block in enumerate(item_blocks(benchmark, block_words)):
        if i:                                       # one block's automaton in a job at a time
            sc = sc or Scratch(docs.sparkSession)
            done = sc.keep(df)
            if kept is not None:
                sc.free(kept)
            kept = df = done
        df = _pass(df, block, window)
    return df.drop("__text")


def _counts(df: DataFrame, coverage: int) -> DataFrame:
    hit = F.aggregate(F.transform("__iv", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"),
                      lambda s, x: s + x)
    return df.withColumn("__hit", hit).withColumn(
        "__bad", (F.col("__hit") > 0) & (F.col("__hit") * coverage >= F.col("__n")))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits.

    ``hits`` are the hit word intervals.  Null texts and texts without words
    are clean.  Repeated rows are judged alike.  Items without words have no windows; the windows
    of items with a null id hit words, but these items are neither counted nor named; items that repeat an id count once.
    """
    out = _counts(find(own_columns(docs, "doc_id", "text"), benchmark, window, block_words), coverage)
    return out.select("doc_id", F.col("__n").alias("n_words"), F.col("__hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
                      F.col("__bad").alias("contaminated"),
                      F.col("__iv").alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                  action: str = "drop", max_span: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with their own columns, rid of benchmark passages.

    ``drop``: contaminated documents go, the others stay as they are.
    ``cut``: hit spans of contaminated documents, and in any document spans longer than
    ``max_span`` words, are cut out of the text (each becomes one space); the
    columns ``text`` and, if present, ``n_chars`` follow.
    """
    cols = docs.columns
    found = _counts(find(docs, benchmark, window, block_words), coverage)
    if action == "drop":
        return found.filter(~F.col("__bad")).select(*[F.col(f"`{c}`") for c in cols])
    names, schema = found.columns, found.schema

    def run(batches):
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(names)}
            texts = t["text"].to_pylist()
            for i, (iv, bad) in enumerate(zip(t["__iv"].to_pylist(), t["__bad"].to_pylist(), strict=True)):
                spans = [(iv[k], iv[k + 1]) for k in range(0, len(iv), 2)]
                spans = [x for x in spans if bad or (max_span is not None and x[1] - x[0] > max_span)]
                if spans:
                    raw = texts[i].encode()
                    low = W.LOWER[np.frombuffer(raw, dtype=np.uint8)]
                    s, e, _ = W.spans(low, np.array([0, len(raw)]), W.ALNUM)
                    out, done = [], 0
                    for a, b in spans:
                        out += [raw[done: s[a]], b" "]
                        done = e[b - 1]
                    texts[i] = b"".join([*out, raw[done:]]).decode()
            t["text"] = pa.array(texts, pa.string())
            if "n_chars" in t:
                t["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([t[n] for n in names], names)
    return found.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in cols])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n,
             unnest([array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') FOR i IN range(1, greatest(len(ws) - 11, 2))]) AS v
      FROM b WHERE len(ws) > 0),
g AS (SELECT d.doc_id, n.n, i, array_to_string(ws[i:i + n.n - 1], ' ') AS v
      FROM d, (SELECT DISTINCT n FROM w) n, unnest(range(1, len(ws) - n.n + 2)) AS t(i)),
o AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM g JOIN w USING (n, v)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op2_benchmark_decontamination", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hits")
