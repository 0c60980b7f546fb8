"""Spelling variants: words one edit apart, by a relational trie frontier.

Method.  The trie of all words is a distributed edge table (node, label, child); a node is the
hash of its prefix.  A frontier of states (word, position, node, edits) starts with every word and
is joined with the edge table level by level.  A state takes an edge whose label continues its
word; a state without an edit also takes an edge that replaces its next code point, or
goes past it (deletes it).  A state with one edit that has read its whole word at a node where a
word ends is a neighbour pair.  Insertions are the deletions of the longer word, and replacements
go to larger code points only; the pairs are then turned round.

Two rules keep the frontier short.  Nearness looks the same from both ends, and one of the
two sides of an edit holds half of the word, so states begin at the middle of the word
in the trie of the words and of the reversed words; the bushy top of the trie is never walked.
And nodes with one child at which no word ends are folded into their edge, so that a word of any
length has few levels: as many as other words branch off or end in its second half.

Prefix hashes have 64 bits: equal hashes of different prefixes would only add paths, and a pair
counts only if its other word, made from the word and its edit, is itself a word of the table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import words as W
from flowlake.llm.common import Scratch, own_columns, query, read

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = W.LOWER.tobytes()
SLIP = 97                       # one run in so many loses a code point
LEAST_LETTERS, LEAST_COUNT = 5, 3
FLUSH = 200_000                 # distinct words that a task counts before it hands them on


def word_counts(docs: DataFrame, slip: int = SLIP, letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): runs of letters of all texts with their slips, counted within tasks and then over the table."""
    def run(batches):
        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                low = text.as_py().encode().translate(LOWER).decode()
                start = zlib.crc32(f"{doc_id.as_py()}:".encode() if doc_id.is_valid else b":")
                for word, c in Counter(RUN.findall(low)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % slip == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1:]
                    if len(word) >= letters:
                        total[word] += c
                if len(total) > FLUSH:
                    yield out()
        yield out()
    return (own_columns(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _prefixes(vocab: DataFrame) -> DataFrame:
    """(id, rev, pos, node, ch) for each position in the second half of every word, read forwards and
    backwards; ``ch`` is the next code point, 0 at the word's end."""
    step = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for rev in (False, True):
                cps = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)[::-1 if rev else 1] for t in texts]
                n = np.array([len(c) for c in cps], dtype=np.int64)
                if not len(n):
                    continue
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                flat = np.concatenate(cps)
                within = np.arange(len(flat)) - np.repeat(first, n)
                with np.errstate(over="ignore"):
                    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max()), step)]).astype(np.uint64))
                    cs = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[within])])
                    half = n // 2
                    rows = n - half + 1
                    begin = np.concatenate([[0], np.cumsum(rows)[:-1]])
                    pos = np.arange(int(rows.sum())) - np.repeat(begin, rows) + np.repeat(half, rows)
                    at = np.repeat(first, rows) + pos
                    node = W.mix(cs[at] - cs[np.repeat(first, rows)] + W.mix(pos.astype(np.uint64) * np.uint64(2) + np.uint64(rev)))
                ch = np.where(pos < np.repeat(n, rows), flat[np.minimum(at, len(flat) - 1)], 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, rows)), pa.array(np.full(len(pos), rev)), pa.array(pos.astype(np.int32)),
                     pa.array(node.view(np.int64)), pa.array(ch.astype(np.int32))], ["id", "rev", "pos", "node", "ch"])
    return vocab.select("id", "word").mapInArrow(run, "id long, rev boolean, pos int, node long, ch int")


def _paths(vocab: DataFrame, scratch: Scratch) -> DataFrame:
    """(rev, word, path): for each word in both directions its nodes at which words branch or end, as structs (pos, node, end)."""
    rows = scratch.keep(_prefixes(vocab))
    nodes = (rows.groupBy("node").agg(F.min("ch").alias("lo"), F.max("ch").alias("hi"))
             .filter("lo = 0 or lo < hi").select("node", (F.col("lo") == 0).alias("end")))
    path = (rows.join(nodes, "node").groupBy("id", "rev")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "node", "end"))).alias("path")))
    word = F.when(F.col("rev"), F.reverse("word")).otherwise(F.col("word")).alias("word")
    out = scratch.keep(path.join(vocab, "id").select("rev", word, "path"))
    scratch.free(rows)
    return out


def _sub(word: Column, begin: Column, length: Column) -> Column:
    """Code points of ``word`` from ``begin`` (from 0)."""
    return F.substring(word, begin + 1, length)


def _edges(paths: DataFrame) -> DataFrame:
    """The trie: one row (node, label, child, end) for each edge."""
    p = F.col("path")
    step = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(
        F.get(p, i)["node"].alias("node"),
        _sub(F.col("word"), F.get(p, i)["pos"], F.get(p, i + 1)["pos"] - F.get(p, i)["pos"]).alias("label"),
        F.get(p, i + 1)["node"].alias("child"), F.get(p, i + 1)["end"].alias("stop")))
    return paths.filter(F.size(p) > 1).select(F.inline(step)).distinct()


def _advance(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """One level: every state with every edge of its node that it can take."""
    word, pos, label = F.col("word"), F.col("pos"), F.col("label")
    n, head, fresh = F.length(label), F.substring(label, 1, 1), F.col("edits") == 0
    nxt = _sub(word, pos, F.lit(1))
    rest = F.length(word)

    def state(other, to, edits):
        return F.struct(other.alias("other"), to.alias("pos"), edits.cast("int").alias("edits"))
    same = F.when(label == _sub(word, pos, n), state(F.col("other"), pos + n, F.col("edits")))
    replaced = F.when(fresh & (head > nxt) & (_sub(label, F.lit(1), n) == _sub(word, pos + 1, n - 1)),
                      state(F.concat(_sub(word, F.lit(0), pos), head, _sub(word, pos + 1, rest)), pos + n, F.lit(1)))
    gone = F.when(fresh & (head != nxt) & (label == _sub(word, pos + 1, n)),
                  state(F.concat(_sub(word, F.lit(0), pos), _sub(word, pos + 1, rest)), pos + 1 + n, F.lit(1)))
    takes = F.filter(F.array(same, replaced, gone), lambda s: s.isNotNull())
    return (frontier.join(edges, (F.col("node") == F.col("at")) & (fresh | (head == nxt)))
            .select("rev", "word", F.col("child").alias("at"), F.col("stop").alias("end"), F.inline(takes)))


def neighbours(vocab: DataFrame, scratch: Scratch) -> DataFrame:
    """``vocab`` (id, word) to the pairs (word, other) that are one edit apart, each both ways."""
    paths = _paths(vocab, scratch)
    edges = scratch.keep(_edges(paths))
    first = F.get("path", F.lit(0))
    frontier = scratch.keep(paths.select("rev", "word", first["node"].alias("at"), first["end"].alias("end"), F.col("word").alias("other"),
                                         first["pos"].alias("pos"), F.lit(0).alias("edits")))
    found, done = [], [paths, edges]
    ends = F.col("pos") == F.length("word")
    while True:
        done.append(frontier)
        # the last code point goes where a word ends before it
        last = (F.col("edits") == 0) & (F.col("pos") == F.length("word") - 1) & F.col("end")
        found.append(frontier.filter(ends & F.col("end") & (F.col("edits") == 1) | last).select(
            "rev", "word", F.when(last, _sub(F.col("word"), F.lit(0), F.length("word") - 1)).otherwise(F.col("other")).alias("other")))
        open_states = frontier.filter(~ends)
        if open_states.isEmpty():
            break
        frontier = scratch.keep(_advance(open_states, edges))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    turn = lambda c: F.when(F.col("rev"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    pairs = pairs.select(turn("word"), turn("other"))
    out = scratch.keep(pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct())
    scratch.free(*done)
    return out


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``forms`` (word, form) to (word, root): the last word reached by following forms, by pointer doubling.

    A form occurs at least twice as often as its word, so chains end and have at most 63 steps.
    """
    cur = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        on = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = scratch.keep(cur.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.free(cur)
        cur = nxt
        if cur.filter("moved").isEmpty():
            return cur.select("word", "root")


def spelling_variants(docs: DataFrame, slip: int = SLIP, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """One row per word of the table: word, form, root, n, n_near, form_n.

    Words are the lower-cased (A-Z only) runs of Latin letters of all texts; a run whose crc32 with its doc_id is
    divided by ``slip`` loses a code point first; then words of ``letters`` code points and ``least`` occurrences count.
    ``form`` is the most frequent near word (ties: the least), if it is at least twice as frequent.

    Null and empty texts hold no words; a null doc_id is written as nothing before the colon; repeated rows count
    again; other columns are ignored; an empty table gives an empty table.  A word may be of any length.
    """
    sc = Scratch(docs.sparkSession)
    vocab = sc.keep(word_counts(docs, slip, letters).filter(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    pairs = neighbours(vocab, sc)
    count = vocab.select("word", "n")
    near = (pairs.join(count.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
            .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("best")))
    formed = sc.keep(count.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best.w")).alias("form"),
        F.when(-F.col("best.m") >= 2 * F.col("n"), -F.col("best.m")).alias("form_n")))
    sc.free(pairs)
    root = roots(formed.filter("form is not null"), sc)
    return formed.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 over UTF-8 bytes (all code points here are below U+0100), then near words by deletion keys
ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
b AS (
  SELECT run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS bytes
  FROM d),
h AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM b, tab),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
k AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT k.word, v.word AS other FROM k JOIN v ON k.cut = v.word
  UNION SELECT v.word, k.word FROM k JOIN v ON k.cut = v.word
  UNION SELECT a.word, b.word FROM k a JOIN k b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word),
m AS (
  SELECT p.word, count(*) AS n_near, first(p.other ORDER BY v.n DESC, p.other) AS best, max(v.n) AS best_n
  FROM p JOIN v ON p.other = v.word GROUP BY p.word),
f AS (
  SELECT v.word, v.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN m ON v.word = m.word),
g AS (SELECT word, word AS top, 0 AS d FROM f UNION ALL SELECT g.word, f.form, g.d + 1 FROM g JOIN f ON g.top = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(top, d) AS root FROM g GROUP BY word)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word
"""


@query("op13_spelling_variants", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return spelling_variants(read(spark, sf_dir, "documents"))
