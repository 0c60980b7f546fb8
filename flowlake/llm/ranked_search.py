"""Ranked lexical search of all documents for many items at once, by a hybrid of two traversals.

Method.  Documents are dealt over tasks; each keeps inverted lists of its documents for the items' terms.
An item's short lists are merged term at a time: their scores are summed into accumulators, one sorted list with the
greatest sum as its bound.  That list then is one more iterator beside the long lists in a document-at-a-time pass.
Iterators are ordered by their bounds.  Documents that occur only in iterators whose bounds together stay below the
score of the item's 20th best so far can't enter the result and are skipped.  The others are taken in runs of
document order: long lists are probed at these documents alone, the one with the greatest bound first, and a document
leaves as soon as its score and the bounds to come stay below the 20th best.

Statistics (documents, terms, document frequencies) count the whole table first.  Every part of the documents keeps
its own best rows of each item, and the best of these are the result; a first part gives
all others a score that the 20th best can't fall below.  Scores are integers, so sums don't depend on the order.

Items are taken in blocks of ``BLOCK_TERMS`` terms, whose vocabulary is sent to the tasks; a block reads the documents
once.  Terms are compared by 64-bit hashes; two terms of one block with one hash are told apart by an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.llm import words as W
from flowlake.llm.common import Scratch, own_columns, query, read

TOP = 20
BLOCK_TERMS = 500_000           # rows (item, term) of one block
POSTINGS = 4_000_000            # postings that a task inverts at a time
SHORT = 1 / 32                  # a list is short below this share of the documents at hand
RUN = 2048                      # documents of one step
SCALE, SHIFT, LENGTH = 1_000_000_000, 12, 25


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times), one row for each item and term."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (own_columns(items, "item_id", "text")
            .select("item_id", F.explode(F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("times")))


class Block:
    """The items of one block: their vocabulary by hash and their terms with repeats."""

    def __init__(self, rows: list[tuple[object, str, int]]):
        counted: dict[object, dict[bytes, int]] = {}
        for item, term, times in rows:
            counted.setdefault(item, {})[term.encode()] = times
        self.items = list(counted)
        vocab = sorted(set().union(*counted.values()))
        flat = np.frombuffer(b"".join(vocab), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in vocab], dtype=np.int64)
        h = W.hashes(flat, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if vocab else np.zeros(0, np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of a block have one hash; take smaller blocks")
        number = {t: i for i, t in enumerate(vocab)}
        self.n_terms = len(vocab)
        self.queries = [(np.array([number[t] for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counted.values()]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words of no item."""
        if not self.n_terms:
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), self.n_terms - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)


def forward_lists(docs: DataFrame, block) -> DataFrame:
    """(doc_id, n, terms, tfs): the length of each document and the items' terms in it. ``block`` is a broadcast :class:`Block`."""
    def run(batches):
        b = block.value
        for batch in batches:
            for first, data, offs in W.slices(batch.column(1)):
                low = W.LOWER[data]
                s, e, at = W.spans(low, offs, W.ALNUM)
                term = b.find(W.hashes(low, s, e))
                row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
                key, tf = np.unique((row * max(b.n_terms, 1) + term)[term >= 0], return_counts=True)
                begins = np.searchsorted(key, np.arange(len(offs)) * max(b.n_terms, 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(offs) - 1), pa.array(np.diff(at).astype(np.int64)),
                     pa.ListArray.from_arrays(begins, pa.array((key % max(b.n_terms, 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(begins, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tfs"])
    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The best rows of one item so far, in order, and the score that a row must reach to matter."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor = top, max(floor, 1)
        self.score = self.none = self.doc = np.zeros(0, dtype=np.int64)

    def add(self, doc: np.ndarray, none: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.floor
        if not ok.any():
            return
        doc, none, score = (np.concatenate(x) for x in ((self.doc, doc[ok]), (self.none, none[ok]), (self.score, score[ok])))
        first = np.lexsort((doc, none, -score))[:self.top]
        self.doc, self.none, self.score = doc[first], none[first], score[first]
        if len(first) == self.top:
            self.floor = max(self.floor, int(self.score[-1]))


class Part:
    """Inverted lists of the documents at hand."""

    def __init__(self, doc, none, length, doc_of, term, tf, weights, n_docs: int, n_words: int):
        by = np.lexsort((doc, none))                # rows in document order
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        self.doc, self.none = doc[by], none[by]
        m = 100 - LENGTH + (LENGTH * length * n_docs) // max(n_words, 1)
        score = (SCALE * tf) // (1000 * tf + SHIFT * m[doc_of]) * weights[term]
        at = place[doc_of]
        order = np.lexsort((at, term))
        self.at, self.score = at[order], score[order]
        self.begin = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        n = len(self.doc)
        lists = [(self.at[a:b], self.score[a:b] * q) for t, q in zip(terms, times, strict=True) if (b := self.begin[t + 1]) > (a := self.begin[t])]
        short = [x for x in lists if len(x[0]) <= max(n * SHORT, 1)]
        iters = [(int(s.max()), at, s) for at, s in lists if len(at) > max(n * SHORT, 1)]
        if short:                                   # term at a time
            at, back = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
            s = np.zeros(len(at), dtype=np.int64)
            np.add.at(s, back, np.concatenate([x[1] for x in short]))
            iters.append((int(s.max()), at, s))
        iters.sort(key=lambda x: -x[0])
        below = np.cumsum([x[0] for x in iters][::-1])[::-1].tolist() + [0]        # the bounds from each iterator on
        lo = 0
        while lo < n:                               # document at a time, in runs
            # iterators whose bounds alone stay below the floor name no documents
            lead = next((i for i in range(len(iters)) if below[i] < best.floor), len(iters))
            if not lead:
                return
            # the next run of documents that a leading iterator holds
            heads = [at[(i := np.searchsorted(at, lo)):i + RUN] for _, at, _ in iters[:lead]]
            cut = min((int(h[-1]) + 1 for h in heads if len(h) == RUN), default=n)
            at = np.unique(np.concatenate([h[h < cut] for h in heads]))
            total = np.zeros(len(at), dtype=np.int64)
            for k, (_, where, s) in enumerate(iters):
                ok = total + below[k] >= best.floor
                at, total = at[ok], total[ok]
                if not len(at):
                    break
                j = np.minimum(np.searchsorted(where, at), len(where) - 1)
                total += np.where(where[j] == at, s[j], 0)
            best.add(self.doc[at], self.none[at], total)
            lo = cut


def search_lists(lists: DataFrame, block, weights, n_docs: int, n_words: int, floors, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): the best rows of each item in each task's documents."""
    def run(batches):
        b, w, floor = block.value, weights.value, floors.value if floors is not None else {}
        bests = [Best(top, floor.get(i, 1)) for i in range(len(b.queries))]
        held: list[pa.RecordBatch] = []
        size = 0

        def work():
            t = pa.Table.from_batches(held)
            ids, terms = t["doc_id"].combine_chunks(), t["terms"].combine_chunks()
            counts = np.diff(terms.offsets.to_numpy())
            part = Part(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), t["n"].to_numpy(),
                        np.repeat(np.arange(len(ids)), counts), terms.flatten().to_numpy().astype(np.int64),
                        t["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64), w, n_docs, n_words)
            for (q, times), best in zip(b.queries, bests, strict=True):
                part.search(q, times, best)
            held.clear()
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= POSTINGS:
                work()
                size = 0
        if held:
            work()
        item = np.repeat(np.arange(len(bests)), [len(x.doc) for x in bests])
        doc, none, score = (np.concatenate([getattr(x, c) for x in bests] or [np.zeros(0, np.int64)]) for c in ("doc", "none", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=none.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])
    return lists.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """For each item the ``top`` documents of the greatest score above 0: item_id, rank, doc_id, score.

    ``docs`` have doc_id and text, ``items`` item_id and text; other columns are ignored.  Null, empty and wordless texts
    have no terms: such documents count nowhere, such items have no rows.  Rows that share an item_id (null
    included) are one item with the terms of all.  Every document row stands for itself, also if its doc_id repeats;
    equal scores go by doc_id, a null one last.  Empty tables give an empty table.
    """
    spark = docs.sparkSession
    sc = Scratch(spark)
    docs = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = sc.keep(item_terms(items))
    n_blocks = max(1, math.ceil(asked.count() / block_terms))
    out = None
    for k in range(n_blocks):
        block = Block([tuple(r) for r in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()])
        sent = spark.sparkContext.broadcast(block)
        lists = sc.keep(forward_lists(docs, sent))
        n_docs, n_words = lists.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(block.n_terms)
        for r in lists.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect():
            df[r["t"]] = r["c"]
        weights = spark.sparkContext.broadcast(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64))
        # the documents of one file give all others a floor
        file = F.col("_metadata.file_name")
        first = min((f.rsplit("/", 1)[-1] for f in lists.inputFiles()), default="")
        head = sc.keep(_ranked(search_lists(lists.filter(file == first), sent, weights, n_docs, n_words, None, top), top))
        floors = spark.sparkContext.broadcast(
            {r["item"]: r["score"] for r in head.filter(F.col("rank") == top).select("item", "score").collect()})
        rest = search_lists(lists.filter(file != first), sent, weights, n_docs, n_words, floors, top)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = sc.keep(_ranked(head.drop("rank").unionByName(rest), top).join(F.broadcast(names), "item")
                       .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        out = part if out is None else out.unionByName(part)
        sc.free(lists, head)
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS nw FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
q AS (
  SELECT item_id, t, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, nd),
s AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nw))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), g GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""


@query("op11_ranked_search", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
