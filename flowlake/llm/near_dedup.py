"""Near-duplicate documents from bottom-k sketches of one hash function.

Method.  A document's set is its distinct 3-word shingles.  Texts with one
set form a class, so exact copies never meet again.  Each class keeps its
``k`` smallest shingle hashes, its bottom-k sketch.  Values of a sketch that
occur in two sketches or more go to inverted lists; lists that share a pair of
classes generate the pair, an estimate over the union's sketch drops pairs far
below the threshold, and the Jaccard of the full sets confirms the rest.

Lists stay short without a cap.  Linked sets (Jaccard >= t) share at least
half of their sketch values but for a chance below 1e-6 a pair at k = 32
(each of the k least values of the union lies in both sets with probability
>= t = 0.85).  So the sketch is ordered by rarity, and only its first
floor(k/2) + 1 values are indexed: two sketches that share half their values
share one of those.  A passage that many documents share is a frequent value
and leaves the index unless it makes up about half a document.

Long lists (groups of copies) don't emit all pairs.  A set can only be linked
if 85 % of its shingles occur in another candidate's set, so candidates with
more shingles of their own leave first (in a group of edited copies, the heavily
edited ones).  Then every member is compared with three leaders of its list
only, the member with the smallest share of own shingles and two at random,
and components are formed.
Lists whose members are then in one component are done.  What remains, members
of different components in one list, is compared exactly: short lists by a
join, long ones block by block, each block pair in a task of its own, with the
sketch estimate taken inside the task.  No pair is dropped for the length of
a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import words as W
from flowlake.llm.common import Scratch, own_columns, query, read
from flowlake.llm.components import components

K, THRESHOLD = 32, 85           # indexed sketch size; percent of the union
K_PAIR = 256                    # sketch size of the estimate
BLOCK, SHORT = 1024, 64         # members of a list in one block; lists compared by a join


def _per_text(batches: Iterator[pa.RecordBatch], n_words: int, make) -> Iterator[list]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for first, data, offs in W.slices(batch.column(1)):
            low = W.LOWER[data]
            s, e, at = W.spans(low, offs, W.SOLID)
            h = W.hashes(low, s, e)
            for i in range(len(offs) - 1):
                rows.append(make(W.shingles(h[at[i]: at[i + 1]], n_words)))
        yield ids, rows


def sketches(docs: DataFrame, k: int = K, n_words: int = 3) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, fp, sketch); ``fp`` names the set."""
    def run(batches):
        def make(u):
            return len(u), hashlib.blake2b(u.tobytes(), digest_size=16).digest(), u[:k]
        for ids, rows in _per_text(batches, n_words, make):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp", "sketch"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp binary, sketch array<long>")


def shingle_sets(docs: DataFrame, n_words: int = 3) -> DataFrame:
    """(node, text) to (node, shingles): the whole sets."""
    def run(batches):
        for ids, rows in _per_text(batches, n_words, lambda u: u):
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.int64()))], ["node", "shingles"])
    return docs.mapInArrow(run, "node long, shingles array<long>")


def _index(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Inverted lists as rows (value, node): the rarest half of each sketch, values of two sketches or more."""
    posts = reps.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    freq = posts.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    held = (posts.join(freq, "value").groupBy("node")
            .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"), F.first("s").alias("s")))
    # values of one sketch only are the rarest: they take their places in the prefix first
    room = F.floor(F.col("s") / 2) + 1 - (F.col("s") - F.size("v"))
    held = held.select("node", F.explode(F.slice("v", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("x")) \
        .select("node", F.col("x.value").alias("value"))
    return scratch.keep(held)


def _sizes_fit(a: Column, b: Column, t: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * t


def _estimated(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) whose sizes fit and whose union sketch (``K_PAIR`` values) is shared enough.

    Of s values of a union sketch at least t s are shared on average if the pair is linked;
    the bar is 4.9 standard deviations below.  A union of fewer values is whole, and the bar exact.
    Sets are sorted, so a sketch is their beginning.
    """
    sk = lambda n: sets.select(F.col("node").alias(n), F.size("shingles").alias(f"n{n}"),
                               F.slice("shingles", 1, K_PAIR).alias(f"s{n}"))
    q = t / 100
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K_PAIR)
    return (pairs.join(sk("a"), "a").join(sk("b"), "b").filter(_sizes_fit(F.col("na"), F.col("nb"), t))
            .withColumn("u", union)
            .withColumn("i", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))))
            .filter(F.when(F.size("u") < K_PAIR, F.col("i") * 100 >= F.size("u") * t)
                    .otherwise(F.col("i") >= q * F.size("u") - 4.9 * F.sqrt(q * (1 - q) * F.size("u"))))
            .select("a", "b"))


def _viable(sets: DataFrame, t: int) -> DataFrame:
    """(node, own, lo, hi): nodes that share enough shingles with other nodes to be linked, their
    share of own ones, and their set sizes (two if texts share a doc_id)."""
    rows = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    common = rows.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1").select("value")
    return (rows.join(common, "value").groupBy("node", "n").agg(F.count("*").alias("c"))
            .filter(F.col("c") * 100 >= F.col("n") * t)
            .groupBy("node").agg(F.min(1 - F.col("c") / F.col("n")).alias("own"), F.min("n").alias("lo"), F.max("n").alias("hi")))


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    j = pairs.join(sa, "a").join(sb, "b").withColumn("i", F.size(F.array_intersect("xa", "xb")))
    return j.filter(F.col("i") * 100 >= (F.size("xa") + F.size("xb") - F.col("i")) * t).select("a", "b")


def _shared(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right value lists, by products of 0/1 matrices."""
    def flat(x):
        return (np.concatenate(x) if x else np.zeros(0, np.int64)), np.repeat(np.arange(len(x)), [len(v) for v in x])
    (lv, li), (rv, ri) = flat(left), flat(right)
    vals = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for i in range(0, len(vals), step):
        part = vals[i:i + step]
        m = []
        for v, r, n in ((lv, li, len(left)), (rv, ri, len(right))):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            ok = part[at] == v
            one = np.zeros((n, len(part)), dtype=np.float32)
            one[r[ok], at[ok]] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def _block_pairs(rows: DataFrame, t: int) -> DataFrame:
    """Pairs of different components in long lists, compared in tasks of two blocks at most.

    A pair that shares several long lists is compared in the first of them.
    """
    q = t / 100

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj, value = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0]), int(pdf["value"].iloc[0])
        x, y = pdf[pdf["blk"] == bi], pdf[pdf["blk"] == bj]
        arr = lambda d, c: d[c].to_numpy()
        ok = (arr(x, "comp")[:, None] != arr(y, "comp")[None, :])
        ok &= (arr(x, "hi")[:, None] * 100 >= t * arr(y, "lo")[None, :]) & (arr(y, "hi")[None, :] * 100 >= t * arr(x, "lo")[:, None])
        if bi == bj:
            ok &= arr(x, "node")[:, None] < arr(y, "node")[None, :]
        first = [[v[v < value] for v in d["lists"]] for d in (x, y)]
        ok &= _shared(*first) == 0
        r, c = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        a = b = np.zeros(0, np.int64)
        if len(r):
            sx, sy = [arr(x, "sketch")[i] for i in r], [arr(y, "sketch")[i] for i in c]
            nx, ny = np.array([len(s) for s in sx])[:, None], np.array([len(s) for s in sy])[None, :]
            both, u = _shared(sx, sy), np.maximum(nx, ny)
            whole = np.maximum(nx, ny) < K_PAIR         # then the sketches are the sets
            bar = np.where(whole, (nx + ny - both) * t / 100 - 1e-6, q * u - 4.9 * np.sqrt(q * (1 - q) * u))
            i, j = np.nonzero(ok[np.ix_(r, c)] & (both >= bar))
            a, b = arr(x, "node")[r[i]], arr(y, "node")[c[j]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64")
    blk = F.pmod(F.xxhash64("node"), F.col("nb"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    rows = (rows.withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("long")).withColumn("blk", blk)
            .withColumn("o", other)
            .withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")))
    return rows.groupBy("value", "bi", "bj").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = K, threshold: int = THRESHOLD, n_words: int = 3) -> DataFrame:
    """Classes and components of near-duplicate texts.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row
    for each input row: doc_id, n_shingles, component_id (least doc_id reachable
    over links with 100 * |A and B| >= threshold * |A or B|), kept.

    A null or wordless text has an empty set and links with nothing.  Rows that
    repeat a doc_id are one node: a link of any of their texts is a link of
    all.  A row without doc_id takes no part: component_id null, kept true.
    Repeated texts fall into one class.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    sc = Scratch(spark)
    docs = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sk = sc.keep(sketches(docs, k, n_words))
    part = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = part.groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("r"))
    classes = sc.keep(classes.select("fp", F.col("r.doc_id").alias("node"), F.col("r.n_shingles").alias("n"),
                                     F.col("r.sketch").alias("sketch")))
    lists = _index(classes, sc)
    near = lists.select("node").distinct()
    sets = sc.keep(shingle_sets(
        docs.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("node"), "text"), n_words).distinct())
    # a repeated doc_id has one class row and one set for each of its texts

    # leaders: three members of each list stand for it
    viable = sc.keep(_viable(sets, threshold))
    index = sc.keep(lists.join(viable, "node"))
    lead = index.groupBy("value").agg(
        F.count("*").alias("c"),
        F.array_distinct(F.array(F.min_by("node", F.struct("own", "node")), F.min_by("node", F.xxhash64("node", F.lit(1))),
                                 F.min_by("node", F.xxhash64("node", F.lit(2))))).alias("l"))
    lead = lead.filter("c > 1")
    star = (index.join(lead.select("value", F.explode("l").alias("lead")), "value").filter("node <> lead")
            .select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    # a doc_id with several texts ties their classes together
    twice = part.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    tied = part.join(twice, "doc_id").select("doc_id", "fp").join(classes.select("fp", "node"), "fp").select("doc_id", "node").distinct()
    tied = tied.join(tied.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")
    links = sc.keep(_verified(_estimated(star, sets, threshold), sets, threshold).unionByName(tied))
    comp = sc.keep(components(links, sc))

    # lists that still hold several components
    held = sc.keep(index.drop("own").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mixed = held.groupBy("value").agg(F.count("*").alias("c"), F.min("comp").alias("least"), F.max("comp").alias("most")) \
        .filter("least < most").select("value", "c")
    rows = sc.keep(held.join(mixed, "value"))
    low = rows.filter(F.col("c") <= SHORT)
    side = lambda n: low.select("value", F.col("node").alias(n), F.col("comp").alias(f"c{n}"),
                                F.col("lo").alias(f"lo{n}"), F.col("hi").alias(f"hi{n}"))
    rest = (side("a").join(side("b"), "value").filter("a < b and ca <> cb")
            .filter((F.col("hia") * 100 >= F.col("lob") * threshold) & (F.col("hib") * 100 >= F.col("loa") * threshold))
            .select("a", "b"))
    high = rows.filter(F.col("c") > SHORT)
    own_lists = high.groupBy("node").agg(F.collect_list("value").alias("lists"))  # at most k / 2 + 1 values
    sketch = sets.select("node", F.slice("shingles", 1, K_PAIR).alias("sketch"))
    rest = rest.unionByName(_block_pairs(high.join(own_lists, "node").join(sketch, "node"), threshold)).distinct()
    more = sc.keep(_verified(_estimated(rest, sets, threshold), sets, threshold))
    comp = sc.keep(components(links.unionByName(more), sc))

    label = classes.join(comp, "node", "left").select(
        "fp", F.coalesce("comp", "node").alias("component_id"))
    out = sk.join(label, "fp", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNull(), None).otherwise(
            F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))))
    out = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    sc.free(lists, sets, viable, index, held, rows, links, more)
    return out


def _own_numbers(one: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``one`` (doc_id, __text, ...; distinct texts of repeated ids) with ``__node``, a number of its own for each row.

    The least text of an id keeps the id.  The others get a 64-bit hash of id and text, with the first salt
    whose hashes meet neither each other nor an id; this is counted, not assumed.
    """
    least = one.groupBy("doc_id").agg(F.min("__text").alias("__least"))
    one = scratch.keep(one.join(least, "doc_id"))
    salt = 0
    while True:
        node = F.when(F.col("__text") == F.col("__least"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "__text", F.lit(salt)))
        out = one.withColumn("__node", node)
        made = out.filter("__text <> __least").select("__node")
        met = made.groupBy("__node").agg(F.count("*").alias("c")).join(ids.withColumnRenamed("doc_id", "__node").withColumn("held", F.lit(True)), "__node", "left")
        if met.filter("c > 1 or held").isEmpty():
            return out.drop("__least")
        salt += 1


def drop_near_duplicates(docs: DataFrame, k: int = K, threshold: int = THRESHOLD, n_words: int = 3) -> DataFrame:
    """The documents with their own columns, one of each component of near-duplicate texts.

    The one with the least doc_id stays.  Rows that share a doc_id are judged by their texts: each distinct text is
    a document of its own, so that an unrelated text stays and an equal one goes; rows without words
    under one id count as one text.  Of rows with one id and one text the least stays, also after a rerun.
    Further texts of an id stand in the order of a hash, not of the id.  Rows without doc_id stay.  An empty table
    gives none.
    """
    sc = Scratch(docs.sparkSession)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    ids = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("__n"))
    twice = sc.keep(ids.filter("__n > 1").select("doc_id"))
    shared = docs.join(twice, "doc_id", "left_semi")
    alone = docs.join(twice, "doc_id", "left_anti").select(*cols)
    text = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "").otherwise(F.col("text"))
    one = (shared.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("__text"), F.struct(*cols).alias("__row"))
           .groupBy("doc_id", "__text").agg(F.min("__row").alias("__row")))
    one = sc.keep(_own_numbers(one, ids.select("doc_id"), sc))
    texts = alone.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(
        one.select(F.col("__node").alias("doc_id"), F.col("__text").alias("text")))
    gone = sc.keep(near_duplicates(texts, k, threshold, n_words).filter("not kept").select("doc_id"))
    rest = one.join(gone.withColumnRenamed("doc_id", "__node"), "__node", "left_anti")
    return alone.join(gone, "doc_id", "left_anti").select(*cols).unionByName(
        rest.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT sh, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
m AS (SELECT s.doc_id, c.rep FROM s JOIN c ON list_sort(s.sh) = c.sh WHERE len(s.sh) > 0),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS v FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.v = b.v AND a.rep < b.rep
        AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS comp FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(k.comp, n.doc_id) AS component_id, n.doc_id = coalesce(k.comp, n.doc_id) AS kept
FROM n LEFT JOIN m ON n.doc_id = m.doc_id LEFT JOIN k ON m.rep = k.a
"""


@query("op10_minhash_near_dedup", ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))
