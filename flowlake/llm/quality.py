"""Quality classifier: document evidence combined with empirical Bayes posteriors of its host and path.

Method.  A document classifier, fitted on a bounded sample of labelled rows
(``max_labels``), turns each whole text into log-odds of being unwanted (low
quality or toxic).  Grouped aggregation of those probabilities over hosts and
over paths within hosts gives site rates.  Host rates are shrunk towards the
global rate and path rates towards their host's posterior, each with a Beta
prior whose strength is estimated from the spread between sites (method of
moments), so a sparse site says little and a large one speaks for itself.  A
document's final log-odds are its own evidence plus what its path's posterior
(without the document itself) says beyond the global rate.

Hosts may be hot: the sums are partially aggregated before the shuffle, and the
site table, one row per path, is joined back (broadcast by Spark when its
written size is small).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm import words as W
from flowlake.llm.common import Scratch, others, own_columns, query, read, small_side

MAX_LABELS = 20_000             # labelled rows used to fit, at most (least hashes of doc_id)
MAX_LEXICON = 500               # words kept as evidence
MIN_COUNT = 5                   # labelled documents a word must occur in
N_FEATURES = 8
#: least spread by which each feature is scaled: labelled rows that hardly differ in one must not make it decisive
LEAST_SCALE = np.array([0.5, 0.5, 0.002, 0.02, 0.02, 0.02, 0.3, 0.5])
MAX_STRENGTH = 1e6              # of a Beta prior, where sites do not differ


@dataclass
class Model:
    """Lexicon (hashes with log-odds) and a logistic regression over text features."""

    lex: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    coef: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    bias: float = -20.0         # without labels of both classes nothing is rejected

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scaled(x) @ self.coef + self.bias, -30, 30)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def _hashed(data: np.ndarray, offs: np.ndarray):
    low = W.LOWER[data]
    s, e, at = W.spans(low, offs, W.ALNUM)
    return low, s, e, at, W.hashes(low, s, e)


def features(col: pa.Array, lex: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers per whole text: strongest and summed
    lexicon evidence, its share, vocabulary, repetition, symbols, word length, size."""
    out = np.zeros((len(col), N_FEATURES))
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(lex >> np.uint64(48)).astype(np.int64)] = True
    for first, data, offs in W.slices(col):
        low, s, e, at, h = _hashed(data, offs)
        n = np.diff(at)
        k = len(n)
        hit = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
        if len(hit):
            i = np.minimum(np.searchsorted(lex, h[hit]), len(lex) - 1)
            same = lex[i] == h[hit]
            hit, w = hit[same], weight[i[same]]
        else:
            w = np.zeros(0)
        row = np.searchsorted(at, hit, side="right") - 1
        top, total, cnt = np.zeros(k), np.zeros(k), np.zeros(k)
        np.maximum.at(top, row, w)
        np.add.at(total, row, w)
        np.add.at(cnt, row, 1)
        kinds = np.array([len(np.unique(h[at[i]:at[i + 1]])) for i in range(k)])
        again = np.zeros(len(h) + 1, dtype=np.int64)
        if len(h) > 1:
            same = h[1:] == h[:-1]
            cut = at[(at > 0) & (at < len(h))]
            same[cut - 1] = False
            again[2:] = np.cumsum(same)
        odd = np.concatenate([[0], np.cumsum(~W.ALNUM[low] & W.SOLID[low])])
        chars = np.concatenate([[0], np.cumsum(e - s)])
        m, size = np.maximum(n, 1), np.maximum(np.diff(offs), 1)
        out[first: first + k] = np.column_stack([
            top, np.log1p(total), cnt / m, np.log1p(kinds) / np.log1p(m), (again[at[1:]] - again[at[:-1]]) / m,
            np.diff(odd[offs]) / size, (chars[at[1:]] - chars[at[:-1]]) / m, np.log1p(n)])
    return out


def labelled_sample(labels: DataFrame, docs: DataFrame, max_labels: int, scratch: Scratch) -> DataFrame:
    """(text, bad, part): at most ``max_labels`` labelled rows.  bad: quality 0 or toxic 1;
    a row with both labels null is not labelled; the worst of repeated labels counts."""
    lab = (own_columns(labels, "doc_id", "quality", "toxic")
           .filter("doc_id is not null and (quality is not null or toxic is not null)")
           .groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    lab = scratch.keep(lab)
    got = own_columns(docs, "doc_id", "text").join(lab, "doc_id")
    return scratch.keep(got.select("text", "bad", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).alias("part")))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, bad, docs): labelled documents that hold each word, pre-summed in each batch."""
    def run(batches):
        for batch in batches:
            bad = batch.column(1).to_numpy(zero_copy_only=False)
            found = []
            for first, data, offs in W.slices(batch.column(0)):
                _, _, _, at, h = _hashed(data, offs)
                for i in range(len(offs) - 1):
                    u = np.unique(h[at[i]:at[i + 1]])
                    found.append(np.column_stack([u.view(np.int64), np.full(len(u), bad[first + i])]))
            if found:
                u, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(n)], ["word", "bad", "n"])
    got = sample.select("text", F.col("bad").cast("long").alias("bad")).mapInArrow(run, "word long, bad long, n long")
    return got.groupBy("word").agg(F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("pos"),
                                   F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("neg"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps with a ridge; the last coefficient is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    pen = ridge * len(x) * np.eye(x.shape[1])
    pen[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + pen @ b
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + pen + 1e-9 * np.eye(len(b)), g)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(labels: DataFrame, docs: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Fit on a bounded labelled sample: one half finds the lexicon, the other the regression."""
    sc = Scratch(docs.sparkSession)
    sample = labelled_sample(labels, docs, max_labels, sc)
    n = {(r["part"], r["bad"]): r["n"] for r in sample.groupBy("part", "bad").agg(F.count("*").alias("n")).collect()}
    m = Model()
    if min((n.get((p, b), 0) for p in (0, 1) for b in (0, 1)), default=0) < 2:
        return m
    pos, neg = n[0, 1], n[0, 0]
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    lex = (_word_counts(sample.filter("part = 0")).filter(F.col("pos") >= MIN_COUNT).withColumn("w", odds)
           .filter(F.col("w") > 1.5).orderBy(F.desc(F.col("w") * F.sqrt("pos")), "word")
           .select("word", "w").limit(MAX_LEXICON).collect())
    order = np.argsort(np.array([r["word"] for r in lex], dtype=np.int64).view(np.uint64), kind="stable")
    m.lex = np.array([r["word"] for r in lex], dtype=np.int64).view(np.uint64)[order]
    m.weight = np.array([r["w"] for r in lex], dtype=float)[order]
    lx, wt = m.lex, m.weight

    def run(batches):
        for batch in batches:
            x = features(batch.column(0), lx, wt)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "bad"])
    rows = sample.filter("part = 1").select("text", "bad").mapInArrow(run, "x array<double>, bad int").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["bad"] for r in rows], dtype=float)
    order = np.lexsort(np.column_stack([x, y]).T)     # row order must not change the last digits
    x, y = x[order], y[order]
    m.mean, m.scale = x.mean(axis=0), np.maximum(x.std(axis=0), LEAST_SCALE)
    b = _logistic(m.scaled(x), y)
    m.coef, m.bias = b[:-1], float(b[-1])
    return m


def with_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``__z``, the log-odds that the text is unwanted (rounded to 1e-6)."""
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("__z", T.DoubleType())])

    def run(batches):
        for batch in batches:
            z = np.round(model.evidence(features(batch.column(at), model.lex, model.weight)), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], [*names, "__z"])
    return docs.mapInArrow(run, schema)


def _p(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(rows: DataFrame, n: str, rate: Column, prior: Column) -> float:
    """Beta prior strength by moments: the spread of site rates beyond what their sizes explain."""
    r = rows.select(F.col(n).cast("double").alias("n"), rate.alias("r"), prior.alias("q")).filter("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("r") - F.col("q")) ** 2).alias("ss"),
        F.sum(F.col("q") * (1 - F.col("q"))).alias("v"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["k"] or r["k"] < 2:
        return MAX_STRENGTH
    var = r["v"] / r["k"]
    room = r["n"] - r["nn"] / r["n"]
    between = (r["ss"] - (r["k"] - 1) * var) / room if room > 0 else 0.0
    return float(min(MAX_STRENGTH, max(1.0, var / between - 1))) if between > 0 else MAX_STRENGTH


def sites(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, float]:
    """Per path: sums and the host's posterior; the global rate; the path prior's strength."""
    path = scratch.keep(scored.groupBy("__host", "__path").agg(F.count("*").alias("__n_p"), F.sum(_p(F.col("__z"))).alias("__s_p")))
    host = path.groupBy("__host").agg(F.sum("__n_p").alias("__n_h"), F.sum("__s_p").alias("__s_h"))
    g = path.agg(F.sum("__n_p").alias("n"), F.sum("__s_p").alias("s")).first()
    rate = min(max((g["s"] or 0.0) / g["n"], 1e-6), 1 - 1e-6) if g["n"] else 0.5
    k_host = _strength(host, "__n_h", F.col("__s_h") / F.col("__n_h"), F.lit(rate))
    host = host.withColumn("__q_h", (F.col("__s_h") + k_host * rate) / (F.col("__n_h") + k_host))
    both = path.join(host, path["__host"].eqNullSafe(host["__host"])).drop(host["__host"])
    k_path = _strength(both, "__n_p", F.col("__s_p") / F.col("__n_p"), F.col("__q_h"))
    return scratch.keep(both.select("__host", "__path", "__n_p", "__s_p", "__q_h")), rate, k_path


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             threshold: float = 0.5, max_labels: int = MAX_LABELS) -> DataFrame:
    """All columns of ``docs`` and evidence, site_rate, score, keep.

    ``host`` and ``path`` name a row's site; by default ``source`` and ``lang``,
    since the documents carry no URL.  Null sites form a site of their own.
    Null and empty texts are judged by their features like any text.  Repeated rows are
    judged alike.  An empty table, or one without labels of both classes,
    rejects nothing.  Columns of the input with the names of the new ones are replaced.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(labels, docs, max_labels)
    sc = Scratch(docs.sparkSession)
    narrow = with_evidence(docs.select("text", host.alias("__host"), path.alias("__path")), model).drop("text")
    table, rate, strength = sites(narrow, sc)
    own = with_evidence(docs.withColumns({"__host": host, "__path": path}), model)
    t = small_side(table).select(F.col("__host").alias("__h"), F.col("__path").alias("__q"), "__n_p", "__s_p", "__q_h")
    j = own.join(t, own["__host"].eqNullSafe(t["__h"]) & own["__path"].eqNullSafe(t["__q"]), "left")
    rest = F.col("__n_p") - 1
    post = (F.greatest(F.col("__s_p") - _p(F.col("__z")), F.lit(0.0)) + strength * F.col("__q_h")) / (rest + strength)
    post = F.least(F.greatest(post, F.lit(1e-6)), F.lit(1 - 1e-6))
    j = j.withColumn("__rate", F.round(post, 6))
    shift = F.log(F.col("__rate") / (1 - F.col("__rate"))) - math.log(rate / (1 - rate))
    j = j.withColumn("__score", F.round(_p(F.col("__z") + shift), 6))
    return j.select(*others(docs, "evidence", "site_rate", "score", "keep"), F.col("__z").alias("evidence"),
                    F.col("__rate").alias("site_rate"), F.col("__score").alias("score"), (F.col("__score") < threshold).alias("keep"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posterior, score and decision for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, read(spark, sf_dir, "labels")).drop("text")
