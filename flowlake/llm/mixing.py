"""Mixing sources to target weights by hierarchical budgeting; DataFrame expressions only.

Method.  Leaves of a domain-language-source tree have target weights, which sum
up to their ancestors.  The root's token budget goes down the tree: a node's
children share its budget by weight, none beyond what its leaves can supply in
``max_epochs`` epochs.  What a child cannot take goes to its siblings first
(water filling under one parent); since every node's capacity is the sum below
it, ancestors pass on only what a whole subtree cannot take.  A leaf's budget
is whole epochs of all its documents and then a token-prefix of one more
epoch, whose order is a seeded hash of epoch and document.

Scale.  The tree has one row per leaf, made by partial aggregation.  A leaf may
hold a third of all rows, so its prefix is found without sorting it in one
task: token sums of 4,096 hash ranges first, then only the range in which the
budget ends is ordered.  The result of a leaf is one cut-off hash, so documents
(with their texts) are never sorted or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlake.llm.common import Scratch, others, query, read, small_side

LEVELS = ("domain", "lang", "source")
SEED, SHARE, EPOCHS = "mix-1", 1.0, 2


def n_tokens(text: Column) -> Column:
    """White-space separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The documents carry no domain: sources fall into sixteen by a hash of their names."""
    return F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)


def _name(c: Column) -> Column:
    """A level's value as a key: null becomes '' and any string gets a prefix."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def order_key(epoch: Column, doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), epoch.cast("string"), F.lit(":"),
                          F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Share each parent's ``budget`` among its children (cap, weight): adds ``grant``.

    Children in the order of cap / weight; the first k that can take the level of
    the rest ends the filling.  All sums are whole numbers, so the result doesn't depend on order.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    o = w.orderBy(F.col("cap") / F.col("weight"), "node")
    d = (nodes.withColumn("k", F.row_number().over(o))
         .withColumn("spent", F.coalesce(F.sum("cap").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("left_w", F.sum("weight").over(o.rowsBetween(0, Window.unboundedFollowing))))
    fits = (F.col("budget") - F.col("spent")).cast("double") * F.col("weight") / F.col("left_w") <= F.col("cap")
    d = d.withColumn("stop", F.min(F.when(fits, F.struct("k", "spent", "left_w"))).over(w))
    level = F.floor((F.col("budget") - F.col("stop.spent")).cast("double") * F.col("weight") / F.col("stop.left_w"))
    grant = F.when(F.col("stop").isNull() | (F.col("k") < F.col("stop.k")), F.col("cap")) \
        .otherwise(F.least(F.col("cap"), F.greatest(level, F.lit(0)).cast("long")))
    return d.withColumn("grant", grant).drop("k", "spent", "left_w", "stop")


def budgets(leaves: DataFrame, levels: list[str], share: float, max_epochs: int) -> DataFrame:
    """(levels, supply, weight) per leaf to (levels, supply, grant): top-down water filling."""
    leaves = leaves.withColumn("cap", F.col("supply") * max_epochs)
    total = leaves.agg(F.least(F.floor(F.sum("supply") * F.lit(float(share))), F.sum("cap")).alias("budget"))
    up: DataFrame | None = None
    for i in range(len(levels)):
        key, parent = levels[:i + 1], levels[:i]
        node = leaves.groupBy(*key).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"),
                                        F.sum("supply").alias("supply")).withColumn("node", F.col(levels[i]))
        node = node.join(up, parent) if parent else node.crossJoin(F.broadcast(total))  # one row
        up = _fill(node, parent).select(*key, F.col("grant").alias("budget"), *(["supply"] if key == levels else []))
    return up.withColumnRenamed("budget", "grant")


def plan(rows: DataFrame, levels: list[str], share: float = SHARE, max_epochs: int = EPOCHS, seed: str = SEED,
         targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, levels as keys, tokens) to one row per leaf: supply, grant, full, cut.

    ``full`` epochs are taken whole; of epoch number ``full``, the documents whose
    order key is at most ``cut`` (null: none).  Default weights are the
    square roots of the supplies, which lifts small leaves; ``targets`` (levels,
    weight) replaces them, and a leaf it doesn't name gets none.
    """
    sc = Scratch(rows.sparkSession)
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("supply"))
    if targets is None:
        leaves = leaves.withColumn("weight", F.greatest(F.floor(F.sqrt("supply")), F.lit(1)).cast("long"))
    else:
        t = targets.groupBy(*levels).agg(F.sum("weight").alias("weight"))
        leaves = leaves.join(t, levels).filter("weight > 0")
    leaf = budgets(sc.keep(leaves), levels, share, max_epochs)
    leaf = leaf.withColumn("full", F.when(F.col("supply") > 0, F.floor(F.col("grant") / F.col("supply"))).otherwise(0).cast("int")) \
        .withColumn("rem", F.col("grant") - F.col("full") * F.col("supply"))
    leaf = sc.keep(leaf)
    d = rows.join(small_side(leaf), levels).withColumn("key", order_key(F.col("full"), F.col("doc_id"), seed)) \
        .withColumn("part", F.substring("key", 1, 3))
    parts = d.groupBy(*levels, "part").agg(F.sum("tokens").alias("t"), F.max("key").alias("last"), F.first("rem").alias("rem"))
    run = Window.partitionBy(*levels).orderBy("part")
    parts = parts.withColumn("upto", F.sum("t").over(run))
    # the last whole range, and where the next one starts
    whole = parts.filter("upto <= rem").groupBy(*levels).agg(F.max("last").alias("whole"), F.max("upto").alias("base"))
    edge = parts.filter("upto > rem").groupBy(*levels).agg(F.min("part").alias("part"))
    edge = edge.join(whole, levels, "left").withColumn("base", F.coalesce("base", F.lit(0)))
    inside = d.join(edge.select(*levels, "part", "base"), [*levels, "part"]).select(*levels, "part", "key", "tokens", "rem", "base")
    inside = inside.withColumn("upto", F.col("base") + F.sum("tokens").over(
        Window.partitionBy(*levels, "part").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    inside = inside.filter("upto <= rem").groupBy(*levels).agg(F.max("key").alias("inside"))
    return sc.keep(leaf.join(whole, levels, "left").join(inside, levels, "left").select(
        *levels, "supply", "grant", "full", F.greatest("inside", "whole").alias("cut")))


def mix(docs: DataFrame, levels: dict[str, Column], tokens: Column | None = None, share: float = SHARE,
        max_epochs: int = EPOCHS, seed: str = SEED, targets: DataFrame | None = None) -> DataFrame:
    """Documents drawn to the target weights: all columns of ``docs``, ``epoch``
    (from 0; a document drawn in two epochs has two rows) and ``n_tokens``.

    ``levels`` names the tree from the top.  Null levels are values of their
    own; null or empty texts have no tokens, cost nothing and are
    drawn like the others: with every whole epoch, and with the last one if their order key is within
    the cut (in a leaf granted less than one epoch, those beyond the cut are left out).  Rows that repeat a doc_id (or have none) in one leaf are taken or left together.
    An empty table gives an empty table.  Extra columns pass
    through; an ``epoch`` or ``n_tokens`` of the input is replaced.
    """
    if not levels:
        raise ValueError("at least one level")
    sc = Scratch(docs.sparkSession)
    keys = [f"__level{i}" for i in range(len(levels))]
    own = {k: _name(c) for k, c in zip(keys, levels.values(), strict=True)}
    tok = n_tokens(F.col("text")) if tokens is None else tokens
    rows = sc.keep(docs.select("doc_id", *[c.alias(k) for k, c in own.items()], tok.alias("tokens")))
    if targets is not None:
        targets = targets.select(*[_name(F.col(n)).alias(k) for n, k in zip(levels, keys, strict=True)], "weight")
    leaf = plan(rows, keys, share, max_epochs, seed, targets)
    leaf = small_side(leaf.select(*keys, F.col("full").alias("__full"), F.col("cut").alias("__cut")))
    d = docs.withColumns(own | {"__tokens": tok}).join(leaf, keys)
    more = F.coalesce(order_key(F.col("__full"), F.col("doc_id"), seed) <= F.col("__cut"), F.lit(False))
    last = F.col("__full") + more.cast("int") - 1
    d = d.filter(last >= 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0), last)))
    return d.select(*others(docs, "epoch", "n_tokens"), F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"))


def _sql() -> str:
    keys = ["l0", "l1", "l2"]
    out = [r"""WITH d AS (SELECT doc_id, lang, source, substr(md5(coalesce(source, '')), 1, 1) AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
r AS (SELECT *, '=' || domain AS l0, coalesce('=' || lang, '') AS l1, coalesce('=' || source, '') AS l2 FROM d),
leaves AS (SELECT *, supply * 2 AS cap, CAST(greatest(floor(sqrt(supply)), 1) AS BIGINT) AS weight
           FROM (SELECT l0, l1, l2, CAST(sum(tokens) AS BIGINT) AS supply FROM r GROUP BY l0, l1, l2)),
b0 AS (SELECT least(CAST(floor(sum(supply) * 1.0::DOUBLE) AS BIGINT), CAST(sum(cap) AS BIGINT)) AS budget FROM leaves)"""]
    for i in range(3):
        key, parent = ", ".join(keys[:i + 1]), ", ".join(keys[:i])
        part = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN b{i} USING ({parent})" if parent else "CROSS JOIN b0"
        out.append(f"""n{i} AS (SELECT * FROM (SELECT {key}, CAST(sum(cap) AS BIGINT) AS cap, CAST(sum(weight) AS BIGINT) AS weight,
  CAST(sum(supply) AS BIGINT) AS supply FROM leaves GROUP BY {key}) {join}),
k{i} AS (SELECT *, row_number() OVER o AS k, CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent,
  CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_w FROM n{i}
  WINDOW o AS ({part} ORDER BY cap / weight::DOUBLE, l{i})),
s{i} AS (SELECT *, min(CASE WHEN CAST(budget - spent AS DOUBLE) * weight / left_w <= cap THEN {{'k': k, 'spent': spent, 'left_w': left_w}} END)
  OVER ({part}) AS stop FROM k{i}),
b{i + 1} AS (SELECT {key}, supply, CASE WHEN stop IS NULL OR k < stop.k THEN cap
  ELSE least(cap, greatest(CAST(floor(CAST(budget - stop.spent AS DOUBLE) * weight / stop.left_w) AS BIGINT), 0)) END AS budget FROM s{i})""")
    out.append("""f AS (SELECT l0, l1, l2, supply, budget,
  CASE WHEN supply > 0 THEN CAST(floor(budget / supply::DOUBLE) AS INTEGER) ELSE 0 END AS whole FROM b3),
x AS (SELECT r.*, f.whole, f.budget - f.whole * f.supply AS rem,
  md5('mix-1:' || f.whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM r JOIN f USING (l0, l1, l2)),
y AS (SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY key RANGE UNBOUNDED PRECEDING) <= rem
  THEN 1 ELSE 0 END AS n FROM x)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch FROM y""")
    return ",\n".join(out)


def corpus_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


@query("op9_source_mixing", _sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document drawn, with its epoch."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mix(docs, corpus_levels()).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source",
                                             "n_tokens", "epoch")
