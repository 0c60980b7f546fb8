"""Profile, encoder and lookup plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlake.operators import encode, profile
from flowlake.operators import summary
from flowlake.plans.registry import plan, rounded, table

# ---- inputs -----------------------------------------------------------------

_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                 "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
_LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax"]


def _docs_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left")


_DL_SQL = """dl AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(_ORDERS_COLS):
        t = _ORDERS_TYPES[c]
        if t in ("string", "timestamp_ntz"):
            parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count({c}) AS count,
  count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique",
  (SELECT CAST({c} AS VARCHAR) FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top,
  (SELECT count(*) FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq,
  NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
  NULL::DOUBLE AS q25, NULL::DOUBLE AS median, NULL::DOUBLE AS q75 FROM orders""")
        else:
            parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count({c}) AS count,
  count(*) - count({c}) AS missing, NULL::BIGINT AS "unique", NULL::VARCHAR AS top,
  NULL::BIGINT AS freq, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS q75 FROM orders""")
    return "\nUNION ALL\n".join(parts)


@plan("table_profile", _profile_sql())
def table_profile(spark, sf):
    """A18 on orders, every column."""
    return rounded(profile.table_profile(table(spark, sf, "orders")))


@plan("missing_counts", f"""WITH {_DL_SQL},
m AS ({' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM dl"
                         for c in ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"])})
SELECT "column", missing FROM m WHERE missing > 0 ORDER BY missing DESC, "column" LIMIT 30""")
def missing_counts(spark, sf):
    """A20 on documents left join labels."""
    return profile.missing_top(_docs_labels(spark, sf))


@plan("column_sums", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(CAST(sum({c}) AS DOUBLE), 4) AS sum FROM lineitem" for c in _LINE_NUM))
def column_sums(spark, sf):
    """A19 on lineitem."""
    out = profile.column_sums(table(spark, sf, "lineitem"))
    return out.select("column", F.round("sum", 4).alias("sum"))


def _corr_sql() -> str:
    rows = []
    for a in _LINE_NUM:
        for b in _LINE_NUM:
            expr = (f"CASE WHEN stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) = 0 "
                    f"OR stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END) = 0 THEN NULL ELSE corr({a}, {b}) END")
            rows.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({expr}, 6) AS corr FROM lineitem")
    return " UNION ALL ".join(rows)


@plan("correlation_matrix", _corr_sql())
def correlation_matrix(spark, sf):
    """A21 on lineitem's numeric columns (one aggregate for all pairs)."""
    return rounded(profile.correlation_matrix(table(spark, sf, "lineitem"), _LINE_NUM))


@plan("variance_rank", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(var_samp({c}), 4) AS variance FROM lineitem" for c in _LINE_NUM)
    .join(["SELECT * FROM (", ") v ORDER BY variance DESC, \"column\" LIMIT 5"]))
def variance_rank(spark, sf):
    """Top 5 columns by variance."""
    out = profile.variance_rank(table(spark, sf, "lineitem"))
    return out.select("column", F.round("variance", 4).alias("variance"))


@plan("top_categories", f"""WITH {_DL_SQL},
c AS (SELECT 'lang' AS "column", coalesce(lang, 'nan') AS value, count(*) AS count FROM dl GROUP BY 2
      UNION ALL SELECT 'source', coalesce(source, 'nan'), count(*) FROM dl GROUP BY 2
      UNION ALL SELECT 'text', coalesce(text, 'nan'), count(*) FROM dl GROUP BY 2)
SELECT "column", value, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c) r
WHERE rank <= 10""")
def top_categories(spark, sf):
    """A23 on documents left join labels."""
    return profile.top_values(_docs_labels(spark, sf))


@plan("capped_categories", """
WITH v AS (SELECT doc_id, coalesce(source, 'nan') AS source FROM documents),
k AS (SELECT source FROM v GROUP BY source ORDER BY count(*) DESC, source LIMIT 3)
SELECT v.doc_id, CASE WHEN k.source IS NOT NULL THEN v.source ELSE 'OTHER' END AS source
FROM v LEFT JOIN k ON v.source = k.source""")
def capped_categories(spark, sf):
    """A24 with the cap lowered to 3 levels (the table has few)."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return encode.cap_categories(d, "source", top=3)


@plan("category_codes", """
SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL THEN -1
       ELSE CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) END AS o_orderpriority_code
FROM orders""")
def category_codes(spark, sf):
    """F12 on orders.o_orderpriority."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.category_codes(o, "o_orderpriority").select("o_orderkey", "o_orderpriority_code")


@plan("one_hot", """
SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F,
       coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O, coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P
FROM orders""")
def one_hot(spark, sf):
    """F13 on orders.o_orderstatus (levels from the data)."""
    from flowlake.operators.flow import one_hot as oh
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return oh(o, "o_orderstatus", encode.levels_of(o, "o_orderstatus"), keep=False)


@plan("robust_scaled", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                  quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round((value - med) / CASE WHEN q3 - q1 = 0 THEN 1.0::DOUBLE ELSE q3 - q1 END, 6) AS value_scaled
FROM events, q""")
def robust_scaled(spark, sf):
    """F14 on events.value."""
    e = table(spark, sf, "events").select("event_id", "value")
    return rounded(encode.robust_scale(e, ["value"], suffix="_scaled").select("event_id", "value_scaled"))


@plan("standard_scaled", """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT event_id, round((value - m) / CASE WHEN sd = 0 THEN 1.0::DOUBLE ELSE sd END, 6) AS value_scaled
FROM events, s""")
def standard_scaled(spark, sf):
    """F15 on events.value."""
    e = table(spark, sf, "events").select("event_id", "value")
    return rounded(encode.standard_scale(e, ["value"], suffix="_scaled").select("event_id", "value_scaled"))


@plan("size_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def size_outliers(spark, sf):
    """P14 on event values."""
    e = table(spark, sf, "events").select("event_id", "value")
    return profile.iqr_outliers(e, "value")


# Event type -> category for the lookup plans (J4 on the driver's events;
# 'error' is left out to exercise unknown -> NULL).
EVENT_CATEGORIES = [("click", "interaction"), ("view", "interaction"),
                    ("purchase", "conversion"), ("signup", "conversion")]
_EC_SQL = " UNION ALL ".join(f"SELECT '{k}' AS k, '{v}' AS category" for k, v in EVENT_CATEGORIES)


def _event_categories(spark, sf):
    m = spark.createDataFrame(EVENT_CATEGORIES, "k string, category string")
    e = table(spark, sf, "events").select("event_id", "event_type")
    return encode.dictionary_lookup(e, "event_type", m, "k", "category", "category")


@plan("attack_category_map", f"""WITH m AS ({_EC_SQL})
SELECT event_id, event_type, m.category FROM events LEFT JOIN m ON events.event_type = m.k""")
def attack_category_map(spark, sf):
    """Dictionary lookup, unknown -> NULL."""
    return _event_categories(spark, sf)


@plan("category_distribution", f"""WITH m AS ({_EC_SQL})
SELECT m.category, count(*) AS count FROM events JOIN m ON events.event_type = m.k GROUP BY 1""")
def category_distribution(spark, sf):
    """Counts per mapped category (missing dropped, as value counts do)."""
    return summary.value_counts(_event_categories(spark, sf), "category")
