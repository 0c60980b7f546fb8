"""Text scalar functions: payload patterns (F3), rule text (F21), byte decode
(F23), pattern list join (F25), display names (F22), log predicates (P12, P13),
text length (F11).  All native expressions; they run on any string column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules (F3), in its order.
# Each pattern counts once per text; weight per family.
SQL_PATTERNS = ["union select", "drop table", "insert into", "delete from",
                "update set", "exec(", "execute(", "sp_executesql"]
XSS_PATTERNS = ["<script", "javascript:", "onerror=", "onload=",
                "eval(", "alert(", "document.cookie"]
CMD_PATTERNS = ["cmd.exe", "/bin/sh", "powershell", "bash",
                "&&", "||", ";cat", ";ls"]
PATTERN_FAMILIES = [("SQL", SQL_PATTERNS, 3), ("XSS", XSS_PATTERNS, 2), ("CMD", CMD_PATTERNS, 4)]

# Fixed values for the live threat rule on payload text.
CODE_EXEC_PATTERNS = ["eval(", "exec("]
SQLI_RULE_PATTERNS = ["union select", "drop table"]

# Fixed regular expressions of the traffic-log features.
BROADCAST_REGEX = "(?i)Broadcast|255.255|ff:ff:ff:ff:ff:ff"
ERROR_REGEX = "(?i)error|fail|timeout|refused"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bytes_to_text(col) -> Column:
    """bytes to text, invalid UTF-8 dropped, lower case."""
    fixed = F.make_valid_utf8(_c(col).cast("binary"))
    return F.lower(F.regexp_replace(fixed, "\ufffd", ""))


def pattern_hits(text_col, lowered: bool = False) -> Column:
    """array<struct<label, weight, pattern>> of the patterns in a text, in family then
    pattern order; NULL for a NULL text.  The text is lower-cased once and each pattern searched once."""
    table = F.array(*[F.struct(F.lit(f"{fam}:{p}").alias("label"), F.lit(w).alias("weight"), F.lit(p).alias("pattern"))
                      for fam, pats, w in PATTERN_FAMILIES for p in pats])
    low = _c(text_col) if lowered else F.lower(_c(text_col))
    return F.get(F.transform(F.array(low), lambda t: F.when(t.isNotNull(), F.filter(
        table, lambda p: F.contains(t, p["pattern"])))), F.lit(0))


def hits_score(hits: Column) -> Column:
    """F3 score of ``pattern_hits``: sum of the weights, 0 if none."""
    return F.coalesce(F.aggregate(hits, F.lit(0), lambda s, p: s + p["weight"]), F.lit(0))


def hits_labels(hits: Column) -> Column:
    return F.coalesce(F.transform(hits, lambda p: p["label"]), F.array().cast("array<string>"))


def suspicious_score(text_col) -> Column:
    """F3 score: sum of family weights of the patterns present (0 if none)."""
    return hits_score(pattern_hits(text_col))


def suspicious_pattern_list(text_col) -> Column:
    """F3 list: array<string> of labels, in family then pattern order."""
    return hits_labels(pattern_hits(text_col))


def with_payload_patterns(df: DataFrame, text_col: str, score_col="suspicious_score",
                          patterns_col="suspicious_patterns") -> DataFrame:
    """F3 + F25: score and '|'-joined list; both NULL when nothing is found,
    as a packet without hits carries no such fields."""
    out = df.withColumn("__hits", pattern_hits(text_col))
    return out.withColumns({
        score_col: F.when(F.size("__hits") > 0, hits_score(F.col("__hits"))),
        patterns_col: F.when(F.size("__hits") > 0, F.array_join(hits_labels(F.col("__hits")), "|")),
    }).drop("__hits")


def has_code_exec(text_col) -> Column:
    """F21 first rule."""
    low = F.lower(_c(text_col))
    return F.coalesce(F.contains(low, F.lit(CODE_EXEC_PATTERNS[0])) | F.contains(low, F.lit(CODE_EXEC_PATTERNS[1])),
                      F.lit(False))


def has_sql_injection(text_col) -> Column:
    """F21 second rule."""
    low = F.lower(_c(text_col))
    return F.coalesce(F.contains(low, F.lit(SQLI_RULE_PATTERNS[0])) | F.contains(low, F.lit(SQLI_RULE_PATTERNS[1])),
                      F.lit(False))


def display_name(col) -> Column:
    """'packet_size' -> 'Packet Size'."""
    return F.initcap(F.regexp_replace(_c(col), "_", " "))


def is_broadcast(col) -> Column:
    """P12 as 0/1."""
    return F.coalesce(_c(col).rlike(BROADCAST_REGEX), F.lit(False)).cast("int")


def has_error(col) -> Column:
    """P13 as 0/1."""
    return F.coalesce(_c(col).rlike(ERROR_REGEX), F.lit(False)).cast("int")


def text_length(col) -> Column:
    """length with missing shown as the text 'nan'."""
    return F.length(F.coalesce(_c(col).cast("string"), F.lit("nan")))


def percent_text(col, digits: int = 2) -> Column:
    """F16: ratio to 'xx.yy%'."""
    return F.format_string(f"%.{digits}f%%", _c(col) * 100)
