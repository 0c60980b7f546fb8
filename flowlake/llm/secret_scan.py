"""Secret scan: fixed patterns and a randomness test battery; DataFrame expressions only.

Method.  Fixed patterns (assignments, access keys, long hex) give the base
spans.  Every other run of 20 or more encoding characters is a candidate.  Its
encoding is the smallest alphabet that holds it; if the text were random in
that alphabet, a chi-squared test of uniformity, a runs test (upper against
lower half of the alphabet) and a lag-1 serial correlation test would each give
a uniform p-value; Fisher's method combines them.  Benjamini-Hochberg at level
``Q`` decides which candidates are *not* random, separately for each encoding and
length band: short runs give weak tests and many hypotheses, and would otherwise
lift or sink the bar for long ones.  Among words, a random token is lost with a chance
of about the level (its p-value is about uniform at any length), so the level falls
with the band (``FALL``): long runs that aren't random have far smaller p-values.  What
isn't rejected is reported as ``random``.  A run that overlaps base spans is cut at
them, and every remaining piece of 20 or more characters is a candidate.

Length-awareness also sets the chi-squared bins: single symbols if each is
expected five times or more, else a few classes of symbols (upper, lower, rest).

Scale.  Matches and their places come from one regular expression pass each
(``regexp_extract_all`` for the matches, ``split`` for the gaps).  The corpus step
needs only counts per encoding, length band and p-value step (a bounded table),
so no p-values are sorted: p is rounded up to a grid of 20 steps per decade, which is
conservative.  Texts are neither shuffled nor collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import Scratch, let, prefix_sums, query, read

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
Q = 0.05                        # level of the shortest band
STEPS, TOP = 20, 400            # p-value grid: steps per decade, last step (1e-20)
BANDS = (32, 64, 128)           # length bands of the strata
FALL = (1, 50, 5_000, 500_000)  # their levels are Q over this: 0.05, 1e-3, 1e-5, 1e-7
MASK = "[SECRET]"
_NONE = "array<struct<s:int,k:int,e:int>>"

_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: alphabet and, symbol by symbol, the class that stands for it in short runs
ALPHABETS = {
    "hex": ("0123456789abcdef", "aaaabbbbccccdddd"),
    "base32": (_UP + "234567", "a" * 8 + "b" * 8 + "c" * 8 + "d" * 8),
    "base64": (_UP + _LOW + _DIG + "+/", "a" * 26 + "b" * 26 + "c" * 12),
    "base64url": (_UP + _LOW + _DIG + "-_", "a" * 26 + "b" * 26 + "c" * 12),
    "mixed": (_UP + _LOW + _DIG + "+/-_", "a" * 26 + "b" * 26 + "c" * 14),
}
ENCODINGS = tuple(ALPHABETS)


def _found(text: Column, pattern: str, when: Column) -> Column:
    """Matches of a pattern as structs (s, m): start in code points and the match."""
    def placed(m: Column, gap: Column) -> Column:
        before = prefix_sums(F.zip_with(gap, F.transform(m, F.length), lambda g, x: g + F.coalesce(x, F.lit(0))))
        return let(before, lambda b: F.transform(m, lambda x, i: F.struct(
            (F.get(b, i) + F.get(gap, i)).cast("int").alias("s"), x.alias("m"))))
    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")), lambda gap: placed(m, gap)))
    return F.when(when, out).otherwise(F.array().cast("array<struct<s:int,m:string>>"))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), (x["s"] + F.length(x["m"])).alias("e")))


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Chebyshev fit, relative error 1.2e-7)."""
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

    def fit(t: Column) -> Column:
        poly = F.lit(c[-1])
        for a in reversed(c[:-1]):
            poly = poly * t + a
        return t * F.exp(-x * x + poly)
    return let(1 / (1 + x / 2), fit)


def upper_tail(z: Column) -> Column:
    return let(z, lambda v: let(_erfc(F.abs(v) / math.sqrt(2)) / 2, lambda p: F.when(v >= 0, p).otherwise(1 - p)))


def _pick(enc: Column, what: int) -> Column:
    out = F.lit(ALPHABETS["mixed"][what])
    for name in ENCODINGS[:-1]:
        out = F.when(enc == name, F.lit(ALPHABETS[name][what])).otherwise(out)
    return out


def infer_encoding(tok: Column) -> Column:
    """The smallest alphabet that holds the token; null for digits alone (numbers, not secrets)."""
    return (F.when(tok.rlike("^[0-9_+/=-]+$"), None)
            .when(tok.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when(tok.rlike("^[A-Z2-7]+$"), "base32")
            .when(~tok.rlike("[_-]"), "base64")
            .when(~tok.rlike("[+/]"), "base64url").otherwise("mixed"))


def _uniform(tok: Column, n: Column, enc: Column) -> Column:
    """p-value of the chi-squared test (Wilson-Hilferty)."""
    def test(cls: Column, seen: Column) -> Column:
        size = F.length(cls)
        bins = F.array_distinct(F.regexp_extract_all(cls, F.lit("."), F.lit(0)))
        # bins with an expected count e and an observed count o
        terms = F.transform(bins, lambda b: _term(n * (size - F.length(F.replace(cls, b, F.lit("")))) / size,
                                                  n - F.length(F.replace(seen, b, F.lit("")))))
        return let(F.struct(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("x"), (F.size(terms) - 1).cast("double").alias("d")),
                   lambda t: upper_tail((F.pow(t["x"] / t["d"], F.lit(1 / 3)) - (1 - 2 / (9 * t["d"]))) / F.sqrt(2 / (9 * t["d"]))))
    full = n >= 5 * F.length(_pick(enc, 0))
    return let(F.struct(F.when(full, _pick(enc, 0)).otherwise(_pick(enc, 1)).alias("c"),
                        F.when(full, tok).otherwise(_by_encoding(tok, enc, ALPHABETS)).alias("s")),
               lambda t: test(t["c"], t["s"]))


def _runs(tok: Column, n: Column, enc: Column) -> Column:
    """p-value of the Wald-Wolfowitz runs test on the halves of the alphabet."""
    halves = {k: (a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for k, (a, _) in ALPHABETS.items()}

    def test(t: Column) -> Column:
        sd = F.sqrt((t["mu"] - 1) * (t["mu"] - 2) / (n - 1))
        return F.when((t["n1"] == 0) | (t["n1"] == n), F.pow(F.lit(2.0), 1 - n)).otherwise(
            2 * upper_tail(F.abs(t["runs"] - t["mu"]) / sd))
    return let(_by_encoding(tok, enc, halves), lambda bits: let(
        F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double"), lambda n1: let(F.struct(
            n1.alias("n1"), (2 * n1 * (n - n1) / n + 1).alias("mu"),
            F.length(F.regexp_replace(bits, "0+|1+", "x")).cast("double").alias("runs")), test)))


def _serial(tok: Column, n: Column, enc: Column) -> Column:
    """p-value of the lag-1 correlation of places in the alphabet."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def test(dev: Column) -> Column:
        cov = total(F.zip_with(dev, F.slice(dev, F.lit(2), F.size(dev)), lambda x, y: x * F.coalesce(y, F.lit(0.0))))
        return let(total(F.transform(dev, lambda x: x * x)), lambda var: F.when(var <= 0, F.lit(1e-12)).otherwise(
            2 * upper_tail(F.abs((cov / var + 1 / n) * F.sqrt(n)))))
    return let(_pick(enc, 0), lambda a: let(
        F.transform(F.regexp_extract_all(tok, F.lit("."), F.lit(0)), lambda c: F.instr(a, c).cast("double")),
        lambda pos: let(total(pos) / n, lambda mean: let(F.transform(pos, lambda x: x - mean), test))))


def _term(e: Column, o: Column) -> Column:
    return (o - e) * (o - e) / e


def _by_encoding(tok: Column, enc: Column, table: dict[str, tuple[str, str]]) -> Column:
    out = F.translate(tok, *table["mixed"])
    for name in ENCODINGS[:-1]:
        out = F.when(enc == name, F.translate(tok, *table[name])).otherwise(out)
    return out


def p_random(tok: Column, enc: Column) -> Column:
    """Fisher's combination of the battery: small if ``tok`` doesn't look random in its encoding."""
    def combined(t: Column, n: Column, e: Column) -> Column:
        p = F.array(_uniform(t, n, e), _runs(t, n, e), _serial(t, n, e))
        x = F.aggregate(p, F.lit(0.0), lambda s, v: s - F.log(F.least(F.greatest(v, F.lit(1e-15)), F.lit(1.0))))
        return let(x, lambda v: F.exp(-v) * (1 + v + v * v / 2))
    return let(enc, lambda e: let(F.when(e == "hex", F.lower(tok)).otherwise(tok), lambda t: let(
        F.length(t).cast("double"), lambda n: combined(t, n, e))))


def _band(n: Column) -> Column:
    out = F.lit(len(BANDS))
    for i, b in reversed(list(enumerate(BANDS))):
        out = F.when(n < b, F.lit(i)).otherwise(out)
    return out


def _rewrite(text: Column, spans: Column, put, block: int = 256) -> Column:
    """The text with ``put(at, x)`` in the place of each span x; spans are sorted and may overlap, ``at``
    is where the text before x is done.

    Two levels, so that m spans in n characters cost about m * block + n * (m / block + block) steps
    and not m * n: the text is cut at blocks of spans, and each block's piece at its own.
    """
    def piece(chunk: Column, base: Column, part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            gap = F.substring(chunk, acc["at"] - base + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.array(gap, put(acc["at"], x))).alias("out"))
        start = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(part, start, step)["out"], "")

    def joined(parts: Column, ats: Column) -> Column:
        body = F.transform(parts, lambda p, i: let(F.get(ats, i), lambda base: let(
            F.substring(text, base + 1, F.get(ats, i + 1) - base), lambda chunk: piece(chunk, base, p))))
        return F.concat(F.array_join(body, ""), F.substring(text, F.element_at(ats, -1) + 1, F.length(text)))

    def ends(parts: Column) -> Column:
        return F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(
            F.greatest(F.element_at(acc, -1), F.array_max(F.transform(p, lambda x: x["e"]))))))

    def cut(sp: Column) -> Column:
        last = F.floor((F.size(sp) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sp, b * block + 1, F.lit(block)))
    return let(spans, lambda sp: F.when(F.size(sp) > 0, let(cut(sp), lambda parts: let(ends(parts), lambda ats: joined(parts, ats))))
               .otherwise(text))


def _blank(text: Column, spans: Column) -> Column:
    """The text with blanks in the place of the spans, of the same length."""
    return _rewrite(text, spans, lambda at, x: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(at, x["s"]), F.lit(0))))


def scan(df: DataFrame, text: Column) -> DataFrame:
    """Add ``__base`` (array of s, k, e) and ``__cand`` (s, e, enc, band, step) for a whole text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    df = df.withColumn("__runs", t.rlike(RUN))
    assign = F.filter(_found(t, ASSIGN, t.rlike(KEYWORD)),
                      lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6)
    base = F.concat(_spans(assign, "assign"),
                    _spans(_found(t, ACCESS, F.col("__runs") & t.contains("AKIA")), "access"),
                    _spans(_found(t, HEX, F.col("__runs")), "hex"))
    df = df.withColumn("__base", F.sort_array(base))
    # the runs outside all base spans: those of the text with these blanked out
    pieces = let(_blank(t, F.col("__base")), lambda rest: _found(rest, RUN, F.lit(True)))
    df = df.withColumn("__run", F.when(F.col("__runs"), pieces).otherwise(F.array().cast("array<struct<s:int,m:string>>")))
    bare = F.transform("__run", lambda x: F.struct(x["s"].alias("s"), F.regexp_replace(x["m"], "=+$", "").alias("m")))
    bare = F.filter(bare, lambda x: (F.length(x["m"]) >= LEAST) & infer_encoding(x["m"]).isNotNull())
    df = df.withColumn("__run", F.when(F.size("__run") > 0, bare).otherwise(F.col("__run")))
    cand = F.transform("__run", lambda x: F.struct(
        x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), infer_encoding(x["m"]).alias("enc"),
        _band(F.length(x["m"])).alias("band"),
        F.least(F.floor(-F.log10(F.greatest(p_random(x["m"], infer_encoding(x["m"])), F.lit(1e-20))) * STEPS),
                F.lit(TOP)).cast("int").alias("step")))
    return df.withColumn("__cand", F.when(F.size("__run") > 0, cand).otherwise(
        F.array().cast("array<struct<s:int,e:int,enc:string,band:int,step:int>>"))).drop("__run", "__runs")


def rejection_steps(scanned: DataFrame, q: float = Q) -> dict[tuple[str, int], int]:
    """Benjamini-Hochberg per encoding and length band, at level ``q`` over the band's ``FALL``: the least
    grid step that rejects randomness.

    The table that reaches the driver has at most 5 encodings x 4 bands x 401 steps, at any input size.
    """
    n = (scanned.select(F.explode("__cand").alias("c")).groupBy("c.enc", "c.band", "c.step")
         .agg(F.count("*").alias("n")).collect())
    out: dict[tuple[str, int], int] = {}
    for key in {(r["enc"], r["band"]) for r in n}:
        own = {r["step"]: r["n"] for r in n if (r["enc"], r["band"]) == key}
        m, k = sum(own.values()), 0
        for step in sorted(own, reverse=True):
            k += own[step]
            if 10 ** (-step / STEPS) <= q / FALL[key[1]] * k / m:
                out[key] = step
    return out


def _random(steps: dict[tuple[str, int], int]) -> Column:
    def kept(c: Column) -> Column:
        bar = F.lit(TOP + 1)
        for (enc, band), step in sorted(steps.items()):
            bar = F.when((c["enc"] == enc) & (c["band"] == band), F.lit(step)).otherwise(bar)
        return c["step"] < bar
    return F.transform(F.filter("__cand", kept), lambda c: F.struct(
        c["s"].alias("s"), F.lit(KINDS.index("random")).alias("k"), c["e"].alias("e")))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def find_secrets(docs: DataFrame, q: float = Q) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null and empty texts have no spans.  Repeated rows are scanned alike (and
    count as hypotheses each).  Extra columns are ignored.  An empty table gives none.
    A text's time grows with its length and, in blocks of 256, with its spans: 40,000 spans in one text are fine.
    """
    sc = Scratch(docs.sparkSession)
    got = sc.keep(scan(docs.select("doc_id", "text"), F.col("text")).drop("text"))
    rnd = _random(rejection_steps(got, q))
    count = lambda k: F.size(F.filter("__base", lambda x: x["k"] == KINDS.index(k))).cast("long")
    return got.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                      count("hex").alias("n_hex"), F.sha2(_text(F.col("__base")), 256).alias("base_sha256"),
                      _text(F.sort_array(F.concat("__base", rnd))).alias("spans"), F.size(rnd).cast("long").alias("n_random"))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span (sorted, may overlap) replaced by ``MASK``; overlapping spans become one."""
    return _rewrite(text, spans, lambda at, x: F.when(x["s"] >= at, F.lit(MASK)).otherwise(F.lit("")))


def redact(docs: DataFrame, q: float = Q) -> DataFrame:
    """The documents with every secret masked; ``n_chars``, if present, follows the text.  No row goes."""
    cols = docs.columns
    sc = Scratch(docs.sparkSession)
    # with __base in the result and no filter on __cand, the base searches run once a text and not once a run
    cand = sc.keep(scan(docs.select("text"), F.col("text")).select("__base", "__cand"))
    steps = rejection_steps(cand, q)
    sc.free(cand)
    got = scan(docs, F.col("text"))
    got = got.withColumn("__all", F.sort_array(F.concat("__base", _random(steps))))
    got = got.withColumn("text", mask(F.col("text"), F.col("__all")))
    if "n_chars" in cols:
        got = got.withColumn("n_chars", F.when(F.size("__all") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return got.select(*[F.col(f"`{c}`") for c in cols])


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return find_secrets(read(spark, sf_dir, "documents"))
