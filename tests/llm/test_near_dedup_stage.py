import random

import corpus_pipeline as P


def brute(rows, n=5, t=80):
    """Ids that stay: the least of each component of texts with ``n``-word Jaccard >= t %."""
    sets = {d: {tuple(w[k:k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set() for d, w in ((d, x.split()) for d, x in rows)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {d for d in sets if find(d) == d}


def left(spark, docs):
    return {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()}


def spread(words, n):
    """The words with ``n`` of them replaced, far from each other."""
    at = {(2 * i + 1) * len(words) // (2 * n) for i in range(n)}
    return [f"new{i}" if i in at else w for i, w in enumerate(words)]


def test_stage_links_five_words_at_eighty_percent(ready_spark, make_docs):
    words = [f"a{i}" for i in range(200)]
    other = [f"b{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"c{i}" for i in range(45)])),      # 5 words: 196/241, 3 words: 198/243
            (3, " ".join(other)), (4, " ".join(spread(other, 5)))]                          # 5 words: 171/221, 3 words: 183/213
    assert brute(rows) == {1, 3, 4} and brute(rows, 3, 85) == {1, 2, 3}
    assert left(ready_spark, make_docs(rows)) == {1, 3, 4}


def test_stage_against_brute_force(ready_spark, make_docs):
    rng = random.Random(12)
    texts = ["", "one", "one two three four", "one two three four"]
    for g in range(8):
        base = [f"w{g}_{rng.randint(0, 400)}" for _ in range(rng.choice((4, 30, 120, 300)))]
        for _ in range(14):
            rate = rng.choice((0, 0.005, 0.015, 0.025, 0.04))
            texts.append(" ".join([rng.choice("abcdefgh") * 5 if rng.random() < rate else w for w in base]
                                  + [f"t{rng.randint(0, 9999)}" for _ in range(rng.choice((0, len(base) // 5, len(base) // 4)))]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert brute(rows) != brute(rows, 3, 85)
    assert left(ready_spark, make_docs(rows)) == brute(rows)


def test_unrelated_texts_of_a_repeated_id_all_stay(ready_spark, make_docs):
    """Each distinct text of an id is a document; the choice doesn't depend on the order of the rows."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "cabd"]
    for rows in ([None, *texts, "", texts[0]], [*texts[::-1], None, texts[1]]):
        docs = make_docs([(7, t) for t in rows] + [(8, "one two three")]).coalesce(1)
        out = P.near_dedup_stage(ready_spark, docs, "")
        assert out.columns == docs.columns
        assert sorted((r["doc_id"], (r["text"] or "")[:2]) for r in out.collect()) == [(7, "")] + [(7, f"{c}0") for c in "abcd"] + [(8, "on")]


def test_texts_of_a_repeated_id_don_t_tie_their_groups(ready_spark, make_docs):
    """5 and 9 each resemble another text of 7; nothing that resembles no kept text goes."""
    words = {c: [f"{c}{i}" for i in range(100)] for c in "xyz"}
    near = lambda c, t: " ".join([*words[c], t])
    rows = [(5, near("x", "t1")), (7, near("x", "t2")), (7, near("y", "t3")), (9, near("y", "t4")), (7, near("z", "t5")), (7, near("z", "t6"))]
    out = [(r["doc_id"], r["text"][0]) for r in P.near_dedup_stage(ready_spark, make_docs(rows), "").collect()]
    assert sorted(c for _, c in out) == ["x", "y", "z"] and (5, "x") in out


def test_numbers_of_further_texts_meet_no_id(ready_spark, make_docs):
    """An id that equals the first hash of another id's text is no tie."""
    b = " ".join(f"b{i}" for i in range(40))
    taken = ready_spark.createDataFrame([(7, b)], "doc_id long, t string").selectExpr("xxhash64(doc_id, t, 0) as h").first().h
    rows = [(7, " ".join(f"a{i}" for i in range(40))), (7, b), (taken, " ".join(f"c{i}" for i in range(40))), (8, b + " tail"),
            (2**63 - 1, "one two"), (-2**63, "three four")]
    out = sorted((r["doc_id"], r["text"][0]) for r in P.near_dedup_stage(ready_spark, make_docs(rows), "").collect())
    assert sorted(x[1] for x in out) == ["a", "b", "c", "o", "t"] and (taken, "c") in out and (7, "a") in out


def test_a_hot_id_and_clashing_columns(ready_spark):
    from pyspark.sql import functions as F
    docs = ready_spark.range(600).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("int").alias("doc_id"),
                                         F.concat(F.lit("w"), F.col("id") % 150, F.lit(" x y z v "), F.col("id") % 150).alias("text"),
                                         F.lit(1).alias("kept"), F.lit("c").alias("component_id"))
    out = P.near_dedup_stage(ready_spark, docs, "")
    assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert out.count() == 150 and out.select("text").distinct().count() == 150
