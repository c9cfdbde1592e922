"""Counting terms in pieces, and the index made of them: equal to plain counting, whatever the pieces; nothing is counted by key in a shuffle."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from parleylake.functions import terms
from parleylake.functions import text as T
from parleylake.operators import lexical, pool

TEXTS = ["goa trip budget", "budget budget meeting on monday", "goa goa goa beach", "Éclair à 漢字 😀 x_1 ١٢", "a\x00b \x00", "", None, " \n\t ", "same text", "same text", "aaaaaa aaaa a", "in-no.par:ts"]


def plain(text: str) -> Counter:
    words = re.findall(r"[abcé漢]+", text)
    out = Counter(("word", w) for w in words) + Counter(("word", " ".join(p)) for p in zip(words, words[1:]))
    for token in re.split(r"[ \n]+", text):
        padded = f" {token} "
        out += Counter(("char", padded[i : i + n]) for n in (3, 4, 5) for i in range(len(padded) - n + 1) if token)
    return out


def test_counts_are_those_of_plain_loops(monkeypatch):
    draw = random.Random(1)
    for _ in range(200):
        texts = ["".join(draw.choice("ab c\x00é漢😀 \n") for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(0, 6))]
        monkeypatch.setattr(terms, "GRAMS", draw.choice([5, 10**6]))
        got = [Counter() for _ in texts]
        for channel, take in (("word", terms.words), ("char", terms.chars)):
            listed, row, t, n = take(pa.array(texts, pa.string()))
            assert len(set(listed.to_pylist())) == len(listed)
            for r, at, times in zip(row.tolist(), t.tolist(), n.tolist(), strict=True):
                got[r][channel, listed[at].as_py()] += times
        assert got == [plain(x) for x in texts]


def test_pieces_hold_every_text_once():
    draw = random.Random(2)
    for _ in range(50):
        texts = ["x" * draw.randint(0, 9) for _ in range(draw.randint(1, 30))]
        batches = pa.table({"folded": texts}).to_batches(max_chunksize=draw.randint(1, 7))
        found = [p.column("folded").to_pylist() for p in terms.pieces(iter(batches), most=12)]
        assert sum(found, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 12 for p in found)


def test_words_and_marks_are_those_of_spark(spark):
    """Every code point that can stand alone: part of a word as in Spark's expression, but for letters that only the newer tables know."""
    points = [(i, chr(i)) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame(pa.table({"id": [i for i, _ in points], "c": [c for _, c in points]}))
    spark_says = {r["id"] for r in rows.where(F.size(T.words(F.col("c"))) > 0).select("id").collect()}
    ours = {i for i, _ in points if terms.in_words()[i]}
    assert not spark_says - ours and len(ours - spark_says) < 10_000
    every = "".join(c for _, c in points)
    assert T._unaccented(pd.Series([every]))[0] == "".join(c for c in unicodedata.normalize("NFKD", every) if not unicodedata.combining(c))


def test_index_gives_the_postings_of_flat_counts(spark, monkeypatch):
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "id string, text string").repartition(3)
    monkeypatch.setattr(terms.pieces, "__defaults__", ("folded", 20))
    index = lexical.Index(rows)
    assert index.terms().select("piece").distinct().count() > 3
    own = lexical.counts(rows, "id")
    flat = lambda df: sorted((r["id"], r["channel"], r["term"], round(r["weight"], 9)) for r in df.collect())
    idf = lexical.document_frequency(rows, own)
    want = flat(lexical.weighted(own, idf, "id"))
    assert flat(index.postings()) == want and len(want) > 100
    assert sorted(map(tuple, lexical.vocabulary(rows).collect())) == sorted({x[1:3] for x in want})
    queries = spark.createDataFrame([(0, "goa beach"), (1, "budget on éclair"), (2, ""), (3, "same unknown")], "query_id long, query string")
    asked = lexical.tfidf_query(queries, index.idf)
    scores = lambda p: sorted((r["query_id"], r["id"], round(r["lexical"], 9)) for r in lexical.lexical_score(asked, p).collect())
    assert scores(index) == scores(lexical.weighted(own, idf, "id")) and scores(index)
    lists = lambda p: sorted((r["id"], sorted((x["t"], round(x["weight"], 9)) for x in r["terms"])) for r in pool.terms_by_row(asked.orderBy("term"), p)[1].collect() if r["terms"])
    assert [x[0] for x in lists(index)] == [x[0] for x in lists(lexical.weighted(own, idf, "id"))]
    plan = lexical.counts(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Generate" not in plan


def test_a_profile_equals_exploded_n_grams(spark):
    """Also for keys that stand twice, null and blank texts, and n-grams beyond ASCII."""
    from pyspark.sql import functions as F

    from parleylake.functions import text as T
    from parleylake.operators import lexical

    rows = [(1, "the budget the"), (1, "Écoles zwölf 👍 a"), (2, None), (3, " \n "), (4, "a"), (None, "x yz"), (None, "yz"), (5, "日本語 ﬁn \U0001f600￮"), (1, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    grams = docs.select("id", F.explode(T.char_terms(T.fold_accents(F.col("text")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    want = grams.groupBy("id").agg(F.sum("c").alias("n"), F.count("*").alias("distinct_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))
    got = lexical.char_profile(docs, "id")
    assert got.columns == want.columns and got.count() == 4 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
