"""Plans that evaluate what they read once, and guards that pass over no date."""

from __future__ import annotations

from pyspark.sql import functions as F

from parleylake.operators import annotate, dense


def _plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_vector_takes_its_text_once(spark):
    """Words and pairs of a text that is itself made of columns: it is made once a row."""
    rows = spark.createDataFrame([(1, "Ein Wort, zwei Worte")], "id long, text string")
    made = dense.hashed_vector(F.concat("text", F.lit("made-of-columns")))
    assert _plan(rows.repartition(2).select(made.alias("vector"))).count("made-of-columns") == 1


def test_date_mentions_make_intervals_once(spark):
    """No filter before the explode repeats all steps of the grammar."""
    rows = spark.createDataFrame([(1, "from 3 to 5 march 2001"), (2, "nothing")], "query_id long, query string").repartition(2)
    found = annotate.date_mentions(rows, "2002-01-01")
    assert not [x for x in _plan(found).splitlines() if "Filter" in x.split("(")[0] and "regexp" in x]
    assert [(r["query_id"], str(r["start"]), str(r["end"])) for r in found.collect()] == [(1, "2001-03-03", "2001-03-05")]


def test_guards_pass_over_no_date(spark):
    """With guards that hold for every text, all texts give the same intervals and doubts."""
    ends = ["2001-03-04", "3 march 2001", "march 3rd, 2001", "sept 2001", "may", "5th may", "may 5", "june"]
    links = [" to ", " through ", "-", " – ", " and ", " se ", " until "]
    texts = [f"{frame}{a}{link}{b}" for frame in ("", "between ", "x from ") for a in ends for b in ends for link in links]
    texts += [f"{d}{link}{e} {m}" for d in ("3", "3rd") for e in ("5", "5th") for m in ("march", "may 2001", "sept, 2001") for link in links]
    texts += [f"{m} {d}{link}{e}{y}" for d in ("3", "3rd") for e in ("5", "5th") for m in ("march", "may") for y in ("", " 2001", ", 2001") for link in links]
    texts += ["today", "aaj", "yesterday", "beete kal", "beetey kal", "last week", "pichle hafte", "pichhle hafte", "last month", "pichle mahine", "this month", "is mahine", "kal", "3/4", "3/4/01", "we may", "in may", "no date", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    read = lambda: sorted(annotate.date_intervals(rows, "text", "2002-01-01").select("query_id", "intervals", "doubts").collect())
    held = {n: getattr(annotate, n) for n in ("IN_RANGES", "IN_DAYS_FIRST", "IN_MONTH_FIRST", "IN_RELATIVE", "IN_SINGLE")}
    got = read()
    try:
        for n in held:
            setattr(annotate, n, "")
        assert got == read()
    finally:
        for n, x in held.items():
            setattr(annotate, n, x)
    assert sum(len(r["intervals"]) > 0 for r in got) > 1000
