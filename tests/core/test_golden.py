"""Published examples of questions, retrieval, contexts and metrics, and brute-force checks of what SQL doesn't cover."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from parleylake.functions import text as T
from parleylake.operators import annotate, context, dense, evaluate, fuse, lexical, quality
from parleylake.sources import io

TODAY = "2026-09-01"
DATES = [
    ("today", "2026-09-01", "2026-09-01"), ("aaj kya hua?", "2026-09-01", "2026-09-01"), ("What happened yesterday?", "2026-08-31", "2026-08-31"), ("beete kal kya bola?", "2026-08-31", "2026-08-31"),
    ("last week ki updates", "2026-08-24", "2026-08-30"), ("pichle hafte kya decide hua?", "2026-08-24", "2026-08-30"), ("last month", "2026-08-01", "2026-08-31"), ("pichhle mahine budget kitna tha?", "2026-08-01", "2026-08-31"),
    ("this month", "2026-09-01", "2026-09-30"), ("is mahine ki baat", "2026-09-01", "2026-09-30"), ("in August", "2026-08-01", "2026-08-31"), ("during May", "2026-05-01", "2026-05-31"), ("May", "2026-05-01", "2026-05-31"),
    ("May mein kya bola?", "2026-05-01", "2026-05-31"), ("December messages", "2026-12-01", "2026-12-31"), ("Feb 2024 messages", "2024-02-01", "2024-02-29"), ("on 2026-08-15", "2026-08-15", "2026-08-15"),
    ("on 15th August 2026", "2026-08-15", "2026-08-15"), ("on August 15, 2026", "2026-08-15", "2026-08-15"), ("from 2026-03-01 to 2026-08-31", "2026-03-01", "2026-08-31"), ("between 1 March and 5 April 2026", "2026-03-01", "2026-04-05"),
    ("from August 1 to August 15", "2026-08-01", "2026-08-15"), ("1-15 August 2026 ki baat", "2026-08-01", "2026-08-15"), ("August 1-15, 2026", "2026-08-01", "2026-08-15"), ("1 Aug se 15 Aug tak", "2026-08-01", "2026-08-15"),
    ("March through August", "2026-03-01", "2026-08-31"), ("Dec 30 2025 to Jan 2 2026", "2025-12-30", "2026-01-02"), ("March 2024 through April", "2024-03-01", "2024-04-30"), ("last month on August 15", "2026-08-15", "2026-08-15"),
]
REFUSED = ["What happened kal?", "on 03/04/2026", "last month or this month", "from 2026-08-31 to 2026-03-01", "31 February 2026", "2026-02-30", "Dec 30 to Jan 2", "in July and August"]
PLAIN = ["", "   ", "may I see the budget?", "we may go", "maybe later", "aajkal kya chal raha hai?", "Someday soon"]
OTHER_DAYS = [
    ("2026-01-01", "last month", "2025-12-01", "2025-12-31"), ("2026-01-01", "last week", "2025-12-22", "2025-12-28"), ("2026-09-06", "last week", "2026-08-24", "2026-08-30"), ("2026-09-07", "last week", "2026-08-31", "2026-09-06"),
    ("2024-03-01", "yesterday", "2024-02-29", "2024-02-29"), ("2024-03-01", "last month", "2024-02-01", "2024-02-29"),
]
CHAT_DATES = [
    ("messages in late April", "2026-04-21", "2026-04-30", None), ("at the start of May", "2026-05-01", "2026-05-07", None), ("early February 2024", "2024-02-01", "2024-02-07", None), ("mid September", "2026-09-11", "2026-09-20", None),
    ("yesterday morning", "2026-08-31", "2026-08-31", (0, 12)), ("in August at night", "2026-08-01", "2026-08-31", (21, 24)), ("where did we decide to go for the June trip?", None, None, None),
    ("what was said on March 28 about the June trip?", "2026-03-28", "2026-03-28", None), ("messages about the trip in June", None, None, None),
]
PEOPLE = [
    ("What did Priya say about the budget?", "Priya Sharma", "filter"), ("Priya ne budget pe kya bola?", "Priya Sharma", "filter"), ("message from Priya about costs", "Priya Sharma", "filter"), ("Priya shared her plan", "Priya Sharma", "filter"),
    ("Priya's messages about costs", "Priya Sharma", "filter"), ("Priya's budget limit", "Priya Sharma", "bonus"), ("messages about Priya", "Priya Sharma", "none"), ("birthday for Priya", "Priya Sharma", "none"),
    ("What did Priya and Rahul say?", None, "none"), ("What did Unknown say?", None, "none"), ("did priya sharma reply", "Priya Sharma", "filter"), ("Priyanka said hi", None, "none"), ("Priya_x update", None, "none"),
    ("Priya - Sharma said", "Priya Sharma", "filter"),
]
TYPES = [
    ("Find the first forwarded warning about library hours", "forwarded"), ("What did Priya forward yesterday?", "forwarded"), ("What alert did Rahul Verma forward?", "forwarded"), ("Show me the PDF about the library", "pdf"),
    ("Find the image of our poster", "image"), ("Where is the voice note about rehearsals?", "voice"), ("Get the link to the recordings", "url"), ("What did Priya say about forwarding the warning?", None),
    ("Who mentioned the forwarded warning?", None), ("Find messages that were not forwarded", None), ("Show a PDF or image about books", None), ("What did Priya not forward?", None), ("Show messages discussing the PDF", None),
]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def iso(d):
    return None if d is None else d.isoformat()


def test_date_phrases(spark):
    got = {r["query_id"]: r for r in annotate.date_bounds(table(spark, [d[0] for d in DATES]), TODAY).collect()}
    for i, (text, start, end) in enumerate(DATES):
        assert (iso(got[i]["start"]), iso(got[i]["end"]), list(got[i]["warnings"])) == (start, end, []), text


def test_refused_and_plain_dates(spark):
    for r in annotate.date_bounds(table(spark, REFUSED), TODAY).collect():
        assert r["start"] is None and r["warnings"], REFUSED[r["query_id"]]
    for r in annotate.date_bounds(table(spark, PLAIN), TODAY).collect():
        assert r["start"] is None and not r["warnings"], PLAIN[r["query_id"]]


@pytest.mark.parametrize("day,text,start,end", OTHER_DAYS)
def test_reference_days(spark, day, text, start, end):
    r = annotate.date_bounds(table(spark, [text]), day).first()
    assert (iso(r["start"]), iso(r["end"])) == (start, end)


@pytest.fixture(scope="module")
def aliases(spark):
    return io.alias_dim(spark.createDataFrame([(0, "Priya Sharma"), (1, "Rahul Verma"), (2, "Aman Khan")], "ord int, name string"))


def test_chat_dates_and_event_dates(spark, aliases):
    got = {r["query_id"]: r for r in annotate.interpret(table(spark, [c[0] for c in CHAT_DATES]), aliases, TODAY).collect()}
    for i, (text, start, end, hours) in enumerate(CHAT_DATES):
        assert (iso(got[i]["start"]), iso(got[i]["end"])) == (start, end), text
        assert (got[i]["hour_lo"], got[i]["hour_hi"]) == (hours or (None, None)), text


def test_people(spark, aliases):
    got = {r["query_id"]: r for r in annotate.interpret(table(spark, [p[0] for p in PEOPLE]), aliases, TODAY).collect()}
    for i, (text, person, mode) in enumerate(PEOPLE):
        if text != "Priya - Sharma said":  # two mentions, of one person
            assert (got[i]["person"], got[i]["mode"]) == (person, mode), text
    assert got[13]["person"] == "Priya Sharma"


def test_shared_first_name(spark):
    two = io.alias_dim(spark.createDataFrame([(0, "Priya Sharma"), (1, "Priya Patel")], "ord int, name string"))
    got = {r["query_id"]: r for r in annotate.interpret(table(spark, ["Priya ne kya bola?", "Priya Patel ne kya bola?"]), two, TODAY).collect()}
    assert got[0]["person"] is None and got[0]["warnings"] and got[1]["person"] == "Priya Patel" and got[1]["mode"] == "filter"


def test_types(spark):
    got = {r["query_id"]: r["t"] for r in table(spark, [t[0] for t in TYPES]).select("query_id", annotate.type_request(F.col("query")).alias("t")).collect()}
    assert [got[i] for i in range(len(TYPES))] == [t[1] for t in TYPES]


def search(spark, rows, queries, k=5):
    docs = spark.createDataFrame(rows, "id string, text string")
    postings, idf = lexical.tfidf_index(docs)
    return [(r["query_id"], r["id"], r["lexical"]) for r in lexical.lexical_topk(table(spark, queries), postings, idf, k).orderBy("query_id", "rank").collect()]


def test_lexical_examples(spark):
    rows = [("1", "Fresh sandwiches at the canteen"), ("2", "Database transactions and indexing practice"), ("3", "Badminton doubles tournament tonight")]
    got = search(spark, rows, [rows[1][1], "canteen practice tournament", "sandwches", "DATABASE TRANSACTIONS", " ", "zzzzzzzzzzzz"])
    of = lambda q: [x for x in got if x[0] == q]
    assert of(0)[0][1] == "2" and of(0)[0][2] == pytest.approx(1.0) and {x[1] for x in of(1)} == {"1", "2", "3"}
    assert of(2)[0][1] == "1" and 0 < of(2)[0][2] <= 0.3 and of(3)[0][1] == "2" and not of(4) and not of(5)


def test_lexical_ties_and_emoji(spark):
    assert [x[1] for x in search(spark, [("c", "same text"), ("a", "same text"), ("b", "same text")], ["same text"])] == ["a", "b", "c"]
    assert search(spark, [("1", "😂"), ("2", "👍👍")], ["😂"])[0][1] == "1"
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            lexical.check_k(bad)


def slow_char_terms(text):
    out = []
    for word in text.split():
        w = f" {word} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return sorted(out)


def test_char_terms(spark):
    texts = ["a bc def ghij klmno", "", "  x  ", "naïve 日本語 😂"]
    for r in table(spark, texts).select("query", T.char_terms(F.col("query")).alias("t")).collect():
        assert sorted(r["t"]) == slow_char_terms(r["query"])


def test_content_words(spark):
    pairs = [("What made a seaside holiday unaffordable?", {"made", "seaside", "holiday", "unaffordable"}), ("Goa rejected for this break because total exceeds our cap", {"goa", "rejected", "break", "total", "exceeds", "cap"}), ("I can't, won't; they’ll don't Priya's Ｆｕｌｌ STRASSE straße", {"not", "priya", "full", "strasse"})]
    for r in table(spark, [p[0] for p in pairs]).select("query_id", T.content_words(F.col("query")).alias("w")).collect():
        assert set(r["w"]) == pairs[r["query_id"]][1]


def chat(spark, rows):
    return spark.createDataFrame([(i, datetime.datetime(2026, 8, 1) + datetime.timedelta(seconds=s), t) for i, s, t in rows], "id string, ts timestamp, text string")


def test_context_examples(spark):
    got = {r["id"]: [m["id"] for m in r["ctx"]] for r in context.context_window(chat(spark, [(str(i), 60 * i, "x") for i in range(1, 8)])).collect()}
    assert got["1"] == ["1", "2", "3"] and got["4"] == ["2", "3", "4", "5", "6"] and got["7"] == ["5", "6", "7"]
    got = {r["id"]: [m["id"] for m in r["ctx"]] for r in context.context_window(chat(spark, [("1", 60, "x"), ("2", 60, "x"), ("3", 6000, "x")])).collect()}
    assert got["1"] == ["1", "2"] and got["3"] == ["3"]
    got = {r["id"]: [m["id"] for m in r["ctx"]] for r in context.context_window(chat(spark, [("Z", 0, "x"), ("A", 0, "x"), ("M", 0, "x")])).collect()}
    assert got["M"] == ["A", "M", "Z"]
    with pytest.raises(ValueError):
        context.context_window(chat(spark, [("1", 0, "x")]), 3)


def test_windows_equal_a_global_sort(spark):
    rng = random.Random(4)
    rows, second = [], 0
    for i in range(400):
        second += rng.choice([0, 1, 60, 500, 1700, 1800, 1801, 7000, 90000])
        rows.append((f"{rng.randrange(10**6):06d}{i}", second, "x"))
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["id"]: r for r in context.display_window(chat(spark, rows).withColumns({"sender": F.lit("a"), "timestamp": F.lit(""), "message_type": F.lit("text")})).collect()}
    for k, (i, s, _) in enumerate(order):
        near = lambda part: [x[0] for x in part if abs(x[1] - s) <= 1800]  # noqa: E731, B023
        assert [m["id"] for m in got[i]["previous"]] == near(order[max(0, k - 3) : k]) and [m["id"] for m in got[i]["next"]] == near(order[k + 1 : k + 4])


def slow_fit(texts, at, budget):
    tokens = [t.split() for t in texts]
    label = lambda i: ["Previous", "message:"] if i < at else ["Current", "message:"] if i == at else ["Following", "message:"]
    total = lambda: sum(len(t) + 2 for t in tokens if t)
    if total() <= budget:
        return "\n".join(" ".join(label(i)) + " " + t for i, t in enumerate(texts) if t.strip()), []
    first = [len(t) for t in tokens]
    while (excess := total() - budget) > 0:
        others = [i for i in range(len(tokens)) if i != at and tokens[i]]
        i = max(others, key=lambda i: (len(tokens[i]), -i)) if others else at
        del tokens[i][-min(len(tokens[i]), excess) :]
    return "\n".join(" ".join(label(i) + t) for i, t in enumerate(tokens) if t), [i for i, t in enumerate(tokens) if len(t) < first[i]]


def test_budget_equals_the_loop(spark):
    rng = random.Random(9)
    cases = []
    for n in range(150):
        texts = [" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 5, 9, 20]))) + rng.choice(["", "  "]) for _ in range(rng.randint(1, 5))]
        at = rng.randrange(len(texts))
        texts[at] = texts[at] if texts[at].strip() else "own"
        cases.append((f"{n}-{at}", [(0, f"{n}-{i}", t) for i, t in enumerate(texts)]))
    df = spark.createDataFrame(cases, "id string, ctx array<struct<t:long,id:string,text:string>>")
    for budget in (8, 13, 24):
        for r in context.fit_budget(df, budget).collect():
            at = int(r["id"].split("-")[1])
            want, trimmed = slow_fit([m["text"] for m in r["ctx"]], at, budget)
            assert r["fitted"] == want and [int(x.split("-")[1]) for x in r["trimmed"]] == trimmed, r
    with pytest.raises(ValueError):
        context.fit_budget(df, 7)


def test_metrics_example(spark):
    labels = spark.createDataFrame([(1, "a", "semantic", True), (2, "b", "person", False), (3, "c", "time", False), (4, "d", "semantic", True)], "query_id long, expected_id string, category string, hard boolean")
    hits = spark.createDataFrame([("m", q, r, i) for q, ids in ((1, "ax"), (2, "xyb"), (4, "xyzd")) for r, i in enumerate(ids, 1)], "method string, query_id long, rank int, id string")
    rows = evaluate.run_rows(labels, hits, spark.createDataFrame([("m",)], "method string"))
    got = {r["part"]: (r["correct"], r["total"], r["percent"]) for r in evaluate.metrics(rows).collect()}
    assert got["top1"] == (1, 4, 25.0) and got["recall_at_3"] == (2, 4, 50.0) and got["hard_top1"] == (1, 2, 50.0) and got["gap"][2] == -25.0
    assert got["category semantic"][:2] == (1, 2) and got["category person"][:2] == (0, 1)
    none = {r["part"]: r["percent"] for r in evaluate.metrics(rows.where("not hard")).collect()}
    assert none["hard_top1"] is None and none["gap"] is None
    with pytest.raises(Exception, match="needed"):
        evaluate.compare_all(rows).collect()


def test_hybrid_score_example(spark):
    constraints = spark.createDataFrame([(1, True)], "query_id long, has_filter boolean")
    signals = spark.createDataFrame([(1, "A", 0.8, 0.4, 0.2, False, False, True), (1, "B", 0.0, 0.0, 0.0, True, True, True)], "query_id long, id string, semantic double, contextual double, lexical double, person_match boolean, date_match boolean, eligible boolean")
    both = fuse.hybrid_scores(signals.withColumn("person_match", F.lit(True)).withColumn("date_match", F.lit(True)), fuse.weights(constraints, fuse.profiles(spark).where("profile = 'context_first'")))
    got = {r["id"]: r["score"] for r in both.collect()}
    assert got["A"] == pytest.approx(0.45 * 0.4 + 0.3 * 0.8 + 0.15 * 0.2 + 0.1) and got["B"] == pytest.approx(0.1)


def test_eligible_uses_the_local_day(spark):
    rows = spark.createDataFrame([("a", datetime.datetime(2026, 8, 30, 20), "p", "text"), ("b", datetime.datetime(2026, 8, 30, 18), "p", "text")], "id string, ts timestamp, sender string, message_type string")
    day = datetime.date(2026, 8, 31)
    asked = spark.createDataFrame([(1, None, "none", day, day, None, None, None)], "query_id long, person string, mode string, start date, end date, hour_lo int, hour_hi int, message_type string")
    assert [r["id"] for r in fuse.eligible(asked, rows, "Asia/Kolkata").collect()] == ["a"]


def test_read_messages_rules(spark, tmp_path):
    good = {"id": "1", "timestamp": "2026-08-01T10:00:00+05:30", "sender": "a", "text": "x"}
    lines = [(good, ""), (good | {"id": "2", "timestamp": "2026-08-01T10:00:00"}, "no offset"), (good | {"id": 5}, "bad id"), (good | {"id": "3", "text": " "}, "bad text"), (good | {"id": "4", "message_type": "poem"}, "unknown type"),
             (good | {"id": "6", "message_type": "pdf"}, "duplicate id"), (good | {"id": "6"}, "duplicate id"), ({k: v for k, v in good.items() if k != "sender"} | {"id": "7"}, "bad sender")]
    raw = [json.dumps(x) for x, _ in lines] + ["{broken", "[1]", '"text"', ""]
    (tmp_path / "m.jsonl").write_text("\n".join(raw))
    got = {r["line"]: ",".join(r["problems"]) for r in io.read_messages(spark, str(tmp_path / "m.jsonl")).collect()}
    assert len(got) == 11 and all(got[json.dumps(x)] == want for x, want in lines) and all(got[x] == "no object" for x in raw[-4:-1])
    with pytest.raises(Exception, match="bad id"):
        io.read_messages(spark, str(tmp_path / "m.jsonl"), fail_fast=True).where("id = '5'").collect()


def test_metadata_rules(spark, tmp_path):
    good = {"reference_date": TODAY, "timezone": "Asia/Kolkata", "participants": [{"id": "P1", "name": "Priya Sharma"}, {"id": "P2", "name": "Aman Khan"}]}
    for n, (change, what) in enumerate([({}, None), ({"reference_date": "2026-9-1"}, "ISO"), ({"timezone": " "}, "zone"), ({"participants": []}, "participants"), ({"participants": [{"id": "1", "name": "A"}, {"id": "2", "name": " a "}]}, "distinct")]):
        (tmp_path / f"{n}.json").write_text(json.dumps(good | change))
        if what:
            with pytest.raises(Exception, match=what):
                io.read_metadata(spark, str(tmp_path / f"{n}.json")).collect()
        else:
            assert [r["name"] for r in io.read_metadata(spark, str(tmp_path / f"{n}.json")).orderBy("ord").collect()] == ["Priya Sharma", "Aman Khan"]


def test_row_rules_one_by_one(spark):
    base = {"id": "C000001_00", "text": "hi", "message_type": "text", "participant_id": "user", "sender": "user", "topic": "t", "episode_id": "e", "timestamp": "2026-03-01T00:00:00+00:00", "thread_id": None}
    changes = [("id", "X", "id"), ("text", " ", "text"), ("message_type", "poem", "known_type"), ("message_type", "pdf", "type_of_text"), ("participant_id", "ghost", "participant"), ("sender", "other", "sender"), ("topic", "", "topic"),
               ("timestamp", "2026-03-01T00:00:00", "offset"), ("timestamp", "2020-03-01T00:00:00+00:00", "dates"), ("thread_id", "T9", "thread")]
    people = spark.createDataFrame([("user", "user")], "participant_id string, participant_name string")
    schema = ", ".join(f"{k} string" for k in base)
    for column, value, rule in changes:
        rows = spark.createDataFrame([tuple((base | {column: value}).values())], schema)
        found = {r["rule"] for r in quality.row_violations(rows, people, ["T0"], r"^C\d{6}_\d{2}$", "2026-03-01", "2026-08-31").collect()}
        assert rule in found and found <= {rule, "sender"}, (rule, found)
    clean = spark.createDataFrame([tuple(base.values())], schema)
    assert quality.row_violations(clean, people, ["T0"], r"^C\d{6}_\d{2}$", "2026-03-01", "2026-08-31").count() == 0


def test_order_of_ids_across_partitions(spark):
    rows = chat(spark, [(f"{i:04d}", 60 * i, "x") for i in range(500)])
    assert quality.out_of_order(rows).first()["n"] == 0
    swapped = rows.withColumn("ts", F.when(F.col("id").isin("0100", "0250"), F.timestamp_seconds(F.lit(0))).otherwise(F.col("ts")))
    assert quality.out_of_order(swapped).first()["n"] == 2
    ids = {r["id"]: r["new_id"] for r in quality.assign_ids(rows.repartition(5)).collect()}
    assert all(ids[f"{i:04d}"] == f"MSG_{i + 1:06d}" for i in range(500))


def test_fingerprint_ignores_order_and_sees_nulls(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", None), ("", "b")], "x string, y string")
    one = quality.fingerprint(rows, ["x", "y"], "d").first()
    assert quality.fingerprint(rows.orderBy(F.desc("y")).repartition(3), ["x", "y"], "d").first() == one
    assert quality.fingerprint(rows.fillna(""), ["x", "y"], "d").first()["fingerprint"] != one["fingerprint"]


def test_dense_ties_and_signs(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [-1.0, 0.0])], "id string, vector array<double>")
    asks = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["id"], r["semantic"]) for r in dense.semantic_topk(asks, rows, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("c", -1.0)]
    assert [r["id"] for r in dense.semantic_topk(asks, rows, 1).collect()] == ["a"]


def test_store_encodes_only_new_texts(spark, tmp_path):
    texts, vector = table(spark, ["a", "b", "b"]).withColumnRenamed("query", "text"), F.array(F.lit(1.0))
    path = f"{tmp_path}/store"
    assert io.extend_store(texts, path, "one", vector).count() == 2 and io.extend_store(texts, path, "one", vector).count() == 2
    assert io.extend_store(texts, path, "two", vector).count() == 4


def test_mentions_by_look_up_by_hashes_and_by_join(spark):
    """All ways of finding people give the same rows, with overlapping, shared, repeated and no names, and null and empty questions."""
    people = spark.createDataFrame([(0, "Ann Lee"), (1, "Bob Lee"), (2, "Ann Marie Ray"), (3, "É Zoë")], "ord int, name string")
    asked = ["what did ann say", "Ann Lee, Bob Lee and ann marie ray", "Lee?", "  ", "", None, "ANN  LEE ann lee", "zoë's é zoë", "no one", "ray bob", "annlee ann-lee"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    aliases = io.alias_dim(people)
    ways = [{}, {"max_aliases": 2}, {"max_aliases": 2, "max_hashes": 2}]
    one, two, three = (sorted(map(repr, annotate.person_mentions(queries, aliases, **way).collect())) for way in ways)
    assert one == two == three and len(one) == len(asked)
    none = annotate.person_mentions(queries, aliases.limit(0)).collect()
    assert len(none) == len(asked) and all(r["person"] is None and list(r["candidates"]) == [] for r in none)


def test_mentions_among_a_million_aliases(spark):
    """Only what is among the aliases leaves its row: every third question names somebody, the others don't move."""
    names = F.concat(F.lit("p"), F.col("id").cast("string"))
    aliases = spark.range(1_000_000).select(names.alias("alias"), F.array(F.initcap(names)).alias("names"))
    aliases = aliases.unionByName(spark.createDataFrame([("p7 p8", ["Both"])], "alias string, names array<string>"))
    who = F.when(F.col("id") % 3 == 0, F.concat(F.lit("P"), (F.col("id") * 7919 % 1_000_000).cast("string"))).when(F.col("id") == 1, "p7 p8").otherwise("nobody of them")
    queries = spark.range(3_000).select(F.col("id").alias("query_id"), F.concat(F.lit("what did "), who, F.lit(" say about p and p1000000")).alias("query"))
    got = annotate.person_mentions(queries, aliases)
    want = {i: f"P{i * 7919 % 1_000_000}" if i % 3 == 0 else "Both" if i == 1 else None for i in range(3_000)}
    assert {r["query_id"]: r["person"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "inline(_found" in plan and "posexplode" not in plan


def test_dense_blocks_of_queries(spark, monkeypatch):
    """Queries are held a block at a time; the scores are those of one block."""
    rows = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(5)], "id string, vector array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(11)], "query_id long, vector array<double>").repartition(3)
    whole = sorted(dense.dense_scores(queries, rows, "id", "string", "s", -99.0, 99.0).collect())
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    monkeypatch.setattr(dense, "ROW_CHUNK", 2)
    assert sorted(dense.dense_scores(queries, rows, "id", "string", "s", -99.0, 99.0).collect()) == whole and len(whole) == 55
    assert dense.dense_scores(queries.limit(0), rows, "id", "string", "s", -1.0, 1.0).count() == 0


def test_channels_of_a_pair_in_one_pass(spark, monkeypatch):
    """Each channel has the scores that it has alone, in one block or several."""
    rows = spark.createDataFrame([(str(i), [float(i), 1.0], [1.0, -float(i)]) for i in range(5)], "id string, x array<double>, y array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(11)], "query_id long, vector array<double>")
    alone = [dense.dense_scores(queries, rows.select("id", F.col(c).alias("vector")), "id", "string", c, -9.0, 9.0) for c in ("x", "y")]
    want = sorted(alone[0].join(alone[1], ["query_id", "id"]).collect())
    for size in (dense.QUERY_BLOCK, 4):
        monkeypatch.setattr(dense, "QUERY_BLOCK", size)
        got = dense.dense_channels(queries, rows, "id", "string", {"x": "x", "y": "y"}, -9.0, 9.0)
        assert sorted(got.collect()) == want and len(want) == 55


def test_signals_test_constraints_as_eligible_does(spark):
    rows = spark.createDataFrame([(str(i), datetime.datetime(2026, 8, 29 + i % 3, 6 * i % 24), None if i == 7 else "pq"[i % 2], "text" if i % 3 else None) for i in range(8)], "id string, ts timestamp, sender string, message_type string")
    day = datetime.date(2026, 8, 30)
    asked = [(1, None, "none", day, day, None, None, None), (2, "p", "filter", None, None, None, None, None), (3, "q", "boost", None, None, 6, 12, None), (4, None, "none", None, None, None, None, "text"), (5, None, "none", None, None, None, None, None)]
    asked = spark.createDataFrame(asked, "query_id long, person string, mode string, start date, end date, hour_lo int, hour_hi int, message_type string")
    pairs = asked.select("query_id").crossJoin(rows.select("id")).withColumns({"semantic": F.lit(0.5), "contextual": F.lit(0.5)})
    lexical = pairs.where("query_id = 1").select("query_id", "id", F.lit(0.25).alias("lexical"))
    got = fuse.hybrid_signals(pairs, lexical, asked, rows, "Asia/Kolkata")
    want = fuse.eligible(asked, rows, "Asia/Kolkata")
    assert got.count() == 40 and sorted(got.where("eligible").select("query_id", "id").collect()) == sorted(want.collect())
    assert got.where("date_match").select("query_id", "id").exceptAll(want.where("query_id = 1")).count() == 0


def test_lexical_keep_on_both_ways(spark, monkeypatch):
    messages = spark.createDataFrame([(str(i), "budget " * (i % 3 + 1) + f"word{i}") for i in range(12)], "id string, text string")
    queries = spark.createDataFrame([(1, "budget word3"), (2, "nothing")], "query_id long, query string")
    postings, idf = lexical.tfidf_index(messages)
    asked = lexical.tfidf_query(queries, idf)
    one = sorted((r["query_id"], r["id"], round(r["lexical"], 9)) for r in lexical.top_k(lexical.lexical_score(asked, postings, "id", 3), "lexical", "id", 3).collect())
    monkeypatch.setattr(lexical, "QUERY_TERMS", 1)
    two = sorted((r["query_id"], r["id"], round(r["lexical"], 9)) for r in lexical.lexical_score(asked, postings, "id", 3).collect())
    assert one == two and len(one) == 3
