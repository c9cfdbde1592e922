"""The registered queries of the reference's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.functions import text as T
from parleylake.operators import annotate, cells, context, dense, evaluate, fuse, lexical, quality, ranges
from parleylake.plans import views
from parleylake.plans.views import MEANT_SQL, MESSAGES_SQL, PARTICIPANTS_SQL, RECORDS_SQL, REFERENCE_DATE, ZONE
from parleylake.sources import io, lexical_store
from parleylake.sources.work import folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores if its files have fewer splits than there are cores; larger tables aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def md5_of(array: str, separator: str = "|") -> F.Column:
    return F.md5(F.array_join(array, separator))


# sources and sinks


def _broken_lines(messages: DataFrame) -> DataFrame:
    """JSON lines of which some break one rule each."""
    k, good = views.number_of("id") % 23, F.to_json(F.struct("id", "timestamp", "sender", "text", "message_type"))
    line = F.when(k == 0, F.substring(good, 1, 20)).when(k == 1, F.lit("[1, 2]")).when(k == 2, F.regexp_replace(good, '"id":"[^"]*"', '"id":5'))
    line = line.when(k == 3, F.regexp_replace(good, r"\+00:00", "")).when(k == 4, F.regexp_replace(good, '"message_type":"[^"]*"', '"message_type":"poem"')).when(k == 5, F.regexp_replace(good, '"text":".*","message_type"', '"text":" ","message_type"'))
    return messages.select(line.otherwise(good).alias("value")).unionByName(messages.where(k == 6).select(good.alias("value")))


@query(f"""WITH {MESSAGES_SQL}, k AS (SELECT *, ('0x' || substr(md5(id), 1, 6))::BIGINT % 23 AS k FROM messages)
SELECT CASE WHEN k > 1 THEN CASE WHEN k = 2 THEN '5' ELSE id END END AS id, CASE WHEN k > 1 THEN CASE WHEN k = 3 THEN replace(timestamp, '+00:00', '') ELSE timestamp END END AS timestamp, CASE WHEN k > 1 THEN sender END AS sender,
 CASE WHEN k = 4 THEN 'poem' WHEN k < 2 THEN 'text' ELSE message_type END AS message_type, CASE WHEN k > 1 THEN md5(CASE WHEN k = 5 THEN ' ' ELSE text END) END AS text_md5,
 CASE k WHEN 0 THEN 'no object' WHEN 1 THEN 'no object' WHEN 2 THEN 'bad id' WHEN 3 THEN 'no offset' WHEN 4 THEN 'unknown type' WHEN 5 THEN 'bad text' WHEN 6 THEN 'duplicate id' ELSE '' END AS problems
FROM (SELECT * FROM k UNION ALL SELECT * FROM k WHERE k = 6)""")
def read_messages(spark, sf):
    path = folder(spark)
    _broken_lines(views.messages(spark, sf)).write.text(path)
    return io.read_messages(spark, path).select("id", "timestamp", "sender", "message_type", F.md5("text").alias("text_md5"), F.array_join("problems", ",").alias("problems"))


@query(f"WITH {MESSAGES_SQL} SELECT id, timestamp, sender, message_type, md5(text) AS text_md5 FROM messages")
def write_messages(spark, sf):
    path = folder(spark)
    io.write_messages(views.messages(spark, sf), path)
    return io.read_messages(spark, path, fail_fast=True).select("id", "timestamp", "sender", "message_type", F.md5("text").alias("text_md5"))


@query(f"WITH {PARTICIPANTS_SQL} SELECT row_number() OVER (ORDER BY ord)::INTEGER - 1 AS ord, 'P' || ord AS id, name, '{REFERENCE_DATE}' AS reference_date, '{ZONE}' AS zone FROM participants")
def read_metadata(spark, sf):
    people = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda p: F.struct(F.concat(F.lit("P"), p["ord"].cast("string")).alias("id"), p["name"].alias("name")))
    document = views.participants(spark, sf).agg(F.to_json(F.struct(F.lit(REFERENCE_DATE).alias("reference_date"), F.lit(ZONE).alias("timezone"), people.alias("participants"))).alias("value"))
    path = folder(spark)
    document.write.text(path)
    return io.read_metadata(spark, path)


LABELS_SQL = """
labels_ AS (SELECT o_orderkey AS query_id, printf('Q%03d', o_orderkey) AS label_id, 'order ' || o_orderkey || ' budget' AS query, o_custkey::VARCHAR AS expected_id, o_orderpriority AS category, o_orderstatus = 'F' AS hard,
  (o_orderkey // 2)::VARCHAR AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'english' ELSE 'hinglish' END AS language FROM orders)"""
HITS_SQL = f"""{LABELS_SQL},
methods AS (SELECT unnest([0, 1, 2, 3]) AS j), names AS (SELECT j, ['lexical', 'semantic', 'contextual', 'hybrid'][j + 1] AS method FROM methods),
hits AS (SELECT method, query_id, r AS rank, CASE WHEN (query_id * 7 + j * 3 + r) % 5 = 0 THEN expected_id ELSE (expected_id::BIGINT + r + 1)::VARCHAR END AS id
  FROM labels_, names, (SELECT unnest([1, 2, 3]) AS r) WHERE r <= (query_id + j) % 4),
runs AS (SELECT method, l.*, coalesce(ids, []) AS ids, coalesce(ids[1] = expected_id, false) AS top1, coalesce(list_contains(ids, expected_id), false) AS recalled
  FROM labels_ l CROSS JOIN names LEFT JOIN (SELECT method, query_id, list(id ORDER BY rank) AS ids FROM hits GROUP BY ALL) h USING (method, query_id))"""


def labels(spark, sf):
    """A label for every order."""
    o = views.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("query_id"), F.format_string("Q%03d", "o_orderkey").alias("label_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" budget")).alias("query"),
        F.col("o_custkey").cast("string").alias("expected_id"), F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("hard"), F.floor(F.col("o_orderkey") / 2).cast("string").alias("pair_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "english").otherwise("hinglish").alias("language"),
    )


def method_names(spark):
    return spark.createDataFrame([(i, m) for i, m in enumerate(evaluate.METHODS)], "j int, method string")


def ranked(spark, sf):
    """Rankings of four methods for every label, up to three hits each, made from the order's number."""
    rows = labels(spark, sf).crossJoin(F.broadcast(method_names(spark))).select("*", F.explode(F.lit([1, 2, 3])).alias("rank")).where(F.col("rank") <= (F.col("query_id") + F.col("j")) % 4)
    right = (F.col("query_id") * 7 + F.col("j") * 3 + F.col("rank")) % 5 == 0
    return rows.select("method", "query_id", "rank", F.when(right, F.col("expected_id")).otherwise((F.col("expected_id").cast("long") + F.col("rank") + 1).cast("string")).alias("id"), (F.lit(1.0) / F.col("rank")).alias("score"))


def runs(spark, sf):
    return evaluate.run_rows(labels(spark, sf), ranked(spark, sf), method_names(spark).select("method"))


@query(f"WITH {LABELS_SQL} SELECT label_id AS id, query, expected_id AS expected_message_id, category, hard AS zero_word_overlap, pair_id, language FROM labels_")
def read_labels(spark, sf):
    path, rows = folder(spark), labels(spark, sf)
    one = F.to_json(F.struct(F.col("label_id").alias("id"), "query", F.col("expected_id").alias("expected_message_id"), "category", F.col("hard").alias("zero_word_overlap"), "pair_id", "language"))
    rows.groupBy(F.floor(F.col("query_id") / 1000).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    return io.read_labels(spark, path).drop("notes", "file")


@query(f"""WITH {PARTICIPANTS_SQL}, a AS (SELECT ord, name, unnest(list_distinct([lower(name), split_part(lower(name), ' ', 1), split_part(lower(name), ' ', 2)])) AS alias FROM participants)
SELECT alias, string_agg(name, '|' ORDER BY ord) AS names FROM a GROUP BY alias""")
def alias_dim(spark, sf):
    return io.alias_dim(views.participants(spark, sf)).withColumn("names", F.array_join("names", "|"))


@query(f"WITH {HITS_SQL} SELECT method, count(*) AS n, count_if(top1) AS top1 FROM runs GROUP BY method")
def write_reports(spark, sf):
    path, rows = folder(spark), runs(spark, sf)
    io.write_reports(evaluate.metrics(rows), rows, path, 4)
    return io.read_reports(spark, path, "rows").groupBy("method").agg(F.count("*").alias("n"), F.count_if("top1_correct").alias("top1"))


@query(f"WITH {MESSAGES_SQL} SELECT DISTINCT sha256('words-64' || chr(31) || text) AS key FROM messages WHERE sha256('words-64' || chr(31) || text) NOT IN (SELECT sha256('words-64' || chr(31) || text) FROM messages WHERE chat_id % 2 = 0)")
def embedding_store(spark, sf):
    """The store holds the texts of half the chats; what is new in the others is encoded and appended."""
    rows, path, vector = views.messages(spark, sf), folder(spark), dense.hashed_vector(F.col("text"))
    before = io.extend_store(rows.where("chat_id % 2 = 0"), path, "words-64", vector).select("key")
    old = written(before)
    return io.extend_store(rows, path, "words-64", vector).select("key").join(old, "key", "left_anti")


# data quality


@query(f"WITH {MESSAGES_SQL} SELECT id, message_type FROM messages")
def classify_type(spark, sf):
    return views.messages(spark, sf).select("id", T.classify_type(F.col("text")).alias("message_type"))


def known(spark, sf):
    return views.table(spark, sf, "conversations").select(F.col("role").alias("participant_id"), F.col("role").alias("participant_name")).distinct()


DIRTY_SQL = f"""{RECORDS_SQL},
placed AS (SELECT *, ('0x' || substr(md5(id), 1, 6))::BIGINT % 97 AS k, printf('MSG_%06d', row_number() OVER (ORDER BY t, id)) AS pos FROM records),
dirty AS (SELECT t, k, participant_id, episode_id, CASE WHEN k = 7 THEN 'Z' || pos ELSE pos END AS id, CASE WHEN k = 0 THEN '  ' ELSE text END AS text, CASE WHEN k = 3 THEN 'nobody' ELSE sender END AS sender,
  CASE WHEN k = 1 THEN 'poem' WHEN k = 2 THEN CASE WHEN message_type = 'pdf' THEN 'image' ELSE 'pdf' END ELSE message_type END AS message_type, CASE WHEN k = 4 THEN timestamp[:19] ELSE timestamp END AS timestamp,
  CASE WHEN k = 5 THEN 'X9' ELSE thread_id END AS thread_id, CASE WHEN k <> 6 THEN topic END AS topic FROM placed)"""


@query(f"""WITH {DIRTY_SQL},
p AS (SELECT *, row_number() OVER (ORDER BY t, id) AS place, ['text', 'forwarded', 'url', 'image', 'pdf', 'voice'] AS types, (SELECT list(DISTINCT role) FROM conversations) AS known,
  CASE WHEN starts_with(text, '[Image]') THEN 'image' WHEN starts_with(text, '[PDF]') THEN 'pdf' WHEN starts_with(text, '[Voice message]') THEN 'voice' WHEN starts_with(text, 'Forwarded:') THEN 'forwarded' WHEN contains(text, 'https://') THEN 'url' ELSE 'text' END AS told FROM dirty),
b AS (SELECT id, unnest(['id', 'text', 'known_type', 'type_of_text', 'participant', 'sender', 'topic', 'offset', 'dates', 'thread', 'sequence']) AS rule,
  unnest([regexp_matches(id, '^MSG_[0-9]{{6,}}$'), trim(text) <> '', list_contains(types, message_type), trim(text) = '' OR NOT list_contains(types, message_type) OR message_type = told, list_contains(known, participant_id), sender = participant_id,
    topic IS NOT NULL AND trim(topic) <> '' AND trim(episode_id) <> '', ends_with(timestamp, '+00:00'), timestamp[:10] BETWEEN '2026-03-01' AND '2027-12-31', thread_id IS NULL OR thread_id IN ('T0', 'T1', 'T2'), id = printf('MSG_%06d', place)]) AS ok FROM p)
SELECT id, rule FROM b WHERE NOT ok""")
def row_violations(spark, sf):
    """Records with ids in sequence, of which some break rules by their number."""
    return quality.row_violations(views.dirty(quality.assign_ids(views.records(spark, sf))), known(spark, sf), ["T0", "T1", "T2"], r"^MSG_\d{6,}$", "2026-03-01", "2027-12-31", sequence="MSG_%06d")


@query(f"""WITH {RECORDS_SQL}, f AS (SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT ts::DATE) AS days, count(DISTINCT strftime(ts, '%Y-%m')) AS months, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span, count(DISTINCT message_type) AS types,
  list_sort(list(DISTINCT sender)) AS senders, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, arg_min(timestamp, (t, id)) AS start, arg_max(timestamp, (t, id)) AS stop FROM records),
l AS (SELECT count_if(t < b) AS late FROM (SELECT t, lag(t) OVER (ORDER BY id) AS b FROM records)), k AS (SELECT list_sort(list(DISTINCT role) || ['moderator']) AS names FROM conversations)
SELECT unnest(['unique_ids', 'senders', 'chronological', 'message_count', 'days', 'months', 'first_day', 'last_day', 'start', 'end', 'span', 'all_types']) AS rule,
 unnest([n = ids, senders = names, late = 0, n = 4634, days = 184, months = 6, first_day = '2026-03-01', last_day = '2026-08-31', start = '2026-03-01T01:35:00+00:00', stop = '2026-08-31T18:00:00+00:00', span >= 183, types = 6]) AS ok FROM f, l, k""")
def dataset_violations(spark, sf):
    """Against the facts of another corpus, and with a participant who never speaks."""
    silent = known(spark, sf).unionByName(spark.createDataFrame([("moderator", "moderator")], "participant_id string, participant_name string"))
    expected = {"messages": 4634, "days": 184, "months": 6, "span_days": 183, "first_day": "2026-03-01", "last_day": "2026-08-31", "start": "2026-03-01T01:35:00+00:00", "end": "2026-08-31T18:00:00+00:00"}
    return quality.dataset_violations(views.records(spark, sf), silent, expected)


@query(f"""WITH {RECORDS_SQL} SELECT unnest(['reply haan', 'reply done', 'reply ok', 'reply 😂', 'mark [Image]', 'mark [PDF]', 'mark [Voice message]', 'mark Forwarded:', 'mark https://', 'mixed language', 'typos', 'topics']) AS rule,
 unnest([bool_or(text = 'haan'), bool_or(text = 'done'), bool_or(text = 'ok'), bool_or(text = '😂'), bool_or(contains(text, '[Image]')), bool_or(contains(text, '[PDF]')), bool_or(contains(text, '[Voice message]')), bool_or(contains(text, 'Forwarded:')),
  bool_or(contains(text, 'https://')), bool_or(regexp_matches(text, '\\b(hai|nahi|kya|yaar|mat)\\b')), bool_or(regexp_matches(text, 'thnks|nhi|sorryyy|birhtday')), count(DISTINCT topic) = 9]) AS ok FROM records""".replace("\\\\", "\\"))
def variety_checks(spark, sf):
    return quality.variety_checks(views.records(spark, sf), views.TOPICS)


@query(f"""WITH RECURSIVE {RECORDS_SQL}, dg(thread_id, i, n, h) AS (
  SELECT thread_id, (p - 1) // {quality.PIECE}, (n + {quality.PIECE - 1}) // {quality.PIECE}, md5(string_agg(id, ',' ORDER BY p))
  FROM (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY t, id) AS p, count(*) OVER (PARTITION BY thread_id) AS n FROM records WHERE thread_id IS NOT NULL) GROUP BY ALL
  UNION ALL SELECT thread_id, i // {quality.PIECE}, (n + {quality.PIECE - 1}) // {quality.PIECE}, md5(string_agg(h, ',' ORDER BY i)) FROM dg WHERE n > 1 GROUP BY thread_id, i // {quality.PIECE}, (n + {quality.PIECE - 1}) // {quality.PIECE}),
th AS (SELECT thread_id, count(*) AS n, arg_min(id, (t, id)) AS first_id, arg_max(id, (t, id)) AS last_id, count(DISTINCT episode_id) AS episodes,
  count(DISTINCT ts::DATE) AS days, count(DISTINCT sender) AS senders, max(t) - min(t) >= 14 * 86400 AS two_weeks, min(t) AS lo, max(t) AS hi FROM records WHERE thread_id IS NOT NULL GROUP BY thread_id)
SELECT thread_id, n, first_id, last_id, (SELECT h FROM dg WHERE dg.n = 1 AND dg.thread_id = th.thread_id) AS ids_md5, episodes, days, senders, two_weeks, (SELECT count(*) FROM records r WHERE r.t > lo AND r.t < hi AND r.thread_id IS DISTINCT FROM th.thread_id) AS "foreign",
 array_to_string(list_filter([CASE WHEN thread_id = 'T1' THEN 'count' END, CASE WHEN thread_id = 'T1' THEN 'members' END, CASE WHEN NOT (first_id < con AND con < last_id) THEN 'conclusion' END], lambda x: x IS NOT NULL), ',') AS problems
FROM th JOIN (SELECT thread_id, CASE WHEN thread_id = 'T2' THEN max(id) ELSE arg_min(id, md5(id)) END AS con FROM records WHERE thread_id IS NOT NULL GROUP BY thread_id) USING (thread_id)
UNION ALL SELECT 'T9', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing'""")
def thread_audit(spark, sf):
    """Against metadata with one message too many in T1, T2's last message for its conclusion, and a thread that isn't there."""
    records, held = views.records(spark, sf), F.col("thread_id") == "T1"
    audit = written(quality.thread_audit(records))
    told = audit.select("thread_id", (F.col("n") + held.cast("int")).alias("message_count"), F.col("first_id").alias("first_message_id"), F.col("last_id").alias("last_message_id"), F.when(held, "x").otherwise(F.col("ids_md5")).alias("ids_md5"))
    ends = records.where("thread_id is not null").groupBy("thread_id").agg(F.when(F.first("thread_id") == "T2", F.max("id")).otherwise(F.min_by("id", F.md5("id"))).alias("conclusion_id"))
    absent = spark.createDataFrame([("T9", 1, "a", "b", "c", "d")], "thread_id string, message_count long, first_message_id string, last_message_id string, ids_md5 string, conclusion_id string")
    return quality.against_metadata(audit, records, told.join(ends, "thread_id").unionByName(absent)).withColumn("problems", F.array_join("problems", ","))


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT unnest(['text', 'forwarded', 'url', 'image', 'pdf', 'voice', 'poem']) AS value, unnest([4324, 44, 51, 134, 24, 57, 3]) AS expected), o AS (SELECT message_type AS value, count(*) AS n FROM records GROUP BY 1)
SELECT value, coalesce(n, 0) AS n, coalesce(expected, 0)::BIGINT AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok FROM o FULL JOIN e USING (value)""")
def type_counts(spark, sf):
    expected = spark.createDataFrame([("text", 4324), ("forwarded", 44), ("url", 51), ("image", 134), ("pdf", 24), ("voice", 57), ("poem", 3)], "value string, expected long")
    return quality.counts_against(views.records(spark, sf), "message_type", expected)


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT topic AS value, count(*) AS expected FROM records WHERE chat_id % 5 > 0 GROUP BY 1), o AS (SELECT topic AS value, count(*) AS n FROM records GROUP BY 1)
SELECT value, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok FROM o FULL JOIN e USING (value)""")
def topic_counts(spark, sf):
    rows = views.records(spark, sf)
    return quality.counts_against(rows, "topic", rows.where("chat_id % 5 > 0").groupBy(F.col("topic").alias("value")).agg(F.count("*").alias("expected")))


@query(f"WITH {MESSAGES_SQL} SELECT count(*) AS messages, count(DISTINCT sender) AS participants, arg_min(timestamp, (t, id)) AS first, arg_max(timestamp, (t, id)) AS last, (date_diff('month', min(ts), max(ts)) + 1)::INTEGER AS months, '{REFERENCE_DATE}' AS reference_date, '{ZONE}' AS zone FROM messages")
def corpus_stats(spark, sf):
    return quality.corpus_stats(views.messages(spark, sf), REFERENCE_DATE, ZONE)


@query(f"WITH {MESSAGES_SQL} SELECT message_type, count(*) AS n, count_if(len(regexp_extract_all(text, '\\S+')) = 1) AS single_token FROM messages GROUP BY 1")
def text_profile(spark, sf):
    return quality.text_profile(views.messages(spark, sf))


@query(f"WITH {MESSAGES_SQL}, k AS (SELECT 'assistant' AS name UNION SELECT n_name FROM nation) SELECT name, 'unknown sender' AS side FROM (SELECT sender AS name FROM messages EXCEPT SELECT name FROM k) UNION ALL SELECT name, 'silent participant' FROM (SELECT name FROM k EXCEPT SELECT sender FROM messages)")
def sender_mismatch(spark, sf):
    people = views.table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("assistant",)], "name string"))
    return quality.sender_mismatch(views.messages(spark, sf), people)


@query(f"WITH {MESSAGES_SQL} SELECT id, printf('MSG_%06d', row_number() OVER (ORDER BY t, id)) AS new_id FROM messages")
def assign_ids(spark, sf):
    return quality.assign_ids(views.messages(spark, sf).select("id", "ts")).select("id", "new_id")


def _fingerprint_sql(name: str, columns: str, source: str) -> str:
    return f"SELECT '{name}' AS dataset, count(*) AS n, sum(('0x' || substr(sha256(concat_ws(chr(31), {columns})), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS fingerprint FROM {source}"


@query(f"""WITH {MESSAGES_SQL}, fp AS ({_fingerprint_sql('messages', 'id, timestamp, sender, text', 'messages')} UNION ALL {_fingerprint_sql('benchmark', 'item_id, text', 'benchmark')} UNION ALL {_fingerprint_sql('labels', 'doc_id, quality', 'labels')})
SELECT dataset, n, fingerprint, CASE dataset WHEN 'benchmark' THEN 'same' WHEN 'messages' THEN 'changed' ELSE 'not listed' END AS state FROM fp UNION ALL SELECT 'pages', NULL, NULL, 'missing'""")
def fingerprint(spark, sf):
    """Three tables against a manifest that lists one as it is, one with another count, and one that isn't there."""
    of = lambda name, columns, rows: quality.fingerprint(rows, columns, name)
    bench = of("benchmark", ["item_id", "text"], views.table(spark, sf, "benchmark"))
    found = of("messages", ["id", "timestamp", "sender", "text"], views.messages(spark, sf)).unionByName(bench).unionByName(of("labels", ["doc_id", "quality"], views.table(spark, sf, "labels")))
    manifest = bench.unionByName(spark.createDataFrame([("messages", -1, "0"), ("pages", 1, "0")], "dataset string, n long, fingerprint string"))
    return quality.against_manifest(found, manifest)


# text


def documents(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", "text")


@query(r"SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))) AS normal_md5 FROM documents")
def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal_md5"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents")
def fold_accents(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("folded_md5"))


WORDS_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+') AS w, strip_accents(lower(text)) AS f FROM documents)"""


@query(f"WITH {WORDS_SQL} SELECT doc_id, (2 * len(w) - 1)::INTEGER AS n, md5(array_to_string(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), '|')) AS terms_md5 FROM w")
def word_terms(spark, sf):
    return documents(spark, sf).select("doc_id", T.word_terms(T.fold_accents(F.col("text"))).alias("t")).select("doc_id", F.size("t").alias("n"), md5_of("t").alias("terms_md5"))


CHARS_SQL = r"""p AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(strip_accents(lower(text)), '\S+'), lambda x: ' ' || x || ' ')) AS p FROM documents),
c AS (SELECT doc_id, unnest(flatten(list_transform([3, 4, 5], lambda n: CASE WHEN n = 3 OR length(p) >= n THEN list_transform(generate_series(1, greatest(length(p) - n + 1, 1)), lambda i: substr(p, i, n)) ELSE [] END))) AS term FROM p)"""


@query(f"WITH {CHARS_SQL} SELECT doc_id, count(*) AS n, count(DISTINCT term) AS distinct_terms, min(term) AS first_term, max(term) AS last_term FROM c GROUP BY doc_id")
def char_terms(spark, sf):
    return lexical.char_profile(documents(spark, sf), "doc_id")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
SPELT_SQL = "replace(replace(lower({0}), 'ß', 'ss'), '’', '''')"
for _pattern, _full in T.ENDINGS:
    SPELT_SQL = f"regexp_replace({SPELT_SQL}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_full}', 'g')"
CONTENT_SQL = f"list_sort(list_filter(list_distinct(regexp_extract_all({SPELT_SQL}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')), lambda x: NOT list_contains({STOP_SQL}, x)))"


@query(f"SELECT doc_id, len(c)::INTEGER AS n, md5(array_to_string(c, '|')) AS words_md5 FROM (SELECT doc_id, {CONTENT_SQL.format('text')} AS c FROM documents)")
def content_words(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_sort(T.content_words(F.col("text"))).alias("c")).select("doc_id", F.size("c").alias("n"), md5_of("c").alias("words_md5"))


@query(f"""WITH l AS (SELECT *, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents), c AS (SELECT doc_id, {CONTENT_SQL.format('text')} AS a, {CONTENT_SQL.format('other')} AS b FROM l WHERE other IS NOT NULL)
SELECT doc_id, len(list_intersect(a, b))::INTEGER AS shared, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 AS zero_overlap FROM c""")
def zero_overlap(spark, sf):
    """Each document and the next of its source: words are taken once a document, narrow rows are numbered by ranges, and words meet by id."""
    docs = views.table(spark, sf, "documents")
    words = written(docs.select("doc_id", "source", F.when(F.col("text").isNotNull(), T.content_words(F.col("text"))).alias("w")))
    placed = written(ranges.numbered(words.select("source", "doc_id"), ["doc_id"], "place", within=["source"]))
    after = placed.select(F.col("source").alias("of"), F.col("doc_id").alias("next_id"), (F.col("place") - 1).alias("before"))
    pairs = placed.join(after, F.col("source").eqNullSafe(F.col("of")) & (F.col("place") == F.col("before"))).select("doc_id", "next_id")
    rows = pairs.join(words.select("doc_id", F.coalesce("w", F.array().cast("array<string>")).alias("a")), "doc_id").join(words.select(F.col("doc_id").alias("next_id"), F.col("w").alias("b")), "next_id").where("b is not null")
    return rows.select("doc_id", F.size(F.array_intersect("a", "b")).alias("shared"), T.zero_overlap(F.col("a"), F.col("b")).alias("zero_overlap"))


@query(f"WITH {MESSAGES_SQL} SELECT id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, hour(ts + INTERVAL 330 MINUTE)::INTEGER AS hour FROM messages")
def local_time(spark, sf):
    day, hour = T.local_time(F.col("ts"), ZONE)
    return views.messages(spark, sf).select("id", day.cast("string").alias("day"), hour.alias("hour"))


@query(r"SELECT doc_id, md5(CASE WHEN len(t) > 128 THEN array_to_string(t[1:128], ' ') ELSE text END) AS cut_md5, len(t) > 128 AS cut FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS t FROM documents)")
def truncate_tokens(spark, sf):
    text, cut = T.truncate_tokens(F.col("text"), 128)
    return documents(spark, sf).select("doc_id", F.md5(text).alias("cut_md5"), cut.alias("cut"))


# questions


def asked(spark, sf):
    return spread(views.questions(spark, sf))


def aliases(spark, sf):
    return io.alias_dim(views.participants(spark, sf))


@query(f"""WITH {MEANT_SQL}, r AS (SELECT split_part(name, ' ', 2) AS region, string_agg(name, '|' ORDER BY name) AS names FROM participants GROUP BY 1)
SELECT query_id, CASE WHEN k = 4 THEN names WHEN k IN (6, 7) THEN '' ELSE name END AS candidates, CASE WHEN k NOT IN (4, 6, 7) THEN name END AS person FROM meant JOIN r ON region = split_part(name, ' ', 2)""")
def person_mentions(spark, sf):
    return annotate.person_mentions(asked(spark, sf), aliases(spark, sf)).select("query_id", F.array_join("candidates", "|").alias("candidates"), "person")


@query(f"WITH {MEANT_SQL} SELECT query_id, ['filter', 'filter', 'none', 'bonus', 'none', 'filter', 'none', 'none'][k + 1] AS mode FROM meant")
def person_role(spark, sf):
    rows = annotate.person_mentions(asked(spark, sf), aliases(spark, sf))
    return rows.select("query_id", annotate.person_role(F.col("marked"), F.col("person")).alias("mode"))


DATES_SQL = f"""{MEANT_SQL}, dates AS (SELECT *, CASE WHEN k IN (1, 5, 6) THEN date_trunc('month', d)::DATE WHEN k = 4 THEN DATE '{REFERENCE_DATE}' - 1 WHEN k = 7 THEN NULL ELSE d END AS s,
  CASE WHEN k IN (1, 5, 6) THEN last_day(d) WHEN k = 2 THEN d + 7 WHEN k = 4 THEN DATE '{REFERENCE_DATE}' - 1 WHEN k = 7 THEN NULL ELSE d END AS e FROM meant)"""


@query(f"WITH {DATES_SQL} SELECT query_id, s::VARCHAR AS start, e::VARCHAR AS end_, true AS valid FROM dates WHERE k <> 7")
def date_mentions(spark, sf):
    return annotate.date_mentions(asked(spark, sf), REFERENCE_DATE).select("query_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end_"), "valid")


@query(f"WITH {DATES_SQL} SELECT query_id, s::VARCHAR AS start, e::VARCHAR AS end_, CASE WHEN k = 7 THEN 'ambiguous numeric date' ELSE '' END AS warnings FROM dates")
def date_bounds(spark, sf):
    return annotate.date_bounds(asked(spark, sf), REFERENCE_DATE).select("query_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end_"), F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {MEANT_SQL} SELECT query_id, CASE WHEN k = 6 THEN 'show me the pdf about the trip' END AS without_event FROM meant".replace("about the trip", "about the  trip").replace("  ", " ").replace("the trip'", "the '"))
def event_dates(spark, sf):
    text = annotate.question_text(F.col("query"))
    cut = annotate.without_event_dates(text)
    return asked(spark, sf).select("query_id", F.when(cut != text, cut).alias("without_event"))


@query(f"WITH {DATES_SQL} SELECT query_id, (CASE WHEN k = 5 THEN s + 20 ELSE s END)::DATE::VARCHAR AS start, e::VARCHAR AS end_ FROM dates")
def month_part(spark, sf):
    rows = annotate.date_bounds(asked(spark, sf), REFERENCE_DATE).join(asked(spark, sf), "query_id")
    start, end = annotate.month_part(annotate.question_text(F.col("query")), F.col("start"), F.col("end"))
    return rows.select("query_id", start.cast("string").alias("start"), end.cast("string").alias("end_"))


@query(f"WITH {MEANT_SQL} SELECT query_id, CASE k WHEN 4 THEN 0 WHEN 7 THEN 21 END AS lo, CASE k WHEN 4 THEN 12 WHEN 7 THEN 24 END AS hi FROM meant")
def day_part(spark, sf):
    return asked(spark, sf).select("query_id", annotate.day_part(annotate.question_text(F.col("query"))).alias("p")).select("query_id", "p.lo", "p.hi")


@query(f"WITH {MEANT_SQL} SELECT query_id, CASE k WHEN 5 THEN 'image' WHEN 6 THEN 'pdf' END AS message_type FROM meant")
def type_request(spark, sf):
    return asked(spark, sf).select("query_id", annotate.type_request(F.col("query")).alias("message_type"))


@query(f"""WITH {DATES_SQL} SELECT query_id, CASE WHEN k NOT IN (4, 6, 7) THEN name END AS person, ['filter', 'filter', 'none', 'bonus', 'none', 'filter', 'none', 'none'][k + 1] AS mode,
 (CASE WHEN k = 6 THEN NULL WHEN k = 5 THEN s + 20 ELSE s END)::DATE::VARCHAR AS start, CASE WHEN k <> 6 THEN e::VARCHAR END AS end_, CASE k WHEN 4 THEN 0 END AS hour_lo, CASE k WHEN 4 THEN 12 END AS hour_hi,
 CASE k WHEN 5 THEN 'image' WHEN 6 THEN 'pdf' END AS message_type, k <> 7 AS has_filter, CASE WHEN k NOT IN (4, 6, 7) THEN 'person_' ELSE '' END || CASE WHEN k <> 7 THEN 'time_' ELSE '' END || 'semantic' AS intent,
 CASE k WHEN 4 THEN 'several people or an ambiguous name' WHEN 7 THEN 'ambiguous numeric date' ELSE '' END AS warnings FROM dates""")
def interpret(spark, sf):
    rows = annotate.interpret(asked(spark, sf), aliases(spark, sf), REFERENCE_DATE)
    return rows.select("query_id", "person", "mode", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end_"), "hour_lo", "hour_hi", "message_type", "has_filter", "intent", F.array_join("warnings", ",").alias("warnings"))


# contexts

CTX_SQL = f"""{MESSAGES_SQL},
cx AS (SELECT id, t, text, list_filter(list({{'t': t, 'id': id, 'text': text}}) OVER (ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda m: abs(m.t - t) <= 1800) AS ctx FROM messages)"""
LINES_SQL = """array_to_string(list_transform(list_filter(ctx, lambda m: trim(m.text) <> ''), lambda m: CASE WHEN (m.t, m.id) < (x.t, x.id) THEN 'Previous message: ' WHEN m.id = x.id THEN 'Current message: ' ELSE 'Following message: ' END || m.text), chr(10))"""


def contexts(spark, sf):
    return context.context_window(views.messages(spark, sf))


@query(f"WITH {CTX_SQL} SELECT id, array_to_string(list_transform(ctx, lambda m: m.id), ',') AS ids FROM cx")
def context_window(spark, sf):
    return contexts(spark, sf).select("id", F.array_join(F.transform("ctx", lambda m: m["id"]), ",").alias("ids"))


@query(f"WITH {CTX_SQL} SELECT id, {LINES_SQL} AS context_text FROM cx x")
def context_text(spark, sf):
    return context.context_text(contexts(spark, sf)).select("id", "context_text")


SHOWN_SQL = f"""{MESSAGES_SQL},
shown AS (SELECT id, t, list_filter(coalesce(list({{'t': t, 'id': id}}) OVER (ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), lambda m: t - m.t <= 1800) AS p,
  list_filter(coalesce(list({{'t': t, 'id': id}}) OVER (ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []), lambda m: m.t - t <= 1800) AS n FROM messages)"""
SHOWN_IDS = "coalesce(array_to_string(list_transform(p, lambda m: m.id), ','), '') AS previous, coalesce(array_to_string(list_transform(n, lambda m: m.id), ','), '') AS next"


@query(f"WITH {SHOWN_SQL} SELECT id, {SHOWN_IDS} FROM shown")
def display_window(spark, sf):
    ids = lambda c: F.array_join(F.transform(c, lambda m: m["id"]), ",")
    return context.display_window(views.messages(spark, sf)).select("id", ids("previous").alias("previous"), ids("next").alias("next"))


BUDGET = 64


def fitted(spark, sf):
    return context.fit_budget(contexts(spark, sf), BUDGET)


@query()
def fit_budget(spark, sf):
    return fitted(spark, sf).select("id", "fitted", F.array_join("trimmed", ",").alias("trimmed"))


TOKENS_SQL = r"list_transform(ctx, lambda m: len(regexp_extract_all(m.text, '\S+')))"


@query(f"""WITH {CTX_SQL}, k AS (SELECT id, {TOKENS_SQL} AS n, list_sum(list_transform({TOKENS_SQL}, lambda c: CASE WHEN c > 0 THEN c + 2 ELSE 0 END)) - {BUDGET} AS excess,
  list_sum(list_transform(list_filter(ctx, lambda m: m.id <> x.id), lambda m: CASE WHEN len(regexp_extract_all(m.text, '\\S+')) > 0 THEN len(regexp_extract_all(m.text, '\\S+')) + 2 ELSE 0 END)) AS others FROM cx x)
SELECT count(*) AS contexts, count_if(excess > 0) AS trimmed, count_if(excess > coalesce(others, 0)) AS own_trimmed FROM k""")
def truncation_stats(spark, sf):
    return context.truncation_stats(fitted(spark, sf))


# retrieval over documents: the benchmark's passages are the stated query set

TERMS_SQL = rf"""{WORDS_SQL}, {CHARS_SQL},
cnt AS MATERIALIZED (SELECT doc_id, 'word' AS channel, term, count(*) AS n FROM (SELECT doc_id, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w) GROUP BY ALL
  UNION ALL SELECT doc_id, 'char', term, count(*) FROM c GROUP BY ALL),
idf AS MATERIALIZED (SELECT channel, term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY ALL),
raw AS (SELECT doc_id, channel, term, (ln(n) + 1) * idf AS w FROM cnt JOIN idf USING (channel, term)), nrm AS (SELECT doc_id, channel, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL),
post AS MATERIALIZED (SELECT doc_id, channel, term, w / norm AS weight FROM raw JOIN nrm USING (doc_id, channel))"""
QTERMS_SQL = TERMS_SQL + r""",
qw AS (SELECT item_id AS q, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+') AS w FROM benchmark), qp AS (SELECT item_id AS q, unnest(list_transform(regexp_extract_all(strip_accents(lower(text)), '\S+'), lambda x: ' ' || x || ' ')) AS p FROM benchmark),
qc AS (SELECT q, unnest(flatten(list_transform([3, 4, 5], lambda n: CASE WHEN n = 3 OR length(p) >= n THEN list_transform(generate_series(1, greatest(length(p) - n + 1, 1)), lambda i: substr(p, i, n)) ELSE [] END))) AS term FROM qp),
qn AS (SELECT q, 'word' AS channel, term, count(*) AS n FROM (SELECT q, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM qw) GROUP BY ALL UNION ALL SELECT q, 'char', term, count(*) FROM qc GROUP BY ALL),
qr AS (SELECT q, channel, term, (ln(n) + 1) * idf AS w FROM qn JOIN idf USING (channel, term)), qs AS (SELECT q, channel, sqrt(sum(w * w)) AS norm FROM qr GROUP BY ALL),
qv AS MATERIALIZED (SELECT q, channel, term, w / norm AS weight FROM qr JOIN qs USING (q, channel))"""
SCORES_SQL = QTERMS_SQL + ", sc AS (SELECT q, doc_id, sum(qv.weight * post.weight * CASE channel WHEN 'word' THEN 0.7 ELSE 0.3 END) AS s FROM qv JOIN post USING (channel, term) GROUP BY ALL)"


def passages(spark, sf):
    return views.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def index(spark, sf):
    """The index job: texts in pieces as a written table, from which frequencies are taken."""
    return lexical.Index(documents(spark, sf), "doc_id")


@query(f"WITH {TERMS_SQL} SELECT doc_id, channel, count(*) AS terms, round(sum(weight), 6) AS weight, round(max(weight), 6) AS heaviest FROM post GROUP BY ALL")
def tfidf_index(spark, sf):
    return index(spark, sf).postings().groupBy("doc_id", "channel").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.max("weight"), 6).alias("heaviest"))


@query(f"WITH {QTERMS_SQL} SELECT q AS query_id, channel, term, round(weight, 6) AS weight FROM qv")
def tfidf_query(spark, sf):
    return lexical.tfidf_query(passages(spark, sf), index(spark, sf).idf).withColumn("weight", F.round("weight", 6))


@query(f"WITH {SCORES_SQL} SELECT q AS query_id, doc_id, round(s, 6) AS lexical FROM sc")
def lexical_score(spark, sf):
    held = index(spark, sf)
    return lexical.lexical_score(lexical.tfidf_query(passages(spark, sf), held.idf), held, "doc_id").withColumn("lexical", F.round("lexical", 6))


TOPK_SQL = f"WITH {SCORES_SQL} SELECT q AS query_id, doc_id, rank, round(s, 6) AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc_id)::INTEGER AS rank FROM sc WHERE round(s, 9) > 0) WHERE rank <= 5"


@query(TOPK_SQL)
def lexical_topk(spark, sf):
    held = index(spark, sf)
    return lexical.lexical_topk(passages(spark, sf), held, held.idf, 5, "doc_id").select("query_id", "doc_id", "rank", F.round("lexical", 6).alias("lexical"))


@query(TOPK_SQL)
def stored_topk(spark, sf):
    """The same from an index on disk that took the documents in three batches."""
    docs, store = documents(spark, sf), lexical_store.LexicalStore(spark, folder(spark), "doc_id", "bigint")
    for batch in range(3):
        store.append(docs.where(F.col("doc_id") % 3 == batch), f"batch{batch}")
    return store.topk(passages(spark, sf)).select("query_id", "doc_id", "rank", F.round("lexical", 6).alias("lexical"))


@query(f"WITH {TERMS_SQL} SELECT channel, count(*) AS terms FROM idf GROUP BY channel")
def vocab_stats(spark, sf):
    return lexical.vocab_stats(lexical.vocabulary(documents(spark, sf)))


NEAREST_SQL = "SELECT a.vec_id AS query_id, b.vec_id, rank, round(s, 6) AS score FROM (SELECT q.vec_id AS a_id, e.vec_id AS b_id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id)::INTEGER AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e, LATERAL (SELECT list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS s)) r JOIN embeddings a ON a.vec_id = a_id JOIN embeddings b ON b.vec_id = b_id WHERE rank <= 5"


@query(NEAREST_SQL)
def semantic_topk(spark, sf):
    """Stated queries: every fiftieth vector, against all."""
    rows = views.table(spark, sf, "embeddings").select("vec_id", dense.unit(F.col("embedding")).alias("vector"))
    asks = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return dense.semantic_topk(asks, rows, 5, "vec_id", "long").select("query_id", "vec_id", "rank", F.round("semantic", 6).alias("score"))


@query(NEAREST_SQL)
def cell_topk(spark, sf):
    """The same through an index of cells, which reads only the blocks that can hold one of the nearest."""
    rows = views.table(spark, sf, "embeddings").select("vec_id", dense.unit(F.col("embedding")).alias("vector"))
    asks = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    found, _ = cells.cell_topk(asks, cells.cell_index(rows, written, "vec_id"), written, 5, "vec_id")
    return found.select("query_id", "vec_id", "rank", F.round("semantic", 6).alias("score"))


@query()
def embed(spark, sf):
    return dense.embed(views.messages(spark, sf)).select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'zero' WHEN vec_id % 7 = 1 THEN 'ragged' ELSE '' END AS problems, CASE WHEN vec_id % 7 > 1 THEN round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) END AS first FROM embeddings""")
def normalize_vectors(spark, sf):
    """Of the vectors every seventh is zeroed and every next one is cut short, to show what is refused."""
    rows = views.table(spark, sf, "embeddings")
    bad = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 7 == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return dense.normalize_vectors(rows.withColumn("v", bad), "v", 64).select("vec_id", F.array_join("problems", ",").alias("problems"), F.round(F.col("unit")[0], 6).alias("first"))


@query("SELECT count(*) AS vectors, bool_and(len(embedding) = 64) AS sound, bool_and(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-5) AS unit_length, count(*) = (SELECT count(*) FROM embeddings) AS complete FROM embeddings")
def check_vectors(spark, sf):
    rows = views.table(spark, sf, "embeddings")
    return dense.check_vectors(rows, "embedding", 64, rows.count())


# fused retrieval over messages

#: A question's kind says what it asks for; of the rules that its own words can trip, the SQL reads those that block a type (kind 4: none asked for).
BLOCKED_SQL = annotate.TYPE_BLOCKED.replace("'", "''")
ASKS_SQL = f"""
asks AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 3 AND regexp_matches(lower(text), '{BLOCKED_SQL}') THEN 4 ELSE item_id % 4 END AS k, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN 'What did assistant say about ' || text WHEN 2 THEN 'in March 2026 ' || text ELSE 'Find the image of ' || text END AS query FROM benchmark)"""
SENDERS = ["user", "assistant", "system"]


def asks(spark, sf):
    k, text = F.col("item_id") % 4, F.col("text")
    said = F.when(k == 0, text).when(k == 1, F.concat(F.lit("What did assistant say about "), text)).when(k == 2, F.concat(F.lit("in March 2026 "), text)).otherwise(F.concat(F.lit("Find the image of "), text))
    return views.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("query"))


def constraints(spark, sf):
    """Written once: what reads a constraint several times would otherwise take the question apart as often."""
    people = spark.createDataFrame(list(enumerate(SENDERS)), "ord int, name string")
    return written(annotate.interpret(asks(spark, sf), io.alias_dim(people), REFERENCE_DATE))


#: The questions' own texts name no people and no dates: a test holds that on all sizes.
ELIGIBLE_SQL = f"""{MESSAGES_SQL},{ASKS_SQL},
el AS (SELECT query_id, id FROM asks, messages WHERE k IN (0, 4) OR (k = 1 AND sender = 'assistant') OR (k = 2 AND strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') = '2026-03') OR (k = 3 AND message_type = 'image'))"""


@query(f"WITH {ELIGIBLE_SQL} SELECT query_id, id FROM el")
def eligible(spark, sf):
    return fuse.eligible(constraints(spark, sf), views.messages(spark, sf), ZONE)


@query(f"WITH {ELIGIBLE_SQL} SELECT query_id, count(id) AS eligible, (SELECT count(*) FROM messages) - count(id) AS excluded FROM asks LEFT JOIN el USING (query_id) GROUP BY query_id")
def eligible_counts(spark, sf):
    c, m = constraints(spark, sf), views.messages(spark, sf)
    return fuse.eligible_counts(c, fuse.eligible(c, m, ZONE), m)


@query(f"WITH {CTX_SQL} SELECT m.id, x.ctx[1].id AS first_neighbour, len(x.ctx)::INTEGER AS size FROM messages m JOIN cx x USING (id) WHERE m.message_type = 'image'")
def attach_context(spark, sf):
    hits = views.messages(spark, sf).where("message_type = 'image'").select("id")
    return context.attach_context(hits, contexts(spark, sf)).select("id", F.col("ctx")[0]["id"].alias("first_neighbour"), F.size("ctx").alias("size"))


def vec_sql(name: str, source: str, key: str, text: str) -> str:
    """The stand-in encoder in SQL."""
    return rf"""{name}_w AS (SELECT {key} AS k, regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}_]+') AS w FROM {source}),
{name}_h AS (SELECT k, ('0x' || substr(md5(term), 1, 6))::BIGINT AS h FROM (SELECT k, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {name}_w)),
{name}_s AS (SELECT k, h % 64 AS d, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM {name}_h GROUP BY ALL),
{name} AS MATERIALIZED (SELECT k, d, s / n AS v FROM {name}_s JOIN (SELECT k, sqrt(sum(s * s)) AS n FROM {name}_s GROUP BY k) USING (k) WHERE n > 0)"""


def _short_lexical(prefix: str, source: str, key: str, text: str, vocabulary: str | None = None) -> str:
    counts = rf"""{prefix}w AS (SELECT {key} AS k, regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}_]+') AS w FROM {source}), {prefix}p AS (SELECT {key} AS k, unnest(list_transform(regexp_extract_all(strip_accents(lower({text})), '\S+'), lambda x: ' ' || x || ' ')) AS p FROM {source}),
{prefix}n AS MATERIALIZED (SELECT k, 'word' AS channel, term, count(*) AS n FROM (SELECT k, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {prefix}w) GROUP BY ALL
  UNION ALL SELECT k, 'char', term, count(*) FROM (SELECT k, unnest(flatten(list_transform([3, 4, 5], lambda n: CASE WHEN n = 3 OR length(p) >= n THEN list_transform(generate_series(1, greatest(length(p) - n + 1, 1)), lambda i: substr(p, i, n)) ELSE [] END))) AS term FROM {prefix}p) GROUP BY ALL)"""
    if vocabulary is None:
        vocabulary = f"{prefix}i"
        counts += f", {prefix}i AS MATERIALIZED (SELECT channel, term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM {prefix}n GROUP BY ALL)"
    return counts + f""", {prefix}r AS (SELECT k, channel, term, (ln(n) + 1) * idf AS w FROM {prefix}n JOIN {vocabulary} USING (channel, term)),
{prefix}v AS MATERIALIZED (SELECT k, channel, term, w / norm AS weight FROM {prefix}r JOIN (SELECT k, channel, sqrt(sum(w * w)) AS norm FROM {prefix}r GROUP BY ALL) USING (k, channel))"""


SIGNALS_SQL = f"""{CTX_SQL},{ASKS_SQL},
el AS (SELECT query_id, id FROM asks, messages WHERE k IN (0, 4) OR (k = 1 AND sender = 'assistant') OR (k = 2 AND strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') = '2026-03') OR (k = 3 AND message_type = 'image')),
ctxt AS (SELECT id, {LINES_SQL} AS text FROM cx x), {vec_sql('vm', 'messages', 'id', 'text')}, {vec_sql('vc', 'ctxt', 'id', 'text')}, {vec_sql('vq', 'asks', 'query_id', 'query')},
{_short_lexical('m', 'messages', 'id', 'text')}, {_short_lexical('q', 'asks', 'query_id', 'query', 'mi')},
sem AS (SELECT q.k AS query_id, m.k AS id, least(greatest(sum(q.v * m.v), 0), 1) AS s FROM vq q JOIN vm m USING (d) GROUP BY ALL), con AS (SELECT q.k AS query_id, m.k AS id, least(greatest(sum(q.v * m.v), 0), 1) AS s FROM vq q JOIN vc m USING (d) GROUP BY ALL),
lex AS (SELECT q.k AS query_id, m.k AS id, sum(q.weight * m.weight * CASE channel WHEN 'word' THEN 0.7 ELSE 0.3 END) AS s FROM qv q JOIN mv m USING (channel, term) GROUP BY ALL),
sig AS MATERIALIZED (SELECT a.query_id, m.id, a.k, coalesce(sem.s, 0) AS semantic, coalesce(con.s, 0) AS contextual, coalesce(lex.s, 0) AS lexical, a.k = 1 AND m.sender = 'assistant' AS person_match, a.k = 2 AND el.id IS NOT NULL AS date_match, el.id IS NOT NULL AS eligible
  FROM asks a CROSS JOIN messages m LEFT JOIN sem USING (query_id, id) LEFT JOIN con USING (query_id, id) LEFT JOIN lex USING (query_id, id) LEFT JOIN el USING (query_id, id))"""
PROFILES_SQL = ", ".join(f"({i}, '{n}', {c}, {s}, {x})" for i, (n, (c, s, x)) in enumerate(fuse.PROFILES.items()))
SCORED_SQL = f"""{SIGNALS_SQL}, prof(ord, profile, c, s, x) AS (VALUES {PROFILES_SQL}),
scored AS MATERIALIZED (SELECT sig.*, ord, profile, (c - CASE WHEN k BETWEEN 1 AND 3 THEN 0.1 ELSE 0 END) * contextual + (s + CASE WHEN k BETWEEN 1 AND 3 THEN 0.1 ELSE 0 END) * semantic + x * lexical + CASE WHEN person_match THEN 0.05 ELSE 0 END + CASE WHEN date_match THEN 0.05 ELSE 0 END AS score FROM sig, prof WHERE eligible),
bal AS (SELECT * FROM scored WHERE profile = 'balanced')"""


def channels(spark, sf):
    """What both ways of scoring read: messages, questions and their constraints, their vectors, and the lexical weights of both sides."""
    m, q, c = views.messages(spark, sf), asks(spark, sf), constraints(spark, sf)
    vectors = q.select("query_id", dense.hashed_vector(F.col("query")).alias("vector"))
    own = spread(m).select("id", dense.hashed_vector(F.col("text")).alias("own"))
    around = context.fit_budget(contexts(spark, sf), 1_000_000).select("id", dense.hashed_vector(F.col("fitted")).alias("around"))
    postings = lexical.Index(m)
    return m, c, vectors, written(own.join(around, "id")), written(lexical.tfidf_query(q, postings.idf)), postings


def signals(spark, sf):
    """All channels of every question and message, for the queries that return or count them all; not written."""
    m, c, vectors, own, query_weights, postings = channels(spark, sf)
    return fuse.hybrid_signals((vectors, own), (query_weights, postings), c, m, ZONE), c


def scored(spark, sf, profile: str = "balanced"):
    s, c = signals(spark, sf)
    return fuse.hybrid_scores(s, fuse.weights(c, fuse.profiles(spark).where(F.col("profile") == profile))), c


def first(spark, sf, width: int = fuse.POOL, profile: str = "balanced", shared=None):
    """The rows that can be in a pool, written; no table of all questions and messages."""
    m, c, vectors, own, query_weights, postings = shared or channels(spark, sf)
    weighted = fuse.weights(c, fuse.profiles(spark).where(F.col("profile") == profile)).drop("ord", "profile")
    return written(fuse.first_stage(c, weighted, vectors, query_weights, own, postings, m, ZONE, width)), c


ROUNDED = ["semantic", "contextual", "lexical"]


@query(f"WITH {SIGNALS_SQL} SELECT query_id, id, round(semantic, 6) AS semantic, round(contextual, 6) AS contextual, round(lexical, 6) AS lexical, person_match, date_match, eligible FROM sig")
def hybrid_signals(spark, sf):
    return signals(spark, sf)[0].withColumns({c: F.round(c, 6) for c in ROUNDED})


@query(f"WITH {SIGNALS_SQL} SELECT query_id, id, round(lexical, 6) AS lexical FROM sig")
def align_scores(spark, sf):
    m, q = views.messages(spark, sf), asks(spark, sf)
    postings = lexical.Index(m)
    scores = lexical.lexical_score(lexical.tfidf_query(q, postings.idf), postings)
    base = m.select("id").crossJoin(F.broadcast(q.select("query_id")))  # the stated questions
    return fuse.align_scores(base, scores, "lexical").select("query_id", "id", F.round("lexical", 6).alias("lexical"))


@query(f"WITH {ASKS_SQL}, prof(ord, profile, c, s, x) AS (VALUES {PROFILES_SQL}) SELECT query_id, profile, round(c - CASE WHEN k BETWEEN 1 AND 3 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS w_contextual, round(s + CASE WHEN k BETWEEN 1 AND 3 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS w_semantic, x::DOUBLE AS w_lexical FROM asks, prof")
def weights(spark, sf):
    rows = fuse.weights(constraints(spark, sf), fuse.profiles(spark))
    return rows.select("query_id", "profile", F.round("w_contextual", 6).alias("w_contextual"), F.round("w_semantic", 6).alias("w_semantic"), "w_lexical")


TOP_SQL = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER"


@query(f"WITH {SCORED_SQL} SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, {TOP_SQL} AS rank FROM bal) WHERE rank <= 5")
def hybrid_topk(spark, sf):
    return fuse.hybrid_topk(first(spark, sf, 5)[0]).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query()
def contextual_topk(spark, sf):
    vectors = asks(spark, sf).select("query_id", dense.hashed_vector(F.col("query")).alias("vector"))
    rows = fitted(spark, sf).select("id", dense.hashed_vector(F.col("fitted")).alias("vector"))
    return dense.semantic_topk(vectors, rows, 5).select("query_id", "rank", "id", F.round("semantic", 6).alias("contextual"))


POOL_SQL = f"""{SCORED_SQL}, pool AS (SELECT DISTINCT query_id, id FROM (SELECT *, {TOP_SQL} AS r0, {' , '.join(f"row_number() OVER (PARTITION BY query_id ORDER BY round({c}, 9) DESC, id) AS r{i}" for i, c in enumerate(ROUNDED, 1))} FROM bal)
  WHERE r0 <= 128 OR {' OR '.join(f'(r{i} <= 128 AND round({c}, 9) > 0)' for i, c in enumerate(ROUNDED, 1))})"""


@query(f"WITH {POOL_SQL} SELECT query_id, id FROM pool")
def candidate_pool(spark, sf):
    return fuse.candidate_pool(first(spark, sf)[0])


@query(f"WITH {MESSAGES_SQL} SELECT id, text || chr(10) || 'Sender: ' || sender || '. Sent: ' || timestamp[1:10] || '.' AS said FROM messages")
def pair_text(spark, sf):
    return views.messages(spark, sf).select("id", fuse.pair_text(F.col("text"), F.col("sender"), F.col("timestamp")).alias("said"))


PAIRS_SQL = f"""{POOL_SQL}, qcw AS (SELECT query_id, {CONTENT_SQL.format('query')} AS a FROM asks), mcw AS (SELECT id, {CONTENT_SQL.format("text || chr(10) || 'Sender: ' || sender || '. Sent: ' || timestamp[1:10] || '.'")} AS b FROM messages),
pairs AS MATERIALIZED (SELECT query_id, id, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END AS pair FROM pool JOIN qcw USING (query_id) JOIN mcw USING (id))"""


def paired(spark, sf):
    rows, c = first(spark, sf)
    pairs = fuse.pair_score(fuse.candidate_pool(rows), asks(spark, sf), views.messages(spark, sf))
    return rows, pairs, c


@query(f"WITH {PAIRS_SQL} SELECT query_id, id, round(pair, 6) AS pair FROM pairs")
def pair_score(spark, sf):
    return paired(spark, sf)[1].withColumn("pair", F.round("pair", 6))


RANKED_SQL = f"{PAIRS_SQL}, rr AS (SELECT query_id, id, pair, 0.85 * pair + 0.15 * score AS score FROM bal JOIN pairs USING (query_id, id)), fin AS (SELECT * FROM (SELECT *, {TOP_SQL} AS rank FROM rr) WHERE rank <= 5)"


@query(f"WITH {RANKED_SQL} SELECT query_id, rank, id, round(pair, 6) AS pair, round(score, 6) AS score FROM fin")
def rerank_topk(spark, sf):
    rows, pairs, _ = paired(spark, sf)
    return fuse.rerank_topk(rows, pairs).select("query_id", "rank", "id", F.round("pair", 6).alias("pair"), F.round("score", 6).alias("score"))


@query(f"""WITH {RANKED_SQL}, sh AS (SELECT id, {SHOWN_IDS} FROM (SELECT id, t, list_filter(coalesce(list({{'t': t, 'id': id}}) OVER (ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), lambda m: t - m.t <= 1800) AS p,
  list_filter(coalesce(list({{'t': t, 'id': id}}) OVER (ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []), lambda m: m.t - t <= 1800) AS n FROM messages))
SELECT query_id, ['none', 'filter', 'none', 'none', 'none'][k + 1] AS mode, coalesce(string_agg(rank || ':' || id || ':' || previous || ':' || next, ' ' ORDER BY rank), '') AS results FROM asks LEFT JOIN fin USING (query_id) LEFT JOIN sh USING (id) GROUP BY query_id, k""")
def search(spark, sf):
    rows, pairs, c = paired(spark, sf)
    m = views.messages(spark, sf)
    found = fuse.search(c, fuse.rerank_topk(rows, pairs), m, context.display_window(m))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    shown = F.transform("results", lambda h: F.concat_ws(":", h["rank"].cast("string"), h["message"]["id"], ids(h["previous"]), ids(h["next"])))
    return found.select("query_id", "mode", F.array_join(shown, " ").alias("results"))


@query(f"WITH {CTX_SQL} SELECT id, t FROM messages ORDER BY t, id")
def sort_chrono(spark, sf):
    return views.messages(spark, sf).orderBy("ts", "id").select("id", F.unix_timestamp("ts").alias("t"))


@query(f"WITH {SCORED_SQL} SELECT query_id, id, rank FROM (SELECT query_id, id, {TOP_SQL} AS rank FROM bal) WHERE rank <= 3")
def top_k(spark, sf):
    return lexical.top_k(first(spark, sf, 3)[0], "score", "id", 3).select("query_id", "id", "rank")


# evaluation

#: The expected message of a question: that with the most words in common by number, so it can be any message.
TARGETS_SQL = "tg AS (SELECT query_id, id AS expected_id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || id)) AS r FROM el) WHERE r = 1)"


def targets(spark, sf):
    """A target for each question, from the messages that it may find, by a hash."""
    allowed = fuse.eligible(constraints(spark, sf), views.messages(spark, sf), ZONE)
    return allowed.groupBy("query_id").agg(F.min_by("id", F.md5(F.concat(F.col("query_id").cast("string"), "id"))).alias("expected_id"))


@query(f"WITH {HITS_SQL} SELECT method, query_id, array_to_string(ids, ',') AS retrieved_ids, top1 AS top1_correct, recalled AS recalled_at_3 FROM runs")
def run_rows(spark, sf):
    return runs(spark, sf).select("method", "query_id", F.array_join("retrieved_ids", ",").alias("retrieved_ids"), "top1_correct", "recalled_at_3")


def metrics_sql(by: str) -> str:
    return f"""met AS (SELECT {by}, unnest(['top1', 'recall_at_3', 'hard_top1', 'gap']) AS part, unnest([top1, rec, ht, NULL]) AS correct, unnest([n, n, hn, NULL]) AS total,
  unnest([round(top1 * 100.0 / n, 6), round(rec * 100.0 / n, 6), round(ht * 100.0 / nullif(hn, 0), 6), round(round(top1 * 100.0 / n, 6) - round(ht * 100.0 / nullif(hn, 0), 6), 6)])::DOUBLE AS percent
  FROM (SELECT {by}, count(*) AS n, count_if(top1) AS top1, count_if(recalled) AS rec, count_if(hard) AS hn, count_if(hard AND top1) AS ht FROM runs GROUP BY {by})
 UNION ALL SELECT {by}, 'category ' || category, count_if(top1), count(*), round(count_if(top1) * 100.0 / count(*), 6)::DOUBLE FROM runs GROUP BY {by}, category)"""


@query(f"WITH {HITS_SQL}, {metrics_sql('method')} SELECT method, part, correct::BIGINT AS correct, total::BIGINT AS total, percent FROM met")
def metrics(spark, sf):
    return evaluate.metrics(runs(spark, sf))


@query(f"WITH {HITS_SQL}, {metrics_sql('language')} SELECT language, part, correct::BIGINT AS correct, total::BIGINT AS total, percent FROM met")
def metrics_by_language(spark, sf):
    return evaluate.metrics(runs(spark, sf), "language")


DELTA_SQL = """SELECT o.method AS baseline, 'hybrid' AS candidate, part, o.percent AS baseline_percent, h.percent AS candidate_percent, round(h.percent - o.percent, 6) AS delta,
 CASE WHEN h.percent > o.percent THEN 'improved' WHEN h.percent < o.percent THEN 'worse' WHEN h.percent = o.percent THEN 'unchanged' END AS direction FROM met o JOIN met h USING (part) WHERE h.method = 'hybrid' AND o.method <> 'hybrid' AND part <> 'gap'"""


@query(f"WITH {HITS_SQL}, {metrics_sql('method')} {DELTA_SQL} AND o.method = 'semantic'")
def compare_methods(spark, sf):
    return evaluate.compare_methods(runs(spark, sf), "semantic", "hybrid")


@query(f"WITH {HITS_SQL} SELECT 'semantic' AS baseline, 'hybrid' AS candidate, query_id, CASE WHEN n.top1 THEN 'newly correct' ELSE 'newly incorrect' END AS change FROM runs o JOIN runs n USING (query_id) WHERE o.method = 'semantic' AND n.method = 'hybrid' AND o.top1 <> n.top1")
def newly_correct(spark, sf):
    return evaluate.newly(runs(spark, sf), "semantic", "hybrid")


@query(f"WITH {HITS_SQL}, {metrics_sql('method')} {DELTA_SQL}")
def compare_all(spark, sf):
    return evaluate.compare_all(runs(spark, sf))


PARTS = ["top1", "recall_at_3", "hard_top1", "gap", "category 1-URGENT", "category 2-HIGH", "category 3-MEDIUM", "category 4-NOT SPECIFIED", "category 5-LOW"]


@query(f"WITH {HITS_SQL}, {metrics_sql('method')} SELECT method, " + ", ".join(f"max({c}) FILTER (WHERE part = '{p}'){'::BIGINT' if c != 'percent' else ''} AS {p.replace(' ', '_').replace('-', '_').lower()}_{c}" for p in PARTS for c in ("correct", "total", "percent")) + " FROM met GROUP BY method")
def comparison_table(spark, sf):
    return evaluate.pivot_parts(evaluate.metrics(runs(spark, sf)), PARTS)


@query(f"WITH {HITS_SQL}, {metrics_sql('method')} SELECT method, percent FROM met WHERE part = 'top1' ORDER BY percent DESC, list_position(['lexical', 'semantic', 'contextual', 'hybrid'], method) LIMIT 1")
def best_method(spark, sf):
    return evaluate.best_method(evaluate.metrics(runs(spark, sf)))


@query(f"""WITH {HITS_SQL} SELECT method, query_id, query, category, expected_id, rank, hits.id, 1.0::DOUBLE / rank AS score, m.c_name AS text, e.c_name AS expected_text
FROM (SELECT * FROM runs WHERE NOT top1) LEFT JOIN hits USING (method, query_id) LEFT JOIN customer m ON m.c_custkey::VARCHAR = hits.id LEFT JOIN customer e ON e.c_custkey::VARCHAR = expected_id""")
def failures(spark, sf):
    people = views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"))
    return evaluate.failures(runs(spark, sf), ranked(spark, sf), people)


NEAR_SQL = "coalesce(CASE WHEN query_id % 2 = 0 THEN list_filter(list_transform(ctx, lambda m: m.id), lambda i: i <> one.id)[1] END, expected_id)"


@query(f"""WITH {SCORED_SQL}, {TARGETS_SQL}, one AS (SELECT query_id, id FROM (SELECT query_id, id, {TOP_SQL} AS r FROM bal) WHERE r = 1)
SELECT 'hybrid' AS method, query_id, one.id FROM one JOIN tg USING (query_id) JOIN cx ON cx.id = one.id WHERE {NEAR_SQL} <> one.id AND list_contains(list_transform(ctx, lambda m: m.id), {NEAR_SQL})""")
def neighbour_misses(spark, sf):
    """The targets of every other question stand next to its first hit, where that has a neighbour."""
    best, around = written(fuse.hybrid_topk(first(spark, sf, 3)[0], 3).select(F.lit("hybrid").alias("method"), "query_id", "rank", "id")), contexts(spark, sf)
    near = best.where("rank = 1 and query_id % 2 = 0").join(around, "id").select("query_id", F.get(F.filter(F.transform("ctx", lambda m: m["id"]), lambda i: i != F.col("id")), F.lit(0)).alias("near"))
    wanted = targets(spark, sf).join(near, "query_id", "left").select("query_id", F.coalesce("near", "expected_id").alias("expected_id"))
    rows = evaluate.run_rows(wanted, best, method_names(spark).where("method = 'hybrid'").select("method"))
    return evaluate.neighbour_misses(rows, around)


@query(f"""WITH {SCORED_SQL}, {TARGETS_SQL}, rk AS (SELECT ord, profile, query_id, id, row_number() OVER (PARTITION BY profile, query_id ORDER BY round(score, 9) DESC, id) AS r FROM scored),
ms AS (SELECT ord, profile, count_if(r = 1) AS top1, count(*) AS rec FROM rk JOIN tg USING (query_id) WHERE r <= 3 AND id = expected_id GROUP BY ALL) SELECT profile FROM ms ORDER BY top1 DESC, rec DESC, ord LIMIT 1""")
def profile_tuning(spark, sf):
    shared, rows = channels(spark, sf), None
    for ord_, profile in enumerate(fuse.PROFILES):
        best = lexical.top_k(first(spark, sf, 3, profile, shared)[0], "score", "id", 3).select(F.lit(ord_).alias("ord"), F.lit(profile).alias("profile"), "query_id", "rank", "id")
        rows = best if rows is None else rows.unionByName(best)
    return evaluate.tune(evaluate.profile_measures(rows, targets(spark, sf))).where("profile is not null")


@query(f"WITH {POOL_SQL}, {TARGETS_SQL} SELECT query_id, count(id) AS pool, coalesce(bool_or(id = expected_id), false) AS target_in_pool FROM tg LEFT JOIN pool USING (query_id) GROUP BY query_id")
def candidate_recall(spark, sf):
    return evaluate.candidate_recall(fuse.candidate_pool(first(spark, sf)[0]), targets(spark, sf))


@query(f"WITH {SCORED_SQL}, {TARGETS_SQL} SELECT query_id, r AS target_rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM bal) b JOIN tg USING (query_id) WHERE id = expected_id")
def target_rank(spark, sf):
    return fuse.target_rank(written(scored(spark, sf)[0]), targets(spark, sf))


@query(f"WITH {LABELS_SQL} SELECT query_id, expected_id, c_name AS target_text, c_custkey IS NULL AS dangling FROM labels_ LEFT JOIN (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 'gone ' ELSE '' END || c_custkey AS id FROM customer) ON id = expected_id")
def attach_target(spark, sf):
    """Customers are the targets; every tenth has another id."""
    people = views.table(spark, sf, "customer").select(renamed("c_custkey").alias("id"), F.col("c_name").alias("text"))
    return evaluate.attach_target(labels(spark, sf), people)


@query(f"WITH {LABELS_SQL}, p AS (SELECT pair_id, count(*) AS n, count(DISTINCT language) AS l, count(DISTINCT expected_id) AS t FROM labels_ GROUP BY 1) SELECT pair_id, 'rows' AS problem FROM p WHERE n <> 2 UNION ALL SELECT pair_id, 'languages' FROM p WHERE l <> 2 UNION ALL SELECT pair_id, 'targets' FROM p WHERE t <> 1")
def pair_check(spark, sf):
    return evaluate.pair_check(labels(spark, sf))


def renamed(key: str) -> F.Column:
    """A customer's id as text; every tenth is another one."""
    return F.concat(F.when(F.col(key) % 10 == 0, "gone ").otherwise(""), F.col(key).cast("string"))


@query(f"""WITH {LABELS_SQL}, t AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'gone ' ELSE '' END || c_custkey AS id, CASE WHEN c_custkey % 10 = 1 THEN 'the of' ELSE 'order budget of ' || c_mktsegment END AS text FROM customer),
 l AS (SELECT *, CASE WHEN query_id % 7 = 0 THEN ' ORDER Budget ' WHEN query_id % 7 = 1 THEN 'the of' ELSE query END AS q, row_number() OVER (ORDER BY query_id) AS place FROM labels_),
 j AS (SELECT l.*, text, id IS NULL AS dangling, count(*) OVER (PARTITION BY lower(trim(q))) AS same FROM l LEFT JOIN t ON id = expected_id)
SELECT query_id, 'target' AS rule FROM j WHERE dangling UNION ALL SELECT query_id, 'category' FROM j WHERE category = '5-LOW' UNION ALL SELECT query_id, 'same query' FROM j WHERE same > 1 UNION ALL SELECT query_id, 'order' FROM j WHERE label_id <> printf('Q%03d', place)
UNION ALL SELECT query_id, 'query words' FROM j WHERE q = 'the of' UNION ALL SELECT query_id, 'target words' FROM j WHERE text = 'the of' UNION ALL SELECT query_id, 'overlap flag' FROM j WHERE NOT dangling AND hard""")
def label_violations(spark, sf):
    """Customers are the targets; every tenth has another id, one in ten has no content words, nor has one query in seven, another one in seven is the same; one category is unknown. No target is without common words where both have any, so no label is hard."""
    people = views.table(spark, sf, "customer").select(renamed("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 1, "the of").otherwise(F.concat(F.lit("order budget of "), "c_mktsegment")).alias("text"))
    asked = labels(spark, sf).withColumn("query", F.when(F.col("query_id") % 7 == 0, " ORDER Budget ").when(F.col("query_id") % 7 == 1, "the of").otherwise(F.col("query")))
    return evaluate.label_violations(asked, people, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], r"^Q\d{3,}$")


@query(f"WITH {RECORDS_SQL},{ASKS_SQL}, el AS (SELECT query_id, id FROM asks, messages WHERE k IN (0, 4) OR (k = 1 AND sender = 'assistant') OR (k = 2 AND strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') = '2026-03') OR (k = 3 AND message_type = 'image')), {TARGETS_SQL} SELECT count(DISTINCT id) AS targets, coalesce(string_agg(DISTINCT thread_id, ',' ORDER BY thread_id), '') AS threads FROM tg JOIN records ON id = expected_id")
def thread_coverage(spark, sf):
    return evaluate.thread_coverage(targets(spark, sf), views.records(spark, sf))
