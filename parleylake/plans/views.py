"""What the operators work on, over the given tables: messages, participants, questions, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.functions.text import classify_type

REFERENCE_DATE, ZONE = "2002-01-01", "Asia/Kolkata"
TOPICS = ["random", "college", "travel", "assignments", "exams", "movies", "food", "coding", "events"]
#: 2026-03-01 01:35:00 UTC in epoch seconds: the first message.
FIRST = 1_772_328_900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as chat messages: id, chat_id, sender, ts, timestamp (text with offset), text, message_type."""
    second = F.expr(f"{FIRST} + (conv_id - conv_id % 3) * 43200 + (conv_id % 3) * 1800 + turn * 400 * (conv_id % 5 + 1)")
    mark = F.expr("CASE (conv_id + turn) % 11 WHEN 0 THEN '[Image] ' WHEN 1 THEN '[PDF] ' WHEN 2 THEN '[Voice message] ' WHEN 3 THEN 'Forwarded: ' WHEN 4 THEN 'https://example.com/x ' ELSE '' END")
    rows = table(spark, sf_dir, "conversations").select(
        F.format_string("C%06d_%02d", "conv_id", "turn").alias("id"), F.col("conv_id").alias("chat_id"), F.col("role").alias("sender"),
        F.timestamp_seconds(second).alias("ts"), F.concat(mark, "text").alias("text"),
    )
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return rows.withColumn("timestamp", stamp).withColumn("message_type", classify_type(F.col("text")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their corpus metadata: participant_id, topic, episode_id, thread_id."""
    return messages(spark, sf_dir).select(
        "*", F.col("sender").alias("participant_id"), F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("chat_id") % 9 + 1).cast("int")).alias("topic"),
        F.concat(F.lit("E"), F.col("chat_id").cast("string")).alias("episode_id"), F.when(F.col("chat_id") % 4 == 0, F.concat(F.lit("T"), (F.col("chat_id") % 3).cast("string"))).alias("thread_id"),
    )


def number_of(text: str) -> F.Column:
    """A number made from a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def dirty(rows: DataFrame) -> DataFrame:
    """Numbered records (``new_id``) of which some break one rule each, by the number of their id."""
    k = number_of("id") % 97
    return rows.withColumn("_k", k).withColumn("id", F.col("new_id")).drop("new_id").transform(lambda r: _broken_by(r, F.col("_k"))).drop("_k")


def _broken_by(rows: DataFrame, k: F.Column) -> DataFrame:
    return rows.withColumns({
        "text": F.when(k == 0, F.lit("  ")).otherwise(F.col("text")), "message_type": F.when(k == 1, "poem").when(k == 2, F.when(F.col("message_type") == "pdf", "image").otherwise("pdf")).otherwise(F.col("message_type")),
        "sender": F.when(k == 3, "nobody").otherwise(F.col("sender")), "timestamp": F.when(k == 4, F.substring("timestamp", 1, 19)).otherwise(F.col("timestamp")),
        "thread_id": F.when(k == 5, "X9").otherwise(F.col("thread_id")), "topic": F.when(k == 6, F.lit(None)).otherwise(F.col("topic")), "id": F.when(k == 7, F.concat(F.lit("Z"), "id")).otherwise(F.col("id")),
    })


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``ord``, ``name``): nations with their region as the last name, so last names are shared."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("ord"), F.concat_ws(" ", F.initcap("n_name"), F.initcap(F.split("r_name", " ")[0])).alias("name"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``query_id``, ``query``): one question for every order, with a person and a date; what it means is known from the order."""
    o = table(spark, sf_dir, "orders")
    rows = o.join(participants(spark, sf_dir), F.col("o_orderkey") % 25 == F.col("ord"))
    day, first, last = F.to_date("o_orderdate"), F.split("name", " ")[0], F.split("name", " ")[1]
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    texts = [
        F.concat(F.lit("What did "), "name", F.lit(" say about the budget on "), iso(day), F.lit("?")),
        F.concat(first, F.lit(" ne budget pe kya bola in "), F.date_format(day, "MMMM yyyy"), F.lit("?")),
        F.concat(F.lit("messages about "), first, F.lit(" from "), iso(day), F.lit(" to "), iso(F.date_add(day, 7))),
        F.concat(first, F.lit("'s budget limit on "), F.date_format(day, "d MMMM yyyy")),
        F.concat(F.lit("What did "), last, F.lit(" say yesterday morning?")),
        F.concat(F.lit("Find the image of our poster from "), "name", F.lit(" in late "), F.date_format(day, "MMMM yyyy")),
        F.concat(F.lit("Show me the PDF about the "), F.date_format(day, "MMMM yyyy"), F.lit(" trip")),
        F.concat(F.lit("What happened on "), F.date_format(day, "MM/dd/yyyy"), F.lit(" at night?")),
    ]
    text = texts[-1]
    for k, t in enumerate(texts[:-1]):
        text = F.when(F.col("o_orderkey") % 8 == k, t).otherwise(text)
    return rows.select(F.col("o_orderkey").alias("query_id"), text.alias("query"))


MESSAGES_SQL = f"""
msg0 AS (SELECT printf('C%06d_%02d', conv_id, turn) AS id, conv_id AS chat_id, role AS sender,
  {FIRST} + (conv_id - conv_id % 3) * 43200 + (conv_id % 3) * 1800 + turn * 400 * (conv_id % 5 + 1) AS t,
  CASE (conv_id + turn) % 11 WHEN 0 THEN '[Image] ' WHEN 1 THEN '[PDF] ' WHEN 2 THEN '[Voice message] ' WHEN 3 THEN 'Forwarded: ' WHEN 4 THEN 'https://example.com/x ' ELSE '' END || text AS text FROM conversations),
messages AS MATERIALIZED (SELECT *, make_timestamp(t * 1000000) AS ts, strftime(make_timestamp(t * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp,
  CASE WHEN starts_with(text, '[Image]') THEN 'image' WHEN starts_with(text, '[PDF]') THEN 'pdf' WHEN starts_with(text, '[Voice message]') THEN 'voice' WHEN starts_with(text, 'Forwarded:') THEN 'forwarded'
       WHEN contains(text, 'https://') THEN 'url' ELSE 'text' END AS message_type FROM msg0)"""
RECORDS_SQL = f"""{MESSAGES_SQL},
records AS (SELECT *, sender AS participant_id, ({TOPICS})[chat_id % 9 + 1] AS topic, 'E' || chat_id AS episode_id, CASE WHEN chat_id % 4 = 0 THEN 'T' || (chat_id % 3) END AS thread_id FROM messages)"""
PARTICIPANTS_SQL = """
participants AS (SELECT n_nationkey AS ord, upper(n_name[1]) || lower(n_name[2:]) || ' ' || upper(r_name[1]) || lower(split_part(r_name, ' ', 1)[2:]) AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
#: What each question means, from its order.
MEANT_SQL = f"""{PARTICIPANTS_SQL},
meant AS (SELECT o_orderkey AS query_id, o_orderkey % 8 AS k, o_orderdate::DATE AS d, name FROM orders JOIN participants ON o_orderkey % 25 = ord)"""
