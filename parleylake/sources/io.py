"""Reading and writing messages, metadata, labels, reports and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.functions.text import MESSAGE_TYPES, normalize_text
from parleylake.operators.dense import vector_problems
from parleylake.operators.evaluate import guarded

FIELDS = ["id", "timestamp", "sender", "text"]


def read_messages(spark: SparkSession, path: str, fail_fast: bool = False) -> DataFrame:
    """JSON lines as messages with ``problems``: an empty array for a good row; ``line`` keeps the source.

    Rules: the line is an object (a blank one isn't); id, timestamp, sender and text are non-blank strings;
    the timestamp has an offset; the type is a known string (absent: text); the id occurs once. With
    ``fail_fast`` the first bad row that a task meets ends the job with its line, and so does an empty corpus.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    held = F.try_parse_json("line")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(F.col("held"), f"$.{name}", "variant"))
    rows = lines.withColumn("held", held).select("line", "held", *[F.try_variant_get("held", f"$.{c}", "string").alias(c) for c in [*FIELDS, "message_type"]], *[kind(c).alias(f"kind_{c}") for c in [*FIELDS, "message_type"]])
    is_object = F.coalesce(F.startswith(F.schema_of_variant("held"), F.lit("OBJECT")), F.lit(False))
    typed = F.when(F.col("kind_message_type").isNull(), F.lit("text")).when(F.col("kind_message_type") == "STRING", F.col("message_type"))  # a null in the line is no string
    rows = rows.withColumn("message_type", typed)
    good = lambda c: F.coalesce((F.col(f"kind_{c}") == "STRING") & (F.btrim(F.col(c)) != ""), F.lit(False))
    offset = F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.col("timestamp").try_cast("timestamp").isNotNull()
    problems = F.when(~is_object, F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(
        *[F.when(~good(c), F.lit(f"bad {c}")) for c in FIELDS], F.when(good("timestamp") & ~offset, F.lit("no offset")), F.when(~F.coalesce(F.col("message_type").isin(MESSAGE_TYPES), F.lit(False)), F.lit("unknown type"))
    )))
    rows = rows.withColumn("problems", problems)
    twice = rows.where(good("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("twice"))
    rows = rows.join(twice, "id", "left").withColumn("problems", F.when(F.col("twice"), F.array_append("problems", F.lit("duplicate id"))).otherwise(F.col("problems")))
    if fail_fast:
        rows = rows.withColumn("problems", F.when(F.size("problems") > 0, F.raise_error(F.concat_ws(": ", F.array_join("problems", ", "), "line"))).otherwise(F.col("problems")))
    ts = F.when(F.size("problems") == 0, F.col("timestamp").try_cast("timestamp"))
    found = rows.select("id", "timestamp", ts.alias("ts"), "sender", "text", "message_type", "problems", "line")
    return guarded(found, lines.agg(F.count("*").alias("n")), F.col("n") > 0, "the corpus is empty") if fail_fast else found


def write_messages(messages: DataFrame, path: str) -> None:
    """Compact JSON lines of the message fields, ordered within files."""
    messages.select(F.to_json(F.struct("id", "timestamp", "sender", "text", "message_type")).alias("value")).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per participant (``ord``, ``name``, ``reference_date``, ``zone``) of a metadata document; a broken rule ends the job."""
    schema = "reference_date string, timezone string, participants array<struct<id:string,name:string>>"
    held = spark.read.schema(schema).option("multiLine", True).json(path)
    names = F.transform("participants", lambda p: normalize_name(p["name"]))
    rules = {
        "an ISO reference date": F.col("reference_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("reference_date").try_cast("date").isNotNull(), "a time zone": F.btrim("timezone") != "",
        "participants": F.size("participants") > 0, "participants' names": ~F.exists(names, lambda n: n.isNull() | (n == "")), "distinct names": F.size(F.array_distinct(names)) == F.size(names),
    }
    for what, ok in rules.items():
        held = held.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"the metadata needs {what}")).cast("boolean")))
    return held.select("reference_date", F.col("timezone").alias("zone"), F.posexplode("participants").alias("ord", "p")).select("ord", F.col("p.id").alias("id"), F.col("p.name").alias("name"), "reference_date", "zone")


def normalize_name(name: Column) -> Column:
    """Lower case and single spaces; what needs NFKC is normalised before by ``normalize_text``."""
    return F.btrim(F.regexp_replace(F.lower(name), r"\s+", " "))


def alias_dim(participants: DataFrame) -> DataFrame:
    """(``alias``, ``names``): full, first and last names; an alias that people share has all of them, in the participants' order."""
    rows = participants.select("ord", "name", normalize_text(F.col("name")).alias("full"))
    parts = F.split("full", " ")
    each = rows.select("ord", "name", F.explode(F.array_distinct(F.array("full", parts[0], F.element_at(parts, -1)))).alias("alias"))
    return each.groupBy("alias").agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "name"))), lambda s: s["name"]).alias("names"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries from JSON files that hold one array each."""
    schema = "id string, query string, expected_message_id string, category string, zero_word_overlap boolean, notes string, pair_id string, language string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_reports(comparison: DataFrame, rows: DataFrame, path: str, methods: int) -> None:
    """The comparison as CSV and JSON and the methods' rows as Parquet, once all methods have answered the same questions.

    All three go into a new folder, and one commit at the end makes it the current report (see ``read_reports``).
    """
    facts = rows.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.sum(F.crc32(F.concat_ws("|", F.col("query_id").cast("string"), F.col("expected_id").cast("string")))).alias("inputs"))
    held = facts.agg(F.count("*").alias("methods"), F.count_distinct("n", "ids", "inputs").alias("kinds"), F.bool_and(F.col("n") == F.col("ids")).alias("once")).first()
    if held["methods"] != methods or held["kinds"] != 1 or not held["once"]:
        raise ValueError("the methods did not all answer the same questions once")
    spark, run, done = rows.sparkSession, f"run-{uuid.uuid4().hex}", _commits(rows.sparkSession, f"{path}/published")
    comparison.write.option("header", True).csv(f"{path}/{run}/comparison_csv")
    comparison.write.json(f"{path}/{run}/comparison_json")
    rows.write.partitionBy("method").parquet(f"{path}/{run}/rows")
    _commit(spark, f"{path}/published", len(done), run)


def read_reports(spark: SparkSession, path: str, part: str) -> DataFrame:
    """``comparison_csv``, ``comparison_json`` or ``rows`` of the report that was published last; one that failed on the way is never seen."""
    where = f"{path}/{_commits(spark, f'{path}/published')[-1]['batch']}/{part}"
    return spark.read.option("header", True).csv(where) if part.endswith("csv") else spark.read.json(where) if part.endswith("json") else spark.read.parquet(where)


COMMIT = "at int, batch string, n long, dims int, checksum string"


def _commits(spark: SparkSession, path: str) -> list:
    """The commits under ``path`` in order: a row and a folder each."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/*").orderBy("at").collect()
    except Exception as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        return []


def _commit(spark: SparkSession, path: str, at: int, batch: str, n: int = 0, dims: int = 0, checksum: str = "") -> None:
    """Publish ``batch`` as commit number ``at``; a second writer who takes the same number fails, as its folder is there."""
    spark.createDataFrame([(at, batch, n, dims, checksum)], COMMIT).coalesce(1).write.mode("errorifexists").parquet(f"{path}/{at:09d}")


def store_key(text: Column, settings: str) -> Column:
    return F.sha2(F.concat(F.lit(settings + "\x1f"), text), 256)


def new_texts(texts: DataFrame, store: DataFrame, settings: str) -> DataFrame:
    """(``key``, ``text``): the distinct texts of which the store has no vector under these settings."""
    wanted = texts.select(store_key(F.col("text"), settings).alias("key"), "text").dropDuplicates(["key"])
    return wanted.join(store.select("key"), "key", "left_anti")


STORE = "key string, vector array<float>"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The committed vectors (``key``, ``vector``); an absent store is empty."""
    done = [f"{path}/vectors/{c['batch']}" for c in _commits(spark, f"{path}/commits")]
    return spark.read.schema(STORE).parquet(*done) if done else spark.createDataFrame([], STORE)


def _facts(batch: DataFrame) -> DataFrame:
    """One row: vectors, their sizes, those that can't be normalised, and a sum over all that no order changes."""
    whole = F.xxhash64("key", F.to_json(F.struct("vector"))).cast("decimal(38,0)")
    size = F.size("vector")
    bad = F.count_if(F.coalesce(F.size(vector_problems(F.col("vector"), size)) > 0, F.lit(True)) | F.col("key").isNull())
    return batch.agg(F.count("*").alias("n"), F.coalesce(F.min(size), F.lit(0)).alias("least"), F.coalesce(F.max(size), F.lit(0)).alias("most"), bad.alias("bad"), F.coalesce(F.sum(whole).cast("string"), F.lit("")).alias("checksum"))


def check_store(spark: SparkSession, path: str) -> None:
    """End with an error if a committed batch isn't what was committed: a file is missing, damaged or changed."""
    for c in _commits(spark, f"{path}/commits"):  # a batch for each run
        try:
            found = _facts(spark.read.schema(STORE).parquet(f"{path}/vectors/{c['batch']}")).first()
        except Exception as broken:
            raise ValueError(f"the batch {c['batch']} can't be read") from broken
        if (found["n"], found["checksum"]) != (c["n"], c["checksum"]):
            raise ValueError(f"the batch {c['batch']} isn't what was committed")


def extend_store(texts: DataFrame, path: str, settings: str, encode: Column, verify: bool = False) -> DataFrame:
    """Add the vectors of new texts to the store at ``path`` and return the whole store; ``encode`` is a column over ``text``.

    Vectors are written as a batch and read back: null, ragged, zero and non-finite ones, or another size than
    the store's, end the job, and so does a writer who committed meanwhile; the batch is then never read. With
    ``verify`` the batches before it are checked first.
    """
    spark = texts.sparkSession
    if verify:
        check_store(spark, path)
    done, batch = _commits(spark, f"{path}/commits"), uuid.uuid4().hex
    new_texts(texts, read_store(spark, path), settings).select("key", encode.cast("array<float>").alias("vector")).write.parquet(f"{path}/vectors/{batch}")
    found = _facts(spark.read.schema(STORE).parquet(f"{path}/vectors/{batch}")).first()
    if found["n"]:
        if found["bad"] or found["least"] != found["most"] or done and done[0]["dims"] != found["most"]:
            raise ValueError(f"{found['bad']} vectors can't be used, sizes are {found['least']} to {found['most']}")
        _commit(spark, f"{path}/commits", len(done), batch, found["n"], found["most"], found["checksum"])
    return read_store(spark, path)
