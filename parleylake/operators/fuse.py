"""Fusion of signals under hard constraints, bounded candidate re-scoring, and the whole search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.functions.text import content_words, local_time
from parleylake.operators import pool
from parleylake.operators.lexical import top_k

#: Weight profiles (contextual, semantic, lexical), bonuses, what a hard filter moves, pool width, re-scoring share.
PROFILES = {"context_first": (0.55, 0.20, 0.15), "balanced": (0.35, 0.35, 0.20), "original_first": (0.20, 0.55, 0.15), "anchor_first": (0.10, 0.65, 0.15)}
PERSON_BONUS, DATE_BONUS, MOVED = 0.05, 0.05, 0.10
POOL, RESCORE = 128, 0.85


def profiles(spark: SparkSession) -> DataFrame:
    rows = [(i, n, c, s, x, PERSON_BONUS, DATE_BONUS, MOVED) for i, (n, (c, s, x)) in enumerate(PROFILES.items())]
    if any(abs(sum(r[2:7]) - 1) > 1e-9 or not 0 <= r[7] <= r[2] for r in rows):
        raise ValueError("a profile's weights sum to one")
    return spark.createDataFrame(rows, "ord int, profile string, contextual_weight double, semantic_weight double, lexical_weight double, person_bonus double, date_bonus double, moved double")


def weights(constraints: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per query and profile its weights; a hard filter moves weight from the context to the message itself. Profiles are a handful of rows."""
    moved = F.when(F.col("has_filter"), F.col("moved")).otherwise(0.0)
    return constraints.select("query_id", "has_filter").crossJoin(F.broadcast(chosen)).select(
        "query_id", "ord", "profile", (F.col("contextual_weight") - moved).alias("w_contextual"), (F.col("semantic_weight") + moved).alias("w_semantic"), F.col("lexical_weight").alias("w_lexical"), "person_bonus", "date_bonus"
    )


def _seen(messages: DataFrame, zone: str) -> DataFrame:
    """What the constraints look at in a message."""
    day, hour = local_time(F.col("ts"), zone)
    return messages.select("id", "sender", F.col("message_type").alias("own_type"), day.alias("day"), hour.alias("hour"))


def _asked(constraints: DataFrame) -> DataFrame:
    return constraints.select("query_id", "person", "mode", "start", "end", "hour_lo", "hour_hi", "message_type")


def _meets() -> Column:
    """Whether a message meets all of a query's hard constraints; those that are absent hold."""
    either = lambda absent, test: absent | F.coalesce(test, F.lit(False))
    return (
        either(F.col("mode") != "filter", F.col("sender") == F.col("person"))
        & either(F.col("start").isNull(), F.col("day").between(F.col("start"), F.col("end")))
        & either(F.col("hour_lo").isNull(), (F.col("hour") >= F.col("hour_lo")) & (F.col("hour") < F.col("hour_hi")))
        & either(F.col("message_type").isNull(), F.col("own_type") == F.col("message_type"))
    )


#: Up to so many queries without any bound are broadcast: each gives every message a row in any case.
UNBOUND = 100_000


def eligible(constraints: DataFrame, messages: DataFrame, zone: str) -> DataFrame:
    """(``query_id``, ``id``) of messages that meet all of a query's hard constraints; those that are absent hold.

    A query looks for its messages by one key: the days between its dates, cut to those that the table has, else
    its sender, else its type. Messages bring the same keys, so an equi-join finds them, and the other
    constraints are tested on what it finds. Only queries without any bound meet every message.
    """
    asked, seen = _asked(constraints), _seen(messages, zone)
    by_sender = F.coalesce(F.col("mode") == "filter", F.lit(False))
    kind = F.when(F.col("start").isNotNull(), "day").when(by_sender, "sender").when(F.col("message_type").isNotNull(), "type")
    ends = seen.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))  # one row
    bound = asked.withColumn("kind", kind).where("kind is not null").crossJoin(F.broadcast(ends))
    low, high = F.greatest("start", "first_day"), F.least("end", "last_day")
    days = F.when(low <= high, F.transform(F.sequence(low, high), lambda d: d.cast("string")))
    values = F.when(F.col("kind") == "day", days).when(F.col("kind") == "sender", F.array("person")).otherwise(F.array("message_type"))
    bound = bound.withColumn("value", F.explode(values)).drop("first_day", "last_day")
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("day", F.col("day").cast("string")), ("sender", F.col("sender")), ("type", F.col("own_type")))])
    keyed = seen.select("*", F.inline(keys))
    found = keyed.join(bound, ["kind", "value"]).where(_meets()).select("query_id", "id")
    free = asked.withColumn("kind", kind).where("kind is null")
    few = free.select("query_id").limit(UNBOUND + 1).count() <= UNBOUND
    return found.unionByName(seen.crossJoin(F.broadcast(free) if few else free).where(_meets()).select("query_id", "id"))  # hours alone are no key


def eligible_counts(constraints: DataFrame, allowed: DataFrame, messages: DataFrame) -> DataFrame:
    """Per query the eligible and excluded messages; queries that exclude all keep their row."""
    found = allowed.groupBy("query_id").agg(F.count("*").alias("eligible"))
    size = messages.agg(F.count("*").alias("corpus"))
    rows = constraints.select("query_id").join(found, "query_id", "left").crossJoin(F.broadcast(size))  # one row
    return rows.select("query_id", F.coalesce("eligible", F.lit(0)).alias("eligible"), (F.col("corpus") - F.coalesce("eligible", F.lit(0))).alias("excluded"))


def align_scores(base: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """``base`` (query_id, id) with a channel's scores; a message without one has 0."""
    return base.join(scores, ["query_id", "id"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def hybrid_signals(dense: DataFrame | tuple[DataFrame, DataFrame], lexical: DataFrame | tuple, constraints: DataFrame, messages: DataFrame, zone: str) -> DataFrame:
    """Per query and message: semantic, contextual, lexical, person_match, date_match, eligible.

    ``dense`` has (query_id, id, semantic, contextual) in [0, 1] of every message and ``lexical`` its scores. Or they are what these
    are products of: (``vectors`` (query_id, vector), ``own`` (id, own, around)) and (``query_weights``, ``postings``). Then the channels
    and constraints of a pair are made at once, where its message is, and no table of pairs is joined. Constraints are
    tested on the pairs in both cases, so no second table of queries and messages is made for them.
    """
    if isinstance(dense, tuple):
        return pool.all_signals(*_sides(_asked(constraints), *dense, *lexical, messages, zone))
    rows = align_scores(dense, lexical, "lexical").join(_asked(constraints), "query_id").join(_seen(messages, zone), "id")
    rows = rows.withColumn("eligible", F.coalesce(_meets(), F.lit(False)))
    person = F.coalesce((F.col("mode") != "none") & (F.col("sender") == F.col("person")), F.lit(False))
    return rows.select("query_id", "id", "semantic", "contextual", "lexical", person.alias("person_match"), (F.col("start").isNotNull() & F.col("eligible")).alias("date_match"), "eligible")


def _sides(asked: DataFrame, vectors: DataFrame, own: DataFrame, query_weights: DataFrame, postings: DataFrame, messages: DataFrame, zone: str) -> tuple[DataFrame, DataFrame]:
    """Questions with vector and terms, messages with both vectors and terms."""
    lists, held = pool.terms_by_row(query_weights, postings)
    return asked.join(vectors, "query_id").join(lists, "query_id", "left"), _seen(messages, zone).join(own, "id").join(held, "id", "left")


def hybrid_score() -> Column:
    parts = F.col("w_contextual") * F.col("contextual") + F.col("w_semantic") * F.col("semantic") + F.col("w_lexical") * F.col("lexical")
    return parts + F.when(F.col("person_match"), F.col("person_bonus")).otherwise(0.0) + F.when(F.col("date_match"), F.col("date_bonus")).otherwise(0.0)


def hybrid_scores(signals: DataFrame, weighted: DataFrame) -> DataFrame:
    """Eligible rows with ``score``, for each profile in ``weighted``."""
    return signals.where("eligible").join(weighted, "query_id").withColumn("score", hybrid_score())


def hybrid_topk(scored: DataFrame, k: int = 5) -> DataFrame:
    return top_k(scored, "score", "id", k).select("query_id", "rank", "id", "score", "semantic", "contextual", "lexical", "person_match", "date_match")


def candidate_pool(scored: DataFrame, k: int = 5, width: int = POOL) -> DataFrame:
    """(``query_id``, ``id``): the best of the fused score, and of each channel where positive."""
    return pool.candidate_pool(scored, k, width).select("query_id", "id")


def first_stage(constraints: DataFrame, weighted: DataFrame, vectors: DataFrame, query_weights: DataFrame, own: DataFrame, postings: DataFrame, messages: DataFrame, zone: str, width: int = POOL) -> DataFrame:
    """The rows with signals and ``score`` that can be in a question's pool, or among its ``width`` best, under the weights of one profile.

    ``vectors`` (query_id, vector), ``own`` (id, own, around), ``query_weights`` and ``postings`` as of the lexical index.
    """
    return pool.first_stage(*_sides(_asked(constraints).join(weighted, "query_id"), vectors, own, query_weights, postings, messages, zone), width)


def pair_text(text: Column, sender: Column, timestamp: Column) -> Column:
    return F.concat(text, F.lit("\nSender: "), sender, F.lit(". Sent: "), F.substring(timestamp, 1, 10), F.lit("."))


def shared_words(query: Column, text: Column) -> Column:
    """Share of the query's content words that the text has: a stand-in for a caller's pair model (a Pandas UDF of two texts)."""
    asked = content_words(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, content_words(text))), F.size(asked)), F.lit(0.0))


def pair_score(pool: DataFrame, queries: DataFrame, messages: DataFrame, model=shared_words) -> DataFrame:
    """``pool`` with ``pair``, the model's score of query and message; a score outside [0, 1] ends the job. Nothing is scored for empty pools."""
    rows = pool.join(queries.select("query_id", "query"), "query_id").join(messages.select("id", pair_text(F.col("text"), F.col("sender"), F.col("timestamp")).alias("said")), "id")
    score = model(F.col("query"), F.col("said"))
    checked = F.when((score >= 0) & (score <= 1) & ~F.isnan(score), score).otherwise(F.raise_error(F.lit("a pair score must be in [0, 1]")).cast("double"))
    return rows.select("query_id", "id", checked.alias("pair"))


def rerank_topk(scored: DataFrame, pairs: DataFrame, k: int = 5, share: float = RESCORE) -> DataFrame:
    """The ``k`` best of the pool by pair and fused score."""
    rows = scored.join(pairs, ["query_id", "id"]).withColumn("first_stage", F.col("score")).withColumn("score", share * F.col("pair") + (1 - share) * F.col("first_stage"))
    return top_k(rows, "score", "id", k)


def search(constraints: DataFrame, ranked: DataFrame, messages: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per query: how it was understood, and ``results`` in order of rank: message, neighbours, scores. Queries without hits keep their row."""
    hits = ranked.join(messages.select("id", "sender", "timestamp", "text", "message_type"), "id").join(windows, "id")
    message = F.struct("id", "sender", "timestamp", "text", "message_type").alias("message")
    hit = F.struct("rank", message, F.col("previous"), F.col("next"), "score", "semantic", "contextual", "lexical", "pair")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("results"))
    return constraints.join(listed, "query_id", "left").withColumn("results", F.coalesce("results", F.array().cast(listed.schema["results"].dataType)))


def target_rank(scored: DataFrame, targets: DataFrame) -> DataFrame:
    """(``query_id``, ``target_rank``): the place of the expected message among all eligible; counted, not sorted."""
    wanted = scored.join(targets.select("query_id", F.col("expected_id").alias("id")), ["query_id", "id"]).select("query_id", F.round("score", 9).alias("own"), F.col("id").alias("own_id"))
    mine = F.round("score", 9)
    before = (mine > F.col("own")) | ((mine == F.col("own")) & (F.col("id") < F.col("own_id")))
    return scored.join(wanted, "query_id").groupBy("query_id").agg((F.count_if(before) + 1).alias("target_rank"))
