"""Benchmark decontamination with DataFrame functions only.

Every benchmark item is cut into windows of ``n`` words (a shorter item is one window). The
64-bit hashes of the distinct windows form the broadcast side. Each document's word array is
exploded once inside whole-stage code generation, the hash of the window that starts at each
position probes the broadcast set, and only on an equal hash are the words themselves compared.
No text is shuffled: one narrow row per document, and one per hit, reach the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parleylake.llm._shared import materialize, table, words_of

WINDOW = 10
#: Up to so many distinct benchmark windows are broadcast (some 200 bytes each); beyond, the join shuffles.
MAX_BROADCAST_WINDOWS = 500_000


def benchmark_windows(items: DataFrame, n: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(``w_len``, ``w_hash``, ``w_words``, ``w_item``) of every distinct window and item that has it; item ids are strings, null as ''."""
    words = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("w_item"), words_of(F.col(text_col)).alias("words"))
    size = F.size("words")
    starts = words.where(size > 0).select(
        "w_item", "words", F.least(size, F.lit(n)).alias("w_len"), F.explode(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))).alias("at")
    )
    grams = starts.select("w_item", "w_len", F.slice("words", F.col("at"), F.col("w_len")).alias("w_words")).distinct()
    return grams.select("w_len", _hash("w_words", 0, n).alias("w_hash"), "w_words", "w_item")


def _hash(words: str, start: F.Column | int, length: int):
    """Hash of ``length`` words from ``start``; words beyond the end are null, which ``xxhash64`` skips."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(length)])


def _text_key(text: str) -> list[F.Column]:
    """Two hashes that together name a text."""
    return [F.xxhash64(F.col(text)).alias("key_a"), F.xxhash64(F.lit(1), F.col(text)).alias("key_b")]


def find_hits(docs: DataFrame, windows: DataFrame, n: int = WINDOW, text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Rows (``row_id``, the other columns of ``docs`` but its text, ``n_words``, ``at``, ``w_len``, ``w_id``).

    ``windows`` has ``w_len``, ``w_hash``, ``w_words``, each window once. One row per verified window
    occurrence, named by ``w_id`` (its words' hash), and at least one row per document: where a document
    has no hit at its first position, that row has a null ``w_id``.

    Up to ``max_broadcast`` windows are broadcast. Beyond, a narrow row per position (text key, position,
    hash) meets the windows' hashes; what survives is brought back to the texts and verified there.
    """
    keep = [c for c in docs.columns if c != text_col]
    held = windows.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("w_len")).alias("lens")).first()  # at most n lengths
    lens, small = list(held["lens"]) or [n], held["n"] <= max_broadcast
    windows = windows.select("w_len", "w_hash", "w_words", _window_id())

    def probes(base: DataFrame) -> DataFrame:
        spots = base.select("*", F.posexplode_outer("words").alias("at", "_word")).drop("_word")
        if lens == [n]:
            return spots.withColumn("p_len", F.lit(n)).withColumn("p_hash", _hash("words", F.col("at"), n))
        # items shorter than n words: one probe for each length that occurs, at most n of them
        return spots.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("p_len"), _hash("words", F.col("at"), k).alias("p_hash")) for k in lens])))

    base = docs.select(F.monotonically_increasing_id().alias("row_id"), *keep, words_of(F.col(text_col)).alias("words"), *([] if small else _text_key(text_col)))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    equal = F.col("p_hash") == F.col("w_hash")
    if small:
        # equal words are checked after the join: as a join condition they would slow the probe of every position
        same = (F.col("p_len") == F.col("w_len")) & (F.slice("words", F.col("at") + 1, F.col("p_len")) == F.col("w_words"))
        found = probes(base).join(F.broadcast(windows), equal, "left").withColumn("w_id", F.when(same, F.col("w_id")))
        first = F.col("at").isNull() | (F.col("at") == 0)
        return found.where(F.col("w_id").isNotNull() | first).select("row_id", *keep, "n_words", "at", "w_len", "w_id")
    texts = docs.select(*_text_key(text_col), words_of(F.col(text_col)).alias("words"))
    spots = probes(texts).where(F.col("at").isNotNull()).select("key_a", "key_b", "at", "p_len", "p_hash")
    survivors = spots.join(windows, equal & (F.col("p_len") == F.col("w_len"))).select("key_a", "key_b", F.struct("at", "w_len", "w_id", "w_words").alias("spot"))
    survivors = survivors.groupBy("key_a", "key_b").agg(F.collect_set("spot").alias("spots"))  # of one text, whose rows share it
    verified = F.filter("spots", lambda x: F.slice("words", x["at"] + 1, x["w_len"]) == x["w_words"])
    found = base.join(survivors, ["key_a", "key_b"], "left").withColumn("spots", verified)
    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("w_len"), F.lit(None).cast("string").alias("w_id")))
    listed = F.when(F.size("spots") > 0, F.transform("spots", lambda x: F.struct(x["at"].alias("at"), x["w_len"].alias("w_len"), x["w_id"].alias("w_id")))).otherwise(none)
    return found.select("row_id", *keep, "n_words", F.inline(listed))


def _window_id() -> F.Column:
    """A window's name: a hash of its words that no two windows share."""
    return F.md5(F.array_join("w_words", " ")).alias("w_id")


def _let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of ``value``, which is computed once and not for each element that a lambda looks at."""
    return F.get(F.transform(F.array(value), body), 0)


def merged_spans(spans: F.Column, n: int) -> F.Column:
    """The runs of sorted, distinct ``spans`` (start, end) of at most ``n`` words that touch or overlap, in time linear in the spans.

    With each start once, at its furthest end, what is more than ``n`` places before a span can't reach beyond the
    spans between; so a span is held against the ends of ``n`` others, and so is the end of a run.
    """
    kind = "array<struct<start:int,end:int>>"

    def runs(held: F.Column, ends: F.Column) -> F.Column:
        fresh = lambda i: (i == 0) | (F.get(held, i)["start"] > F.array_max(F.slice(ends, F.greatest(i - n, F.lit(0)) + 1, F.least(F.greatest(i, F.lit(1)), F.lit(n)))))
        begins = F.filter(F.sequence(F.lit(0), F.size(held) - 1), fresh)

        def closed(begins: F.Column) -> F.Column:
            def run(first: F.Column, j: F.Column) -> F.Column:
                after = F.coalesce(F.get(begins, j + 1), F.size(held))
                lo = F.greatest(first, after - n)
                return F.struct(F.get(held, first)["start"].alias("start"), F.array_max(F.slice(ends, lo + 1, after - lo)).alias("end"))

            return F.transform(begins, run)

        return _let(begins, closed)

    furthest = lambda all_: F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + 1)["start"] > x["start"], F.lit(True)))
    whole = _let(spans, lambda all_: _let(furthest(all_), lambda held: _let(F.transform(held, lambda x: x["end"]), lambda ends: runs(held, ends))))
    return F.when(F.size(spans) > 0, whole).otherwise(F.array()).cast(kind)


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``hit_spans``.

    Null or wordless texts have no words and no hits; an empty benchmark gives no hits. Repeated rows
    each keep their own row, null ids stay null. Further columns of either table are ignored.
    ``hit_spans`` are the merged word spans (start, end), which ``remove_spans`` takes. Items are looked up
    once for each distinct set of windows that documents hold, not for each hit.
    """
    windows = materialize(benchmark_windows(items, n, item_col, item_text_col))
    distinct = windows.select("w_len", "w_hash", "w_words").distinct()
    hits = find_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), distinct, n, max_broadcast=max_broadcast)
    hit = F.col("w_id").isNotNull()
    spans = F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("w_len")).alias("end")))))
    per = materialize(hits.groupBy("row_id", "doc_id", "n_words").agg(spans.alias("spans"), F.array_sort(F.collect_set("w_id")).alias("w_ids")))
    sets = per.where(F.size("w_ids") > 0).select("w_ids").distinct()
    named = windows.select(_window_id(), "w_item")
    found = sets.select("w_ids", F.explode("w_ids").alias("w_id")).join(named, "w_id").groupBy("w_ids").agg(F.array_sort(F.collect_set("w_item")).alias("found"))
    clean = per.where(F.size("w_ids") == 0).withColumn("found", F.array().cast("array<string>"))  # most rows: they don't move for the look-up
    per = per.where(F.size("w_ids") > 0).join(found, "w_ids").unionByName(clean)
    per = per.withColumn("hit_spans", merged_spans(F.col("spans"), n))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return per.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "hit_spans",
    )


def remove_documents(docs: DataFrame, items: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold any benchmark window; columns and other rows are as they were.

    A contaminated text is removed wherever it stands, so the anti join goes by the text's hash and
    length; repeated rows stay repeated and null texts stay.
    """
    windows = benchmark_windows(items, n, item_col, item_text_col).select("w_len", "w_hash", "w_words").distinct()
    key = F.struct(F.xxhash64(F.col(text_col)), F.octet_length(F.col(text_col)), F.md5(F.col(text_col)))
    hits = find_hits(docs.select(key.alias("text_key"), F.col(text_col).alias("text")), windows, n)
    bad = hits.where(F.col("w_id").isNotNull()).select(F.col("text_key").alias("_bad_key")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key"))  # whole rows, so no column of theirs can clash
    return rows.join(bad, F.col("_key") == F.col("_bad_key"), "left_anti").select("_row.*")


def remove_spans(docs: DataFrame, items: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with every hit word blanked out of the text; separators, other columns and the number of rows stay.

    What is hit depends on a text alone, so spans are joined back by the text's hashes and length: rows
    with null or repeated ids and repeated rows each get their own text's spans. Null and empty texts stay
    as they are, an empty table gives an empty result, an empty benchmark changes nothing.
    """
    key = F.struct(F.xxhash64(F.col(text_col)), F.octet_length(F.col(text_col)), F.md5(F.col(text_col)))
    found = scan(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), items, n, "doc_id", "text", item_col, item_text_col)
    found = found.where("contaminated").groupBy(F.col("doc_id").alias("_key")).agg(F.first("hit_spans").alias("_spans"))
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key")).join(found, "_key", "left")  # whole rows, so no column of theirs can clash
    own, hit = lambda c: F.col("_row").getField(c), F.col("_spans").isNotNull()
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the text still has its upper case
    rows = rows.withColumn("_parts", F.when(hit, F.regexp_extract_all(own(text_col), F.lit(gap + "|" + gap.replace("[", "[^")), F.lit(0))))
    lead = F.when(F.col("_parts")[0].rlike(f"^{gap}"), 1).otherwise(0)
    inside = lambda i: F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    blank = F.transform("_parts", lambda p, i: F.when(((i - lead) % 2 == 0) & inside(((i - lead) / 2).cast("int")), F.lit("")).otherwise(p))
    changed = {text_col: F.when(hit, F.array_join(blank, "")).otherwise(own(text_col))}
    return rows.select([changed.get(c, own(c)).alias(c) for c in docs.columns])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
                  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
     dp AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
     h AS (SELECT rid, i, n, item_id FROM (SELECT rid, i, k, list_slice(w, i, i + k - 1) AS g, len(w) AS lw
                                           FROM dp, (SELECT DISTINCT n AS k FROM bw)) x
           JOIN bw ON x.k = bw.n AND x.g = bw.g AND x.i + x.k - 1 <= x.lw),
     hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY rid),
     its AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
