"""License scan by diagonal voting.

An Arrow pass hashes every rolling word k-gram of every whole text; Spark joins the hashes to the
positions of the template k-grams (a fixed, small side). Each match votes for the diagonal
``document position - template position``. Votes are counted per (document, template, diagonal), and
each voted diagonal is merged with those up to ``NEIGHBOURS`` after it (a word more or less shifts the
rest): a band, which never grows beyond that, however often a text repeats itself. Bands with enough
votes are verified, each in full, against the text's own words.

A phrase is a template that must stand whole on one diagonal. A notice is a longer template: a band
needs ``VOTES`` of its k-grams, then ``COVERAGE`` of its words, each on one of the band's diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.llm._shared import materialize, table

K, SEED = 3, 42
COVERAGE, NEIGHBOURS = 0.6, 3
#: Share of a notice's k-grams that a band needs to be verified: a notice with every fourth word changed has a quarter of them and three quarters of its words.
VOTES = 0.2
#: Up to so many distinct texts to verify are named in a broadcast (some 200 bytes each); beyond, the join shuffles.
MAX_BROADCAST_TEXTS = 200_000

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Bytes that are no word characters become spaces; A-Z become a-z; other bytes stay.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of_text(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def _grams(words: list[bytes]) -> np.ndarray:
    n = max(len(words) - K + 1, 0)
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if n else ()
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n).view(np.int64)


def template_positions(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(``gram``, ``template``, ``t_at``) of all templates; ``template`` numbers phrases first."""
    texts = [*phrases, *notices]
    if short := [t for t in texts if len(words_of_text(t)) < K]:
        raise ValueError(f"templates need {K} words: {short}")
    rows = [(int(g), i, at) for i, t in enumerate(texts) for at, g in enumerate(_grams(words_of_text(t)).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, t_at int")


def _rolled(batches: Iterator[pa.RecordBatch], step: int = 200) -> Iterator[pa.RecordBatch]:
    """Per document one row with at = -1, whose gram is the number of words, and one per k-gram."""
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            at, gram, sizes = [], [], []
            for text in part.column("text").to_pylist():
                words = words_of_text(text)
                own = _grams(words)
                at.append(np.arange(-1, len(own), dtype=np.int32))
                gram.append(np.concatenate([np.array([len(words)], np.int64), own]))
                sizes.append(len(own) + 1)
            take = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            names = ["row_id", "doc_id", "key_a", "key_b"]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in names), pa.array(np.concatenate(at)), pa.array(np.concatenate(gram))], [*names, "at", "gram"])


def votes(docs: DataFrame, positions: DataFrame, sizes: DataFrame, share: float = VOTES) -> DataFrame:
    """Per row of ``docs`` (``row_id``, ``doc_id``, ``key_a``, ``key_b``, ``text``): ``n_words`` and candidate ``bands`` (template, diagonals)."""
    schema = f"row_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, key_a long, key_b long, at int, gram long"
    rolled = docs.mapInArrow(_rolled, schema)
    matched = rolled.join(F.broadcast(positions), "gram", "left").where(F.col("template").isNotNull() | (F.col("at") < 0))
    matched = matched.withColumn("template", F.when(F.col("at") >= 0, F.col("template")))
    keys = ["row_id", "doc_id", "key_a", "key_b"]
    diagonal = F.when(F.col("template").isNotNull(), F.col("at") - F.col("t_at"))
    voted = matched.groupBy(*keys, "template", diagonal.alias("diagonal")).agg(F.count("*").alias("n"), F.max(F.when(F.col("at") < 0, F.col("gram"))).alias("n_words"))
    after = Window.partitionBy(*keys, "template").orderBy("diagonal").rangeBetween(0, NEIGHBOURS)
    merged = voted.withColumn("n_band", F.sum("n").over(after)).withColumn("diagonals", F.collect_list("diagonal").over(after)).join(F.broadcast(sizes), "template", "left")
    enough = F.when(F.col("exact"), F.col("n") >= F.col("size")).otherwise(F.col("n_band") >= F.greatest(F.ceil(F.col("size") * share), F.lit(1)))
    band = F.when(F.col("template").isNotNull() & enough, F.struct("template", F.when(F.col("exact"), F.array("diagonal")).otherwise(F.col("diagonals")).alias("diagonals")))
    return merged.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(band)).alias("bands"))


def _held(words: list[bytes], whole: list[bytes], diagonals: list[int]) -> tuple[int, int, int]:
    """How many of a template's words stand on one of the diagonals, and the span from the first to behind the last of them."""
    first, last, n = len(words), -1, 0
    for t, word in enumerate(whole):
        at = [t + d for d in diagonals if 0 <= t + d < len(words) and words[t + d] == word]
        if at:
            first, last, n = min(first, *at), max(last, *at), n + 1
    return n, first, last + 1


def _verified(batches: Iterator[pa.RecordBatch], texts: list[list[bytes]], n_phrases: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """Verified spans; of overlapping bands of one notice the best is kept, of equal ones the shortest."""
    kind = pa.list_(pa.struct([pa.field("template", pa.int32()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("score", pa.float64())]))
    for batch in batches:
        out = []
        for text, bands in zip(batch.column("text").to_pylist(), batch.column("bands").to_pylist(), strict=True):
            words, kept = words_of_text(text), []
            for band in bands:  # by template, then diagonal
                template, whole = band["template"], texts[band["template"]]
                n, start, end = _held(words, whole, band["diagonals"])
                if n < len(whole) * (1 if template < n_phrases else coverage):
                    continue
                span = {"template": template, "start": start, "end": end, "score": n / len(whole)}
                if template >= n_phrases and kept and kept[-1]["template"] == template and start < kept[-1]["end"]:
                    if (span["score"], start - end) > (kept[-1]["score"], kept[-1]["start"] - kept[-1]["end"]):
                        kept[-1] = span
                else:
                    kept.append(span)
            out.append(kept)
        yield pa.RecordBatch.from_arrays([batch.column("key_a"), batch.column("key_b"), pa.array(out, kind)], ["key_a", "key_b", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, coverage: float = COVERAGE, share: float = VOTES, max_broadcast: int = MAX_BROADCAST_TEXTS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``found`` (template, word span, score), and the digest columns made of it.

    Null and wordless texts have no words and find nothing (``first_word`` and ``last_word`` null, labels
    empty, score 0), repeated rows each keep a row, further columns are ignored, an empty table gives an
    empty result.
    """
    spark, phrases, notices = docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    texts, labels = [words_of_text(t) for t in [*phrases, *notices]], [*phrases.values(), *notices.values()]
    sizes = spark.createDataFrame([(i, len(t) - K + 1, i < len(phrases)) for i, t in enumerate(texts)], "template int, size int, exact boolean")
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key_a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("key_b"), F.col(text_col).alias("text")
    )
    per = materialize(votes(keyed.withColumn("row_id", F.monotonically_increasing_id()), template_positions(spark, phrases, notices), sizes, share))
    doubt = per.where(F.size("bands") > 0).groupBy("key_a", "key_b").agg(F.first("bands").alias("bands"))
    if doubt.count() <= max_broadcast:
        doubt = F.broadcast(doubt)
    rows = keyed.select("key_a", "key_b", "text").join(doubt, ["key_a", "key_b"])
    found = "array<struct<template:int,start:int,end:int,score:double>>"
    n_phrases = len(phrases)
    checked = rows.mapInArrow(lambda b: _verified(b, texts, n_phrases, coverage), f"key_a long, key_b long, found {found}")
    checked = checked.groupBy("key_a", "key_b").agg(F.first("found").alias("found"))
    out = per.drop("bands").join(checked, ["key_a", "key_b"], "left").withColumn("found", F.coalesce("found", F.array().cast(found)))
    base = F.filter("found", lambda s: s["template"] < n_phrases)
    names = F.array(*[F.lit(x) for x in labels])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.element_at(names, s["template"] + 1)))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).cast("long").alias("last_word"), listed(base).alias("base_labels"), listed(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("score"), "found",
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the phrases and notices above."""
    return scan(table(spark, sf_dir, "documents")).drop("found")
