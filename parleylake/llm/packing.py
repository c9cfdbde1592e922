"""Best-fit packing of tokenised documents, planned on the length histogram.

The plan is made on counts: at most ``capacity`` distinct lengths come to the driver, and best-fit
decreasing runs over groups of equal bins instead of over documents. Pieces then take the planned
slots by joining on their rank within their length. Ranks are distributed: pieces are numbered within
(length, chunk), and the chunks' counts give each chunk its first rank, so a hot length is spread too.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.llm._shared import materialize, table

CAPACITY, END_ID = 1024, 2
#: Pieces a chunk that is ranked by itself.
CHUNK = 1 << 18
#: The pre-token pattern of byte-level vocabularies, and their bytes that are written as themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: tiktoken's stack doesn't hold the look-ahead of longer runs of blanks (it fails at about a million): such texts go to tokenizers whole.
BLANKS = 100_000
LONG_BLANK = re.compile(r"\s{%d}" % BLANKS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, of a byte-level BPE vocabulary in a tokenizer's JSON file.

    The merges run in tiktoken, several times as fast as in tokenizers and with the same ids (held in the
    tests, for every code point); added tokens in a text are cut out first, as tokenizers does. Texts with a run
    of ``BLANKS`` blanks are encoded by tokenizers itself, more slowly and with memory in proportion to the text.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.whole = path, None

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary, merges = held["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        others = iter(range(256, 512))
        byte = {chr(b) if b in PLAIN_BYTES else chr(next(others)): b for b in range(256)}
        if any(t.get(flag) for t in held["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in what stands around them")
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        own = {t: i for t, i in vocabulary.items() if t not in self.added}
        ranks = {bytes(byte[c] for c in t): i for t, i in own.items()}
        level = held["pre_tokenizer"] or {}
        if level.get("type") != "ByteLevel" or level.get("add_prefix_space") or held["normalizer"] or sorted((own[a + b] for a, b in merges)) != [own[a + b] for a, b in merges]:
            raise ValueError(f"{path}: not a byte-level BPE vocabulary whose ids are in merge order")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __call__(self, text: str) -> bytes:
        if len(text) >= BLANKS and LONG_BLANK.search(text):
            if self.whole is None:
                import tokenizers

                self.whole = tokenizers.Tokenizer.from_file(self.path)
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        encode = self.encoding.encode_ordinary
        if not self.cut or not self.cut.search(text):
            return array("I", encode(text)).tobytes()
        parts = [array("I", [self.added[p]] if k % 2 else encode(p)) for k, p in enumerate(self.cut.split(text))]
        return b"".join(p.tobytes() for p in parts)


def encoder(path: str) -> Encoder:
    """The worker process's encoder: workers are used again, while functions are unpickled for each task."""
    store = sys.modules.setdefault("_parleylake_worker", types.ModuleType("_parleylake_worker")).__dict__
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first of several may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for lo in range(0, batch.num_rows, 500):
            taken, rows = [], []
            for k, text in enumerate(texts.slice(lo, 500).to_pylist(), lo):
                held = encode(text or "") + end
                for p, (first, n) in enumerate(cut(len(held) // 4, capacity)):
                    part = held[4 * first : 4 * (first + n)]
                    taken.append(k)
                    rows.append((p, first, n, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
            piece, start, length, crc, own = zip(*rows, strict=True)
            columns = [ids.take(pa.array(taken)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens; a document is its ids and ``end_id``, null texts are empty."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lambda batches: _pieces(batches, path, capacity, end_id, with_ids), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: segments (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Bins are kept as ranges of sequence numbers with equal space. Best fit keeps filling the tightest
    bin that takes the length, so a range of bins takes ``space // length`` pieces each at once.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # space -> ranges of sequences
    spaces: list[int] = []  # sorted
    segments, fresh = [], 0

    def put(space: int, first: int, end: int) -> None:
        if space and end > first:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, end))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, end = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first = capacity, fresh
                end = fresh = fresh + -(-left // (capacity // length))
            each = space // length
            bins = min(end - first, left // each)
            for used, items in ((bins, each), (1, left - bins * each) if first + bins < end and left > bins * each else (0, 0)):
                if used:
                    segments.append((length, rank, rank + used * items, first, items, capacity - space))
                    put(space - items * length, first, first + used)
                    rank, left, first = rank + used * items, left - used * items, first + used
            put(space, first, end)
    return segments


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``_row``, a number of each) with ``sequence_id`` and ``offset``. ``pieces`` are read three times, so hand in a written table.

    Chunks go by the row's number too, so repeated rows spread over them; there is one for each ``CHUNK`` pieces.
    """
    spark = pieces.sparkSession
    held = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    chunks = max(64, -(-sum(held.values()) // CHUNK))
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), F.lit(chunks)).cast("int"))
    counts = dealt.groupBy("length", "_chunk").agg(F.count("*").alias("n"))
    segments = spark.createDataFrame(plan(held, capacity), "p_length long, lo long, hi long, first_sequence long, each long, at long")
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32", "_row")
    ranked = dealt.withColumn("_own", F.row_number().over(within)).join(firsts, ["length", "_chunk"]).withColumn("_rank", F.col("first_rank") + F.col("_own") - 1)
    slot = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(segments), slot)  # a few segments for each of at most `capacity` lengths
    return placed.select(
        *[c for c in pieces.columns if c != "_row"], (F.col("first_sequence") + F.floor((F.col("_rank") - F.col("lo")) / F.col("each"))).alias("sequence_id"),
        (F.col("at") + (F.col("_rank") - F.col("lo")) % F.col("each") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their ``sequence_id`` and ``offset`` (and their ``ids``, if asked for).

    Repeated rows and null ids are packed like others, further columns are ignored, an empty table gives no pieces.
    """
    pieces = tokenized_pieces(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids)
    return assign(materialize(pieces.withColumn("_row", F.monotonically_increasing_id())), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(``sequence_id``, ``ids``, ``starts``): the packed training sequences, from ``pack(..., with_ids=True)``; each holds ``capacity`` ids at most.

    Every piece has ids, at least the end mark, so nothing is null or empty; no pieces give no sequences; further columns are left out.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
