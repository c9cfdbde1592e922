"""The first stage of a search in one pass: every signal of a question and a message, of which only the best lists leave a task.

Questions come in blocks, messages in Arrow batches. A batch's dense and sparse products, constraints and
fused scores are matrices that live for the batch; what stays is, for each question, the best rows by the
fused score and by each channel. No table of questions and messages is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parleylake.operators.dense import in_blocks, vectors_of
from parleylake.operators.lexical import QUERY_TERMS, SHARES, Index
from parleylake.operators.ranges import numbered

CHANNELS = ["semantic", "contextual", "lexical"]
WEIGHTS = ["w_contextual", "w_semantic", "w_lexical", "person_bonus", "date_bonus"]
#: Messages and questions of one matrix, products of terms at once, and candidates that a task holds before it prunes them.
ROWS, ASKED, PRODUCTS, HELD = 2_048, 256, 2_000_000, 200_000


def firsts(scores: np.ndarray, k: int) -> np.ndarray:
    """Which cells are among a column's ``k`` greatest, equal to nine digits by row from the top; cells of minus infinity never are."""
    rounded = np.round(scores, 9)
    if len(rounded) > k:
        least = -np.partition(-rounded, k - 1, axis=0)[k - 1]
        above, equal = rounded > least, rounded == least
        return (above | (equal & (np.cumsum(equal, axis=0, dtype=np.int32) <= k - above.sum(axis=0)))) & (rounded > -np.inf)
    return rounded > -np.inf


def pruned(rows: pd.DataFrame, width: int, key: str = "id") -> pd.DataFrame:
    """Of (``query_id``, ``key``, ``score``, channels) rows those among the ``width`` best of a question by the score, or by a channel where positive."""
    keep = np.zeros(len(rows), bool)
    for c in ["score", *CHANNELS]:
        own = pd.DataFrame({"q": rows["query_id"].to_numpy(), "s": -np.round(rows[c].to_numpy(float), 9), "k": rows[key].to_numpy()}).sort_values(["q", "s", "k"], kind="stable")
        kept = (own.groupby("q", sort=False).cumcount() < width) & ((own["s"] < 0) | (c == "score"))
        keep[own.index[kept.to_numpy()]] = True
    return rows[keep].reset_index(drop=True)


def candidate_pool(scored: DataFrame, k: int = 5, width: int = 128, key: str = "id") -> DataFrame:
    """Rows of ``scored`` (query_id, ``key``, score, channels) in a question's pool: the best by the fused score, and by each channel where positive.

    Each task prunes its rows to these lists for all four at once, so one exchange, by question, is left.
    """
    width = max(k, width)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, most = [], HELD
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > most:
                held = [pruned(pd.concat(held, ignore_index=True), width, key)]
                most = max(HELD, 2 * len(held[0]))
        if held:
            yield pruned(pd.concat(held, ignore_index=True), width, key)

    rows = scored.mapInPandas(prune, scored.schema)
    place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(c, 9).desc(), F.col(key)))
    ranked = rows.select("*", *[place(c).alias(f"_{c}") for c in ("score", *CHANNELS)])
    chosen = F.col("_score") <= width
    for c in CHANNELS:
        chosen |= (F.col(f"_{c}") <= width) & (F.round(c, 9) > 0)
    return ranked.where(chosen).select(*scored.columns)


def terms_by_row(query_weights: DataFrame, postings: DataFrame | Index, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Numbers instead of terms on both sides: (query_id, terms) and (``key``, terms), terms as (t, weight), of the terms that queries have.

    Up to ``QUERY_TERMS`` different terms of the queries are numbered on the driver and broadcast; more are numbered by ranges and joined with the postings.
    """
    vocabulary = query_weights.select("channel", "term").distinct()
    held = vocabulary.limit(QUERY_TERMS + 1).toArrow()
    few = held.num_rows <= QUERY_TERMS
    if few:
        vocabulary = query_weights.sparkSession.createDataFrame(held.append_column("t", pa.array(range(held.num_rows), pa.int64())))
    else:
        vocabulary = numbered(vocabulary, ["channel", "term"], "t")
    share = F.when(F.col("channel") == "word", SHARES["word"]).otherwise(SHARES["char"])
    listed = lambda rows, by, weight: rows.groupBy(by).agg(F.collect_list(F.struct("t", weight.alias("weight"))).alias("terms"))
    asked = listed(query_weights.join(vocabulary, ["channel", "term"]), "query_id", F.col("weight") * share)
    if isinstance(postings, Index):
        return asked, postings.listed(vocabulary, few)
    met = postings.join(F.broadcast(vocabulary) if few else vocabulary, ["channel", "term"])
    return asked, listed(met, key, F.col("weight"))


def first_stage(questions: DataFrame, messages: DataFrame, width: int, key: str = "id") -> DataFrame:
    """(``query_id``, ``key``, semantic, contextual, lexical, person_match, date_match, score) of each task's best rows a question, eligible ones only.

    ``questions`` has vector, terms (t, weight by share), person, mode, start, end, hour_lo, hour_hi,
    message_type and the weights of one profile; ``messages`` has own, around, terms, sender, own_type, day and
    hour. Up to a block of questions is broadcast, more meet the messages block by block. Questions without
    terms or messages without them have no lexical score.
    """
    kind = messages.schema[key].dataType.simpleString()
    schema = f"query_id long, {key} {kind}, semantic double, contextual double, lexical double, person_match boolean, date_match boolean, score double"
    return in_blocks(questions, messages, key, lambda batches, asked: _candidates(batches, asked, width, key), schema)


def all_signals(questions: DataFrame, messages: DataFrame, key: str = "id") -> DataFrame:
    """(``query_id``, ``key``, semantic, contextual, lexical, person_match, date_match, eligible) of every question and message, which ``first_stage`` describes; weights aren't read.

    A pair's signals are made together where its message is, so no table of pairs is joined or moved.
    """
    kind = messages.schema[key].dataType.simpleString()
    schema = f"query_id long, {key} {kind}, semantic double, contextual double, lexical double, person_match boolean, date_match boolean, eligible boolean"
    bare = questions.withColumns({c: F.lit(0.0) for c in WEIGHTS})
    return in_blocks(bare, messages, key, lambda batches, asked: _pairs(batches, asked, key), schema)


def _list(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, t, weight) of a column of term lists; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), column.flatten()
    return np.repeat(np.arange(len(sizes)), sizes), flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _days(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of dates of any year as days; pandas' nanoseconds end in 2262."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.date32()).to_numpy(zero_copy_only=False)


class _Asked:
    """A slice of questions as arrays."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("query_id").to_numpy()
        self.vectors = vectors_of(table.column("vector"))
        self.row, t, weight = _list(table.column("terms"))
        order = np.lexsort((self.row, t))
        self.row, self.weight = self.row[order], weight[order]
        self.terms, self.begin = np.unique(t[order], return_index=True)
        self.begin = np.append(self.begin, len(t))
        frame = table.drop_columns(["vector", "terms"]).to_pandas()
        self.text = {c: frame[c].to_numpy(object) for c in ("person", "mode", "message_type")}
        self.day = {c: _days(table.column(c)) for c in ("start", "end")}
        self.number = {c: frame[c].to_numpy(float) for c in ("hour_lo", "hour_hi", *WEIGHTS)}

    def lexical(self, lists: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        row, t, weight = lists
        at = np.searchsorted(self.terms, t)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == t[known]
        row, at, weight = row[known], at[known], weight[known]
        sizes = self.begin[at + 1] - self.begin[at]
        out = np.zeros((n, len(self.ids)))
        ends = np.searchsorted(row, np.arange(n + 1))  # postings are by row
        step = np.cumsum(np.bincount(row, weights=sizes, minlength=n)) // PRODUCTS
        for lo, hi in zip(*(np.searchsorted(step, np.unique(step), side) for side in ("left", "right")), strict=True):
            own = slice(ends[lo], ends[hi])
            k = sizes[own]
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.begin[at[own]], k)
            cells = np.repeat(row[own] - lo, k) * len(self.ids) + self.row[place]
            out[lo:hi] = np.bincount(cells, weights=self.weight[place] * np.repeat(weight[own], k), minlength=(hi - lo) * len(self.ids)).reshape(hi - lo, len(self.ids))
        return out


class _Part:
    """Some messages as arrays, by key, so that of equal scores the first row goes first."""

    def __init__(self, part: pa.RecordBatch, key: str):
        part = part.take(pc.sort_indices(part.column(key)))
        self.own, self.around, self.lists = vectors_of(part.column("own")), vectors_of(part.column("around")), _list(part.column("terms"))
        self.sender, self.type, self.hour = (part.column(c).to_pandas().to_numpy() for c in ("sender", "own_type", "hour"))
        self.day, self.keys = _days(part.column("day")), part.column(key)

    def signals(self, q: _Asked) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(the channels, which pairs meet the constraints, which the person, which the dates): a row a message, a column a question."""
        found = [np.clip(self.own @ q.vectors.T, 0.0, 1.0), np.clip(self.around @ q.vectors.T, 0.0, 1.0), q.lexical(self.lists, len(self.keys))]
        is_person = self.sender[:, None] == q.text["person"][None]
        dated = ~np.isnat(q.day["start"])
        ok = (q.text["mode"] != "filter")[None] | is_person
        ok &= ~dated[None] | ((self.day[:, None] >= q.day["start"][None]) & (self.day[:, None] <= q.day["end"][None]))
        ok &= np.isnan(q.number["hour_lo"])[None] | ((self.hour[:, None] >= q.number["hour_lo"]) & (self.hour[:, None] < q.number["hour_hi"]))
        ok &= pd.isna(q.text["message_type"])[None] | (self.type[:, None] == q.text["message_type"][None])
        return found, ok, is_person & (q.text["mode"] != "none")[None], ok & dated[None]


def _pairs(batches: Iterator[pa.RecordBatch], asked: pa.Table, key: str) -> Iterator[pa.RecordBatch]:
    slices = [_Asked(asked.slice(lo, ASKED)) for lo in range(0, asked.num_rows, ASKED)]
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = _Part(batch.slice(lo, ROWS), key)
            for q in slices:
                signals, ok, person, dates = part.signals(q)
                at, of = (x.ravel() for x in np.indices(ok.shape))
                columns = [pa.array(q.ids[of]), part.keys.take(pa.array(at)), *(pa.array(x.astype(float).ravel()) for x in signals), *(pa.array(x.astype(bool).ravel()) for x in (person, dates, ok))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", key, *CHANNELS, "person_match", "date_match", "eligible"])


def _candidates(batches: Iterator[pa.RecordBatch], asked: pa.Table, width: int, key: str) -> Iterator[pa.RecordBatch]:
    slices = [_Asked(asked.slice(lo, ASKED)) for lo in range(0, asked.num_rows, ASKED)]
    held, size, most = [], 0, HELD
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = _Part(batch.slice(lo, ROWS), key)
            ids = part.keys.to_pandas().to_numpy()
            for q in slices:
                signals, ok, person, dates = part.signals(q)
                score = q.number["w_contextual"] * signals[1] + q.number["w_semantic"] * signals[0] + q.number["w_lexical"] * signals[2]
                score = score + np.where(person, q.number["person_bonus"], 0.0) + np.where(dates, q.number["date_bonus"], 0.0)
                keep = firsts(np.where(ok, score, -np.inf), width)
                for s in signals:
                    keep |= firsts(np.where(ok & (np.round(s, 9) > 0), s, -np.inf), width)
                at, of = np.nonzero(keep)
                held.append(pd.DataFrame({"query_id": q.ids[of], key: ids[at], **{c: s[at, of] for c, s in zip(CHANNELS, signals)}, "person_match": person[at, of], "date_match": dates[at, of], "score": score[at, of]}))
                size += len(at)
            if size > most:
                held = [pruned(pd.concat(held, ignore_index=True), width, key)]
                size, most = len(held[0]), max(HELD, 2 * len(held[0]))
    if held:
        yield pa.RecordBatch.from_pandas(pruned(pd.concat(held, ignore_index=True), width, key), preserve_index=False)
