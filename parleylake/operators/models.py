"""A caller's models as column functions: loaded once a worker process, fed in batches of texts of like length, checked batch by batch."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are sorted by length together, and texts that a model gets at once.
BLOCK, BATCH = 256, 32


def _model(name: str, load: Callable):
    """The worker's model: workers are used again for later tasks, while functions are unpickled for each."""
    held = sys.modules.setdefault("_parleylake_models", types.ModuleType("_parleylake_models")).__dict__
    if name not in held:
        held[name] = load()
    return held[name]


def _in_batches(columns: list[pd.Series], run: Callable, check: Callable[[object, int], np.ndarray], block: int, batch: int) -> list:
    """``run`` over the rows without nulls, in batches from each block's shortest text to its longest; results are in the rows' order, null where an input is."""
    whole = ~np.logical_or.reduce([c.isna().to_numpy() for c in columns])
    at, out = np.flatnonzero(whole), [None] * len(columns[0])
    size = sum(c.str.len().fillna(0).to_numpy() for c in columns)
    for lo in range(0, len(at), block):
        order = at[lo : lo + block][np.argsort(size[at[lo : lo + block]], kind="stable")]
        for first in range(0, len(order), batch):
            some = order[first : first + batch]
            for place, value in zip(some, check(run(*[c.iloc[some].tolist() for c in columns]), len(some)), strict=True):
                out[place] = value
    return out


def _vectors(found, n: int, dims: int) -> np.ndarray:
    found = np.asarray(found, np.float64)
    if found.shape != (n, dims):
        raise ValueError(f"the encoder gave {found.shape} for {n} texts of {dims} dimensions")
    if not np.isfinite(found).all():
        raise ValueError("the encoder gave a vector that isn't finite")
    return found


def _scores(found, n: int) -> np.ndarray:
    found = np.asarray(found, np.float64)
    if found.shape != (n,):
        raise ValueError(f"the pair model gave {found.shape} for {n} pairs")
    if not ((found >= 0) & (found <= 1)).all():
        raise ValueError("a pair score must be in [0, 1]")
    return found


def encoder(name: str, load: Callable[[], Callable], dims: int, block: int = BLOCK, batch: int = BATCH) -> Callable[[Column], Column]:
    """For ``embed``: ``load`` gives a function from a list of texts to as many vectors of ``dims`` numbers.

    ``name`` stands for the model and its settings: a worker keeps one model a name. A wrong count, a wrong
    size or a number that isn't finite ends the job. Null texts have null vectors and never reach the model.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for texts in batches:
            yield pd.Series(_in_batches([texts], model, lambda found, n: _vectors(found, n, dims), block, batch), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


def pair_model(name: str, load: Callable[[], Callable], block: int = BLOCK, batch: int = BATCH) -> Callable[[Column, Column], Column]:
    """For ``pair_score``: ``load`` gives a function from two lists of texts to as many scores in [0, 1]; otherwise as ``encoder``."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for left, right in batches:
            yield pd.Series(_in_batches([left, right], model, _scores, block, batch), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")
