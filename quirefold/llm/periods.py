"""Periodic run detection: an online sparse dynamic programme over the diagonals of a text's words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import ship_package

#: Words in the shortest context under which earlier occurrences of a word are looked up.
CONTEXT = 8
#: More occurrences of one context in the lags of a level than this, and it repeats within itself.
_FEW = 3
SCHEMA = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers, equal for equal pairs alone."""
    return np.unique((left.astype(np.int64) << 32) | right, return_inverse=True)[1]


def _proposals(word: np.ndarray, min_periods: int) -> dict[int, list[int]]:
    """Positions with the lags at which a run may be under way there.

    A run of period q has max(24 - q, 2q) matching words or more on diagonal q, so a word
    is looked up with the words before it: for lags under ``CONTEXT`` with ``CONTEXT`` words,
    for lags of g to 2g - 1 with g (8, 16, 32, ...). Of short lags the nearest occurrence is
    enough. In a level of lags a context that occurs over ``_FEW`` times has a period of its
    own (g / 2 at most), and in any q successive words of a run of smallest period q some
    context has none; so those are left to the others and no level has over ``_FEW`` times
    as many proposals as words.
    """
    found: dict[int, list[int]] = {}
    gram, g = word, 1
    while g < CONTEXT:
        gram, g = _paired(gram[:-g], gram[g:]), 2 * g
    at = np.arange(g - 1, len(word), dtype=np.int64)  # gram[k] ends at word at[k]
    first = True
    while len(gram) and (first or min_periods * g <= len(word)):
        times = np.bincount(gram)
        often = times[gram] > 1
        if not often.any():
            break
        order = np.argsort(gram, kind="stable")
        key = gram[order] * np.int64(len(word) + 1) + at[order]
        some = key[often[order]]
        place = some % (len(word) + 1)
        if first:
            before = np.searchsorted(key, some) - 1
            lag = np.where((before >= 0), some - key[before], len(word) + 1)
            for i, q in zip(place[lag < g].tolist(), lag[lag < g].tolist(), strict=True):
                found.setdefault(i, []).append(q)
        base = some - place
        low = np.searchsorted(key, np.maximum(some - 2 * g + 1, base))
        high = np.searchsorted(key, np.maximum(some - g + 1, base))
        few = (high > low) & (high - low <= _FEW)
        for i, k, a, b in zip(place[few].tolist(), some[few].tolist(), low[few].tolist(), high[few].tolist(), strict=True):
            found.setdefault(i, []).extend(k - x for x in key[a:b].tolist())
        if len(gram) <= g:
            break
        gram, at, g, first = _paired(gram[:-g], gram[g:]), at[g:], 2 * g, False
    return found


def periodic_runs(words: list, min_length: int = 24, min_periods: int = 3) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a list of words, by start, then period.

    A run is a stretch of ``max(min_length, min_periods * q)`` words or more with smallest
    period q that cannot be made longer with that period. Words are read once, left to right.
    ``active`` holds the match length of each lag under way: a word that equals the one a
    lag before makes it longer, another ends it, and an ended lag of sufficient length gives
    its run at once. New lags come from a word's earlier occurrences (see ``_proposals``),
    with what matches to their left. A stretch found with several periods has the smallest
    alone: the others are its multiples, and a lag that is a multiple of one under way, within
    its stretch, is not begun.
    """
    if min_length < 24 or min_periods < 3:
        raise ValueError("runs have 24 words and 3 periods at least")
    n = len(words)
    if n < min_length:
        return []
    ids: dict = {}
    number = [ids.setdefault(w, len(ids)) for w in words]
    if n - len(ids) < min_length - min_length // min_periods:  # fewer repeated words than any run has
        return []
    begun = _proposals(np.array(number, dtype=np.int64), min_periods)
    if not begun:
        return []
    active: dict[int, int] = {}
    ended: dict[tuple[int, int], int] = {}

    def end(q: int, m: int, last: int) -> None:
        if m + q >= max(min_length, min_periods * q):
            stretch = (last - m - q + 1, m + q)
            ended[stretch] = min(q, ended.get(stretch, q))

    starts = sorted(begun)
    i, k = starts[0], 0
    while i < n:
        if active:
            for q in [q for q in active if number[i] != number[i - q]]:
                end(q, active.pop(q), i - 1)
            for q in active:
                active[q] += 1
        if k < len(starts) and starts[k] == i:
            for q in sorted(set(begun[i])):
                if q in active or number[i] != number[i - q] or any(q % p == 0 and q <= m for p, m in active.items()):
                    continue
                m = 1
                while i - m - q >= 0 and number[i - m] == number[i - m - q]:
                    m += 1
                active[q] = m
            k += 1
        if not active:
            if k == len(starts):
                break
            i = starts[k]
        else:
            i += 1
    for q, m in active.items():
        end(q, m, n - 1)
    return sorted((start, length, q) for (start, length), q in ended.items())


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without what a run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, dropped in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not dropped]


def periods(col: Column, min_length: int = 24, min_periods: int = 3) -> Column:
    """A struct of a text's ``runs`` and its ``collapsed`` text; see ``scan``."""

    @F.pandas_udf(SCHEMA)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            runs, collapsed = [], []
            for text in texts:
                words = (text or "").encode().split()
                found = periodic_runs(words, min_length, min_periods)
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                collapsed.append(b" ".join(kept_words(words, found)).decode())
            yield pd.DataFrame({"runs": runs, "collapsed": collapsed})

    return of(col)


def scan(docs: DataFrame, text_col: str = "text", min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """``docs`` with a struct ``periodic`` of ``runs`` and ``collapsed``.

    Words are runs of characters other than ASCII white space. ``runs`` holds ``start,
    length, period`` in words; ``collapsed`` is the text's words without the repeats of each
    run, joined by a space. Nothing is shuffled: a text is one task's work, and its memory
    and time grow with the text's words (a proposal costs what matches to its left).
    Null, empty and blank texts have no runs and collapse to the empty text; equal rows get
    equal results; an empty table gives none. All columns pass; one called ``periodic`` gives
    way to the new one.
    """
    ship_package(docs.sparkSession)
    return docs.withColumn("periodic", periods(F.col(f"`{text_col}`"), min_length, min_periods))
