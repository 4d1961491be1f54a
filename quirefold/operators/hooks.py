"""Hooks for the user's own readers and translators, in batches on the workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def recognise(regions: DataFrame, primary: Callable, fallback: Callable | None = None, payload: str = "image") -> DataFrame:
    """regions with ``text, engine, error``.

    A factory (``primary()``) is called once a task and gives a function from a list of
    payloads to a list of texts. A batch that fails in the primary goes to the fallback;
    if that fails, its rows have the error and no text. Nothing fails the job.
    """
    schema = regions.drop("text", "engine", "error").schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines: dict[str, Callable] = {}

        def attempt(name: str, factory: Callable, values: list) -> list:
            if name not in engines:
                engines[name] = factory()
            return list(engines[name](values))

        for pdf in batches:
            values, problem, texts, used = pdf[payload].tolist(), None, [None] * len(pdf), None
            for name, factory in (("primary", primary), ("fallback", fallback)):
                if factory is None:
                    continue
                try:
                    texts, used, problem = attempt(name, factory, values), name, None
                    break
                except Exception as e:  # a user's reader may fail in any way
                    problem = f"{type(e).__name__}: {e}"
            yield pdf.assign(text=pd.Series(texts, index=pdf.index, dtype="object"), engine=used, error=problem)

    return regions.drop("text", "engine", "error").mapInPandas(run, f"{out}, text string, engine string, error string")


def translate(requests: DataFrame, factory: Callable, key: str, text: str) -> DataFrame:
    """``key, code, data, message``: one request at a time through ``factory()``'s function;
    a row that fails has code 500 and its message and does not stop others."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                try:
                    rows.append((k, 200, call(t), None))
                except Exception as e:
                    rows.append((k, 500, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "code", "data", "message"])

    return requests.select(key, text).mapInPandas(run, f"`{key}` {kind}, code int, data string, message string")


def translate_in_order(requests: DataFrame, factory: Callable, page: str, pos: str, text: str) -> DataFrame:
    """as ``translate``, but page by page in order, each call given the results before it on its page."""
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (page, pos)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        call, earlier, rows = factory(), [], []
        for _, r in pdf.sort_values(pos, kind="stable").iterrows():
            try:
                data = call(r[text], tuple(earlier))
                earlier.append(data)
                rows.append((r[page], r[pos], 200, data, None))
            except Exception as e:
                rows.append((r[page], r[pos], 500, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=[page, pos, "code", "data", "message"])

    schema = f"`{page}` {kinds[page]}, `{pos}` {kinds[pos]}, code int, data string, message string"
    return requests.select(page, pos, text).groupBy(page).applyInPandas(run, schema)
