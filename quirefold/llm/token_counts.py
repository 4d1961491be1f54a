"""Token counts: a broadcast table of frequent pre-tokens, worker caches for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import ship_package

#: SentencePiece writes a space as this character and treats the two alike.
SPACE_MARK = "▁"
#: Texts are looked up in groups of about so many characters, to bound a worker's memory.
_GROUP_CHARS = 1_000_000
_WORKER: dict = {}


def frequent_pretokens(
    docs: DataFrame, text_col: str = "text", k: int = 8192, tracked: int = 16384
) -> list[str]:
    """The most frequent space-separated pre-tokens (at most ``k``), approximately.

    Every task keeps one frequent-items sketch of ``tracked`` entries over the
    pre-tokens of its texts; only sketches travel, in two levels of merging, so no
    pre-token is shuffled. The answer steers speed alone: a wrong or missing member
    never changes a count.
    """
    words = docs.select(
        F.explode(F.split(F.col(text_col), " ")).alias("w"),
    ).where((F.col("w") != "") & ~F.col("w").contains(SPACE_MARK))
    first = words.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(w, {tracked})").alias("sketch")
    )
    # grouped by a constant: an empty task then makes no sketch, where combining would fail on it
    merged = first.groupBy(F.lit(0).alias("one")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    top = merged.select(
        F.expr(f"approx_top_k_estimate(sketch, {k})").alias("top")
    )
    row = top.first()
    return [x["item"] for x in (row["top"] if row and row["top"] else [])]


def _processor(model: str):
    if _WORKER.get("model") != model:
        import sentencepiece

        _WORKER.clear()
        _WORKER.update(model=model, sp=sentencepiece.SentencePieceProcessor(model_file=model), cache={})
    return _WORKER["sp"], _WORKER["cache"]


def _encode_words(sp, words: list[str], chunk: int = 2000) -> dict[str, int]:
    """Token counts of pre-tokens, each taken with the mark before it.

    Many pre-tokens go through one call: in its ids each begins at a piece that
    begins with the mark. The empty pre-token is a lone mark.
    """
    starts = _WORKER.get("starts")
    if starts is None:
        starts = np.array([sp.id_to_piece(i).startswith(SPACE_MARK) for i in range(sp.get_piece_size())])
        _WORKER["starts"] = starts
    out = {"": 1} if "" in words else {}
    words = [x for x in words if x]
    for at in range(0, len(words), chunk):
        part = words[at : at + chunk]
        ids = np.asarray(sp.encode(" ".join(part)))
        cut = np.flatnonzero(starts[ids])
        out.update(zip(part, np.diff(cut, append=len(ids)).tolist(), strict=True))
    return out


def _lengths(model: str, words: list[str]) -> dict[str, int]:
    sp, _ = _processor(model)
    return _encode_words(sp, words)


def _splits_at_spaces(model: str) -> bool:
    """True if texts can be cut before every mark: no piece has a mark after another
    character or is only marks but one, and texts aren't normalised first."""
    sp, _ = _processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    inner = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
    plain = all(sp.normalize(x) == SPACE_MARK + x.replace(" ", SPACE_MARK) for x in ("a  b ", "ﬁ \t", " A"))
    return plain and not inner


def token_count(model: str, frequent: dict[str, int] | None = None, cache_size: int = 400_000):
    """A column function: text -> number of tokens, without begin or end tokens.

    A text is cut into pre-tokens at its spaces; with a SentencePiece model none of
    whose pieces has a space inside, the count of a text is the sum over its
    pre-tokens. Tier one is ``frequent``, broadcast; tier two is a cache in each
    Python worker, emptied when it would hold more than ``cache_size`` pre-tokens.
    Texts with runs of spaces or a space in front, and any text when the model's
    pieces do not allow the cut, are encoded whole. Null counts as empty, empty has
    0 tokens.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    ship_package(spark)
    table = spark.sparkContext.broadcast(frequent or {})
    cuts = _splits_at_spaces(model)

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp, cache = _processor(model)
        known = table.value
        if not cache:
            cache.update(known)

        def of(texts: list[str]) -> list[int]:
            if len(cache) > cache_size + len(known):
                cache.clear()
                cache.update(known)
            split = [x.split(" ") if cuts and x and x[0] != " " and "  " not in x else [] for x in texts]
            lengths = [list(map(cache.get, words)) for words in split]
            missing = {w for ws, ns in zip(split, lengths, strict=True) if None in ns for w, n in zip(ws, ns, strict=True) if n is None}
            new = _encode_words(sp, list(missing))
            found = []
            for text, words, ns in zip(texts, split, lengths, strict=True):
                if not words:
                    found.append(len(sp.encode(text)) if text else 0)
                elif None in ns:
                    found.append(sum(new[w] if n is None else n for w, n in zip(words, ns, strict=True)))
                else:
                    found.append(sum(ns))
            cache.update((w, n) for w, n in new.items() if len(w) <= 64)
            return found

        for texts in batches:
            out: list[int] = []
            group: list[str] = []
            chars = 0
            for text in texts:
                if SPACE_MARK in text:
                    text = text.replace(SPACE_MARK, " ")
                group.append(text)
                chars += len(text)
                if chars > _GROUP_CHARS:
                    out += of(group)
                    group, chars = [], 0
            yield pd.Series(out + of(group), dtype="int64")

    return lambda col: counts(F.coalesce(col, F.lit("")))


def with_token_counts(
    docs: DataFrame, model: str, text_col: str = "text", out: str = "n_tokens", k: int = 8192, cache_size: int = 400_000
) -> DataFrame:
    """``docs`` with a column ``out``: the token count of each whole text.

    Other columns pass through untouched, whatever their names; an existing column
    ``out`` is replaced. No shuffle of rows, texts or pre-tokens. Repeated rows are counted
    alike, null and empty texts have 0 tokens, an empty table gives no rows.
    """
    frequent = _lengths(model, frequent_pretokens(docs, text_col, k))
    count = token_count(model, frequent, cache_size)
    return docs.withColumn(out, count(F.col(text_col)))


def utf8_bytes(col: Column) -> Column:
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
