"""Language-model scores: n-gram estimates mixed by deleted interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import materialise, ship_package

#: What a chunk of documents is for: counts, mixture weights, or scores alone.
KEPT, DELETED, OTHER = 0, 1, 2
#: Tokens in a chunk, but for a longer document: a worker's memory, some 100 bytes a token, and so not the input's size.
CHUNK_TOKENS = 1_000_000
#: Distinct n-grams of chunks that one group of the count takes, on the mean.
GROUP_GRAMS = 1_500_000
#: Numbers of the two tokens that no text has: its end, and what stands before its first word.
_END, _START = 0, 1
#: Multipliers that mix hashes.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each pair of hashes."""
    x = (left * np.uint64(_MIX[0])) ^ (right + np.uint64(_MIX[1]) + (left >> np.uint64(32)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


def chunked(docs: DataFrame, id_col: str, text_col: str, role: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of documents: ``chunk, role, ids, lengths, words, tokens``.

    ``words`` has the XXH64 hashes (seed 13) of a chunk's distinct tokens in order of first
    use, ``tokens`` their places in it (unsigned 32-bit, under Zstandard), documents one after
    another, each ended by one end token. A chunk holds documents of one role, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        digest, made = xxhash.xxh64_intdigest, TaskContext.get().partitionId() << 32
        blank = lambda: {"ids": [], "lengths": [], "seen": {None: _END, "": _START}, "tokens": [], "n": 0}
        open_chunks = {r: blank() for r in (KEPT, DELETED, OTHER)}

        def closed(r: int) -> pa.RecordBatch:
            nonlocal made
            c, open_chunks[r] = open_chunks[r], blank()
            made += 1
            words = np.fromiter((digest(w, 13) if isinstance(w, bytes) else i for i, w in enumerate(c["seen"])), dtype="<u8", count=len(c["seen"]))
            values = [made, r, c["ids"], c["lengths"], words.tobytes(), pa.compress(b"".join(c["tokens"]), codec="zstd", asbytes=True)]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["chunk", "role", "ids", "lengths", "words", "tokens"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for i, text, r in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                c = open_chunks[r]
                seen = c["seen"]
                words = (text.as_py() or "").encode().lower().split()
                numbers = [seen.setdefault(w, len(seen)) for w in words]
                numbers.append(_END)
                c["ids"].append(i)
                c["lengths"].append(len(numbers))
                c["tokens"].append(np.array(numbers, dtype="<u4").tobytes())
                c["n"] += len(numbers)
                if c["n"] >= chunk_tokens:
                    yield closed(r)
        for r in (KEPT, DELETED, OTHER):
            if open_chunks[r]["ids"]:
                yield closed(r)

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), role.cast("int").alias("role"))
    return slim.mapInArrow(run, "chunk long, role int, ids array<long>, lengths array<long>, words binary, tokens binary")


def _grams(words: bytes, tokens: bytes, lengths: list[int], order: int) -> list[np.ndarray]:
    """Hashes of the n-gram that ends at each token, for n from 1 to ``order``; texts are begun by start marks."""
    plain = pa.decompress(tokens, decompressed_size=4 * int(sum(lengths)), codec="zstd")
    word, number = np.frombuffer(words, dtype="<u8"), np.frombuffer(plain, dtype="<u4")
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    out = [word[number]]
    firsts = ends - np.asarray(lengths, dtype=np.int64)
    for _ in range(1, order):
        # the gram one shorter that ends a token before, then this token
        before = np.empty(len(number), dtype=np.uint64)
        before[1:] = out[-1][:-1]
        before[firsts] = _START
        out.append(_mixed(before, out[0]))
    return out


def _dealt(chunks: DataFrame, order: int, groups: list[int]) -> DataFrame:
    """``n, part, chunk, role, grams, times``: a chunk's distinct n-grams, sorted, cut at the ranges of ``groups[n - 1]`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cols: list[list] = [[], [], [], [], [], []]
                for n, grams in enumerate(_grams(row["words"], row["tokens"], row["lengths"], order), 1):
                    gram, times = np.unique(grams, return_counts=True)
                    edges = np.searchsorted(gram, np.array([k * (1 << 64) // groups[n - 1] for k in range(1, groups[n - 1])], dtype=np.uint64))
                    cuts = [0, *edges.tolist(), len(gram)]
                    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if a < b:
                            values = (n, part, row["chunk"], row["role"], gram[a:b].tobytes(), times[a:b].astype("<u4").tobytes())
                            for col, v in zip(cols, values, strict=True):
                                col.append(v)
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                names = ["n", "part", "chunk", "role", "grams", "times"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return chunks.select("chunk", "role", "lengths", "words", "tokens").mapInArrow(
        run, "n int, part int, chunk long, role int, grams binary, times binary"
    )


_COUNTED = "n int, part int, chunk long, role int, learnt binary, kept binary, distinct long, total long"


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of one range of n-grams over all chunks, given back to each chunk for its own n-grams.

    ``learnt`` is over kept and deleted documents, ``kept`` (to chunks of deleted ones alone)
    without those. The range's distinct learnt n-grams and their total go with its first chunk.
    """
    rows = rows.sort_values("chunk", ignore_index=True)
    grams = [np.frombuffer(x, dtype="<u8") for x in rows["grams"]]
    sizes = np.array([len(g) for g in grams])
    every, place = np.unique(np.concatenate(grams), return_inverse=True)
    times = np.concatenate([np.frombuffer(x, dtype="<u4") for x in rows["times"]]).astype(np.float64)
    role = np.repeat(rows["role"].to_numpy(), sizes)
    kept = np.bincount(place, weights=np.where(role == KEPT, times, 0), minlength=len(every)).astype("<u4")
    learnt = kept + np.bincount(place, weights=np.where(role == DELETED, times, 0), minlength=len(every)).astype("<u4")
    cuts = np.cumsum(sizes)[:-1]
    own = [p.astype(np.int64) for p in np.split(place, cuts)]
    first = np.arange(len(rows)) == 0
    return pd.DataFrame({
        "n": rows["n"],
        "part": rows["part"],
        "chunk": rows["chunk"],
        "role": rows["role"],
        "learnt": [learnt[p].tobytes() for p in own],
        "kept": [kept[p].tobytes() if r == DELETED else b"" for p, r in zip(own, rows["role"], strict=True)],
        "distinct": np.where(first, int((learnt > 0).sum()), 0),
        "total": np.where(first, int(learnt.sum(dtype=np.int64)), 0),
    })


def _merged(answers: pd.DataFrame, order: int, column: str) -> list[np.ndarray]:
    """A chunk's counts for n from 1 to ``order``, in the order of its sorted n-grams."""
    out = []
    for n in range(1, order + 1):
        own = answers[answers["n"] == n].sort_values("part")
        out.append(np.frombuffer(b"".join(own[column]), dtype="<u4"))
    return out


def _looked_up(row, answers: pd.DataFrame, order: int, column: str, starts: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Counts of the n-gram that ends at each token, and of its context, for n from 1 to ``order``."""
    lengths = np.asarray(row["lengths"], dtype=np.int64)
    firsts = np.cumsum(lengths) - lengths
    grams, contexts = [], []
    for gram, count in zip(_grams(row["words"], row["tokens"], row["lengths"], order), _merged(answers, order, column), strict=True):
        grams.append(count[np.unique(gram, return_inverse=True)[1]].astype(np.float64))
    for n in range(2, order + 1):
        before = np.empty(len(grams[0]))
        before[1:] = grams[n - 2][:-1]
        before[firsts] = starts
        contexts.append(before)
    return grams, contexts


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context that was not met, else 1 and the whole part of its count's binary logarithm."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def learn_weights(events: DataFrame, order: int, rounds: int = 12) -> list[list[float]]:
    """Weights of the n-gram estimate against what is below it, by n and bucket, from held-out events.

    ``events`` has ``b1.., f1.., times`` (bucket of the context and estimate for each n) and
    ``floor``, the uniform estimate. Each round of expectation-maximisation is an aggregation
    by bucket; the driver holds ``order`` times 64 weights. A bucket without events keeps the
    start value, bucket 0 has weight 0.
    """
    weights = [[0.0] + [0.5] * 63 for _ in range(order)]
    names = [f"{x}{n}" for n in range(1, order + 1) for x in "bf"]
    for _ in range(rounds):
        step = events.select(*names, "floor", "times")
        for n in range(1, order + 1):
            own = F.get(F.array(*(F.lit(w) for w in weights[n - 1])), F.col(f"b{n}"))
            step = step.withColumn(f"w{n}", own)
            below = F.col(f"p{n - 1}") if n > 1 else F.col("floor")
            step = step.withColumn(f"p{n}", F.col(f"w{n}") * F.col(f"f{n}") + (1 - F.col(f"w{n}")) * below)
        left: Column = F.col("times").cast("double")
        shares = []
        for n in range(order, 0, -1):
            part = left * F.col(f"w{n}") * F.col(f"f{n}") / F.col(f"p{n}")
            shares.append(F.struct(F.lit(n).alias("n"), F.col(f"b{n}").alias("b"), part.alias("own"), left.alias("all")))
            left = left - part
        told = step.select(F.explode(F.array(*shares)).alias("s")).groupBy("s.n", "s.b").agg(F.sum("s.own").alias("own"), F.sum("s.all").alias("all"))
        for x in told.collect():  # at most order * 64 rows
            if x["b"] and x["all"] > 0:
                weights[x["n"] - 1][x["b"]] = min(max(x["own"] / x["all"], 1e-6), 1 - 1e-6)
    return weights


def score(
    docs: DataFrame,
    learn: Column,
    delete: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    chunk_tokens: int = CHUNK_TOKENS,
    group_grams: int = GROUP_GRAMS,
) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    A-Z are lower-cased; tokens are runs of characters other than ASCII white space, then one
    end. ``learn`` says which rows the model learns from, ``delete`` which of those are held
    out to learn the mixture weights; ``score`` is log10 of the text's probability under

        P_n = w(b) f(token | n - 1 tokens before) + (1 - w(b)) P_(n-1),  P_0 = 1 / (V + 1),

    f maximum-likelihood estimates over all learnt rows, b the bucket of the context's count.
    The weights come from expectation-maximisation on the deleted rows, with estimates over
    the others. ``base_score`` is the add-half unigram score, ``n_known`` counts learnt tokens.

    Tokens are hashed to 64 bits once and kept in files as chunks of about ``chunk_tokens``;
    a chunk's distinct n-grams, sorted, are cut into ranges of hashes, and a range from all
    chunks, some ``group_grams`` n-grams, is counted in one group and its counts given back to
    the chunks, which are then scored. A frequent n-gram is one entry a chunk, so groups are
    even whatever the text; what is shuffled grows with the input and is a few bytes a token.

    Null and empty texts have the end token alone; null ids and repeated rows are rows like
    any other; nothing learnt gives the uniform probability 1; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    role = F.when(F.coalesce(learn, F.lit(False)), F.when(F.coalesce(delete, F.lit(False)), DELETED).otherwise(KEPT)).otherwise(OTHER)
    chunks = materialise(chunked(docs, id_col, text_col, role, chunk_tokens), "lm-chunks")
    n_tokens = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda n, x: n + x))
    sizes = chunks.select(
        F.sum(F.octet_length("words") / 8).alias("words"), n_tokens.alias("tokens"),
        F.sum(F.when(F.col("role") == KEPT, F.size("ids")).otherwise(0)).alias("kept"),
        F.sum(F.when(F.col("role") != OTHER, F.size("ids")).otherwise(0)).alias("learnt"),
    ).first()
    most = [sizes["words"] or 0, *[sizes["tokens"] or 0] * (order - 1)]
    groups = [max(1, math.ceil(m / group_grams)) for m in most]
    counted = _dealt(chunks, order, groups).groupBy("n", "part").applyInPandas(_counted, _COUNTED)
    counted = materialise(counted, "lm-counts")
    totals = counted.where("n = 1").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    v, total = int(totals["v"] or 0), int(totals["n"] or 0)
    deleted = chunks.where(F.col("role") == DELETED)
    kept_total = total - int(deleted.agg(n_tokens).first()[0] or 0)
    kept_starts, starts = int(sizes["kept"] or 0), int(sizes["learnt"] or 0)
    floor = 1.0 / (v + 1)

    def estimates(row, answers: pd.DataFrame, column: str, n_starts: int, n_tokens: int):
        grams, contexts = _looked_up(row, answers, order, column, n_starts)
        contexts = [np.full(len(grams[0]), float(n_tokens)), *contexts]
        return grams, [bucket(c) for c in contexts], [g / np.maximum(c, 1) for g, c in zip(grams, contexts, strict=True)]

    names = [f"{x}{n}" for n in range(1, order + 1) for x in "bf"]

    def held_out(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        blank = pd.DataFrame({c: [] for c in [*names, "times"]})
        if chunk.empty:
            return blank
        _, buckets, f = estimates(chunk.iloc[0], answers, "kept", kept_starts, kept_total)
        both = pd.DataFrame({f"{x}{n}": col[n - 1] for n in range(1, order + 1) for x, col in (("b", buckets), ("f", f))})
        return both.groupby(names, sort=False).size().rename("times").reset_index()

    kinds = ", ".join(f"{c} {'int' if c[0] == 'b' else 'double'}" for c in names)
    answers = counted.select("n", "part", "chunk", "role", "learnt", "kept")
    mine = answers.where(F.col("role") == DELETED).select("n", "part", "chunk", "kept")
    events = deleted.select("chunk", "lengths", "words", "tokens").groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(held_out, f"{kinds}, times long")
    events = materialise(events.withColumn("floor", F.lit(floor)), "lm-events")
    weights = [np.array(w) for w in learn_weights(events, order)]

    def scored(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        grams, buckets, f = estimates(row, answers, "learnt", starts, total)
        p = np.full(len(grams[0]), floor)
        for n in range(order):
            w = weights[n][buckets[n]]
            p = w * f[n] + (1 - w) * p
        base = np.log10((grams[0] + 0.5) / (total + 0.5 * (v + 1)))
        lengths = np.asarray(row["lengths"], dtype=np.int64)
        firsts = np.cumsum(lengths) - lengths
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None else int(x) for x in row["ids"]], dtype="Int64"),
            "n_tokens": lengths,
            "n_known": np.add.reduceat((grams[0] > 0).astype(np.int64), firsts),
            "train_tokens": np.full(len(lengths), total, dtype=np.int64),
            "base_score": np.add.reduceat(base, firsts),
            "score": np.add.reduceat(np.log10(p), firsts),
        })

    given = answers.select("n", "part", "chunk", "learnt")
    whole = chunks.withColumn("ids", F.col("ids").cast("array<string>"))  # as numbers, ids beside a null would turn to doubles
    return whole.select("chunk", "ids", "lengths", "words", "tokens").groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(
        scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
