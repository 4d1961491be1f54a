"""Document fingerprints: digests of improbable features in chained Bloom filters."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import ship_package

#: Bytes in a feature, and features in a neighbourhood that vote for the rarest.
WINDOW = 16
#: A feature is selected if it is the rarest of so many neighbourhoods at least.
POPULAR = 5
#: Bits of one Bloom filter, features it takes, bits set for a feature.
FILTER_BITS = 2048
FILTER_FEATURES = 160
FEATURE_BITS = 5
#: Entropies are rounded to thousandths of the largest; flatter or fuller windows than these say nothing.
LOW, HIGH = 100, 990
#: Rank of a window that is never selected.
NEVER = 2047
#: Texts are worked on together in groups of about so many bytes, long ones in stretches of so many.
_GROUP = 1 << 18
_STRETCH = 1 << 17
_SCALE = 1 << 20


def _entropy_steps() -> np.ndarray:
    """f(c) = c log2 c in whole numbers for each count c of a byte in a window."""
    c = np.arange(WINDOW + 1, dtype=np.float64)
    return np.round(c * np.log2(np.maximum(c, 1)) * _SCALE).astype(np.int64)


_F = _entropy_steps()
_STEP = np.diff(_F)
_TOP = int(np.log2(WINDOW)) * WINDOW * _SCALE


def _stretch_entropies(data: np.ndarray) -> np.ndarray:
    n = len(data) - WINDOW + 1
    ahead = np.zeros(len(data), dtype=np.uint8)  # equal bytes among the next 15
    behind = np.zeros(len(data), dtype=np.uint8)  # and among the 15 before
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    total = np.empty(n, dtype=np.int64)
    total[0] = _F[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.subtract(_STEP[behind[WINDOW:]], _STEP[ahead[: n - 1]], out=total[1:])
    np.cumsum(total, out=total)
    return ((_TOP - total) * 1000 // _TOP).astype(np.int16)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in thousandths of log2(16) of each 16-byte window of ``data``.

    A window's entropy is log2(16) less the mean of f(c) = c log2 c over its bytes'
    counts c. Sliding by one byte changes two counts only; these come from comparing
    the data with itself at each of 15 shifts, and a running sum in whole numbers
    does the rest.
    """
    n = max(0, len(data) - WINDOW + 1)
    out = np.empty(n, dtype=np.int16)
    for a in range(0, n, _STRETCH):
        out[a : a + _STRETCH] = _stretch_entropies(data[a : a + _STRETCH + WINDOW - 1])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))
    h = np.full(len(at), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in range(0, WINDOW, 8):
        w = np.ascontiguousarray(words[at + k]).view("<u8").ravel()
        h = _mix(h ^ w) + np.uint64(k + 1)
    return h


def select(rank: np.ndarray) -> np.ndarray:
    """Positions of the selected windows, given the rank of each (``NEVER`` for none).

    In each neighbourhood of 16 windows the leftmost of the lowest rank gets a vote;
    neighbourhoods that reach beyond an end count with what they hold. Windows with
    ``POPULAR`` votes are selected, so a text of one window selects it.
    """
    n, pad = len(rank), WINDOW - 1
    found = []
    for a in range(0, n, _STRETCH):
        b = min(n, a + _STRETCH)
        # every neighbourhood of a window of a to b, and all that it holds
        low = max(0, a - 2 * pad)
        part = np.full(b + 2 * pad - low + pad, NEVER, dtype=np.int32)
        got = rank[low : b + 2 * pad]
        part[pad : pad + len(got)] = got
        best = (part << 20) | np.arange(len(part), dtype=np.int32)
        span = 1
        while span < WINDOW:
            step = min(span, WINDOW - span)
            best = np.minimum(best[:-step], best[step:])
            span += step
        votes = np.bincount(best & ((1 << 20) - 1), minlength=len(part))[a - low + pad : b - low + pad]
        found.append(a + np.flatnonzero((votes >= POPULAR) & (rank[a:b] < NEVER)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """For each text a chain of Bloom filters, one row each; none for the empty text.

    Windows that reach into the next text are never selected, and as there are 15 of
    them no neighbourhood holds windows of two texts. A text shorter than a window, or
    one in which none is selected, is a feature as a whole.
    """
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    rank = ranks[entropies(data)]
    for end in ends[:-1].tolist():  # the last text's windows end with the data
        rank[max(0, end - WINDOW + 1) : end] = NEVER
    at = select(rank)
    owner = np.searchsorted(ends, at, side="right")
    h = _hashes(data, at)
    lone = np.setdiff1d(np.flatnonzero(sizes), owner)
    if len(lone):
        import xxhash

        whole = np.array([xxhash.xxh64_intdigest(texts[i]) for i in lone.tolist()], dtype=np.uint64)
        owner, h = np.concatenate([owner, lone]), np.concatenate([h, whole])
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    counts = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    filters = -(-counts // FILTER_FEATURES)
    first = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), FILTER_BITS), dtype=np.uint8)
    which = first[owner] + nth // FILTER_FEATURES
    for k in range(FEATURE_BITS):
        bits[which, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n] for a, n in zip(first.tolist(), filters.tolist(), strict=True)]


def digest(text: str, ranks: np.ndarray) -> np.ndarray:
    """The chain of one text."""
    return digests([text.encode()], ranks)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised overlap of two chains, 0 to 1.

    Each filter of the shorter chain is set against its best match in the other: the
    bits in common beyond those that chance gives two filters so full, as a share of
    the most there could be. The mean counts filters by their bits. Equal chains give
    1, and so do two empty ones; an empty one is unlike all else.
    """
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    ones_a, ones_b = np.bitwise_count(a).sum(axis=1), np.bitwise_count(b).sum(axis=1)
    got = 0.0
    for f, ones in zip(a, ones_a.tolist(), strict=True):
        common = np.bitwise_count(b & f).sum(axis=1)
        chance = ones * ones_b / FILTER_BITS
        most = np.minimum(ones, ones_b)
        floor = chance + 0.3 * (most - chance)
        score = (common - floor) / np.maximum(most - floor, 1e-9)
        got += ones * max(0.0, min(1.0, float(score.max())))
    return got / float(ones_a.sum())


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def _grouped(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    """Consecutive rows in lists whose sizes sum to about ``_GROUP``."""
    group: list[tuple] = []
    n = 0
    for row in rows:
        group.append(row)
        n += size(row)
        if n > _GROUP:
            yield group
            group, n = [], 0
    if group:
        yield group


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy by how rare it is over all windows of all texts.

    One count per thousandth comes back (1001 numbers). Entropies outside ``LOW`` to
    ``HIGH`` get the rank ``NEVER``. Null and short texts have no windows; an empty
    table ranks by the entropy alone.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, dtype=np.int64)
        raw = (x.as_py().encode() for batch in batches for x in batch.column(0) if x.is_valid)
        for group in _grouped(((x,) for x in raw if len(x) >= WINDOW), lambda r: len(r[0])):
            found = entropies(np.frombuffer(b"".join(x for x, in group), dtype=np.uint8))
            own = np.ones(len(found), dtype=bool)
            end = 0
            for (x,) in group[:-1]:
                end += len(x)
                own[end - WINDOW + 1 : end] = False
            total += np.bincount(found[own], minlength=1001)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["entropy", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(count, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n"))
    seen = np.zeros(1001, dtype=np.int64)
    for r in rows.collect():
        seen[r["entropy"]] = r["n"]
    ranks = np.empty(1001, dtype=np.int32)
    ranks[np.lexsort((np.arange(1001), seen))] = np.arange(1001)
    ranks[:LOW] = ranks[HIGH + 1 :] = NEVER
    return ranks


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first code points of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Cuts:
    """Cut points of rows in descending order of id, then ascending order of a 64-bit hash.

    ``quantiles`` of the ids, with repeats: an id that holds several quantiles is cut
    again by the hash, so that neither a hot id nor many null ones end in one part.
    """

    def __init__(self, quantiles: list[int]) -> None:
        self.ids, self.times = np.unique(np.array(quantiles, dtype=np.int64), return_counts=True)
        self.above = np.concatenate([np.cumsum(self.times[::-1])[::-1], [0]])  # cuts at an id or higher
        self.parts = int(self.times.sum()) + 1

    def part(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids, side="left")
        if not len(self.ids):
            return np.zeros(len(ids), dtype=np.int64)
        here = np.minimum(at, len(self.ids) - 1)
        equal = (at < len(self.ids)) & (self.ids[here] == ids)
        share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
        own = np.minimum(np.floor(share * self.times[here]).astype(np.int64), self.times[here] - 1) + 1
        return np.where(equal, self.above[at + equal] + own, self.above[at])


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Rows in descending order of id, cut into parts that each end with a copy of the next row.

    Columns ``part, copy, doc_id, text``: within a part, sorted, each row is followed
    by the next of the whole table, and the row after the last is the first. Rows that
    share an id, null ids among them, follow each other by a hash of their texts. Cut
    points are approximate quantiles of the ids, and within an id that holds several
    of them even steps of the hash; the first row of each part is exact. The driver
    holds one row per part, without texts. Texts are shuffled once. Null ids come last.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    at = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)
    cuts = _Cuts(rows.agg(at.alias("q")).first()["q"] or [])

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:  # the highest ids are in part 0
        return pd.Series(cuts.part(ids.to_numpy(), hashes.to_numpy()).astype("int32"))

    firsts = rows.select("doc_id", "h").withColumn("part", part_of("doc_id", "h")).groupBy("part")
    firsts = firsts.agg(F.max(F.struct("doc_id", F.negative(F.col("h").cast("decimal(20)")).alias("h"))).alias("first")).collect()
    order = sorted((r["part"], (r["first"]["doc_id"], -int(r["first"]["h"]))) for r in firsts)
    owner = {first: order[i - 1][0] for i, (_, first) in enumerate(order)}  # the first row follows the last

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = cuts.part(ids.to_numpy(), hashes.to_numpy()).tolist()
        keys = zip(ids.tolist(), hashes.tolist(), strict=True)
        return pd.Series([[p, owner[k]] if k in owner else [p] for k, p in zip(keys, own, strict=True)])

    spread = rows.select("doc_id", "text", "h", F.posexplode(places("doc_id", "h")).alias("copy", "part"))
    return spread.repartitionById(cuts.parts, F.col("part")).sortWithinPartitions("part", "copy", F.desc("doc_id"), "h")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of each text, its edited text and their likenesses.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; see ``edited`` and ``neighbours`` for the edited text
    and the next document. Null texts are empty; a lone document is followed by
    itself; rows that repeat an id follow each other in order of a hash of their texts.
    An empty table gives no rows. ``ranks`` defaults to ``rarity(docs)``.
    """
    table = rarity(docs, text_col) if ranks is None else ranks
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    lowest = -(1 << 63)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
        """Each row with the text that follows it; rows after the first copy repeat it."""
        held = None
        for batch in batches:
            for doc_id, text, copy in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                if held is not None:
                    yield *held, text
                held = (doc_id.as_py(), text)
                if copy:
                    return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for group in _grouped(pairs(batches), lambda r: len(r[1])):
            changed = [edited(text, following).encode() for _, text, following in group]
            own = [text.encode() for _, text, _ in group] + [group[-1][2].encode()]
            chains, others = digests(own, table), digests(changed, table)
            n = range(len(group))
            columns = [
                [None if doc_id == lowest else doc_id for doc_id, *_ in group],
                [len(text) for _, text, _ in group],
                [hashlib.sha256(x).hexdigest() for x in changed],
                [encode(chains[i]) for i in n],
                [encode(x) for x in others],
                [likeness(chains[i], others[i]) for i in n],
                [likeness(chains[i], chains[i + 1]) for i in n],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs, id_col, text_col).select("doc_id", "text", "copy").mapInArrow(run, schema)
