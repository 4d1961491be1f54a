"""SimHash near-duplicates through an inverted index over byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.graph import connected_components
from quirefold.plans.session import materialise, ship_package

BYTES = 8


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, as a signed integer.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space,
    shingles are ``words`` words joined by a space, with repeats; a shorter text is
    one shingle, and a text without words (or null) has fingerprint 0. A bit is set
    if it is set in over half of the shingles' XXH64 values.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    shingles = zip(*(parts[i:] for i in range(words)), strict=False) if len(parts) >= words else [parts]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in map(b" ".join, shingles)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(h[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(col: Column, words: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(x, words, seed) for x in texts], dtype="int64")

    return of(col)


def hex64(col: Column) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


#: Sets of four of eight positions whose numbers cancel under exclusive or: 14 sets, each position in
#: seven, each two in three, each three in one. So sets clear of 1, 2 or 3 given positions are 7, 3 or 1.
SETS = [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
_CLEAR = {1: 7, 2: 3, 3: 1}
#: Bits of a position at each level: bytes, then half-bytes and quarter-bytes of what a list leaves open.
_WIDTHS = (8, 4, 2)


def _masks(level: int) -> list[int]:
    """Bits that are fixed in each list of a level; list ``14 i + j`` of a level splits list i of the one above."""
    if level < 0:
        return [0]
    width, out = _WIDTHS[level], []
    for fixed in _masks(level - 1):
        free = [i for i in range(0, 64, width) if not fixed >> i & 1]
        out += [fixed | sum(((1 << width) - 1) << free[i] for i in chosen) for chosen in SETS]
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _posted(prints: DataFrame, level: int) -> DataFrame:
    """Postings ``s, k, fp, rep``: each fingerprint in 14 lists, under the bytes that are fixed there."""
    masks = F.expr(f"array({','.join(f'CAST({_signed(m)} AS BIGINT)' for m in _masks(level))})")
    first = F.col("s") * len(SETS) if level else F.lit(0)
    lists = F.transform(F.sequence(F.lit(0), F.lit(len(SETS) - 1)), lambda j: (first + j).cast("int"))
    posted = prints.select("fp", "rep", F.explode(lists).alias("s"))
    return posted.select("s", F.col("fp").bitwiseAND(F.get(masks, F.col("s"))).alias("k"), "fp", "rep")


def _shared(prints: DataFrame, least: int, long_list: int, level: int = 0) -> DataFrame:
    """``s, fa, ra, fb, rb``: a row for each list of a level that a pair shares."""
    posted = materialise(_posted(prints, level), f"simhash-lists-{level}")
    lists = posted.groupBy("s", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(posted.join(lists.hint("merge"), ["s", "k"]), f"simhash-met-{level}")
    last = level + 1 == len(_WIDTHS)
    short = met if last else met.where(F.col("n") <= long_list)
    a = short.select("s", "k", F.col("fp").alias("fa"), F.col("rep").alias("ra"))
    b = short.select("s", "k", F.col("fp").alias("fb"), F.col("rep").alias("rb"))
    pairs = a.hint("merge").join(b, ["s", "k"]).where("fa < fb").select("s", "fa", "ra", "fb", "rb")
    if last:
        return pairs
    long = met.where(F.col("n") > long_list)
    if long.isEmpty():
        return pairs
    below = _tallied(_shared(long, least, long_list, level + 1), least, F.floor(F.col("s") / len(SETS)).cast("int").alias("s"))
    return pairs.unionByName(below)


def _tallied(shared: DataFrame, least: int, *by: Column) -> DataFrame:
    """Pairs that share ``least`` lists or more."""
    pair = ("fa", "ra", "fb", "rb")
    return shared.groupBy(*by, *pair).agg(F.count("*").alias("tally")).where(F.col("tally") >= least).drop("tally")


def links(prints: DataFrame, max_bits: int = 2, long_list: int = 16) -> DataFrame:
    """Edges ``src, dst`` between representatives ``rep`` of distinct fingerprints
    ``fp`` for all pairs at ``max_bits`` (1 to 3) differing bits or fewer.

    An inverted index over byte positions with count filtering. Lists over one byte
    would hold a 256th of all fingerprints each and make the tally grow with the square
    of the input, so a list is over four positions and a fingerprint is in 14 of them
    (``SETS``). A pair that differs in two bytes at most shares three lists or more: the
    lists that a pair shares are counted, pairs under the guaranteed minimum (7, 3 or 1
    for 1, 2 or 3 bits) go, and the bits of the others are compared.

    A list of over ``long_list`` fingerprints is hot and split by the same rule over the
    half-bytes that it leaves open, and once more over quarter-bytes; a pair that reaches
    the minimum in the lists of a split counts once for the list. A list of the last
    level has eight open bits and so at most 256 fingerprints. No pair within
    ``max_bits`` is lost at any length.
    """
    if max_bits not in _CLEAR:
        raise ValueError("max_bits must be 1, 2 or 3")
    least = _CLEAR[max_bits]
    pairs = _tallied(_shared(prints, least, long_list), least)
    near = pairs.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)
    return near.select(F.col("ra").alias("src"), F.col("rb").alias("dst"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, max_bits: int = 2
) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest id reachable over links of ``max_bits``
    differing bits or fewer, its own included. Equal fingerprints are one class from
    the start, so copies are never paired. Null, empty and blank texts share the zero
    fingerprint and are linked like any other; rows that repeat an id stay rows; a
    null id takes its class's component and is never one. Only the id and the
    fingerprint of a document are shuffled, never its text.
    """
    ship_package(docs.sparkSession)
    prints = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), words, seed).alias("fp")),
        "simhash",
    )
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = connected_components(links(classes.where("rep IS NOT NULL"), max_bits))
    placed = classes.join(
        found.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left"
    ).select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(placed.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


#: Fixed value: multiplier that spreads a hash into further ones.
_SPREAD = 0x9E3779B97F4A7C15
#: Words of 64 bits in a long signature.
PARTS = 4
#: Byte positions of a long signature.
PLACES = BYTES * PARTS
#: Pairs of a list of so many members are all looked at; longer lists are compared in blocks.
SHORT_LIST = 8
#: Values of a shingle's hash that are counted apart.
COUNTED = 256
#: Classes of a text's candidates, by a hash, of each of which the nearest is verified first.
PICKS = 4
#: Members of a block of a longer list, of which a task compares two at a time.
LIST_BLOCK = 512


def list_width(texts: int) -> int:
    """Bytes in a list's key, so that a list holds one unrelated text at most on the mean."""
    return max(3, -(-(max(1, texts) - 1).bit_length() // 8))


def list_places(width: int) -> np.ndarray:
    """The byte positions of each list: 128 of three, four times as many for each byte more.

    A pair at similarity 0.8 agrees in a byte with a probability of about 0.27, so that it
    shares as many lists on the mean at any width.
    """
    lists = 4 * PLACES * 4 ** (width - 3) if width > 3 else 4 * PLACES
    steps = np.random.default_rng(width).permuted(np.tile(np.arange(1, PLACES), (lists // PLACES, 1)), axis=1)[:, : width - 1]
    first = np.arange(PLACES)[None, :, None]
    return ((first + np.concatenate([np.zeros((len(steps), 1), dtype=int), steps], axis=1)[:, None, :]) % PLACES).reshape(lists, width)


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _shingles(parts: list[bytes], words: int) -> list[bytes]:
    if len(parts) < words:
        return [b" ".join(parts)] if parts else []
    return list(map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)))


def signature(text: str | None, words: int = 5, seed: int = 42) -> list[int]:
    """A SimHash of ``PARTS`` times 64 bits over the distinct shingles of a text, as signed integers.

    Words and shingles are those of ``simhash``. Each shingle's XXH64 is multiplied and
    mixed to as many hashes; without words all are 0.
    """
    import xxhash

    shingles = set(_shingles(_words_of(text), words))
    if not shingles:
        return [0] * PARTS
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64, count=len(shingles))
    out = []
    for k in range(PARTS):
        ones = np.zeros(64, dtype=np.int64)
        x = h * np.uint64((_SPREAD * (2 * k + 1)) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        for at in range(0, len(x), 8192):
            ones += np.unpackbits(x[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view("<i8")[0]))
    return out


def jaccard(a: str | None, b: str | None, words: int = 5) -> float:
    """Similarity of two texts' sets of shingles; 1 for two without words."""
    x, y = set(_shingles(_words_of(a), words)), set(_shingles(_words_of(b), words))
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_counts(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """How many distinct shingles of a text fall to each of ``COUNTED`` values of their hash.

    Two texts share no more shingles than the sum of their lesser counts, so what they would
    have to share can be ruled out without the texts.
    """
    import xxhash

    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in set(_shingles(_words_of(text), words))), dtype=np.uint64)
    return np.bincount((h % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED).astype(np.int32)


def _differ(a: str, b: str) -> Column:
    """Bits in which two signatures are unequal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)


def _pairs_of(members: DataFrame, by: list[str], max_bits: int) -> DataFrame:
    """``src, dst`` of all members of different groups in one list within ``max_bits``; for short lists."""
    a = members.select(*by, F.col("node").alias("src"), F.col("group").alias("ga"), F.col("sig").alias("sa"))
    b = members.select(*by, F.col("node").alias("dst"), F.col("group").alias("gb"), F.col("sig").alias("sb"))
    return a.hint("merge").join(b, by).where("src < dst AND ga <> gb").where(_differ("sa", "sb") <= max_bits).select("src", "dst")


def _blocks_met(members: DataFrame, by: list[str], max_bits: int, block: int = LIST_BLOCK, similarity: float = 0.0) -> DataFrame:
    """``src, dst`` of all members of different groups in one list within ``max_bits``, for lists of any length.

    ``members`` has ``node, group, sig`` and maybe ``counts`` (``shingle_counts``), by which pairs that cannot
    have ``similarity`` are left out. A list is dealt into blocks of some ``block`` members by a hash;
    each pair of its blocks meets in a task of its own that compares the signatures and gives only
    pairs that are near, so a task holds two blocks and no pair is left out.
    """
    sizes = members.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks"))
    dealt = members.hint("merge").join(sizes, by).withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other")
    counted = ["counts"] if "counts" in members.columns else []
    sent = dealt.select(*by, "node", "group", "sig", *counted, "__own", other)
    sent = sent.withColumns({"__low": F.least("__own", "__other"), "__high": F.greatest("__own", "__other")})

    def near(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable")
        node, group = part["node"].to_numpy(), part["group"].to_numpy()
        own, mixed = part["__own"].to_numpy(), part["__low"].iat[0] != part["__high"].iat[0]
        sig = np.array(part["sig"].tolist(), dtype=np.int64).view(np.uint64).reshape(len(part), -1)
        counts = np.array(part["counts"].tolist(), dtype=np.int32).reshape(len(part), -1) if counted else None
        size = counts.sum(axis=1, dtype=np.int64) if counted else None
        src, dst = [], []
        for i in range(len(part) - 1):
            later = np.arange(i + 1, len(part))
            later = later[(group[i + 1 :] != group[i]) & ((own[i + 1 :] != own[i]) | (not mixed))]
            bits = np.bitwise_count(sig[later] ^ sig[i]).sum(axis=1, dtype=np.int64)
            later = later[bits <= max_bits]
            if counted and len(later):  # alike by s, they share s / (1 + s) of both sizes together
                shared = np.minimum(counts[later], counts[i]).sum(axis=1, dtype=np.int64)
                later = later[shared + 1e-6 >= similarity / (1 + similarity) * (size[later] + size[i])]
            src.append(np.full(len(later), node[i]))
            dst.append(node[later])
        none = [np.empty(0, dtype=np.int64)]
        return pd.DataFrame({"src": np.concatenate(src or none), "dst": np.concatenate(dst or none)})

    return sent.groupBy(*by, "__low", "__high").applyInPandas(near, "src long, dst long")


def _group_of(rows: DataFrame, found: DataFrame, node: str, out: str) -> DataFrame:
    """``rows`` with the group of ``node`` as ``out``: a node that ``found`` does not have is one by itself."""
    own = found.select(F.col("node").alias(node), F.col("component").alias("__c"))
    return rows.hint("merge").join(own, node, "left").withColumn(out, F.coalesce("__c", node)).drop("__c")


def regrouped(found: DataFrame, new: DataFrame) -> DataFrame:
    """Groups ``node, component`` of ``found`` after further edges ``src, dst``.

    Only the groups that new edges lie between are linked, so that what the components cost, in jobs
    and in plans that the driver holds, follows the new edges and not all edges found so far.
    """
    ends = materialise(_group_of(_group_of(new.select("src", "dst"), found, "src", "ca"), found, "dst", "cb"), "similar-ends")
    moved = connected_components(ends, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("__to"))
    seen = found.select("node", "component").unionAll(ends.select("src", "ca")).unionAll(ends.select("dst", "cb")).distinct()
    placed = seen.hint("merge").join(moved, "component", "left")
    return materialise(placed.select("node", F.coalesce("__to", "component").alias("component")), "similar-grouped")


def similar(
    texts: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, max_bits: int = 60, width: int | None = None
) -> DataFrame:
    """Edges ``src, dst`` that connect distinct texts whose shingle sets have ``similarity`` or more, as ``similar_groups`` finds them."""
    return similar_groups(texts, words, similarity, seed, max_bits, width)[0]


def similar_groups(
    texts: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, max_bits: int = 60, width: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Edges ``src, dst`` that connect distinct texts whose shingle sets have ``similarity`` or more, and
    the groups that they make: ``node, component`` of each text with an edge, the smallest node of its group.

    ``texts`` has ``node, text``, a row for each distinct text. An inverted index over the
    32 byte positions of ``signature``: a text is in ``list_places`` lists, under three bytes
    each, or more where there are more texts (``list_width``; ``width`` overrides it).

    First a list's members are set against its least and its greatest node. The members of shared
    lists carry their signatures, so pairs with more than ``max_bits`` of the 256 bits unequal go
    where they are made (at a similarity of 0.8 the mean is 39). The others are verified on the texts'
    shingles in three rounds: of each text the pairs with the fewest unequal bits (one for each of
    ``PICKS`` classes of the other text, so that most groups are whole after it), then of each two
    groups that are not connected yet the one that has them, then whatever still lies between
    groups. A pair looks its texts' groups up once, then only what became of those groups. So a
    group of near copies costs pairs in proportion to its members, two a list at most, and no
    pair is left out that could connect. What is left are lists of three or more whose members are not one group
    by then, of any length: all pairs of different groups are looked at, in lists of up to
    ``SHORT_LIST`` by a join and in longer ones block by block (``_blocks_met``). No list is
    cut to its ends. Lists that unrelated texts fill cost the square of their length in
    comparisons of signatures, a task holds two blocks of one, and only near pairs that may share
    enough shingles by their counts (``shingle_counts``) become rows.

    Edges are exact, the search is not: a pair at 0.8 shares a list with a probability of
    about 0.9, one at 0.9 of over 0.99, and groups are linked through any of their pairs.
    Groups are carried from round to round: each links only what its own edges join (``regrouped``).
    """
    at = list_places(width or list_width(texts.count()))

    @F.pandas_udf("sig array<long>, keys array<long>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lists = np.arange(len(at), dtype=np.int64)
        for batch in batches:
            sig = np.array([signature(x, words, seed) for x in batch], dtype="<i8").reshape(-1, PARTS)
            own = np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), -1)[:, at].astype(np.int64)
            keys = lists[None, :]
            for i in range(at.shape[1]):
                keys = (keys << 8) + own[:, :, i]
            yield pd.DataFrame({"sig": list(sig), "keys": list(keys)})

    prints = materialise(texts.select("node", signed("text").alias("s")).select("node", "s.*"), "similar-signatures")
    posted = prints.select("node", F.explode("keys").alias("k"))
    ends = posted.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    met = materialise(posted.join(ends.hint("merge"), "k"), "similar-met")
    met = materialise(met.hint("merge").join(prints.select("node", "sig"), "node"), "similar-signed")
    both = met.groupBy("k").agg(F.min_by("sig", "node").alias("first"), F.max_by("sig", "node").alias("last"))
    both = materialise(both, "similar-ends-signed")
    pairs = met.select("k", "node", "sig", "low", "high").join(both.hint("merge"), "k")
    own = (F.struct(F.col(end).alias("end"), F.col(other).alias("other")) for end, other in (("low", "first"), ("high", "last")))
    pairs = pairs.select("node", "sig", F.explode(F.array(*own)).alias("e"))
    pairs = pairs.select("node", "sig", "e.*").where("node <> end").withColumn("bits", _differ("sig", "other")).where(F.col("bits") <= max_bits)
    pairs = pairs.select(F.least("node", "end").alias("src"), F.greatest("node", "end").alias("dst"), "bits")
    near = materialise(pairs.distinct(), "similar-near")

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(p, q, words) for p, q in zip(x, y, strict=True)], dtype="float64")

    def texts_of(pairs: DataFrame, label: str) -> DataFrame:
        ends = [pairs.select(F.col(c).alias("node")).distinct() for c in ("src", "dst")]
        return materialise(texts.join(ends[0].unionAll(ends[1]).hint("merge"), "node", "left_semi"), label)

    def verified(pairs: DataFrame, needed: DataFrame, label: str) -> DataFrame:
        one = needed.select(F.col("node").alias("src"), F.col("text").alias("ta"))
        two = needed.select(F.col("node").alias("dst"), F.col("text").alias("tb"))
        held = pairs.hint("merge").join(one, "src").hint("merge").join(two, "dst").where(alike("ta", "tb") >= similarity)
        return materialise(held.select("src", "dst"), label)

    def tested(pairs: DataFrame, label: str) -> DataFrame:
        return verified(pairs, texts_of(pairs, f"similar-{label}-texts"), f"similar-{label}")

    def apart(pairs: DataFrame, found: DataFrame, one: str, two: str) -> DataFrame:
        return _group_of(_group_of(pairs, found, one, "ca"), found, two, "cb").where("ca <> cb")

    def nearest(pairs: DataFrame, *by: Column) -> DataFrame:
        return pairs.groupBy(*by).agg(F.min(F.struct("bits", "src", "dst")).alias("b"))

    def picks(node: str, other: str) -> DataFrame:
        return nearest(near, F.col(node).alias("node"), F.pmod(F.xxhash64(other), F.lit(PICKS)).alias("pick"))

    best = picks("src", "dst").unionAll(picks("dst", "src")).groupBy("node", "pick").agg(F.min("b").alias("b"))
    first = materialise(best.select("b.src", "b.dst").distinct(), "similar-best")
    edges = tested(first, "first")
    found = materialise(connected_components(edges), "similar-grouped")
    rest = materialise(apart(near, found, "src", "dst").join(first.hint("merge"), ["src", "dst"], "left_anti"), "similar-apart")
    second = materialise(nearest(rest, F.least("ca", "cb"), F.greatest("ca", "cb")).select("b.src", "b.dst"), "similar-groups")
    new = tested(second, "second")
    if not new.isEmpty():
        edges, found = edges.unionAll(new), regrouped(found, new)
        rest = apart(rest, found, "ca", "cb")  # a group goes by one of its nodes
    rest = materialise(rest.join(second.hint("merge"), ["src", "dst"], "left_anti").select("src", "dst"), "similar-left")
    if not rest.isEmpty() and not (new := tested(rest, "rest")).isEmpty():
        edges, found = edges.unionAll(new), regrouped(found, new)

    more = met.where("n > 2").select("node", "k", "sig")
    if more.isEmpty():
        return edges, found
    members = materialise(_group_of(more, found, "node", "group"), "similar-members")
    mixed = members.groupBy("k").agg(F.min("group").alias("g1"), F.max("group").alias("g2"), F.count("*").alias("n")).where("g1 <> g2").select("k", "n")
    members = materialise(members.join(mixed.hint("merge"), "k"), "similar-mixed")
    if members.isEmpty():
        return edges, found
    pairs = _pairs_of(members.where(F.col("n") <= SHORT_LIST), ["k"], max_bits)
    long = members.where(F.col("n") > SHORT_LIST)
    if not long.isEmpty():

        @F.pandas_udf("array<int>")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([shingle_counts(x, words, seed) for x in batch])

        own = texts.join(long.select("node").distinct().hint("merge"), "node", "left_semi").select("node", counted("text").alias("counts"))
        own = materialise(own, "similar-counts")
        wide = long.hint("merge").join(own, "node").select("k", "node", "group", "sig", "counts")
        pairs = pairs.unionAll(materialise(_blocks_met(wide, ["k"], max_bits, similarity=similarity), "similar-long"))
    # what is of different groups still and was near before has been verified
    again = pairs.distinct().join(near.select("src", "dst").hint("merge"), ["src", "dst"], "left_anti")
    new = tested(materialise(again, "similar-anew"), "again")
    return (edges, found) if new.isEmpty() else (edges.unionAll(new), regrouped(found, new))


def keep_one_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42
) -> DataFrame:
    """``docs`` with one document of each group linked by ``similar``, that of the smallest id.

    Rows are told apart by id and text (two hashes, 96 bits): of rows that repeat both one
    stays, of rows that repeat an id alone only near copies go. Texts without words, null ones
    too, are one group. A row with a null id stays. All columns pass, whatever their names; an empty
    table gives none.
    """
    ship_package(docs.sparkSession)
    given, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    with_id = docs.where(given.isNotNull())
    named = {"__id": given.cast("long"), "__node": F.xxhash64(text), "__check": F.hash(text), "__none": F.col(f"`{text_col}`").isNull()}
    rows = materialise(with_id.select(*(v.alias(k) for k, v in named.items())), "similar-rows")
    texts = with_id.select(F.xxhash64(text).alias("node"), F.hash(text).alias("check"), text.alias("text")).groupBy("node")
    texts = materialise(texts.agg(F.min("check").alias("check"), F.min_by("text", "check").alias("text")), "similar-distinct")
    found = similar_groups(texts.select("node", "text"), words, similarity, seed)[1].select(F.col("node").alias("__node"), "component")
    own = texts.select(F.col("node").alias("__node"), F.col("check").alias("__check"), F.lit(True).alias("own"))
    placed = rows.hint("merge").join(own, ["__node", "__check"], "left").hint("merge").join(found, "__node", "left")
    # another text of the same first hash is in no group but its copies'
    group = [F.when(F.col("own"), F.coalesce("component", "__node")).otherwise(F.col("__node")), F.when(F.col("own").isNull(), F.col("__check"))]
    stays = placed.groupBy(*(g.alias(f"group{i}") for i, g in enumerate(group))).agg(F.min(F.struct(*named)).alias("least")).select("least.*")
    kept = with_id.withColumns(named)
    kept = kept.join(stays.hint("merge"), list(named), "left_semi").dropDuplicates(list(named))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionAll(docs.where(given.isNull()).select(*columns))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, max_bits: int = 2
) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest id.

    Rows are told apart by id and text: of rows that repeat both one stays, of rows
    that repeat an id alone only near copies go. A row with a null id stays. All
    columns pass.
    """
    ship_package(docs.sparkSession)
    given = F.col(f"`{id_col}`")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())
    prints = materialise(
        docs.where(given.isNotNull()).select(
            given.cast("long").alias("__id"), key.alias("__key"), fingerprint(F.col(text_col), words, seed).alias("fp")
        ),
        "simhash-rows",
    )
    classes = materialise(prints.groupBy("fp").agg(F.min(F.struct("__id", "__key")).alias("least")), "simhash-row-classes")
    # nodes are fingerprints: an id may have several
    found = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), max_bits))
    groups = classes.join(found.select(F.col("node").alias("fp"), "component").hint("merge"), "fp", "left")
    stays = groups.groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("least").alias("least"))
    stays = stays.select("least.*").hint("merge")
    rows = docs.where(given.isNotNull()).withColumn("__id", given.cast("long")).withColumn("__key", key)
    kept = rows.join(stays, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionAll(docs.where(given.isNull()).select(*columns))
