"""Packing token sequences: concatenate everything, cut it into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.plans.session import materialise, ship_package

_WORKER: dict = {}
#: Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two other white-space characters; without one, a text can be cut at its spaces.
_INNER_SPACE = re.compile(r"\s \s")


def _byte_characters() -> dict[str, int]:
    """The character that byte-level BPE files write for each byte: itself if it is
    printable Latin-1, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast_encoding(model: str):
    """The file's vocabulary as a tiktoken encoding, or None where that would not be the same.

    tiktoken merges by rank, so ids must rise in the order of the file's merges, and
    the file must use the byte-level pattern and nothing that changes texts.
    """
    import tiktoken

    with open(model, encoding="utf-8") as f:
        spec = json.load(f)
    pre, bpe = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and bpe.get("type") == "BPE"
        and not any((spec.get("normalizer"), bpe.get("dropout"), bpe.get("ignore_merges")))
    )
    if not plain:
        return None
    added = {x["content"] for x in spec.get("added_tokens", [])}
    byte = _byte_characters()
    ranks = {bytes(byte[c] for c in k): v for k, v in bpe["vocab"].items() if k not in added}
    merged = [bpe["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in bpe["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids_of(model: str, cache_size: int):
    """A function from a text to its ids, little-endian unsigned 32-bit, for a BPE file of tokenizers.

    The pre-tokens of a byte-level file never cross from a non-space to a space, so
    a text without inner spaces is cut at its spaces and each piece looked up in the
    worker's cache; what is missing there is encoded together. Texts with inner
    spaces or special strings go to the library whole.
    """
    if _WORKER.get("model") != model:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(model)
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        fast = _fast_encoding(model)
        spaced = fast and np.array([fast.decode_single_token_bytes(i)[:1] == b" " for i in range(fast.n_vocab)])
        _WORKER.clear()
        _WORKER.update(model=model, tokenizer=tokenizer, special=special, fast=fast, spaced=spaced, cache={})
    tokenizer, special, fast, spaced, cache = (_WORKER[k] for k in ("tokenizer", "special", "fast", "spaced", "cache"))

    def whole_text(text: str) -> bytes:
        if fast is None or any(s in text for s in special):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode_words(words: list[str]) -> dict[str, bytes]:
        """Ids of words, each with a space before it; a token with a space in front begins a word."""
        out = {w: whole_text(f" {w}") for w in words if not w or w[0].isspace() or w[-1].isspace()}
        words = [w for w in words if w not in out]
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.asarray(fast.encode_ordinary(" " + " ".join(part)), dtype="<u4")
            cut = [*(4 * np.flatnonzero(spaced[ids])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            out.update(zip(part, (data[a:b] for a, b in zip(cut, cut[1:], strict=False)), strict=True))
        return out

    def ids(texts: list[str]) -> list[bytes]:
        if len(cache) > cache_size:
            cache.clear()
        split = [
            [] if fast is None or _INNER_SPACE.search(x) or any(s in x for s in special) else x.split(" ")
            for x in texts
        ]
        parts = [list(map(cache.get, words[1:])) for words in split]
        new = encode_words(
            list({
                w
                for words, got in zip(split, parts, strict=True)
                if None in got
                for w, n in zip(words[1:], got, strict=True)
                if n is None
            })
        )
        out = []
        for text, words, got in zip(texts, split, parts, strict=True):
            if None in got:
                got = [new[w] if n is None else n for w, n in zip(words[1:], got, strict=True)]
            out.append(whole_text(words[0] if words else text) + b"".join(got))
        cache.update((w, n) for w, n in new.items() if len(w) <= 64)
        return out

    return ids


def _grouped(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    group: list[str] = []
    n = 0
    for text in texts:
        group.append(text)
        n += len(text)
        if n > chars:
            yield group
            group, n = [], 0
    if group:
        yield group


def tokenised(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, cache_size: int = 150_000
) -> DataFrame:
    """One row per document: ``doc_id, ids, n, part, start`` with the end id added.

    ``ids`` is binary, little-endian unsigned 32-bit; ``start`` is the number of ids
    before the document in its task and ``part`` that task's number, so that
    (part, start) orders all ids. Null texts count as empty and get the end id alone.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _ids_of(model, cache_size)
        part = TaskContext.get().partitionId()
        start = 0
        for batch in batches:
            at = 0
            for texts in _grouped([x or "" for x in batch.column(1).to_pylist()]):
                packed = [x + end for x in encode(texts)]
                n = np.array([len(x) // 4 for x in packed], dtype="int64")
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(packed, pa.binary()),
                        pa.array(n),
                        pa.array(np.full(len(n), part, dtype="int64")),
                        pa.array(starts),
                    ],
                    names=["doc_id", "ids", "n", "part", "start"],
                )
                at += len(texts)

    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids binary, n long, part long, start long")


def pack(
    docs: DataFrame,
    model: str,
    length: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents laid end to end in sequences of exactly ``length`` ids.

    First pass: each task tokenises its documents once, keeps its running total and
    writes ids with their place in the task to the shared folder. The task totals (a
    row per task) are summed into global offsets. Second pass: every document is cut
    where its global place crosses a multiple of ``length``; a document over a
    boundary gives several pieces. Only the last sequence can be short. No row is
    shuffled, none is lost, and each id lies in exactly one piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``,
    and with ``with_ids`` the ids themselves. Repeated rows and null ids are
    documents like any other; an empty table gives no rows.
    """
    stored = materialise(tokenised(docs, model, id_col, text_col, end_id), "pack-ids")
    totals = stored.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    offsets: dict[int, int] = {}
    total = 0
    for row in totals:
        offsets[row["part"]] = total
        total += row["n"]
    before = docs.sparkSession.sparkContext.broadcast(offsets)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = ["long"] * 7 + ["binary"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), batch.column(1), strict=True)
            for doc_id, n, part, start, ids in rows:
                data = memoryview(ids.as_buffer())
                at, place = 0, before.value[part] + start
                while at < n:
                    offset = place % length
                    take = min(n - at, length - offset)
                    piece = data[4 * at : 4 * (at + take)]
                    values = [doc_id, at, take, zlib.crc32(piece), n, place // length, offset]
                    for col, value in zip(cols, values + [bytes(piece)] * with_ids, strict=True):
                        col.append(value)
                    at += take
                    place += take
            types = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return stored.select("doc_id", "ids", "n", "part", "start").mapInArrow(
        cut, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True))
    )
