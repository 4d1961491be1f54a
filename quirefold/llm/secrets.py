"""Secret scans: single patterns, and credentials whose parts stand near each other.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.plans.session import materialise

#: Two private-use characters mark a match's ends while a text is cut. They are
#: swapped for another one in the text first, which no pattern can tell apart.
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"

#: Kinds in their order, each with its pattern, the group whose length
#: counts, and that length at least.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Parts that say little alone: kind, role in a credential, pattern. The pattern of weak secrets
#: passes over hosts and paths of addresses, which look much like them; ``weak_spans`` leaves these out.
#: A run of 16 or more is one if it mixes cases and has a digit beside a capital or three digits,
#: or is of small letters and digits that take turns, or of capitals and digits 2 to 7; words run together,
#: with their numbers, are a name and none, as are small hex digits alone. User and password of an address are a pair in themselves.
WEAK = [
    (
        "weak_id",
        "id",
        r"""(?i)(?:\b|(?<=_))(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}|\b(?-i:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{4,15}\b""",
    ),
    (
        "weak_secret",
        "secret",
        r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s\"'<>|?#]+"
        r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?!(?:(?:[A-Z]?[a-z]{2,}+|[0-9]{1,4}+|[_-])++|[0-9a-f]++)(?![A-Za-z0-9+/_-]))(?:"
        r"(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*?(?:[A-Z][0-9]|[0-9][A-Z])|(?:[A-Za-z+/_-]*[0-9]){3})"
        r"|(?=(?:[a-z]*[0-9]+[a-z]+){3})(?=[a-z0-9]+(?![A-Z+/_-]))"
        r"|(?=[A-Z]*[2-7])(?=[A-Z2-7]+(?![a-z0189+/_-])))[A-Za-z0-9+/_-]+={0,2}",
    ),
    ("endpoint", "endpoint", r"""\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>|]+|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b"""),
    ("userinfo", "pair", r"""(?<=://)[^\s/@:"'<>]+:[^\s/@"'<>]+(?=@)"""),
]
#: Role of a base kind in a credential. A hex run alone is as likely a checksum; a named one is an assignment.
ROLES = {"assign": "secret", "access": "id"}
#: A weak part is reported if a part of one of these roles is in its scope.
COMPLEMENTS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]


#: Matches of one text are placed in blocks of so many: an array grows by copying, so that one
#: array for all would cost the square of their number.
_BLOCK = 128
_FOUND = "array<struct<start:int,end:int,match:string>>"


def _placed(pieces: Column) -> Column:
    """Matches with their places, from a text cut before each match, whose end is marked."""
    size = F.size(pieces)
    blocks = F.sequence(F.lit(0), F.floor((size - 2) / _BLOCK).cast("int"))

    def block(i: Column) -> Column:
        return F.slice(pieces, i * _BLOCK + 2, F.lit(_BLOCK))

    def start(state: Column, i: Column) -> Column:
        length = F.aggregate(block(i), F.lit(0), lambda n, piece: n + F.length(piece) - 1)
        return F.struct((state["at"] + length).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    starts = F.aggregate(
        blocks,
        F.struct(F.length(pieces[0]).alias("at"), F.array().cast("array<int>").alias("out")),
        start,
        lambda state: state["out"],
    )

    def step(state: Column, piece: Column) -> Column:
        found = F.substring_index(piece, _CLOSE, 1)
        one = F.struct(state["at"].alias("start"), (state["at"] + F.length(found)).alias("end"), found.alias("match"))
        return F.struct((state["at"] + F.length(piece) - 1).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def inside(i: Column, at: Column) -> Column:
        empty = F.struct(at.alias("at"), F.array().cast(_FOUND).alias("out"))
        return F.aggregate(block(i), empty, step, lambda state: state["out"])

    return F.flatten(F.transform(F.array(starts), lambda s: F.flatten(F.transform(blocks, lambda i: inside(i, F.get(s, i))))))


def _matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Array of (start, end, match) in code points, leftmost and without overlaps."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)
    placed = F.flatten(F.transform(F.array(pieces), _placed))  # cut once, used often
    hit = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(hit, placed).otherwise(F.array().cast(_FOUND))


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind its spans: array of (start, end)."""
    out = {}
    for kind, pattern, group, least in BASE:
        gate = None
        if kind == "hex":  # a run is as long as it can be, so the short ones can be left out at once
            pattern = f"[0-9a-f]{{{least},}}"
        elif kind == "access":
            gate = text.contains("AKIA")
        else:
            gate = text.contains("=") | text.contains(":")
        out[kind] = _long_enough(_matches(text, pattern, gate), pattern, group, least)
    return out


def _long_enough(found: Column, pattern: str, group: int, least: int) -> Column:
    def long(x: Column) -> Column:
        return F.length(F.regexp_extract(x["match"], pattern, group) if group else x["match"]) >= least

    return F.transform(F.filter(found, long), lambda x: F.struct(x["start"], x["end"]))


def weak_spans(text: Column) -> dict[str, Column]:
    """For each weak kind its spans: array of (start, end)."""
    gates = {
        "weak_id": text.contains("=") | text.contains(":") | text.rlike("A[A-Z]{3}"),
        "endpoint": text.contains("://") | text.rlike(r"\d\.\d"),
        "userinfo": text.contains("://") & text.contains("@"),
    }

    def kept(kind: str, pattern: str) -> Column:
        found = _matches(text, pattern, gates.get(kind))
        return F.filter(found, lambda x: ~x["match"].contains("://")) if kind == "weak_secret" else found

    return {kind: F.transform(kept(kind, pattern), lambda x: F.struct(x["start"], x["end"])) for kind, _, pattern in WEAK}


def _tagged(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    text = F.transform(
        F.array_sort(spans),
        lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.array_join(text, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, base, spans, links``.

    ``base`` are the spans of the single patterns. ``spans`` are these and the weak
    parts that another part completes: an identifier a secret, a secret an identifier
    or an endpoint, an endpoint a secret, if they start at most ``scope`` code points
    apart in one document and no character is in both; base spans count as parts too.
    User and password in an address are complete in themselves. Each span is (start, rank,
    end, kind), in code points, end exclusive; ``links`` has for each weak part that others
    complete (part, with): the nearest before it and the nearest after, where there are such.

    Parts are joined to scopes by interval frames over a stretch of a document: a part
    is completed from before if the least end of the parts wanted among those that start
    up to ``scope`` earlier is no later than its start, from after if their greatest
    start up to ``scope`` later is no earlier than its end. A part has two links at most,
    so that a document of n parts never gives n times n, and long documents are many
    stretches. Only spans are shuffled, texts never. Null and empty texts have none; an
    empty table gives none. Documents are told apart by id and text, so repeated rows get
    the same spans.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _OPEN + _CLOSE, _OTHER + _OTHER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(id_col, text_col).alias("text_key"), text.alias("t"))
    base = base_spans(F.col("t"))
    weak = weak_spans(F.col("t"))
    found = rows.select(
        "doc_id",
        "text_key",
        F.concat(*(_tagged(s, k) for k, s in base.items())).alias("base"),
        F.concat(*(_tagged(s, k) for k, s in weak.items())).alias("weak"),
    )
    found = materialise(found, "secret-spans")
    linked = _completed(found, scope).groupBy("text_key").agg(
        F.collect_list("p").alias("linked"), F.flatten(F.collect_list("links")).alias("links")
    )
    none = F.array().cast(linked.schema["links"].dataType)
    return found.join(linked.hint("merge"), "text_key", "left").select(
        "doc_id",
        "text_key",
        "base",
        F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked")).alias("spans"),
        F.coalesce("links", none).alias("links"),
    )


def _text_key(id_col: str, text_col: str) -> Column:
    return F.concat_ws(
        "/",
        F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
        F.hex(F.xxhash64(F.col(text_col))),
        F.hex(F.crc32(F.coalesce(F.col(text_col), F.lit("")))),
    )


def _completed(found: DataFrame, scope: int) -> DataFrame:
    """``text_key, p``: the weak parts that others complete, each once."""
    stretch = 100 * scope
    role = F.lit(None).cast("string")
    for kind, of in [*ROLES.items(), *((k, r) for k, r, _ in WEAK)]:
        role = F.when(F.col("p.kind") == kind, of).otherwise(role)
    parts = found.where("size(weak) > 0").select("text_key", F.explode(F.concat("base", "weak")).alias("p")).distinct()
    # a part near the border of its stretch is seen from the next one, too
    near = F.array_distinct(F.array(*(F.floor((F.col("p.start") + d) / stretch) for d in (0, -scope, scope))))
    parts = parts.select("text_key", "p", role.alias("role"), F.posexplode(near).alias("seen", "stretch"))
    by = Window.partitionBy("text_key", "stretch").orderBy(F.col("p.start"))
    wanted = {of: F.col("role").isin(*others) for of, others in COMPLEMENTS.items()}
    done = F.col("role") == "pair"
    nothing = F.lit(None).cast(parts.schema["p"].dataType)
    links = F.array(nothing)
    for of, other in wanted.items():
        earlier, later = by.rangeBetween(-scope, -1), by.rangeBetween(0, scope)
        part = F.when(other, F.col("p"))
        # the nearest, or where that one overlaps, the one that surely does not
        near, least = F.max(part).over(earlier), F.min(F.when(other, F.struct("p.end", "p"))).over(earlier)
        before = F.when(near["end"] <= F.col("p.start"), near).when(least["end"] <= F.col("p.start"), least["p"])
        first, last = F.min(part).over(by.rangeBetween(1, scope)), F.max(part).over(later)
        after = F.when(first["start"] >= F.col("p.end"), first).when(last["start"] >= F.col("p.end"), last)
        links = F.when(F.col("role") == of, F.array(before, after)).otherwise(links)
    partners = F.filter(links, lambda x: x.isNotNull())
    done = F.coalesce(done, F.lit(False)) | (F.size(partners) > 0)
    weak = F.col("p.kind").isin(*(k for k, *_ in WEAK))
    pairs = F.transform(partners, lambda x: F.struct(F.col("p").alias("part"), x.alias("with")))
    out = parts.select("text_key", "p", "seen", weak.alias("weak"), done.alias("done"), pairs.alias("links"))
    return out.where("weak AND done AND seen = 0")


#: Code points in a block of a text that is cut at many places.
_CUT = 4096


def _without(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each of its sorted, disjoint spans, each piece cut from its blocks alone."""

    def hidden(x: Column) -> Column:
        blocks, cuts = x["blocks"], x["cuts"]
        size = F.size(cuts)

        def piece(i: Column) -> Column:
            a = F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"])
            b = F.when(i == size, x["n"]).otherwise(F.get(cuts, i)["start"])

            def part(j: Column) -> Column:
                begin = F.greatest(a - j * _CUT, F.lit(0))
                return F.substr(F.get(blocks, j), begin + 1, F.least(b - j * _CUT, F.lit(_CUT)) - begin)

            whole = F.sequence(F.floor(a / _CUT).cast("int"), F.floor((b - 1) / _CUT).cast("int"))
            return F.when(a < b, F.array_join(F.transform(whole, part), "")).otherwise(F.lit(""))

        return F.array_join(F.transform(F.sequence(F.lit(0), size), piece), mark)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{_CUT}}})"), F.lit(1))
    bound = F.array(F.struct(blocks.alias("blocks"), spans.alias("cuts"), F.length(text).alias("n")))
    return F.get(F.transform(bound, hidden), F.lit(0))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]", **options) -> DataFrame:
    """``docs`` with every found span of a text replaced by ``mark``; overlapping spans are one.

    Rows and other columns stay as they are, null ids, repeated rows and clashing names
    included; so do texts without spans, null and empty ones.
    """
    found = scan(docs, id_col, text_col, **options).select("text_key", F.explode("spans").alias("p")).distinct()
    line = Window.partitionBy("text_key").orderBy("p.start", "p.end")
    covered = F.max("p.end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("p.start") >= covered, F.lit(True)).cast("int")
    found = found.withColumn("apart", apart).withColumn("no", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = found.groupBy("text_key", "no").agg(F.min("p.start").alias("start"), F.max("p.end").alias("end"))
    spans = merged.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    rows = docs.withColumn("__key", _text_key(id_col, text_col))
    text = F.col(f"`{text_col}`")
    out = rows.join(spans.withColumnRenamed("text_key", "__key").hint("merge"), "__key", "left")
    shown = F.when(F.col("__spans").isNull(), text).otherwise(_without(text, F.col("__spans"), mark))
    return out.withColumn(text_col, shown).select(*(F.col(f"`{c}`") for c in docs.columns))
