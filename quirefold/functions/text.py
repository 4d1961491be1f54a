"""Column functions: cleaning, guards and tolerant coercion of text and scalar fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompt markers removed from names, one after the other.
CONTROL_MARKERS = [
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|im_start|>",
    "<|im_end|>", "<|endoftext|>", "<start_of_turn>", "<end_of_turn>", "<|turn>", "<turn|>", "<think>", "</think>",
    "<<START>>", "<<JAPANESE>>", "<<ENGLISH>>",
]
#: Words for true and false.
TRUE_WORDS = ["true", "1", "y", "yes", "on"]
FALSE_WORDS = ["false", "0", "n", "no", "off"]
#: Quotes that wrap a reply, and quotes a source may have.
QUOTE_PAIRS = [('"', '"'), ("“", "”"), ("„", "“"), ("‟", "”"), ("＂", "＂")]
SOURCE_QUOTES = "\"'“”„‟‘’‚‛«»‹›「」『』〝〞〟＂＇"
#: White space as Unicode has it.
BLANK = r"(?U)\s+"


def collapse(col: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col, BLANK, " "))


def clean_name(col: Column, limit: int = 100) -> Column:
    """A name without control markers, white space collapsed, cut to ``limit``
    characters and right-trimmed; blank is null."""
    for marker in CONTROL_MARKERS:
        col = F.replace(col, F.lit(marker), F.lit(""))
    return F.nullif(F.rtrim(F.substring(collapse(col), 1, limit)), F.lit(""))


def enum_or(col: Column, allowed: Iterable[str], default: str | None = None) -> Column:
    """The value, lower-cased and trimmed, if it is allowed, else ``default``."""
    low = F.lower(F.trim(col.cast("string")))
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default).cast("string"))


def num_or(col: Column, low: float, high: float, default: float, rounding: str = "even") -> Column:
    """A number within bounds; what is no finite number becomes ``default``.

    ``rounding`` is ``even`` (ties to even), ``up`` (floor of x + 0.5) or ``none``.
    """
    x = col.try_cast("double")
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float(default))).otherwise(x)
    if rounding == "even":
        x = F.bround(x, 0)
    elif rounding == "up":
        x = F.floor(x + 0.5).cast("double")
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def bool_or(col: Column, default: bool | None = None) -> Column:
    """C4: true and false words; anything else is ``default``."""
    low = F.lower(F.trim(col.cast("string")))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).otherwise(F.lit(default).cast("boolean"))


def redact(col: Column) -> Column:
    """Without URL queries and fragments, URL user info, ``key: value`` secrets
    and bearer tokens, in this order; line ends are written out."""
    #: What is taken out.
    col = F.regexp_replace(col, r"(?i)(https?://[^\s?#]+)[?#][^\s]*", "$1?[redacted]")
    col = F.regexp_replace(col, r"(?i)(https?://)[^\s/@]+:[^\s/@]+@", "$1[redacted]@")
    col = F.regexp_replace(
        col,
        r"""(?i)\b(authorization|api[ _-]?key|access[ _-]?token|token|password|secret)([\s"']*[:=][\s"']*)(?:bearer\s+)?[^\s,;"'<>]+""",
        "$1$2[redacted]",
    )
    col = F.regexp_replace(col, r"(?i)\bbearer\s+[a-z0-9._~+/=-]+", "Bearer [redacted]")
    return F.replace(F.replace(col, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def clean_reply(text: Column, source: Column) -> Column:
    """A reply without a code fence around it, leading think blocks, a stray closing
    mark, and one wrapping quote pair where the source has no quotes and the pair is
    not inside. An unclosed think block is null (an error row)."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_extract(t, r"(?s)^```[^\n`]*\n(.*?)\n?```$", 1)
    t = F.when(t.rlike(r"(?s)^```[^\n`]*\n.*?\n?```$") & ~F.substring(t, 4, 1 << 30).contains("```\n"), F.trim(fenced)).otherwise(t)
    t = F.regexp_replace(t, r"(?s)^(?:<think>.*?</think>\s*)+", "")
    t = F.regexp_replace(t, r"^</think>\s*", "")
    broken = t.startswith("<think>")
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    opening, closing = F.substring(t, 1, 1), F.substring(t, -1, 1)
    wrapped = F.lit(False)
    for a, b in QUOTE_PAIRS:
        wrapped = wrapped | ((opening == a) & (closing == b) & ~inner.contains(a) & ~inner.contains(b))
    plain_source = source.isNotNull() & ~source.rlike(f"[{SOURCE_QUOTES}]")
    t = F.when(plain_source & (F.length(t) >= 2) & wrapped, F.trim(inner)).otherwise(t)
    return F.when(~broken, t)


def split_speaker(text: Column) -> Column:
    """struct(tag, body): up to four leading ``[tag]:`` taken off, the last one kept."""
    lead = F.regexp_extract(text, r"^((?:\s*\[[^\[\]\n]{1,64}\]\s*[:：]\s*){1,4})", 1)
    tag = F.regexp_extract(lead, r"\[([^\[\]\n]{1,64})\]\s*[:：]\s*$", 1)
    return F.struct(
        F.nullif(F.trim(tag), F.lit("")).alias("tag"), F.substring(text, F.length(lead) + 1, F.length(text)).alias("body")
    )


def normalise_ocr(col: Column) -> Column:
    """Full-width exclamation marks as plain ones."""
    return F.translate(col, "！", "!")


def apply_placeholders(template: Column, text: Column, source: Column, target: Column) -> Column:
    """C11: ``<TEXT>``, ``<SOURCE_LANG>``, ``<TARGET_LANG>`` replaced one after the other,
    each over the previous result; a null value is empty."""
    for mark, value in (("<TEXT>", text), ("<SOURCE_LANG>", source), ("<TARGET_LANG>", target)):
        template = F.replace(template, F.lit(mark), F.coalesce(value, F.lit("")))
    return template


def version_key(col: Column) -> Column:
    """Struct that orders versions: three numbers, then whether it is final.

    A suffix that begins with + is no pre-release; text that is no version is null.
    """
    pattern = r"^([0-9]+)\.([0-9]+)\.([0-9]+)(.*)$"
    rest = F.regexp_extract(col, pattern, 4)
    key = F.struct(
        *(F.regexp_extract(col, pattern, i).try_cast("long").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))),
        ((rest == "") | rest.startswith("+")).alias("final"),
    )
    return F.when(col.rlike(pattern), key)


def safe_name(col: Column) -> Column:
    """C14: whether a page name has no separator and is not empty, ``.`` or ``..``."""
    return col.isNotNull() & ~col.isin("", ".", "..") & ~col.rlike(r"[/\\\x00]")


def natural_key(col: Column, width: int = 20) -> Column:
    """Key that sorts ``p2`` before ``p10``, whatever the case: digit runs padded."""
    low = F.lower(col)
    parts = F.regexp_extract_all(low, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), ""
    )
