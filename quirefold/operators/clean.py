"""Cleaning operators on whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import rotated, text

#: Language codes taken as they are, and names and short forms of others.
CODES = (
    "AR BG CS DA DE EL EN-GB EN-US ES ES-419 ET FI FR HE HU ID IT JA KO LT LV NB NL PL PT-BR PT-PT RO RU SK SL SV TR UK VI "
    "ZH ZH-HANS ZH-HANT"
)
ALIASES = "EN=EN-US PT=PT-BR ENGLISH=EN-US JAPANESE=JA CHINESE=ZH KOREAN=KO JP=JA CN=ZH KR=KO"


def lang_map(kind: str) -> dict[str, str]:
    """Codes by upper-case input; source codes have no region, but for ES-419."""
    out = {c: c for c in CODES.split()} | dict(x.split("=") for x in ALIASES.split())
    if kind == "source":
        out = {k: v if v == "ES-419" else v.split("-")[0] for k, v in out.items()}
    return out


def resolve_lang(df: DataFrame, col: str, kind: str, out: str, allow_auto: bool = False) -> DataFrame:
    """``df`` with ``out`` and ``error``: null, ``missing``, ``auto`` or ``unsupported``.

    The map is a fixed table of under 50 rows and is broadcast.
    """
    table = df.sparkSession.createDataFrame(sorted(lang_map(kind).items()), "__key string, __code string")
    code = F.upper(F.col(col))
    found = df.drop(out, "error").join(F.broadcast(table), code == F.col("__key"), "left")
    auto = F.lower(F.col(col)) == "auto"
    value = F.when(auto & F.lit(allow_auto), F.lit("auto")).otherwise(F.col("__code"))
    error = (
        F.when(F.col(col).isNull() | (F.col(col) == ""), "missing")
        .when(auto, F.lit(None if allow_auto else "auto"))
        .when(F.col("__code").isNull(), "unsupported")
    )
    return found.withColumns({out: value, "error": error}).drop("__key", "__code")


def speaker_labels(df: DataFrame, roster: DataFrame, label: str, text_col: str = "text") -> DataFrame:
    """Leading ``[tag]:`` marks split off ``text_col``; ``tag``, ``body`` and the
    roster's ``label`` that is equal whatever the case, or null. The roster is a
    bounded table (50 rows a destination) and is broadcast."""
    split = df.withColumn("__s", text.split_speaker(F.col(text_col)))
    names = roster.select(F.col(label).alias("label")).where("label IS NOT NULL").dropDuplicates(["label"])
    out = split.join(F.broadcast(names), F.lower(F.col("__s.tag")) == F.lower("label"), "left")
    keep = [c for c in df.columns if c != text_col]
    return out.select(*keep, F.col("__s.tag").alias("tag"), "label", F.col("__s.body").alias("body"))


@dataclass
class EnumField:
    allowed: list[str]
    default: str

    def value(self, col: Column) -> Column:
        return text.enum_or(col, self.allowed)


@dataclass
class NumberField:
    low: float
    high: float
    default: float

    def value(self, col: Column) -> Column:
        x = col.try_cast("double")
        good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.when(good, text.num_or(col, self.low, self.high, self.default))


@dataclass
class BoolField:
    default: bool

    def value(self, col: Column) -> Column:
        return text.bool_or(col)


def reconcile(df: DataFrame, spec: dict[str, EnumField | NumberField | BoolField]) -> DataFrame:
    """``df`` brought to a schema of defaults.

    Valid fields stay, missing and invalid ones get their default, other columns pass.
    ``missing``, ``invalid`` and ``changed`` name the fields of each row: absent or
    null; present but unreadable; readable but altered by bounds or rounding.
    """
    new, states = {}, {"missing": [], "invalid": [], "changed": []}
    for name, field in spec.items():
        raw = F.col(name) if name in df.columns else F.lit(None).cast("string")
        value = field.value(raw)
        new[name] = F.coalesce(value, F.lit(field.default))
        states["missing"].append(F.when(raw.isNull(), F.lit(name)))
        states["invalid"].append(F.when(raw.isNotNull() & value.isNull(), F.lit(name)))
        altered = (value != raw.try_cast("double")) if isinstance(field, NumberField) else F.lit(False)
        states["changed"].append(F.when(raw.isNotNull() & value.isNotNull() & altered, F.lit(name)))
    return df.withColumns(new | {k: F.array_compact(F.array(*v)) for k, v in states.items()})


def report(reconciled: DataFrame) -> DataFrame:
    """How often each field had each status."""
    parts = F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("fields")) for s in ("missing", "invalid", "changed")))
    rows = reconciled.select(F.explode(parts).alias("p")).select("p.status", F.explode("p.fields").alias("field"))
    return rows.groupBy("status", "field").agg(F.count("*").alias("n"))


def accept_pieces(df: DataFrame, region: str, piece: str, area: str) -> DataFrame:
    """Pieces of a cut region worth keeping, largest first as ``rank``.

    A piece has max(24, 0.4 %) of the region's area or more, and less than all but
    that much or 99 %, whichever is greater; a region with fewer than two has none.
    """
    w = Window.partitionBy(region)
    least = F.greatest(F.lit(24.0), F.floor(0.004 * F.col("__all")).cast("double"))
    most = F.greatest(F.col("__all") - least, F.floor(0.99 * F.col("__all")).cast("double"))
    kept = df.withColumn("__all", F.sum(area).over(w)).where((F.col(area) >= least) & (F.col(area) < most))
    ranked = kept.withColumns(
        {"__n": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc(area), piece))}
    )
    return ranked.where("__n >= 2").select(region, piece, area, "rank")


def boxes_from_contours(
    contours: DataFrame, page: str, contour: str, points: str, score: str, ratio: float = 1.5, width: Column | int | None = None,
    height: Column | int | None = None, scale_x: Column | float = 1.0, scale_y: Column | float = 1.0, most: int = 1000, least: float = 3.0, good: float = 0.6,
) -> DataFrame:
    """G7 from the contour: ``page, contour, score, short, grow, box`` of candidates that are boxes.

    Of a page's first ``most`` contours those whose least rectangle has a short side of ``least``
    or more and whose score is ``good`` or more are kept. Each side moves out by area x ``ratio`` /
    perimeter; the short side must be ``least`` + 2 then. Corners (upper left first, clockwise) are
    scaled, rounded half to even and clipped to the page. Contours without area are no candidates
    but count among the first.
    """
    side = lambda v: F.lit(v) if not isinstance(v, Column) else v
    nth = F.row_number().over(Window.partitionBy(page).orderBy(contour))
    rows = contours.withColumn("__nth", nth).where((F.col("__nth") <= most) & (F.col(score) >= good))
    # dealt to all tasks, and through explode, behind which no filter is moved: a rectangle is worked out once a contour
    rows = rows.repartition(int(contours.sparkSession.conf.get("spark.sql.shuffle.partitions")), page, contour)
    rows = rows.withColumn("__r", F.explode(F.array(rotated.least_rectangle(F.col(points))))).where(F.col("__r")["short"] >= least)
    r = F.col("__r")
    rows = rows.withColumn("grow", r["short"] * r["long"] * ratio / (2 * (r["short"] + r["long"])))
    rows = rows.withColumn("short", r["short"] + 2 * F.col("grow")).where(F.round(F.col("short"), 9) >= least + 2)

    def placed(v: Column, scale, limit) -> Column:
        whole = F.greatest(F.lit(0), F.bround(F.round(v * side(scale), 9), 0).cast("int"))
        return whole if limit is None else F.least(whole, side(limit).cast("int"))

    box = F.transform(rotated.grown_corners(r, F.col("grow")), lambda p: F.struct(placed(p["x"], scale_x, width).alias("x"), placed(p["y"], scale_y, height).alias("y")))
    return rows.select(page, contour, score, "short", "grow", box.alias("box"))


def filter_candidates(df: DataFrame, page: str, box: str, grow: float, width: int, height: int, score: str = "score") -> DataFrame:
    """Of the first 1000 candidates of a page those with a short side of 3 or more, a
    score of 0.6 or more, and a short side of 5 or more when grown; corners rounded
    half to even and clipped to the page."""
    nth = F.row_number().over(Window.partitionBy(page).orderBy(box))
    short = F.least("w", "h")
    kept = df.withColumn("__nth", nth).where(
        (F.col("__nth") <= 1000) & (short >= 3) & (F.col(score) >= 0.6) & (short + 2 * grow >= 5)
    )

    def corner(c: Column, limit: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.bround(c, 0), F.lit(limit))).cast("int")

    return kept.withColumns(
        {
            "x1": corner(F.col("x") - grow, width),
            "y1": corner(F.col("y") - grow, height),
            "x2": corner(F.col("x") + F.col("w") + grow, width),
            "y2": corner(F.col("y") + F.col("h") + grow, height),
        }
    ).drop("__nth")
