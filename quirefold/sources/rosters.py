"""Sources and sinks: page folders, roster CSV and documents, checksum manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions.headers import image_size
from quirefold.functions.text import clean_name, enum_or, natural_key

FIELDS = ["name_en", "name_ja", "gender", "alias_en", "alias_ja"]
GENDERS = ["male", "female"]
EXTENSIONS = r"(?i)\.(png|jpe?g|webp|bmp|gif|avif)$"


def catalogue(files: DataFrame) -> DataFrame:
    """``folder, name, seq, width, height`` of image files (path, width, height).

    Extensions count whatever their case, dot files do not; order is natural (p2 before
    p10) within a folder; a size that could not be read (-1) is 0.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), "width", "height")
    rows = rows.where(F.col("name").rlike(EXTENSIONS) & ~F.col("name").startswith("."))
    size = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("int").alias(c)
    seq = F.row_number().over(Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "name"))
    return rows.select("folder", "name", seq.alias("seq"), size("width"), size("height"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a folder with the sizes that their headers give, all seven types; nothing is decoded.

    Spark's readers pass over files without any bytes, so those are not listed."""
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(EXTENSIONS))
    sized = files.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), image_size(F.col("content")).alias("s"))
    return catalogue(sized.select("path", "s.width", "s.height"))


def saved_pages(pages: DataFrame, saved: DataFrame, same_folder: bool = False) -> DataFrame:
    """Pages that the destination has by name; none if it is the folder itself."""
    if same_folder:
        return pages.limit(0)
    return pages.join(saved.select("name").distinct().hint("merge"), "name", "left_semi")


def _cleaned(df: DataFrame) -> DataFrame:
    new = {f: clean_name(F.col(f)) for f in FIELDS if f != "gender"}
    return df.withColumns(new | {"gender": enum_or(F.col("gender"), GENDERS)})


def read_roster_csv(spark: SparkSession, path: str, dest: str | None = None, most: int = 50) -> DataFrame:
    """S3: rosters from CSV: ``dest, ord, meta_id`` and fields.

    ``path`` is the file of destination ``dest`` or, without one, a folder of ``dest=<name>``
    folders with a file each and one header for all. Header names count trimmed and
    whatever their case, without a byte order mark; other columns are ignored, missing ones
    null, blank rows skipped, the first ``most`` of a destination kept. Ids come from a hash of
    destination, place and row, so that a reread gives the same. A file is small and read
    by one task, in its order.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    by_name = {c.replace("\ufeff", "").strip().lower(): c for c in reversed(raw.columns)}
    cols = [(F.col(f"`{by_name[f]}`") if f in by_name else F.lit(None).cast("string")).alias(f) for f in FIELDS]
    given = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), "/dest=([^/]*)/", 1)) if dest is None else F.lit(dest)
    rows = _cleaned(raw.select(given.alias("dest"), *cols)).where(F.coalesce(*FIELDS).isNotNull()).withColumn("__at", F.monotonically_increasing_id())
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("dest").orderBy("__at"))).where(F.col("ord") <= most)
    meta = F.substring(F.sha2(F.to_json(F.struct("dest", "ord", *FIELDS)), 256), 1, 8)
    return rows.select("dest", "ord", meta.alias("meta_id"), *FIELDS)


def roster_rows(roster: DataFrame) -> DataFrame:
    """The five fields in roster order, nulls as empty."""
    return roster.orderBy("ord").select(*(F.coalesce(c, F.lit("")).alias(c) for c in FIELDS))


def write_roster_csv(roster: DataFrame, path: str) -> None:
    """One CSV file with a header."""
    roster_rows(roster).coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def roster_documents(docs: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows of good documents, rejected ``path``) from ``path, raw`` JSON texts.

    A document must be ``{"version": 1, "characters": [...]}`` with exactly these keys, at
    most ``most`` rows of exactly the known keys, ids unique, trimmed, not blank and of 128
    characters at most, every field clean already; one bad row rejects all. Repeated JSON
    keys make a document unreadable.
    """
    v = F.try_parse_json("raw")
    keys = lambda x: F.array_sort(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")))
    rows = F.try_variant_get("v", "$.characters", "array<variant>")
    doc = docs.select("path", v.alias("v")).withColumn("rows", rows)
    version = F.schema_of_variant(F.try_variant_get("v", "$.version", "variant"))
    ok_doc = (
        F.col("v").isNotNull()
        & (keys(F.col("v")) == F.array(F.lit("characters"), F.lit("version")))
        & (version == "BIGINT")
        & (F.try_variant_get("v", "$.version", "long") == 1)
        & F.col("rows").isNotNull()
        & (F.size("rows") <= most)
    )
    doc = doc.withColumn("ok", F.coalesce(ok_doc, F.lit(False)))
    each = doc.where("ok").select("path", F.posexplode("rows").alias("i", "r"))
    text = lambda f: F.try_variant_get("r", f"$.{f}", "string")
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("r", f"$.{f}", "variant")), F.lit("VOID"))
    each = each.withColumns({f: text(f) for f in ["meta_id", *FIELDS]}).withColumn("__keys", keys(F.col("r")))
    good = F.col("__keys") == F.array(*(F.lit(k) for k in sorted(["meta_id", *FIELDS])))
    good = good & (kind("meta_id") == "STRING") & (F.trim("meta_id") == F.col("meta_id")) & F.length("meta_id").between(1, 128)
    for f in FIELDS:
        clean = enum_or(F.col(f), GENDERS) if f == "gender" else clean_name(F.col(f))
        good = good & kind(f).isin("STRING", "VOID") & F.col(f).eqNullSafe(clean)
    good = good & F.coalesce(*FIELDS).isNotNull()
    each = each.withColumn("__good", F.coalesce(good, F.lit(False)))
    verdict = each.groupBy("path").agg(
        (F.bool_and("__good") & (F.count_distinct("meta_id") == F.count("*"))).alias("__all")
    )
    bad = doc.join(verdict.hint("merge"), "path", "left").where(~F.col("ok") | ~F.coalesce("__all", F.lit(True))).select("path")
    fine = each.join(bad.hint("merge"), "path", "left_anti")
    return fine.select("path", (F.col("i") + 1).alias("ord"), "meta_id", *FIELDS), bad


def read_roster_docs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder, one a file."""
    files = spark.read.text(path, wholetext=True)
    return roster_documents(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))


def save_roster(roster: DataFrame, path: str) -> None:
    """Replaces the rosters of the destinations in ``roster``; others stay."""
    roster.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dest").parquet(path)


def parse_checksums(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(``name, sha256``, problems ``line, reason``) of ``digest  name`` or
    ``SHA256 (name) = digest`` lines. Blank lines are skipped, others are errors, and so
    is a name that comes twice."""
    c: Column = F.trim(F.col(line))
    first, second = r"^([0-9a-fA-F]{64}) [ *](\S.*)$", r"^SHA256 \((.+)\) = ([0-9a-fA-F]{64})$"
    name = F.coalesce(F.nullif(F.regexp_extract(c, first, 2), F.lit("")), F.nullif(F.regexp_extract(c, second, 1), F.lit("")))
    digest = F.coalesce(F.nullif(F.regexp_extract(c, first, 1), F.lit("")), F.nullif(F.regexp_extract(c, second, 2), F.lit("")))
    rows = lines.where(c != "").select(c.alias("line"), name.alias("name"), F.lower(digest).alias("sha256"))
    n = F.count("*").over(Window.partitionBy("name"))
    rows = rows.withColumn("reason", F.when(F.col("name").isNull(), "unreadable").when(n > 1, "duplicate"))
    return rows.where("reason IS NULL").select("name", "sha256"), rows.where("reason IS NOT NULL").select("line", "reason")


def read_checksums(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_checksums(spark.read.text(path))
