"""File catalog: scan, code resolution, labelled inventory, sorting plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, fixed
from ..functions.text import col
from ..operators.ranking import global_rank


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths under ``root``; only file metadata is read, never the content."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(F.col("path").alias("file_path"), "length", "modificationTime")
    )
    base = root.rstrip("/") + "/"
    cut = F.locate(base, F.col("file_path")) + len(base)
    return found.withColumn(
        "relative_path", F.substr(F.col("file_path"), cut)
    )


def keep_material(name) -> Column:
    """False for system, hidden, temporary, checklist and readme files."""
    name = col(name)
    return ~(name.rlike(fixed.SKIP_NAME) | name.rlike(fixed.SKIP_CHECKLIST)
             | (name == fixed.SKIP_README))


def extension(name) -> Column:
    """Lower-case extension with its dot; empty for none."""
    return F.lower(F.regexp_extract(col(name), r"^.+(\.[^./]*)$", 1))


def reader_for(ext) -> Column:
    """Reader of an extension, NULL for files no reader takes."""
    flat = [F.lit(x) for pair in fixed.READERS for x in pair]
    return F.try_element_at(F.create_map(*flat), F.lower(col(ext)))


def resolve_codes(paths: DataFrame, known: DataFrame, path: str = "relative_path") -> DataFrame:
    """Best code of every path and the segment it stands in.

    Codes listed in ``known(code)`` win, then the deepest segment, then the
    last code inside that segment. One partial aggregation per path, so the
    shuffle carries one row per path and map task.
    """
    parts = F.split(F.col(path), "/")
    segments = paths.select(path, F.posexplode(parts).alias("depth", "part"))
    found = segments.select(
        path, "depth", "part", F.posexplode(codes.all_codes("part")).alias("pos", "code")
    )
    marked = found.join(known.select("code").distinct().withColumn("listed", F.lit(1)), "code", "left")
    best = marked.groupBy(path).agg(F.max_by(
        F.struct("code", "part", "depth", F.col("listed").isNotNull().alias("known")),
        F.struct(F.coalesce("listed", F.lit(0)), F.col("depth"), F.col("pos")),
    ).alias("best"))
    return paths.join(best, path, "left")


def catalog(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Kept files with name, best code, extension and reader."""
    named = paths.withColumn("file_name", F.element_at(F.split("relative_path", "/"), -1))
    kept = named.filter(keep_material("file_name"))
    return resolve_codes(kept, known).select(
        "file_path", "relative_path", "file_name",
        F.col("best.code").alias("folder_code"),
        extension("file_name").alias("extension"),
        reader_for(extension("file_name")).alias("reader"),
    )


def reader_counts(files: DataFrame) -> DataFrame:
    """Files per reader, and how many no reader takes."""
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("reader").isNotNull()).alias("readable"),
        F.count_if(F.col("reader").isNull()).alias("skipped"),
    )


def inventory(paths: DataFrame, indicators: DataFrame) -> DataFrame:
    """Labelled list of files: topic, indicator, shown folder, tagged name.

    Running numbers follow the path order and are computed without pulling the
    list into one task.
    """
    named = paths.withColumn("file_name", F.element_at(F.split("relative_path", "/"), -1))
    kept = named.filter(~F.col("file_name").rlike(r"^[.~]"))
    coded = resolve_codes(kept, indicators)
    parts = F.split("relative_path", "/")
    shown = coded.withColumn("folder", codes.display_folder(parts, F.col("best"))).select(
        F.col("best.code").alias("code"), "folder", "file_name", "relative_path",
        F.concat(F.lit("["), F.coalesce(F.col("best.code"), F.col("folder")), F.lit("] "),
                 F.col("file_name")).alias("tagged_name"),
    )
    named_topics = indicators.select("code", "topic", "indicator")
    joined = shown.join(named_topics, "code", "left")
    return global_rank(joined, [], [F.col("relative_path")], "number")


def plan_targets(path: str = "relative_path") -> Column:
    """Codes an unsorted file belongs to (empty: none found).

    Folders that are exactly a code win, outermost first; else up to three
    codes in folder names from the inside out; else up to three codes of the
    file name.
    """
    parts = F.split(F.col(path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    pure = F.transform(F.filter(folders, codes.is_pure_code), lambda p: F.upper(F.trim(p)))
    inner_first = F.reverse(F.filter(folders, lambda p: ~codes.is_pure_code(p)))
    loose = F.array_distinct(F.flatten(F.transform(inner_first, lambda p: codes.all_codes(p))))
    return (
        F.when(F.size(pure) > 0, F.slice(pure, 1, 1))
        .when(F.size(loose) > 0, F.slice(loose, 1, 3))
        .otherwise(F.slice(codes.codes_in_file_name(F.element_at(parts, -1)), 1, 3))
    )


def sorting_plan(paths: DataFrame) -> DataFrame:
    """Where every file would be sorted to; later files of one name are duplicates."""
    named = paths.select(
        "relative_path", F.element_at(F.split("relative_path", "/"), -1).alias("file_name"),
        plan_targets().alias("codes"),
    )
    kept = named.filter(keep_material("file_name"))
    planned = kept.select(
        "relative_path", "file_name", F.explode_outer("codes").alias("code")
    ).withColumn("target", F.when(F.col("code").isNotNull(), codes.target_folder("code")))
    # the fallback folder may hold most files: ranks come from range partitions
    placed = global_rank(planned, ["target", "file_name"], [F.col("relative_path")], "place")
    return placed.withColumn("duplicate", F.col("place") > 1).drop("place")


def plan_counts(plan: DataFrame, limit: int = 20) -> DataFrame:
    """Files per code, first codes in order."""
    return (
        plan.filter(F.col("code").isNotNull() & ~F.col("duplicate"))
        .groupBy("code").agg(F.count("*").alias("files")).orderBy("code").limit(limit)
    )


def plan_unidentified(plan: DataFrame, limit: int = 30) -> DataFrame:
    return plan.filter(F.col("code").isNull()).select("relative_path").orderBy("relative_path").limit(limit)


def extension_histogram(files: DataFrame, keep: int = 6) -> DataFrame:
    """Most frequent extensions, all further ones together as ``other``."""
    shown = F.when(F.col("extension") == "", "none").otherwise(
        F.upper(F.regexp_replace("extension", r"^\.+", "")))
    counts = files.groupBy(shown.alias("extension")).agg(F.count("*").alias("files"))
    top = counts.orderBy(F.desc("files"), "extension").limit(keep).select(
        "extension", F.lit(True).alias("shown"))
    name = F.when(F.col("shown"), F.col("extension")).otherwise("other")
    return counts.join(top, "extension", "left").groupBy(name.alias("extension")).agg(
        F.sum("files").alias("files"))
