"""Folders of described packs: front matter of their files, the best of several paths, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders by preference, the part of a path that marks packs, and the file that describes one.
PREFERRED = ("tasks/", "tasks-no-skills/", "tasks_no_skills_generate/")
TREE, FILE = "/environment/skills/", "SKILL.md"


def front_matter(text: Column) -> Column:
    """A map of the ``key: value`` lines between a leading pair of ``---``; the last of equal keys counts."""
    block = F.regexp_extract(text, r"^\s*---\n(?s)(.*?)\n---(?:\n|$)", 1)
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.contains(":") & ~x.startswith("#"))
    strip = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"+|"+$', ""), "^'+|'+$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """(name, description, directory, path) of each ``folder/*/SKILL.md``; a pack without a name has its folder's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILE).load(f"{folder}/*")
    m = files.select("path", front_matter(F.decode("content", "UTF-8")).alias("m"))
    directory = F.regexp_replace("path", "/[^/]+$", "")
    name = F.coalesce(F.nullif(F.trim(F.try_element_at("m", F.lit("name"))), F.lit("")), F.substring_index(directory, "/", -1))
    return m.select(name.alias("name"), F.trim(F.coalesce(F.try_element_at("m", F.lit("description")), F.lit(""))).alias("description"), directory.alias("directory"), "path")


def best_paths(listing: DataFrame) -> DataFrame:
    """(name, path): for each pack of a listing of file paths, the folder in the most preferred tree, then the shallowest, shortest, first."""
    folder = F.regexp_replace("path", f"/{FILE}$", "")
    packs = listing.where(F.col("path").endswith("/" + FILE) & F.col("path").contains(TREE)).select(folder.alias("path"))
    rank = F.lit(len(PREFERRED))
    for i, p in reversed(list(enumerate(PREFERRED))):
        rank = F.when(F.col("path").startswith(p), i).otherwise(rank)
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    order = F.struct(rank, depth, F.length("path"), F.col("path"))
    name = F.trim(F.substring_index("path", "/", -1))
    return packs.withColumn("name", name).where("name <> ''").groupBy("name").agg(F.min_by("path", order).alias("path"))


def missing(asked: DataFrame, available: DataFrame) -> DataFrame:
    """The names asked for that aren't available, each once."""
    return asked.select("name").distinct().join(available, "name", "left_anti")
