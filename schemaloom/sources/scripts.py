"""Migration scripts from folders of SQL files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.functions.numbers import glob_pattern

# Folders that are never searched.
SKIPPED = ("node_modules", ".git", "dist", "build", ".next", ".turbo")


def read_scripts(spark: SparkSession, path: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(file, text) of every .sql file below ``path``, less the skipped folders and the ignore globs."""
    rows = (
        spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    )
    rows = rows.filter(~F.col("file").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    for glob in ignore:
        rows = rows.filter(~F.col("file").rlike(glob_pattern(glob)))
    return rows


def migration_names(scripts: DataFrame) -> DataFrame:
    """Adds ``name``: the folder of a ``migration.sql``, else the file's name without its ending; and the layout."""
    folder, base = F.regexp_extract("file", "([^/]+)/migration[.]sql$", 1), F.regexp_extract("file", "([^/]+)[.]sql$", 1)
    return scripts.withColumn("name", F.when(folder != "", folder).otherwise(base)).withColumn("layout", F.when(folder != "", "folders").otherwise("flat"))


# Where tools keep migrations, the first that has any counts; and the tool's name.
LAYOUTS = (
    (r"^prisma/migrations/[^/]+/migration[.]sql$", "prisma"), (r"^drizzle/[^/]+[.]sql$", "drizzle"), (r"^migrations/[^/]+/migration[.]sql$", "prisma"), (r"^migrations/[^/]+[.]sql$", "generic"),
)
#: The same within a folder that is named: a folder for each migration, else its files, else all files below.
WITHIN = ((r"^[^/]+/migration[.]sql$", "prisma"), (r"^[^/]+[.]sql$", "drizzle"), (r"[.]sql$", "generic"))


def discovered(scripts: DataFrame, root: str, named: bool = False) -> DataFrame:
    """The scripts (file, ...) of a project at ``root`` that are its migrations, with ``name``, ``project_type`` and ``n``, their number in order of
    name: those of the first layout that has any; ``named`` if ``root`` is the migrations' own folder. A root that is a file is the one migration."""
    below = F.regexp_replace(F.substring_index("file", root.rstrip("/"), -1), "^/+", "")
    rows = scripts.filter(F.contains("file", F.lit(root.rstrip("/")))).withColumn("__path", below)
    rank, kind = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (pattern, tool) in reversed(list(enumerate(WITHIN if named else LAYOUTS))):
        rank, kind = F.when(F.col("__path").rlike(pattern), i).otherwise(rank), F.when(F.col("__path").rlike(pattern), tool).otherwise(kind)
    if root.endswith(".sql"):
        rank, kind = F.lit(0), F.lit("generic")
    ranked = migration_names(rows.withColumns({"__rank": rank, "project_type": kind}).filter("__rank IS NOT NULL")).drop("layout")
    if root.endswith(".sql"):
        return ranked.withColumn("n", F.lit(1)).drop("__path", "__rank")
    first = ranked.agg(F.min("__rank").alias("__first"))
    own = ranked.join(F.broadcast(first), ranked["__rank"] == first["__first"]).withColumn("name", F.when(F.col("__path").rlike("/migration[.]sql$"), F.col("name")).otherwise(F.regexp_extract("__path", "([^/]+)$", 1)))
    return own.withColumn("n", F.row_number().over(Window.orderBy("name", "file"))).drop("__path", "__rank", "__first")  # a project's migrations


def only_changed(scripts: DataFrame, changed: DataFrame) -> DataFrame:
    """Scripts whose file is among ``changed`` (file)."""
    return scripts.join(changed.select("file").distinct(), "file", "left_semi")


def write_scripts(rows: DataFrame, path: str, phase: str | None = None) -> None:
    """Writes (file, text) as text files, each with a line end behind it, a folder for each script and, within it, for each phase if a column is named."""
    keys = ["file", *([phase] if phase else [])]
    rows.select(*keys, "text").write.partitionBy(*keys).text(path)
