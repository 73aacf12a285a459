"""Source files of projects as rows, read by Spark's whole-text source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specdrift.functions.text import glob_pattern

#: What is source, and what never is.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
SKIPPED = ("node_modules", "dist", "build")
DECLARATIONS = ("d.ts", "d.mts", "d.cts")


def scan(
    spark: SparkSession, projects: dict[str, str], include: list[str] | None = None, exclude: list[str] | None = None, out_dir: str | None = None,
    extensions: tuple[str, ...] = EXTENSIONS,
) -> DataFrame:
    """(project, path, text, bytes): the source files under each project's root; ``path`` is relative to the root.

    The listing asks for the extensions only; build folders, ``out_dir`` and declaration files are left out, and of the rest
    ``include`` (all without it) and ``exclude`` decide, path globs relative to the root. Filters are on the
    file's name, so no file left out is read. A file is one row, whatever its size. A root that
    lies in another one is scanned twice: ``ownership_conflicts`` finds such files. A project without a file has no rows.
    """
    names = "*.{" + ",".join(extensions) + "}"

    def of(project: str, root: str) -> DataFrame:
        files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names)
        path = relative(F.col("_metadata.file_path"), root)
        kept = files.filter(is_source(path, include, exclude, out_dir))
        return kept.select(F.lit(project).alias("project"), path.alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes"))

    return reduce(DataFrame.union, [of(p, r) for p, r in sorted(projects.items())])


def relative(path: Column, root: str) -> Column:
    """A file's path, as its URL says it, from a root on; the whole path if it is not under the root."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    base = root.split(":", 1)[-1].strip("/")
    at = F.instr(plain, f"/{base}/") if base else F.lit(1)
    return F.when(at > 0, F.substring(plain, at + len(base) + 2 if base else F.lit(1), F.length(plain))).otherwise(plain)


def is_source(path: Column, include: list[str] | None = None, exclude: list[str] | None = None, out_dir: str | None = None) -> Column:
    """Whether a path relative to its project is one of its sources."""
    inside = ~F.startswith(path, F.lit("..")) & ~F.startswith(path, F.lit("/"))
    ok = inside & ~F.arrays_overlap(F.split(path, r"[\\/]"), F.array(*[F.lit(s) for s in SKIPPED]))
    ok = ok & ~path.rlike(r"(?i)\.(" + "|".join(d.replace(".", r"\.") for d in DECLARATIONS) + ")$")
    if out_dir:
        ok = ok & (path != out_dir.strip("/")) & ~F.startswith(path, F.lit(out_dir.strip("/") + "/"))
    if include is not None:
        ok = ok & reduce(Column.__or__, [path.rlike(glob_pattern(g)) for g in include], F.lit(False))
    for g in exclude or []:
        ok = ok & ~path.rlike(glob_pattern(g))
    return ok
