"""Module specifiers of import statements: relative paths, aliases and a base folder, looked up among known files and modules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.files import SUFFIXES

_SUFFIX = "(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$"


def path_parts(path: Column) -> Column:
    """Parts of a path without empty ones, `.` and each `..` with the part before it; a path that leaves its root starts with `..`."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def module_name(parts: Column) -> Column:
    """The module of path parts: without a source suffix and a leading src, joined with dots; null if nothing is left."""
    bare = F.regexp_replace(F.array_join(parts, "/"), _SUFFIX, "")
    return F.nullif(F.replace(F.regexp_replace(bare, "^src(/|$)", ""), F.lit("/"), F.lit(".")), F.lit(""))


def relative_modules(specs: DataFrame, files: DataFrame) -> DataFrame:
    """path, spec, module of specs(path, spec) that start with a dot; null if they leave the root or name the root itself.

    Without a suffix of its own a specifier means the first file that is there of, for each suffix in order, the path with the
    suffix and the folder's index file; all candidates meet files(path) in one join. If none is there, the path as written.
    """
    at = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    s = specs.select("path", "spec").distinct().where(F.col("spec").startswith(".")).withColumn("parts", path_parts(F.concat_ws("/", at, "spec")))
    s = s.withColumn("parts", F.when((F.size("parts") > 0) & (F.get("parts", F.lit(0)) != ".."), F.col("parts")))
    joined = F.array_join("parts", "/")
    tries = [t for x in SUFFIXES for t in (F.concat(joined, F.lit(x)), F.concat(joined, F.lit("/index" + x)))]
    probes = s.where(~joined.rlike(_SUFFIX)).select("path", "spec", F.posexplode(F.array(*tries)).alias("order", "file"))
    there = probes.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    first = there.groupBy("path", "spec").agg(F.min_by("file", "order").alias("file"))
    return s.join(first, ["path", "spec"], "left").select("path", "spec", F.coalesce(module_name(F.split("file", "/")), module_name(F.col("parts"))).alias("module"))


def canonical_modules(specs: DataFrame, modules: DataFrame, aliases: dict[str, str] | None = None, base: str = "") -> DataFrame:
    """spec, module of specs(spec): the known module that a specifier means, or the specifier itself.

    The first alias whose prefix it has puts its folder in the prefix's place. Without one, a specifier that neither is
    known nor starts with a dot or slash is looked for below the base folder.
    """
    known = modules.select(F.col("module").alias("found")).distinct()
    s = specs.select("spec").distinct().join(known.withColumn("as_is", F.lit(True)), F.col("spec") == F.col("found"), "left").drop("found")
    to = F.lit(None).cast("string")
    if base:
        free = ~F.col("spec").rlike(r"^[./]") & F.col("as_is").isNull()
        to = F.when(free, F.concat(F.lit(base.rstrip("/") + "/"), "spec"))
    for prefix, folder in reversed((aliases or {}).items()):
        to = F.when(F.col("spec").startswith(prefix), F.concat(F.lit(folder.rstrip("/") + "/"), F.expr(f"substr(spec, {len(prefix) + 1})"))).otherwise(to)
    wanted = s.withColumn("found", module_name(F.filter(F.split(to, "/"), lambda x: ~x.isin("", "."))))
    hit = wanted.join(known.withColumn("hit", F.lit(True)), "found", "left")
    return hit.select("spec", F.when(F.col("hit"), F.col("found")).otherwise(F.col("spec")).alias("module"))
