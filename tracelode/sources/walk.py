"""Walking folders: which files are read, and why the others are not.

The listing itself is made by the cluster (binaryFile with path alone is pruned to the listing); verdicts are columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.index import ancestors
from tracelode.sources.rules import Rule, decide, denied

# Folders that tools make, and files that mark the folder they lie in as made by a tool.
TOOL_FOLDERS = {".git", ".hg", ".svn", ".bzr", "node_modules", "__pycache__", ".venv", "venv", "site-packages", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".ipynb_checkpoints", "conda-meta"}
TOOL_MARKERS = {"pyvenv.cfg", "CACHEDIR.TAG"}
SIDE_BY_SIDE = 500


def verdicts(paths: DataFrame, rules: list[Rule] = (), most: int = SIDE_BY_SIDE) -> DataFrame:
    """(path, reason): null where a file is read, else the first reason that keeps it out: protected, tool, hidden,
    excluded by a rule, or one of more than `most` files side by side in a folder that no rule includes."""
    parts = F.split("path", "/")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.element_at(parts, -1)
    rows = paths.select("path", folder.alias("folder"), name.alias("name")).distinct()
    marked = rows.where(F.col("name").isin(*sorted(TOOL_MARKERS))).select(F.col("folder").alias("ancestor")).distinct()
    below = ancestors(rows.select("path")).join(marked, "ancestor").select("path", F.lit(True).alias("marked")).distinct()
    crowd = rows.groupBy("folder").agg(F.count("*").alias("crowd"))
    named = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*sorted(TOOL_FOLDERS)))
    hidden = F.exists(parts, lambda p: p.startswith(".") & (F.length(p) > 1))
    ruled = decide(F.col("path"), list(rules), True)
    included = decide(F.col("path"), list(rules), False)
    reason = (
        F.when(denied(F.col("path")), "protected")
        .when(F.coalesce("marked", F.lit(False)) | named, "tool")
        .when(~ruled, "excluded")
        .when(hidden & ~included, "hidden")
        .when((F.col("crowd") > most) & ~included, "too many side by side")
    )
    return rows.join(below, "path", "left").join(crowd, "folder").select("path", reason.alias("reason"))


def first_copies(files: DataFrame) -> DataFrame:
    """Files with `kept`: the first path of their content, in order of path. An aggregate, no group is gathered."""
    first = files.where("sha is not null").groupBy("sha").agg(F.min("path").alias("kept"))
    return files.join(first, "sha", "left")
