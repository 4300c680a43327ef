"""Which source file declares which class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECLARES = r"(?m)^(?:[\w@]+(?:\([^)]*\))?\s+)*(?:class|interface|enum|record|object)\s+(\w+)"


def index(files: DataFrame) -> DataFrame:
    """(class, path) of top-level declarations in Java and Kotlin files(path, text); a Kotlin file is also the class named after it."""
    text = F.regexp_replace("text", r"(?s)/\*.*?\*/|//[^\n]*", "")
    package = F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)", 1)
    stem = F.regexp_extract("path", r"([^/]+)\.kt$", 1)
    names = F.regexp_extract_all(text, F.lit(_DECLARES), F.lit(1))
    own = F.when(stem != "", F.array(F.concat(stem, F.lit("Kt")))).otherwise(F.array().cast("array<string>"))
    rows = files.select("path", package.alias("package"), F.explode(F.array_distinct(F.concat(names, own))).alias("name"))
    return rows.select(F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name")).alias("class"), "path")
