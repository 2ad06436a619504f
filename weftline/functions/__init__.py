"""Column functions by group. Each takes and returns plain Spark Columns (or column names), so all of pyspark.sql.functions mixes in."""

from weftline.functions import (
    aggregates,
    arithmetic,
    arrays,
    bitwise,
    casts,
    comparison,
    dates,
    hashing,
    jsons,
    lambdas,
    maps,
    mathematics,
    plumbing,
    sketches,
    strings,
    timestamps,
    variants,
    windows,
    xpaths,
)

__all__ = ["aggregates", "arithmetic", "arrays", "bitwise", "casts", "comparison", "dates", "hashing", "jsons", "lambdas", "maps", "mathematics", "plumbing", "sketches", "strings", "timestamps", "variants", "windows", "xpaths"]
