"""Names: pose files, behaviours, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pose_version(path: Column) -> Column:
    """Version digit of a pose file name (NULL if it has none)."""
    digit = F.regexp_extract(path, r"_v[0-9]*([0-9])\.h5", 1)
    return F.when(digit != "", digit.cast("int"))


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def pose_stem(path: Column) -> Column:
    """File stem without the pose version suffix, so pose and video files share it."""
    return F.regexp_replace(file_stem(path), r"_pose_est_v\d+$", "")


def safe_name(name: Column) -> Column:
    """Name usable in paths: other characters become single underscores; empty raises."""
    plain = F.regexp_replace(name, r"(?U)[^\w.-]+", "_")
    plain = F.regexp_replace(F.regexp_replace(plain, "_{2,}", "_"), "^_+|_+$", "")
    empty = F.raise_error(F.concat(F.lit("name has no usable characters: "), name)).cast("string")
    return F.when(plain == "", empty).otherwise(plain)


def valid_tag(tag: Column) -> Column:
    """1 to 32 letters, digits, underscores or hyphens."""
    return F.coalesce(tag.rlike(r"^[\p{L}\p{N}_-]{1,32}$"), F.lit(False))
