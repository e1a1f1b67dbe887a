"""Writing rendered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.schema import FORMATS, check_choice


def write_as(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists") -> str:
    """Write to a folder and return it. Folders are made as needed.

    ``json`` writes rows, one per line. ``csv`` writes a header and, for lists, JSON; an
    empty table leaves a header only. ``txt`` and ``md`` need a ``body``. A table of bodies
    keeps its other columns in every format, see ``write_bodies``.
    """
    check_choice("format", fmt, FORMATS)
    if "body" in df.columns:
        return write_bodies(df, path, mode)
    if fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        flat = [
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
        df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"Format '{fmt}' needs a body column")
    return path


def write_bodies(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write rendered bodies with their keys and file names, and return the folder.

    Each body is a row of a Parquet table, whatever its lines, so bodies stay apart and are
    found by key or by ``file``. A file per page would be as many files as the corpus has pages.
    """
    df.write.mode(mode).parquet(path)
    return path


def body_lines(bodies: DataFrame) -> DataFrame:
    """The lines of written bodies: their keys, ``line_no`` and ``line``."""
    keys = [name for name in bodies.columns if name != "body"]
    return bodies.select(*keys, F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
