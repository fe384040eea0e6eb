"""Sources and sinks (S1-S3, S5): delimited, JSON-array and Parquet tables; report writer."""

from __future__ import annotations

import json
import os
import re
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import attach
from .activity import append_activity

#: Blanks trimmed off every cell.
CELL_BLANKS = " \t\n\x0b\x0c\r\u00a0\ufeff"
SEPARATORS = [",", "\t", "|", ";"]

#: No JSON text holds this (control characters must be escaped), so a file is one line of it.
END_OF_FILE = "\x1e\x02end of file\x03\x1e"
#: Array files from here on are parsed as a stream: one line must fit an array of bytes.
STREAM_BYTES = 1 << 30
#: Names of files that Hadoop's codecs read.
COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"


def detect_separator(first_line: str) -> str:
    """The most frequent of , TAB | ; in what is left without quoted stretches (ties in that order)."""
    return max(SEPARATORS, key=re.sub(r'"[^"]*("|$)', "", first_line).count)


def read_delimited(spark: SparkSession, paths: str | Sequence[str], sep: str | None = None,
                   multi_line: bool = False) -> DataFrame:
    """Header row + rows, every cell a trimmed string, quoted or not (``""`` escapes a
    quote); all-empty rows dropped; missing cells read as ''.

    Rows end at line breaks, so a file of any size is split over many tasks.  With
    ``multi_line`` quoted cells may span lines, at the price of one task per file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if sep is None:
        head = spark.read.text(paths[0]).limit(1).first()   # one line: the header
        sep = detect_separator((head[0] if head else "").lstrip("\ufeff"))
    df = (spark.read.option("header", True).option("sep", sep).option("quote", '"')
          .option("escape", '"').option("multiLine", multi_line).option("inferSchema", False)
          .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
          .option("encoding", "UTF-8").csv(paths))
    clean = {c: c.lstrip("\ufeff").strip() for c in df.columns}
    df = df.select(*[F.coalesce(F.btrim(F.col(f"`{c}`").cast("string"), F.lit(CELL_BLANKS)), F.lit("")).alias(n)
                     for c, n in clean.items() if n])
    if not df.columns:
        return df
    return df.where(F.greatest(*[F.length(F.col(f"`{c}`")) for c in df.columns] + [F.lit(0)]) > 0)


def _opening(spark: SparkSession, paths, pieces: int) -> list[str]:
    """The first pieces of the first file, cut after each closing brace, however its lines run."""
    first = paths if isinstance(paths, str) else paths[0]
    return [r[0] + "}" for r in spark.read.option("lineSep", "}").text(first).limit(pieces).collect()]


def _first_object_keys(spark: SparkSession, paths) -> list[str] | None:
    """Keys of the first JSON object, in order; reads on until that object is whole, so what
    comes to the driver is bounded by the object.  None if the file holds no object."""
    pieces = 1
    while True:
        got = _opening(spark, paths, pieces)
        text = "".join(got).lstrip("\ufeff").lstrip().removeprefix("[").lstrip()
        try:
            obj, _ = json.JSONDecoder().raw_decode(text)
            return list(obj.keys()) if isinstance(obj, dict) else None
        except ValueError:
            if len(got) < pieces:
                if text.startswith("{"):
                    raise ValueError(f"the first object of {paths} is not valid JSON") from None
                return None
        pieces *= 4


def _one_line_files(spark: SparkSession, paths) -> bool:
    """Whether each file can be read as one line: none compressed, none of ``STREAM_BYTES`` or more."""
    odd = (F.col("length") >= STREAM_BYTES) | F.col("path").rlike(COMPRESSED)
    return spark.read.format("binaryFile").load(paths).select("path", "length").where(odd).isEmpty()


def read_json_table(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """A JSON array of objects (or JSON lines); values become strings, null -> '',
    nested values are kept as JSON text.  The columns are the keys of the first object,
    in its order, whatever its length; keys that appear only in later objects are
    dropped.  An array is one task per file, as the format cannot be split: use JSON
    lines for large tables.

    Spark's multi-line reader goes back to the file for the text of every single number, some
    0.3 ms each; a file that is one line is parsed from memory, with the same texts.  Only
    compressed files and those of ``STREAM_BYTES`` or more are left to the multi-line reader."""
    reader = spark.read.option("primitivesAsString", True)
    if not multi_line:
        df = reader.json(paths)
    elif _one_line_files(spark, paths):
        df = reader.option("lineSep", END_OF_FILE).json(paths)
    else:
        df = reader.option("multiLine", True).json(paths)
    fields = {f.name: f for f in df.schema.fields}
    names = _first_object_keys(spark, paths) or list(fields)
    cols = []
    for name in names:
        f = fields.get(name)
        if f is None:
            cols.append(F.lit("").alias(name))
            continue
        c = F.col(f"`{name}`")
        v = c if isinstance(f.dataType, T.StringType) else F.to_json(c)
        cols.append(F.coalesce(v, F.lit("")).alias(name))
    return df.select(*cols)


def read_table(spark: SparkSession, paths: str | Sequence[str], format: str | None = None) -> DataFrame:
    """S3: Parquet by ``format`` or extension; else JSON where the text opens like JSON (or the
    format says so), else delimited."""
    first = paths if isinstance(paths, str) else paths[0]
    fmt = format or os.path.splitext(first.rstrip("/"))[1].lstrip(".").lower()
    if fmt == "parquet":
        return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if fmt in ("json", "jsonl", "ndjson"):
        return read_json_table(spark, paths, multi_line=fmt == "json")
    opening = _opening(spark, paths, 1) if format is None else []
    start = opening[0].lstrip("\ufeff").lstrip()[:1] if opening else ""
    if start in ("[", "{"):
        return read_json_table(spark, paths, multi_line=start == "[")
    return read_delimited(spark, paths)


def scrub_non_finite(df: DataFrame) -> DataFrame:
    """NaN and +-Infinity in double/float columns become 0 (JSON-safe output)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write every result table under ``path/<name>`` with non-finite numbers scrubbed."""
    for name, df in tables.items():
        scrub_non_finite(df).write.mode(mode).format(fmt).save(os.path.join(path, name))


def write_analysis(tables: dict[str, DataFrame], path: str, log_path: str, file_name: str, client: str, at,
                   by: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Write the report and append the activity row of the analysis, one for each group.

    ``tables`` holds ``judgment`` and ``confidence`` among others.  The judgment is observed while it is written
    (``DataFrame.observe``): rows, tiers and grades come from that one pass.  Returns the rows appended, ``ts, ip, type,
    fileName, *by, rows, confidence, tier``; their sum of rows is checked against what was written."""
    spark = tables["judgment"].sparkSession
    by, seen = list(by), Observation(f"analysis-{uuid.uuid4().hex[:8]}")
    graded = attach(tables["judgment"], tables["confidence"].select(*by, "confidence"), by, "left")
    graded = graded.observe(seen, F.count("*").alias("groups"), F.sum("rows").alias("rows"))
    write_report({**tables, "judgment": graded}, path, fmt)
    done = spark.read.format(fmt).load(os.path.join(path, "judgment"))
    log = done.select(F.lit(at).cast("timestamp").alias("ts"), F.lit(client).alias("ip"), F.lit("ANALYSIS").alias("type"),
                      F.lit(file_name).alias("fileName"), *by, "rows", "confidence", F.col("analysis_tier").alias("tier"))
    check = log.agg(F.count("*").alias("groups"), F.sum("rows").alias("rows")).first()
    if check.asDict() != seen.get:
        raise RuntimeError(f"the report at {path} holds {check.asDict()}, written were {seen.get}")
    append_activity(log, log_path)
    return log
