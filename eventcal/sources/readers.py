"""Reading exports whatever their header and encoding (S1-S4, R9's batch side).

Spark maps CSV columns by position, and two products share positions but not names. Files are
therefore grouped by their own header line, each group is parsed with its own all-text schema, and the
groups are united by name.

Exports are read once, as lines of bytes, so that large files split, UTF-16 too. What a line means depends on the encoding of
its whole file only where it has bytes beyond ASCII; such lines are kept as they are and parsed when the scan has
told the encoding of each file. All other lines are parsed in the scan itself.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventcal import schema as S
from eventcal.functions import scalars as X
from eventcal.operators import record as R
from eventcal.session import stored, tune

HEAD_BYTES = 1 << 16          # read at a time, until the first line ends
# Bytes that Windows-1252 leaves undefined.
UNDEFINED_1252 = r"^(..)*(81|8D|8F|90|9D)"


# Spark reads Latin-1 but not Windows-1252; the two differ in one block of bytes.
_BLOCK = {chr(b): bytes([b]).decode("cp1252", errors="ignore") for b in range(0x80, 0xA0)}
LATIN = "".join(k for k, v in _BLOCK.items() if v)
WINDOWS = "".join(v for v in _BLOCK.values() if v)


HEADS = "path string, wide boolean, mark string, header string"


def _probe(batches):
    """First line and byte-order mark of each file; reads only the head of it."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch["path"]:
            filesystem, inner = fs.FileSystem.from_uri(path)
            with filesystem.open_input_stream(inner) as stream:
                head = stream.read(HEAD_BYTES)
                while not any(end in head for end in (b"\n", b"\r")) and (more := stream.read(HEAD_BYTES)):
                    head += more
                if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
                    head += stream.read(2 - len(head) % 2)
            wide = head[:2] in (b"\xff\xfe", b"\xfe\xff")
            text = head.decode("utf-16" if wide else "latin-1", errors="ignore")
            if not wide and head.startswith(b"\xef\xbb\xbf"):
                text = head[3:].decode("latin-1")
            mark = {b"\xff\xfe": "LE", b"\xfe\xff": "BE"}.get(head[:2], "")
            out.append((path, wide, mark, re.split("\r\n|\n|\r", text)[0]))
        yield pd.DataFrame(out, columns=["path", "wide", "mark", "header"])


def signatures(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Header line and encoding of each file in ``path``.

    UTF-16 by its mark; UTF-8 when every line of the file is valid; else Windows-1252, or Latin-1
    where a byte has no meaning in that. The validity test reads whole files, split like any scan.
    """
    heads = files.select("path").mapInPandas(_probe, HEADS)
    narrow = [r.path for r in heads.filter(~F.col("wide")).select("path").collect()]
    if narrow:
        raw = F.col("value").cast("binary")
        lines = spark.read.text(narrow).select(
            F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("utf8"),
            F.hex(raw).rlike(UNDEFINED_1252).alias("odd"))
        judged = lines.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("odd").alias("odd"))
    else:
        judged = spark.createDataFrame([], "path string, utf8 boolean, odd boolean")
    encoding = (F.when(F.col("wide"), "UTF-16").when(F.coalesce("utf8", F.lit(True)), "UTF-8")
                .when(F.col("odd"), "ISO-8859-1").otherwise("windows-1252"))
    return heads.join(judged, "path", "left").select("path", "header", encoding.alias("encoding"))


def split_header(line: str) -> list[str]:
    return [c.strip().strip('"').strip().lower() for c in line.lstrip("﻿").split(",")]


# ------------------------------------------------------------------ one scan
#: Lines of whole UTF-16 characters: no half of a pair stands alone. By the hexadecimal digits of both byte orders.
_WHOLE = {"LE": "^(..([^D].|D[0-7])|..D[89AB]..D[C-F])*$", "BE": "^(([^D].|D[0-7])..|D[89AB]..D[C-F]..)*$"}
#: What the scan keeps besides the parsed columns: the file, as several may go by one name, the group of the header, the line if it
#: has to wait for its encoding, and what the line says about the encoding of its file.
CARRIED = ("__path", "__group", "__raw", "__utf8", "__odd", "__header_line")


def _one_name(path):
    """Local paths have one or three slashes, by who wrote them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def lines(spark: SparkSession, paths: list[str], mark: str, header: str) -> DataFrame:
    """(path, file_name, __raw, text, __utf8, __odd, __header_line) of every line that is not blank, in one scan that splits files.

    UTF-16 is cut at its two-byte line feed; where a character from U+0A00 to U+0AFF meets one whose number ends in 00, the same two
    bytes stand across both, and what is left of that line is no UTF-16. ``text`` is null for such lines, which count as rows
    without use, and for those that wait for their file's encoding.
    """
    reader = spark.read.option("lineSep", {"LE": "\n\0", "BE": "\0\n"}[mark]) if mark else spark.read
    read = reader.text(paths).select(
        F.col("value"), F.col("value").cast("binary").alias("__raw"),
        _one_name(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_name").alias("file_name"))
    if mark:
        whole = F.hex("__raw").rlike(_WHOLE[mark])
        text = F.rtrim(F.regexp_replace(F.decode(F.when(whole, F.col("__raw")), f"UTF-16{mark}"), "^\ufeff", ""), F.lit("\r"))
        out = read.select("path", "file_name", F.lit(None).cast("binary").alias("__raw"), text.alias("text"),
                          F.lit(True).alias("__utf8"), F.lit(False).alias("__odd"), F.length("__raw").alias("size"))
        return out.filter((F.col("size") > 0) & F.coalesce(F.col("text") != "", F.lit(True))).withColumn(
            "__header_line", F.coalesce(F.col("text") == header, F.lit(False))).drop("size")
    utf8 = F.is_valid_utf8("value")
    ascii_ = utf8 & (F.octet_length("value") == F.char_length("value"))
    plain = F.decode("__raw", "ISO-8859-1")
    out = read.filter(F.octet_length("value") > 0).select(
        "path", "file_name", "__raw", plain.alias("latin"), ascii_.alias("ascii"), utf8.alias("__utf8"),
        F.when(ascii_, False).otherwise(F.hex("__raw").rlike(UNDEFINED_1252)).alias("__odd"))
    own = F.regexp_replace("latin", "^\u00ef\u00bb\u00bf", "") == header
    return out.select("path", "file_name", F.when(~F.col("ascii") & ~own, F.col("__raw")).alias("__raw"),
                      F.when(F.col("ascii"), F.col("latin")).alias("text"), "__utf8", "__odd", own.alias("__header_line"))


def _parsed(df: DataFrame, header: str, text) -> DataFrame:
    """Lines of one group as typed record columns; nothing is dropped."""
    names = split_header(header)
    schema = ", ".join(f"`{n}` string" for n in names)
    fields = df.withColumn("_f", F.from_csv(text, schema, {"mode": "PERMISSIVE"}))
    raw = fields.select(*[F.col("_f")[n].alias(n) for n in names], "src_file", *CARRIED)
    return R.typed(raw, carried=CARRIED)


def scan_exports(spark: SparkSession, files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(every row of the readable files as typed columns, not yet judged; a verdict for each file).

    ``files`` has a ``path`` and, if files go by other names than their own, ``src_file``. Reads heads of files, then each
    readable file once, and stores what it has parsed. The listing is a row for each file, as in Spark's own file index.
    """
    tune(spark)
    named = "src_file" in files.columns
    heads = files.select("path").mapInPandas(_probe, HEADS).collect()
    names = files.select(_one_name("path").alias("path"), F.col("src_file") if named else F.element_at(F.split("path", "/"), -1).alias("src_file"))
    groups, verdicts = {}, []
    for row in heads:
        missing = sorted(set(S.REQUIRED) - set(split_header(row.header)))
        verdicts.append((re.sub("^file:/+", "file:/", row.path), f"missing required columns: {', '.join(missing)}" if missing else None))
        if not missing:
            groups.setdefault((row.header, row.mark), []).append(row.path)
    verdict = spark.createDataFrame(verdicts, "path string, refused string").join(names, "path").groupBy("src_file").agg(
        F.min("refused").alias("refused"))
    if not groups:
        return None, verdict
    parts, headers = [], list(groups)
    for number, (header, mark) in enumerate(headers):
        found = lines(spark, groups[header, mark], mark, header).withColumns({"__group": F.lit(number), "__path": F.col("path")})
        found = found.join(F.broadcast(names), "path") if named else found.withColumn("src_file", F.col("file_name"))
        parts.append(_parsed(found, header, F.col("text")))
    scanned = stored(reduce(DataFrame.unionByName, parts), "ingested")
    told = scanned.groupBy("__path").agg(F.bool_and("__utf8").alias("_utf8"), F.bool_or("__odd").alias("_odd"))
    late = scanned.filter(F.col("__raw").isNotNull()).select("src_file", *CARRIED).join(told, "__path")
    latin = F.decode("__raw", "ISO-8859-1")
    shown = (F.when(F.col("_utf8"), F.decode(F.when(F.col("_utf8"), F.col("__raw")), "UTF-8"))
             .when(F.col("_odd"), latin).otherwise(F.translate(latin, LATIN, WINDOWS)))
    rows = [scanned.filter(F.col("__raw").isNull() & ~F.col("__header_line"))]
    for number, (header, mark) in enumerate(headers):
        if not mark:
            rows.append(_parsed(late.filter(F.col("__group") == number), header, shown))
    # A line like the header behind the first one is a row, though not a usable one.
    again = scanned.filter("__header_line").groupBy("src_file", "__path").agg((F.count("*") - 1).alias("_n")).filter("_n > 0")
    again = again.select("src_file", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("col")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [*rows, again]), verdict


def read_exports(spark: SparkSession, files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(typed rows of the readable files with their ``src_file``; a verdict for each file)."""
    rows, verdict = scan_exports(spark, files)
    return (rows.drop(*CARRIED) if rows is not None else None), verdict


def ingest(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record, report). Every file is in the report; nothing accepted at all is an error."""
    rows, verdict = read_exports(spark, files)
    if rows is None:
        reasons = "; ".join(f"{r.src_file}: {r.refused}" for r in verdict.collect())
        raise ValueError(reasons)
    counted = R.counted_by_file(rows)
    report = verdict.join(counted, "src_file", "left").select(
        "src_file", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("kept", F.lit(0)).alias("kept"),
        F.when(F.col("kept") > 0, "accepted").otherwise("rejected").alias("status"),
        F.coalesce("refused", "reason", F.when(F.col("rows").isNull(), "no rows read")).alias("reason"))
    report = stored(report, "report")
    if report.filter(F.col("status") == "accepted").isEmpty():
        raise ValueError("; ".join(f"{r.src_file}: {r.reason}" for r in report.collect()))
    return R.deduped(rows), report


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A parquet or CSV path as a record, harmonised unless it already is one."""
    tune(spark)
    if path.lower().rstrip("/").endswith(".parquet"):
        frame = X.clean_headers(spark.read.parquet(path))
        names = set(frame.columns)
        if not set(S.RECORD_MARKERS) <= names:
            R.require_columns(names)
        return R.ensure_harmonized(frame)
    files = spark.createDataFrame([(path if "://" in path or path.startswith("file:") else f"file:{path}",)],
                                  "path string")
    rows, verdict = read_exports(spark, files)
    if rows is None:
        raise R.MissingColumns(verdict.first().refused.split(": ")[1].split(", "))
    return rows.filter(R.countable())
