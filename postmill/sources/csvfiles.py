"""Recipient CSV files in any of the known encodings and layouts.

What a file is like - encoding, header, place of the address - is read from its first bytes only, in tasks, whatever its
size. All files are then read in one scan by position: bytes are taken as Latin-1, which keeps them as they are and has the
same delimiters, and the address alone is decoded again when its file is UTF-8.
"""

import codecs
import csv
import re
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postmill import constants as K
from postmill.operators.spread import attach

UTF8, UTF8_BOM, LATIN1 = "utf-8", "utf-8-bom", "iso-8859-1"
#: The first line with content: what comes before it, and the line up to its end.
FIRST_LINE = re.compile(rb"\s*([^\r\n]*)([\r\n]?)")
CHUNK_BYTES = 64 << 10
#: Characters that stand in a URI as they are.
URI = "%/:?#[]@!$&'()*+,;=~"


@dataclass(frozen=True)
class CsvOptions:
    """How recipient files are laid out. email_column counts with a header, email_index without one."""

    has_header: bool = True
    email_column: str = "email"
    email_index: int = 0
    delimiter: str = ","
    multi_line: bool = False


def encoding_of(head, cut):
    """Encoding name from a file's first bytes; a character that the cut left incomplete does not count as invalid."""
    if head.startswith(codecs.BOM_UTF8):
        return UTF8_BOM
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=not cut)
    except UnicodeDecodeError:
        return LATIN1
    return UTF8


def look(stream, limit=K.ENCODING_HEAD_BYTES):
    """(encoding, header): from the first `limit` bytes of a binary file, and its first line with content to the line's end."""
    start = stream.read(limit + 1)
    encoding = encoding_of(start[:limit], len(start) > limit)
    rest = start.removeprefix(codecs.BOM_UTF8)
    while True:
        line = FIRST_LINE.match(rest)
        if line[2]:
            break
        more = stream.read(CHUNK_BYTES)
        if not more:
            break
        rest = line[1] + more if line[1] else more
    return encoding, line[1].decode("latin-1") if encoding == LATIN1 else line[1].decode("utf-8", "replace")


def header_cells(line, delimiter=","):
    """The cells of a header line, trimmed."""
    return [cell.strip() for cell in next(csv.reader([line], delimiter=delimiter), [])]


def email_place(cells, options=CsvOptions()):
    """Position of the address cell by exact header text or by index; None when there is no such column."""
    if options.has_header:
        return cells.index(options.email_column) if options.email_column in cells else None
    return options.email_index if options.email_index < len(cells) else None


def catalogue(spark: SparkSession, paths, options=CsvOptions()) -> DataFrame:
    """(path, length, encoding, header, place) per file: its first line and the position of the address cell in it.

    Spark lists the files and deals them out by size; tasks open each one and read its first bytes and its first line. The
    store must be one that Arrow opens by the path's scheme. Files without any byte have no row.
    """
    def heads(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                # Spark leaves characters beyond ASCII in its paths as they are.
                store, place = fs.FileSystem.from_uri(quote(path, safe=URI))
                with store.open_input_file(place) as stream:
                    encoding, header = look(stream)
                rows.append((encoding, header, email_place(header_cells(header, options.delimiter), options)))
            columns = zip(*rows) if rows else ((), (), ())
            found = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], ["path", "length", "encoding", "header", "place"])

    files = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
    return files.mapInArrow(heads, "path string, length long, encoding string, header string, place int")


def detect_encodings(spark: SparkSession, paths) -> DataFrame:
    return catalogue(spark, paths).select("path", "length", "encoding")


def read_csv(spark: SparkSession, paths, options=CsvOptions(), encoding="UTF-8", schema=None) -> DataFrame:
    """Text cells as they are: trimmed, blank lines skipped, short rows padded, long rows cut, nothing cast."""
    reader = spark.read.options(
        header=options.has_header, sep=options.delimiter, quote='"', escape='"', ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", inferSchema=False, encoding=encoding,
        multiLine=options.multi_line, enforceSchema=True,
    )
    return (reader.schema(schema) if schema else reader).csv(paths)


def read_recipients(spark: SparkSession, paths, mailing_id, options=CsvOptions()) -> DataFrame:
    """Rows (mailing_id, raw_email, source_file, split_start, row_key) of files that may differ in encoding and header.

    mailing_id: a text, or a Column over source_file when each file is a mailing of its own. One scan reads all files up to
    the rightmost address column; of the catalogue, the driver sees that one number.
    """
    files = catalogue(spark, paths, options).select(F.col("path").alias("source_file"), "encoding", "place")
    known = files.agg(F.count("*").alias("n"), F.max("place").alias("last")).first()
    if not known["n"]:
        raise FileNotFoundError(f"no CSV file under {paths}")
    # Cells are read by position: Spark would rename headers that differ in case only.
    names = [f"_c{i}" for i in range((known["last"] or 0) + 1)]
    df = read_csv(spark, paths, options, "ISO-8859-1", ", ".join(f"{name} string" for name in names))
    rows = df.select(
        F.array(*names).alias("_cells"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("row_key"))
    rows = attach(rows, files, ["source_file"])
    cell = F.when(F.col("place").isNotNull(), F.get("_cells", F.col("place")))
    decoded = F.make_valid_utf8(F.encode(cell, "ISO-8859-1").cast("string"))
    text = (F.when(F.col("encoding") == LATIN1, cell).when(F.col("encoding") == UTF8, decoded)
            .otherwise(F.ltrim(decoded, F.lit("\ufeff"))))
    owner = F.lit(mailing_id) if isinstance(mailing_id, str) else mailing_id
    return rows.select(text.alias("raw_email"), "source_file", "split_start", "row_key").withColumn("mailing_id", owner)


def with_line_numbers(rows: DataFrame) -> DataFrame:
    """Add line_no: the 1-based data row in its file.

    A row's number is its place in its file split plus the rows of the earlier splits of that file. Both steps group by
    (file, split), which no file can make larger than one split.
    """
    split = ["source_file", "split_start"]
    sizes = rows.groupBy(*split).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*split, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("row_key"))
    return (
        rows.withColumn("_at", inside).join(starts, split)
        .withColumn("line_no", (F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_at", "_before")
    )
