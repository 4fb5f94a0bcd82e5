"""Text files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import col, let

#: well-formed UTF-8 of two, three and four bytes (Unicode, table 3-7), a character for a byte. Fixed values
WELL_FORMED = (
    (2, r"[\xC2-\xDF][\x80-\xBF]"),
    (3, r"\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"),
    (4, r"\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"),
)
#: bytes that are looked at as one array
BLOCK = 1 << 16


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_path, text) of the raw chapter files below a folder; cleaned copies are left out."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("raw_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")).where(
        ~F.endswith("file_name", F.lit("_cleaned.txt"))
    )


def write_cleaned(docs: DataFrame, path: str, by: str = "source") -> None:
    """Cleaned text as Parquet in one folder per source; a large source becomes many files."""
    docs.write.mode("errorifexists").option("maxRecordsPerFile", 500_000).partitionBy(by).parquet(path)


def undecodable(content: Column | str) -> Column:
    """Each byte that belongs to no well-formed UTF-8 sequence: an array of (offset from 0, byte), in order.

    NULL for NULL, empty for valid and empty content. Only rows that are not valid are looked into: well-formed sequences, which
    never overlap, give way to as many ASCII bytes, so what is left above 127 is bad and stands where it stood.
    """
    top = F.lit(bytearray(b"\x80"))

    def bad(data):
        def block(k):
            first = k * BLOCK
            part = F.substring(data, first + 1, F.lit(BLOCK))
            at = F.filter(F.sequence(first, F.least(first + BLOCK, F.octet_length(data)) - 1), lambda i: F.substring(data, i + 1, F.lit(1)) >= top)
            found = F.transform(at, lambda i: _place(data, i))
            return F.when(F.decode(part, "ISO-8859-1").rlike(r"[\x80-\xFF]"), found).otherwise(F.filter(F.array(_place(data, F.lit(0))), lambda _: F.lit(False)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(data) - 1) / BLOCK).cast("int")), block))

    def _place(data, i):
        byte = F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int")
        return F.struct(i.cast("bigint").alias("offset"), byte.alias("byte"))

    plain = F.decode(col(content), "ISO-8859-1")
    for width, pattern in WELL_FORMED:
        plain = F.regexp_replace(plain, pattern, "a" * width)
    none = F.array().cast("array<struct<offset:bigint,byte:int>>")
    looked = F.when(F.is_valid_utf8(col(content).cast("string")), none).otherwise(let(F.encode(plain, "ISO-8859-1"), bad))
    return F.when(col(content).isNotNull(), looked)


def audit_encoding(raw: DataFrame, content: str = "content") -> DataFrame:
    """Per document whether its bytes are not UTF-8, how many bytes belong to no character, and which (``undecodable``)."""
    found = raw.withColumn("undecodable", undecodable(content))
    return found.withColumn("invalid", F.size("undecodable") > 0).withColumn("bad_bytes", F.size("undecodable"))
