"""Column helpers for sizes, times, paths and text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results must agree on.
KIB = 1024
MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024
NAME_WIDTH = 22
GLYPHS = {"COMPLETE": "█", "ACTIVE": "▓", "FAILED": "█"}
OTHER_GLYPH = "░"


def human_size(size: Column) -> Column:
    """Bytes as `512 B`, `1.5 KB`, `42.0 MB` or `1.25 GB`; halves go to the even digit."""
    def scaled(unit: int, digits: int, suffix: str) -> Column:
        return F.format_string(f"%.{digits}f {suffix}", F.bround(size / F.lit(float(unit)), digits))

    return (
        F.when(size < KIB, F.format_string("%d B", size.cast("long")))
        .when(size < MIB, scaled(KIB, 1, "KB"))
        .when(size < GIB, scaled(MIB, 1, "MB"))
        .when(size >= GIB, scaled(GIB, 2, "GB"))
    )


def format_mtime(epoch_ms: Column) -> Column:
    """Epoch milliseconds as `yyyy-MM-dd HH:mm` in UTC, whatever the session zone is."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (epoch_ms / F.lit(1000)).cast("decimal(20,6)")
    moment = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.substring(moment.cast("string"), 1, 16)


def utc_millis(moment: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone read as UTC, whatever the session zone is."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), moment)
    return F.unix_millis(local.cast("timestamp"))


def type_symbol(kind: Column) -> Column:
    """`d` for a directory, `-` for anything else."""
    return F.when(kind == "DIRECTORY", "d").otherwise("-")


def parse_spark_time(text: Column) -> Column:
    """Milliseconds since the epoch from the time spellings Spark's REST API uses.

    Accepts whole numbers (already milliseconds) and ISO date-times. A zone name
    such as GMT or EST is dropped and the time is read as UTC; `Z` and numeric
    offsets are honoured. Anything else is null.
    """
    text = text.cast("string")
    bare = F.regexp_replace(text, "[A-Za-z&&[^Z]]+$", "")
    zoned = F.when(bare.rlike(r"(Z|[+-]\d\d:\d\d)$"), bare).otherwise(F.concat(bare, F.lit("Z")))
    full = zoned.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    moment = F.unix_millis(F.when(full, F.try_to_timestamp(zoned)))
    number = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text)).try_cast("bigint")
    return F.coalesce(number, moment)


def hdfs_path(uri: Column) -> Column:
    """Path part of `hdfs://host:port/path`; `/` when there is none; other text unchanged."""
    path = F.regexp_replace(uri, "^hdfs://[^/]*", "")
    return F.when(~F.startswith(uri, F.lit("hdfs://")), uri).when(path == "", "/").otherwise(path)


def one_line(text: Column) -> Column:
    """Line breaks replaced by blanks."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def history_line(moment: Column, statement: Column) -> Column:
    """`[yyyy-MM-dd HH:mm:ss] statement` on one line."""
    stamp = F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.lit("["), stamp, F.lit("] "), one_line(statement))


def split_key_value(text: Column) -> Column:
    """`KEY=VALUE` cut at the first `=` as struct(key, value, valid).

    Without `=` the pair is invalid and key and value are null.
    """
    at = F.instr(text, "=")
    valid = at > 0
    return F.struct(
        F.when(valid, F.substring(text, F.lit(1), at - 1)).alias("key"),
        F.when(valid, F.substring(text, at + 1, F.length(text))).alias("value"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def short_name(name: Column, width: int = NAME_WIDTH) -> Column:
    """Name cut to `width` characters, the last one `…` when something was cut."""
    return F.when(
        F.length(name) > width, F.concat(F.substring(name, 1, width - 1), F.lit("…"))
    ).otherwise(name)


def status_glyph(status: Column) -> Column:
    """The bar character that stands for a stage status."""
    glyph = F.lit(OTHER_GLYPH)
    for state, char in GLYPHS.items():
        glyph = F.when(F.upper(status) == state, char).otherwise(glyph)
    return glyph
