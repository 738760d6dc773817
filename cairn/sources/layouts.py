"""Layouts of trace records by the text of their format files, and records decoded by them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(texts: DataFrame) -> DataFrame:
    """(host, event, rank, field, offset, size, signed) of each field line with an offset; the first line of a field stays.

    ``texts`` have host, event, rank (the order in which an event's format
    files are tried) and content; tabs and spaces count alike.
    """
    lines = texts.filter("content is not null").select("host", "event", "rank", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    parts = F.transform(F.split("text", ";"), lambda x: F.btrim(x, F.lit(" \t\r")))
    rows = lines.withColumn("parts", parts).filter(F.get("parts", F.lit(0)).startswith("field:"))
    words = F.split(F.btrim(F.substring(F.get("parts", F.lit(0)), 7, 1 << 30), F.lit(" \t")), r"[ \t]+")
    of = lambda key: F.get(F.filter("parts", lambda x: x.startswith(f"{key}:")), F.lit(0))
    value = lambda key: F.regexp_extract(of(key), r"^[a-z]+:[ \t]*\+?([0-9]{1,9})\z", 1)
    rows = rows.filter(of("offset").isNotNull()).select("host", "event", "rank", "line", F.element_at(words, -1).alias("field"), *[F.try_to_number(F.nullif(value(k), F.lit("")), F.lit("999999999")).cast("int").alias(k) for k in ("offset", "size", "signed")])
    first = F.min_by(F.struct("offset", "size", "signed"), "line").alias("v")
    return rows.groupBy("host", "event", "rank", "field").agg(first).select("host", "event", "rank", "field", "v.*")


def layout(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(host, event, field, offset, size, signed, warning) of ``wanted`` (host, event, field, offset, size, signed: the defaults).

    Of an event's format files the first that can be read (content isn't null)
    counts. Where there is none, or it doesn't have the field, the defaults
    hold and ``warning`` says so.
    """
    chosen = texts.filter("content is not null").groupBy("host", "event").agg(F.min("rank").alias("rank"))
    found = fields(texts).select("host", "event", "rank", "field", F.col("offset").alias("_o"), F.col("size").alias("_s"), F.col("signed").alias("_g"))
    rows = wanted.join(chosen, ["host", "event"], "left").join(found, ["host", "event", "rank", "field"], "left")
    known = F.col("_o").isNotNull()
    warning = F.when(F.col("rank").isNull(), "format file not found").when(~known, "field not found")
    return rows.select(
        "host", "event", "field", F.coalesce("_o", "offset").alias("offset"), F.when(known, F.coalesce("_s", "size")).otherwise(F.col("size")).alias("size"),
        (F.when(known, F.coalesce("_g", "signed")).otherwise(F.col("signed")) == 1).alias("signed"), warning.alias("warning"),
    )


def little_endian(record: Column, offset: Column, size: Column, signed: Column) -> Column:
    """The number of up to 8 bytes at an offset; null where the record ends before. An unsigned one of 8 bytes wraps at 2**63."""
    digits = F.hex(F.substring(record, offset + 1, size))
    reversed_digits = F.array_join(F.transform(F.sequence(size, F.lit(1), F.lit(-1)), lambda i: F.substring(digits, 2 * i - 1, F.lit(2))), "")
    value = F.conv(reversed_digits, 16, -10).cast("long")
    half = F.shiftleft(F.lit(1).cast("long"), 1)  # 2; powers below stay exact in longs
    wrap = F.pow(half, 8 * size).cast("long")
    negative = signed & (size < 8) & (value >= F.pow(half, 8 * size - 1).cast("long"))
    return F.when((size.between(1, 8)) & (F.octet_length(record) >= offset + size), F.when(negative, value - wrap).otherwise(value))


def decoded(records: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """``records`` (host, event, record and others) with a number for each of ``names``, read where the layout has it; null where it has none.

    The layout is folded to one row an event first, so records meet one small
    table once.
    """
    spec = lambda n: F.max(F.when(F.col("field") == n, F.struct("offset", "size", "signed"))).alias(f"_{n}")
    wide = found.groupBy("host", "event").agg(*[spec(n) for n in names])
    rows = records.join(wide, ["host", "event"], "left")
    read = lambda n: F.when(F.col(f"_{n}").isNotNull(), little_endian(F.col("record"), F.col(f"_{n}.offset"), F.col(f"_{n}.size"), F.col(f"_{n}.signed")))
    return rows.select(*[c for c in records.columns if c != "record"], *[read(n).alias(n) for n in names])
