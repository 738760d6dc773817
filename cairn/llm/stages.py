"""Corpus stages: rows of ``documents`` in, rows of the same columns out (but for packing).

Null and empty texts pass the quality stage if the sample's mean label is
``ACCEPT`` or more, are never near duplicates nor contaminated, and pack as
their end id. Very long texts are handled as each operator says; columns of
any other name, row_id and the like included, come through unchanged; repeated
rows are near copies, of which one stays; an empty table comes out empty.
"""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_join, neighbours, packing, suffix_dedup
from .common import filtered_rows, numbered, released, row_blocks, utf8_of


def held_out(parts: int, part: int):
    """Rows of a doc_id whose crc32 falls in the held-out part."""
    return lambda doc_id: F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the nearest labelled texts vote down."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return neighbours.accepted(docs, neighbours.fitted(docs, labels, held_out(5, 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near copies."""
    return filtered_rows(docs, near_join.surplus(docs), "left_anti")


def without_spans(batches):
    """Task: (row struct, spans) to rows with the spans cut from the text; rows cut to nothing go."""
    for batch in released(batches):
        row = batch.column("row")
        texts = row.field(row.type.get_field_index("text"))
        for a, b in row_blocks(utf8_of(texts)[1], 4 << 20):
            part = row.slice(a, b - a)
            columns = {f.name: part.field(i) for i, f in enumerate(part.type)}
            spans_of = batch.column("spans").slice(a, b - a).to_pylist()
            cut = [i for i, spans in enumerate(spans_of) if spans]
            if cut:
                rest, keep = columns["text"].to_pylist(), np.ones(b - a, bool)
                for i in cut:
                    raw, at, left = rest[i].encode(), 0, []
                    for s, e in suffix_dedup.merged_spans([(x["start"], x["stop"]) for x in spans_of[i]]):
                        left.append(raw[at:s])
                        at = e
                    rest[i] = b"".join([*left, raw[at:]]).decode("utf-8", "ignore")
                    keep[i] = bool(rest[i].strip())
                columns["text"] = pa.array(rest, pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pc.utf8_length(columns["text"]).cast(columns["n_chars"].type)
            out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield out.filter(pa.array(keep)) if cut else out


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings that occur twice; half characters at the cuts go too."""
    spans = suffix_dedup.removed_spans(numbered(docs)).groupBy("row_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row_id"))
    return packed.join(spans, "row_id", "left").select("row", "spans").mapInArrow(without_spans, docs.schema)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.contamination(docs, benchmark).filter(F.size("hits") > 0)
    return filtered_rows(docs, hit, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
