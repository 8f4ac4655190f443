"""Helpers of the operators: texts of Arrow batches, bounded bit filters."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.session import materialize, prepare

#: Rows of an Arrow batch that goes to a Python worker. Texts may be long, so batches are short; results don't depend on it.
BATCH_ROWS = 512
#: Bits of a key filter: a filter is at most this large, however many keys there are.
FILTER_BITS = (20, 27)


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """A text column in which NULL counts as empty."""
    return F.coalesce(quoted(name), F.lit(""))


def filter_words(hashes: DataFrame, hash_col: str = "hash") -> tuple[DataFrame, int]:
    """(word, mask) rows of a bit filter over 64-bit hashes, and the number of its bits.

    A filter answers "certainly not there" or "maybe there". It has eight bits per key, but never more than the upper
    limit of ``FILTER_BITS``, so it can be sent to all executors. Beyond that it answers "maybe" more often; callers
    decide by an exact join afterwards, so only the amount of shuffled data depends on it.
    """
    kept = materialize(hashes.select(F.col(hash_col).alias("hash")))
    wanted = int(max(8 * kept.count(), 1)).bit_length()
    bits = min(max(wanted, FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = kept.select(F.shiftrightunsigned(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    return words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")), bits


def split_by_filter(rows: DataFrame, hash_value: Column, words: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(maybe, not): rows whose hash may be among the keys of a filter, and rows whose hash is not.

    ``words`` has at most 2^(bits - 6) rows of 16 bytes, so it is broadcast whatever the data are.
    """
    slot = hash_value.bitwiseAND(F.lit((1 << bits) - 1))
    # a filter's columns get names that no table of documents has
    word, mask = "\u0001word", "\u0001mask"
    marks = F.broadcast(words.select(F.col("word").alias(word), F.col("mask").alias(mask)))
    joined = rows.join(marks, F.shiftrightunsigned(slot, 6) == quoted(word), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", quoted(mask), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.filter(hit).drop(word, mask), joined.filter(~hit).drop(word, mask)


def filter_array(words: DataFrame, bits: int) -> np.ndarray:
    """A filter as an array of 64-bit words (16 MB at the limit), for scans in Python."""
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def in_filter(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with numbered column names, and the numbered names of some columns: any name may come from outside, and
    Python functions over whole rows are given columns by name."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), [names[docs.columns.index(c)] for c in columns]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, text): rows as the occurrence-based operators see them.

    ``doc`` is the id as a number, with NULL as the smallest; ``th`` tells texts under one id apart and orders them. Rows
    equal in both are one document that is listed several times.
    """
    text = text_of(text_col)
    return docs.select(
        F.coalesce(quoted(id_col).cast("bigint"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")
    )


def with_marks(rows: DataFrame, marks: DataFrame, doc: Column, th: Column, out: str) -> DataFrame:
    """``rows`` with the marks of their document, (doc, th, mark bigint), as a sorted array; NULL without any.

    Only rows of documents that may have marks are shuffled. A document's marks are bounded by its length.
    """
    key, other, found = "\u0001doc", "\u0001th", "\u0001list"
    lists = materialize(marks.groupBy("doc", "th").agg(F.sort_array(F.collect_set("mark")).alias("marks")))
    words, bits = filter_words(lists.select(F.xxhash64("doc", "th").alias("hash")))
    maybe, clean = split_by_filter(rows, F.xxhash64(doc, th), materialize(words), bits)
    lists = lists.select(F.col("doc").alias(key), F.col("th").alias(other), F.col("marks").alias(found))
    joined = maybe.join(lists, (doc == quoted(key)) & (th == quoted(other)), "left").withColumn(out, quoted(found)).drop(key, other, found)
    return clean.withColumn(out, F.lit(None).cast("array<bigint>")).unionByName(joined)
