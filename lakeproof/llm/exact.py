"""Exact duplicates: one row stays of the rows whose texts are identical.

Rows are grouped by a 128-bit content hash, which shuffles 16 bytes per row and no text. Only rows whose hash is shared
are looked at again: they are grouped by hash *and* text, so the bytes decide and a collision of hashes splits a group.
Grouping combines on the map side first, so a text that a third of all rows share is shuffled once per task.

Defined cases, for both functions:

* NULL texts count as empty, and an empty text is a text like any other.
* A NULL id ranks last: it is kept only if all ids of its group are NULL.
* Rows with equal text and equal id (repeated rows) tie. ``report`` marks them all as kept, as it names rows by id;
  ``deduplicate`` returns one of them, the first in the order of the remaining columns that can be ordered.
* Other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.llm.common import filter_words, quoted, split_by_filter, text_of
from lakeproof.session import materialize


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _shared(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """Filter over the content hashes that occur more than once."""
    hashes = docs.select(content_hash(text_of(text_col)).alias("h"))
    return _shared_of(hashes)


def _shared_of(hashes: DataFrame) -> tuple[DataFrame, int]:
    repeated = hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    words, bits = filter_words(repeated.select(F.xxhash64("h").alias("hash")))
    return materialize(words), bits


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    ``keep`` is "min" or "max": which id of a group stays.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = text_of(text_col)
    keyed = materialize(
        docs.select(quoted(id_col).alias("doc_id"), content_hash(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    )
    words, bits = _shared_of(keyed.select("h"))
    candidates, _ = split_by_filter(
        docs.select(quoted(id_col).alias("doc_id"), text.alias("text"), content_hash(text).alias("h")), F.xxhash64("h"), words, bits
    )
    # the bytes are compared here: one group per distinct text
    groups = candidates.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    groups = materialize(groups.select("h", F.sha2("text", 256).alias("text_sha256"), "keep_id", "n"))
    found = keyed.join(groups, ["h", "text_sha256"], "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    words, bits = _shared(docs, text_col)
    maybe, single = split_by_filter(docs, F.xxhash64(content_hash(text_of(text_col))), words, bits)
    fields = [f for f in docs.schema.fields if f.name not in (id_col, text_col)]
    row = F.struct(
        quoted(id_col).alias("id"),
        quoted(text_col).isNull().alias("no_text"),
        *[quoted(f.name).alias(f"c{i}") for i, f in enumerate(fields)],
    )
    # for the largest id as for the smallest, a NULL id comes last
    null_id = quoted(id_col).isNull() if keep == "min" else quoted(id_col).isNotNull()
    order = F.struct(
        null_id.alias("null_id"),
        quoted(id_col).alias("id"),
        quoted(text_col).isNull().alias("no_text"),
        *[quoted(f.name).alias(f"c{i}") for i, f in enumerate(fields) if _orderable(f.dataType)],
    )
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    text = text_of(text_col)
    kept = maybe.groupBy(content_hash(text).alias("h"), text.alias("t")).agg(pick(row, order).alias("r"))
    back = {
        id_col: F.col("r.id"),
        text_col: F.when(F.col("r.no_text"), F.lit(None).cast("string")).otherwise(F.col("t")),
        **{f.name: F.col(f"r.c{i}") for i, f in enumerate(fields)},
    }
    return single.unionByName(kept.select(*[back[name].alias(name) for name in docs.columns]))
