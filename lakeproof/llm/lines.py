"""Removal of repeated lines by overlapping three-line windows.

Every three consecutive lines of a text are a window, hashed to 128 bits. A window that also occurs earlier (in a document
with a smaller id, or earlier in the same one) is a later occurrence; the lines that later occurrences cover are removed,
overlaps merged. A line is thus only removed as part of a repeated run of at least three.

Windows are counted after a map-side combine, so one that a third of all documents share is one row per task. Only windows
whose hash may be repeated, by a bounded bit filter, are shuffled again, and that join is one that Spark splits where it
is skewed. Texts are shuffled only if lines of them may go.

Defined cases: NULL texts count as empty; texts of fewer than three lines have no window and stay; empty lines are lines; a
NULL id is the smallest; rows with equal id are ordered by a hash of their texts; rows equal in id and text are one
document, listed again with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import filter_words, identified, numbered, quoted, split_by_filter, text_of, utf8, with_marks
from lakeproof.session import materialize

WINDOW = 3


def windows(rows: DataFrame) -> DataFrame:
    """(key, doc, th, line): all windows of rows from ``identified``."""
    lines = rows.select("doc", "th", F.split("text", "\n", -1).alias("lines"))
    placed = lines.select("doc", "th", "lines", F.posexplode("lines").alias("line", "first"))
    parts = [F.get("lines", F.col("line") + j) for j in range(WINDOW)]
    whole = placed.filter(F.col("line") <= F.size("lines") - WINDOW)
    return whole.select(F.unhex(F.md5(F.concat_ws("\n", *parts))).alias("key"), "doc", "th", F.col("line").cast("bigint").alias("line"))


def later_windows(rows: DataFrame) -> DataFrame:
    """(doc, th, mark): first lines of windows that occur earlier, too."""
    every = materialize(windows(rows))
    place = F.struct("doc", "th", "line")
    counted = every.groupBy("key").agg(F.count("*").alias("n"))
    repeated = materialize(counted.filter("n > 1").select(F.xxhash64("key").alias("hash")))
    words, bits = filter_words(repeated)
    maybe, _ = split_by_filter(every, F.xxhash64("key"), materialize(words), bits)
    # written, so that Spark can split the places of a frequent window in the join
    first = materialize(maybe.groupBy("key").agg(F.min(place).alias("earliest")))
    later = maybe.join(first, "key").filter(place != F.col("earliest"))
    return later.select("doc", "th", F.col("line").alias("mark"))


def removed_spans(marks: list[int] | None) -> list[tuple[int, int]]:
    """Maximal spans of lines covered by windows at sorted first lines."""
    out: list[tuple[int, int]] = []
    for start in marks or []:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], start + WINDOW)
        else:
            out.append((start, start + WINDOW))
    return out


def kept_lines(lines: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for start, end in spans:
        out += lines[at:start]
        at = end
    return out + lines[at:]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, spanned, digests = [], [], [], []
        for text, marks in zip(utf8(batch, "text"), batch.column("marks").to_pylist(), strict=True):
            lines, spans = text.split(b"\n"), removed_spans(marks)
            counts.append(len(lines))
            removed.append(sum(end - start for start, end in spans))
            spanned.append(len(spans))
            digests.append(hashlib.sha256(b"\n".join(kept_lines(lines, spans))).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (counts, removed, spanned)], pa.array(digests, pa.string())],
            names=["doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256"],
        )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_spans, kept_sha256), one row per row of ``docs``."""
    marks = later_windows(identified(docs, id_col, text_col))
    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    marked = with_marks(rows, marks, F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text"), "marks")
    return marked.mapInArrow(_report, "doc_id bigint, n_lines bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated lines of their texts; all columns and rows stay."""
    rows, (id_name, text_name) = numbered(docs, id_col, text_col)
    return _deduplicate(rows, id_name, text_name).toDF(*docs.columns)


def _deduplicate(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marks = later_windows(identified(docs, id_col, text_col))
    doc = F.coalesce(quoted(id_col).cast("bigint"), F.lit(-(2**63)))
    marked = with_marks(docs, marks, doc, F.xxhash64(text_of(text_col)), "\u0001marks")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = map(removed_spans, batch.column(batch.num_columns - 1).to_pylist())
            texts = [t if t is None or not s else b"\n".join(kept_lines(t.split(b"\n"), s)) for t, s in zip(utf8(batch, text_col), spans, strict=True)]
            field = batch.schema.field(at)
            column = pa.array(texts, pa.binary()).cast(pa.string()).cast(field.type)
            yield batch.select(range(batch.num_columns - 1)).set_column(at, field, column)

    return marked.mapInArrow(cut, docs.schema)


SQL = """
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(l[i : i + 2], chr(10)) AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM doc)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM later),
line AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS s FROM doc),
judged AS (
  SELECT line.doc_id, line.i, s, gone.i IS NOT NULL AS out, coalesce(lag(gone.i IS NOT NULL) OVER (PARTITION BY line.doc_id ORDER BY line.i), false) AS out_before
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT out_before) AS n_spans,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT out), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
