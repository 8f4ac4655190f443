"""Documents with everything an operator must take: NULLs, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, doc bigint, th bigint, h string, "
    "fp bigint, key string, spans string, score double, features string, label int, word bigint, mask bigint, hash bigint, n bigint"
)
WIDTH = SCHEMA.count(",") + 1
LONG = " ".join(f"word{i % 977} {'x' * (i % 7)}" for i in range(40_000))
TEXTS = [
    (0, "A quick brown fox jumps over the lazy dog and runs away"),
    (1, "A quick brown fox jumps over the lazy dog and runs away"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "é ü 漢字 \U0001f600 naïve"),
    (7, "one two"),
    (7, "one two"),
    (7, "other text under an id that was used"),
    (None, "no id here"),
    (None, "no id here"),
    (None, None),
    (8, "line one\nline two\nline three\nline four"),
    (9, "line one\nline two\nline three\nline five"),
    (10, "!!!"),
]


def rows() -> list[tuple]:
    return [(i, t, "en", "a" if k % 3 else None, 0) + (None,) * (WIDTH - 5) for k, (i, t) in enumerate(TEXTS)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def texts(spark, pairs):
    return spark.createDataFrame(list(pairs), "doc_id bigint, text string")
