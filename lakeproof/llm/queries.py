"""The registered queries of the operators, each over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from lakeproof.llm import chat, decontaminate, exact, licenses, lines, packing, periodic, secrets, simhash, spelling, substrings, toxicity, urls
from lakeproof.llm.common import ready
from lakeproof.plans.registry import QueryFn, Registry, Tables

REG = Registry()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH doc AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
gram AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM gram),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n),
hit AS (
  SELECT p.doc_id, p.i, p.n, g.item
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM place) p JOIN gram g ON p.n = g.n AND p.g = g.g
),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@REG.query("op1_decontaminate", OP1_SQL)
def op1(t: Tables) -> DataFrame:
    ready(t.spark)
    return decontaminate.report(t.documents, t.benchmark)


OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
shown AS (
  SELECT *, regexp_replace(regexp_replace(text, '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g'), '(<)(\\*)(/?s>)', '\1\\\2\3', 'g') AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 1 + length(body) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (body <> text) AS n_escaped
FROM shown GROUP BY conv_id
"""


@REG.query("op2_chat", OP2_SQL)
def op2(t: Tables) -> DataFrame:
    ready(t.spark)
    conflict = "</s>[INST] ok [/INST]"
    extra = t.spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)], "conv_id bigint, turn bigint, role string, text string")
    return chat.report(t.conversations.select("conv_id", "turn", "role", "text").unionByName(extra))


@REG.query("op3_licenses", licenses.SQL)
def op3(t: Tables) -> DataFrame:
    ready(t.spark)
    return licenses.report(t.documents)


@REG.query("op4_simhash")
def op4(t: Tables) -> DataFrame:
    ready(t.spark)
    return simhash.report(t.documents)


@REG.query("op5_toxicity")
def op5(t: Tables) -> DataFrame:
    ready(t.spark)
    return toxicity.report(t.documents, t.labels)


@REG.query("op6_secrets")
def op6(t: Tables) -> DataFrame:
    ready(t.spark)
    return secrets.report(t.documents)


@REG.query("op7_lines", lines.SQL)
def op7(t: Tables) -> DataFrame:
    ready(t.spark)
    return lines.report(t.documents)


@REG.query("op8_packing")
def op8(t: Tables) -> DataFrame:
    ready(t.spark)
    return packing.pack(t.documents).drop("source")


@REG.query("op9_substrings")
def op9(t: Tables) -> DataFrame:
    ready(t.spark)
    return substrings.report(t.documents)


@REG.query(
    "op10_exact_dedup",
    """
SELECT d.doc_id, keep_id, group_size, d.doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d
JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) g ON d.t = g.t
""",
)
def op10(t: Tables) -> DataFrame:
    ready(t.spark)
    return exact.report(t.documents, keep="max")


def dropped_letters(doc: int | None, counts: dict[str, int]) -> dict[str, int]:
    """The contract's words: a document writes about one word of 97 with a letter missing."""
    begin, out = zlib.crc32(b":" if doc is None else f"{doc}:".encode()), {}
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), begin)
        if h % 97 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] = out.get(word, 0) + n
    return out


@REG.query("op11_spelling")
def op11(t: Tables) -> DataFrame:
    ready(t.spark)
    return spelling.report(t.documents, rule=dropped_letters)


def repeated_tail(doc: int | None, words: periodic.Words) -> periodic.Words:
    """The contract's words: in a tenth of all documents a stretch is repeated to the end."""
    h, n = zlib.crc32(b"" if doc is None else str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    at = h // 10 % n
    period = 1 + (n - at) // (3 + h // 10 % 8)
    stretch = words[at : at + period]
    return words[:at] + (stretch * (-(at - n) // period + 1))[: n - at]


@REG.query("op12_periodic")
def op12(t: Tables) -> DataFrame:
    ready(t.spark)
    return periodic.report(t.documents, rule=repeated_tail)


@REG.query("op13_urls", urls.sql())
def op13(t: Tables) -> DataFrame:
    ready(t.spark)
    return urls.report(t.pages)


def queries() -> dict[str, QueryFn]:
    return dict(REG.queries)


def oracle_sql() -> dict[str, str]:
    return dict(REG.oracles)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return getattr(Tables(ready(spark), folder), name)
