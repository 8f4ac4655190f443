"""A corpus of queries and job code, derived from the documents table.

Each document keeps its whole text and gets one statement appended, filled with its own id and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATEMENTS = [
    "SELECT MAP(ARRAY['a', 'b'], ARRAY[{k}, 2]), MAP(), MAP_KEYS(m{k}), map_values(m), MAP_FILTER(m, (k, v) -> v > {n}), "
    "MAP_ENTRIES(m), MAP_CONCAT(m, m2), MAP_FROM_ENTRIES(es) FROM t{k}",
    "SELECT TRANSFORM(arr, x -> x * {k}), filter(arr, y -> y > {n}), CONTAINS(arr, {k}), CARDINALITY(arr), "
    "ARRAY_DISTINCT(arr), ARRAY_JOIN(arr, ','), ARRAY_SORT(arr) FROM t",
    "SELECT ARRAY_POSITION(arr, {k}), ARRAY_REMOVE(arr, 2), ARRAY_MAX(arr), ARRAY_MIN(arr), ELEMENT_AT(arr, 3), "
    "FLATTEN(nested), SEQUENCE(1, {k}), SLICE(arr, 2, 3), CONCAT(a, b) -- array",
    "SELECT ARRAY_UNION(a, b), REDUCE(arr, 0, (s, x) -> s + x, s -> s), tags[{k}], Transform(z, e -> CAST(e AS BIGINT)) FROM t",
    "SELECT DATE_TRUNC('day', ts), DATE_ADD('day', -{k}, ts), DATE_DIFF('day', a, b), DATE_FORMAT(ts, '%Y'), "
    "DATE_PARSE(s, '%Y'), FROM_UNIXTIME({n}), TO_UNIXTIME(ts), NOW(), AT_TIMEZONE(ts, 'UTC') FROM t{k}",
    "SELECT ts + INTERVAL '{k}' DAY, YEAR(ts), MONTH(ts), DAY(ts), hour(ts), MINUTE(ts), SECOND(ts), DAY_OF_WEEK(ts), "
    "DAY_OF_YEAR(ts), WEEK(ts), CURRENT_TIMESTAMP, current_timestamp() FROM t",
    "SELECT TRY_CAST(s AS BIGINT), REGEXP_LIKE(s, 'x'), REGEXP_EXTRACT(s, 'y{k}'), REGEXP_EXTRACT_ALL(s, 'z'), "
    "REGEXP_REPLACE(s, 'a', 'b'), REGEXP_COUNT(s, 'a') FROM t WHERE region = {n}",
    "SELECT APPROX_DISTINCT(u), APPROX_PERCENTILE(x, 0.95), HISTOGRAM(x), ARBITRARY(y), CODEPOINT(c), SPLIT(s, ',', 2), "
    "STRPOS(s, 'a'), CHR(65), REPLACE(s, 'a', 'b'), split(s, ';') FROM t{k}",
    "SELECT REVERSE(s), LPAD(s, 5, '0'), RPAD(s, {k}, '*'), POSITION('a' IN s), YEAR(DATE_ADD('day', 1, ts)) FROM t",
    "SELECT BOOL_AND(b), BOOL_OR(b), COUNT_IF(x > 1), MAX_BY(a, b), MIN_BY(a, b), MAP_AGG(k, v), MULTIMAP_AGG(k, v), "
    "CHECKSUM(x), EVERY(b), COUNT(*) FILTER (WHERE x > {k}) FROM t",
    "SELECT CAST(a AS VARCHAR), CAST(a AS VARCHAR(10)), CAST(a AS INTEGER), CAST(a AS BIGINT), CAST(a AS DOUBLE), "
    "CAST(a AS REAL), CAST(a AS BOOLEAN), CAST(a AS TINYINT), CAST(a AS SMALLINT), CAST(a AS VARBINARY) FROM t{k}",
    "SELECT TRY(CAST(v AS INTEGER)), NVL(a, {k}), NVL2(a, 1, 2), IF(a > {n}, 'x', 'y') FROM t",
    "SELECT JSON_EXTRACT(j, '$.a'), JSON_EXTRACT_SCALAR(j, '$.b'), JSON_ARRAY_LENGTH(j), JSON_PARSE(j), JSON_FORMAT(j), "
    "JSON_ARRAY_GET(j, {k}) FROM t",
    "SELECT NTH_VALUE(x, 2) OVER (w), ROW_NUMBER() OVER (w), CUME_DIST( ) OVER (w), NTILE({k}) OVER (w) FROM t",
    "SELECT * FROM UNNEST(arr) WITH ORDINALITY AS t(v, o) CROSS JOIN UNNEST(items) AS u(item), LATERAL (SELECT {k}); "
    "INSERT INTO t VALUES (1), (2), ({k})",
    "SELECT BITWISE_AND(a, {k}), BITWISE_OR(a, b), BITWISE_XOR(a, b), BITWISE_NOT(a), BIT_COUNT(a, 64) FROM t",
    "SELECT INFINITY(), NAN(), IS_FINITE(x), IS_NAN(x), TRUNCATE(x), RANDOM(), TO_BASE({k}, 16), MOD(a, 3), CBRT(x), LOG2({n}) FROM t",
    "SELECT UUID(), FROM_HEX(h), TO_HEX(b), URL_EXTRACT_HOST(u), URL_EXTRACT_PATH(u), URL_EXTRACT_PARAMETER(u, 'p{k}') FROM t",
    "SELECT a || b || ' ' FROM t WHERE region = '{k}' AND UPPER(status) = 'A' OR status = region2 AND Region <> status",
    "from airflow.providers.amazon.aws.operators.emr_add_steps import EmrAddStepsOperator\n"
    "from airflow.providers.amazon.aws.operators.athena import AthenaOperator\n"
    "load = AthenaOperator(task_id='t{k}', output='s3://lake/out-{k}/')\nkeep = MyAthenaOperatorX('s3://lake/raw.{n}')",
    "import boto3\nclient = boto3.client('athena')\nschema = StructField('m', MapType(k, v))  # map {k}\n"
    "wait = S3KeySensor(key=\"s3://lake/in_{n}\")",
    "const f{k} = (x) => JSON.parse(x)",
    "no statement {k}",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


CORPUS_SQL = f"""
SELECT doc_id, source, lang, n_chars, source || '/' || doc_id || '.sql' AS path, text || chr(10) ||
  replace(replace([{", ".join(_quoted(s) for s in STATEMENTS)}][doc_id % {len(STATEMENTS)} + 1],
          '{{k}}', CAST(doc_id AS VARCHAR)), '{{n}}', CAST(n_chars AS VARCHAR)) AS content
FROM documents
"""


def corpus(documents: DataFrame) -> DataFrame:
    statement = F.array(*[F.lit(s) for s in STATEMENTS])[(F.col("doc_id") % len(STATEMENTS)).cast("int")]
    filled = F.replace(
        F.replace(statement, F.lit("{k}"), F.col("doc_id").cast("string")), F.lit("{n}"), F.col("n_chars").cast("string")
    )
    # a table may be one row group, and many patterns per text cost far more than a shuffle
    width = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.repartition(width).select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("path"),
        F.concat("text", F.lit("\n"), filled).alias("content"),
    )
