"""One query per function of the rule library, each over a whole table.

Collections are rendered as text, so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeproof.functions import aggregates as a
from lakeproof.functions import collections as c
from lakeproof.functions import scalars as s
from lakeproof.functions import tables as tb
from lakeproof.functions import temporal as t
from lakeproof.functions import text as x
from lakeproof.functions import windows as w
from lakeproof.plans.registry import Registry, Tables

REG = Registry()
col, lit = F.col, F.lit


def scalar(rule: str, table: str, key: str, expr: Callable[[], Column], sql: str) -> None:
    REG.add(
        f"fn_{rule}",
        lambda tables: getattr(tables, table).select(key, expr().alias("value")),
        f"SELECT {key}, {sql} AS value FROM {table}",
    )


def listed(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda e: e.cast("string")), ",", "null")


def listed_sql(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda e: coalesce(CAST(e AS VARCHAR), 'null')), ',')"


def entries(m: Column) -> Column:
    """Map entries sorted by key, as text."""
    pairs = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"].cast("string"), lit("="), e["value"].cast("string"))), ",")


def entries_sql(m: str) -> str:
    return (
        f"array_to_string(list_transform(list_sort(map_entries({m})), "
        "lambda e: CAST(e.key AS VARCHAR) || '=' || CAST(e.value AS VARCHAR)), ',')"
    )


# -- maps and lambdas over part and lineitem ------------------------------------------------------

part_arr = lambda: F.array(col("p_size").cast("bigint"), F.pmod("p_partkey", lit(7)), lit(2).cast("bigint"), col("p_size").cast("bigint"))
part_arr2 = lambda: F.array(F.pmod("p_partkey", lit(5)), lit(2).cast("bigint"))
PART_ARR = "[CAST(p_size AS BIGINT), p_partkey % 7, CAST(2 AS BIGINT), CAST(p_size AS BIGINT)]"
PART_ARR2 = "[p_partkey % 5, CAST(2 AS BIGINT)]"
part_map = lambda: F.map_from_arrays(F.array(lit("size"), lit("key")), F.array(col("p_size").cast("bigint"), col("p_partkey")))
PART_MAP = "MAP(['size', 'key'], [CAST(p_size AS BIGINT), p_partkey])"
part_map2 = lambda: F.map_from_arrays(F.array(lit("key"), lit("rest")), F.array(lit(-1).cast("bigint"), F.pmod("p_partkey", lit(5))))
PART_MAP2 = "MAP(['key', 'rest'], [CAST(-1 AS BIGINT), p_partkey % 5])"

scalar("map_constructor_to_struct", "part", "p_partkey", lambda: entries(part_map()), entries_sql(PART_MAP))
scalar("map_constructor_empty", "part", "p_partkey",
       lambda: F.cardinality(c.map_concat(c.empty_map("string", "bigint"), part_map())).cast("bigint"),
       f"CAST(cardinality(map_concat(MAP([]::VARCHAR[], []::BIGINT[]), {PART_MAP})) AS BIGINT)")
scalar("transform_array", "part", "p_partkey", lambda: listed(F.transform(part_arr(), lambda e: e * 2)),
       listed_sql(f"list_transform({PART_ARR}, lambda e: e * 2)"))
scalar("transform_nested", "part", "p_partkey",
       lambda: F.array_join(c.array_transform_cast(part_arr(), "string"), "/"),
       f"array_to_string(list_transform({PART_ARR}, lambda e: CAST(e AS VARCHAR)), '/')")
scalar("filter_array", "part", "p_partkey", lambda: listed(F.filter(part_arr(), lambda e: e > 3)),
       listed_sql(f"list_filter({PART_ARR}, lambda e: e > 3)"))

# -- dates and times over events and orders -------------------------------------------------------

scalar("date_trunc", "events", "event_id", lambda: t.date_trunc("week", col("ts")), "date_trunc('week', ts)")
scalar("date_add", "events", "event_id", lambda: t.date_add("day", 7, col("ts")), "ts + INTERVAL 7 DAY")
scalar("date_diff", "events", "event_id",
       lambda: t.date_diff("hour", col("ts"), lit("2024-02-01 00:00:00").cast("timestamp_ntz")),
       "date_sub('hour', ts, TIMESTAMP '2024-02-01 00:00:00')")
scalar("date_format", "events", "event_id", lambda: t.date_format(col("ts"), "%Y-%m-%d at %H:%i:%s"),
       "strftime(ts, '%Y-%m-%d at %H:%M:%S')")
scalar("date_parse", "events", "event_id",
       lambda: t.date_parse(F.when(col("event_type") == "error", "unknown").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")), "%d/%m/%Y %H:%i:%s"),
       "CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END")
scalar("from_unixtime", "events", "event_id", lambda: t.from_unixtime(col("event_id") * 1000).cast("timestamp_ntz"),
       "make_timestamp(event_id * 1000 * 1000000)")
scalar("to_unixtime", "events", "event_id", lambda: t.to_unixtime(col("ts")), "epoch_us(ts) / 1e6")
scalar("now_function", "events", "event_id", lambda: t.now() > col("ts").cast("timestamp"),
       "CAST(now() AS TIMESTAMP) > ts")
scalar("at_timezone", "events", "event_id", lambda: t.at_timezone(col("ts"), "America/New_York"),
       "(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'")
scalar("interval_quoted", "events", "event_id", lambda: t.plus_interval(col("ts"), 1, "DAY"), "ts + INTERVAL '1' DAY")
for _rule, _fn, _sql in [
    ("year_extract", t.year, "year(ts)"),
    ("month_extract", t.month, "month(ts)"),
    ("day_extract", t.day, "day(ts)"),
    ("hour_extract", t.hour, "hour(ts)"),
    ("minute_extract", t.minute, "minute(ts)"),
    ("second_extract", t.second, "second(ts)"),
    ("day_of_week_extract", t.day_of_week, "isodow(ts)"),
    ("day_of_year_extract", t.day_of_year, "dayofyear(ts)"),
]:
    scalar(_rule, "events", "event_id", lambda f=_fn: f(col("ts")).cast("bigint"), f"CAST({_sql} AS BIGINT)")
scalar("week_extract", "orders", "o_orderkey", lambda: t.week(col("o_orderdate")).cast("bigint"),
       "CAST(weekofyear(o_orderdate) AS BIGINT)")
scalar("date_sub", "orders", "o_orderkey",
       lambda: F.date_format(t.date_sub(7, col("o_orderdate").cast("date")), "yyyy-MM-dd"),
       "strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d')")

# -- patterns and strings over documents, pages and part ------------------------------------------

props_digits = lambda: F.substring("props", 7, 2)
scalar("try_cast", "events", "event_id", lambda: s.try_cast(props_digits(), "int").cast("string"),
       "CAST(TRY_CAST(substr(props, 7, 2) AS INTEGER) AS VARCHAR)")
scalar("regexp_like", "documents", "doc_id", lambda: x.regexp_like(col("text"), "[A-Z][a-z]+ing "),
       "regexp_matches(text, '[A-Z][a-z]+ing ')")
scalar("regexp_extract", "documents", "doc_id", lambda: x.regexp_extract(col("text"), "[a-z]+ing "),
       "NULLIF(regexp_extract(text, '[a-z]+ing '), '')")
scalar("regexp_extract_all", "documents", "doc_id",
       lambda: F.array_join(x.regexp_extract_all(col("text"), "[A-Z][a-z]+"), ","),
       "array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), ',')")
scalar("regexp_replace", "documents", "doc_id", lambda: F.md5(x.regexp_replace(col("text"), "[aeiou]+", "_")),
       "md5(regexp_replace(text, '[aeiou]+', '_', 'g'))")
scalar("regexp_count", "documents", "doc_id", lambda: x.regexp_count(col("text"), "[a-z]+").cast("bigint"),
       "CAST(len(regexp_extract_all(text, '[a-z]+')) AS BIGINT)")
scalar("codepoint", "documents", "doc_id", lambda: x.codepoint(col("text")).cast("bigint"), "CAST(unicode(text) AS BIGINT)")
scalar("split_with_limit", "pages", "page_id",
       lambda: F.concat(F.size(x.split(col("url"), "/", 4)).cast("string"), lit(" "), F.array_join(x.split(col("url"), "/", 4), " | ")),
       """CASE WHEN len(string_split(url, '/')) <= 4
          THEN CAST(len(string_split(url, '/')) AS VARCHAR) || ' ' || array_to_string(string_split(url, '/'), ' | ')
          ELSE '4 ' || array_to_string(string_split(url, '/')[1:3], ' | ') || ' | ' || array_to_string(string_split(url, '/')[4:], '/') END""")  # fmt: skip
scalar("strpos", "documents", "doc_id", lambda: x.strpos(col("text"), "the").cast("bigint"), "CAST(strpos(text, 'the') AS BIGINT)")
scalar("chr", "part", "p_partkey", lambda: x.chr(col("p_partkey") + 200), "chr(CAST(p_partkey + 200 AS INTEGER))")
scalar("replace_function", "documents", "doc_id", lambda: F.md5(x.replace(col("text"), "the", "THE")),
       "md5(replace(text, 'the', 'THE'))")
scalar("split_basic", "documents", "doc_id", lambda: F.size(x.split(col("text"), ".")).cast("bigint"),
       "CAST(len(string_split(text, '.')) AS BIGINT)")
scalar("reverse_string", "part", "p_partkey", lambda: x.reverse(col("p_name")), "reverse(p_name)")
scalar("lpad", "part", "p_partkey", lambda: x.lpad(col("p_name"), 11, "*"), "lpad(p_name, 11, '*')")
scalar("rpad", "part", "p_partkey", lambda: x.rpad(col("p_name"), 11, "*"), "rpad(p_name, 11, '*')")
scalar("position_function", "documents", "doc_id", lambda: x.position("ing", col("text")).cast("bigint"),
       "CAST(position('ing' IN text) AS BIGINT)")

# -- arrays over part -----------------------------------------------------------------------------

scalar("contains_function", "part", "p_partkey", lambda: F.array_contains(part_arr(), 5), f"list_contains({PART_ARR}, 5)")
scalar("map_keys", "part", "p_partkey", lambda: listed(F.array_sort(F.map_keys(part_map()))), listed_sql(f"list_sort(map_keys({PART_MAP}))"))
scalar("map_values", "part", "p_partkey", lambda: listed(F.array_sort(F.map_values(part_map()))), listed_sql(f"list_sort(map_values({PART_MAP}))"))
scalar("cardinality", "documents", "doc_id", lambda: F.cardinality(F.split("text", " ")).cast("bigint"),
       "CAST(len(string_split(text, ' ')) AS BIGINT)")
scalar("array_distinct", "documents", "doc_id", lambda: F.cardinality(F.array_distinct(F.split("text", " "))).cast("bigint"),
       "CAST(len(list_distinct(string_split(text, ' '))) AS BIGINT)")
scalar("array_join", "documents", "doc_id", lambda: F.md5(F.array_join(F.split("text", " "), " | ")),
       "md5(array_to_string(string_split(text, ' '), ' | '))")
scalar("array_sort", "part", "p_partkey", lambda: listed(F.array_sort(part_arr())), listed_sql(f"list_sort({PART_ARR})"))
scalar("array_position", "part", "p_partkey", lambda: F.array_position(part_arr(), 5).cast("bigint"),
       f"CAST(coalesce(list_position({PART_ARR}, 5), 0) AS BIGINT)")
scalar("array_remove", "part", "p_partkey", lambda: listed(F.array_remove(part_arr(), 2)),
       listed_sql(f"list_filter({PART_ARR}, lambda e: e <> 2)"))
# every fifth part has an unknown element
gapped = lambda: F.when(F.pmod("p_partkey", lit(5)) == 0, F.array_append(part_arr(), lit(None).cast("bigint"))).otherwise(part_arr())
scalar("array_max", "part", "p_partkey", lambda: c.array_max(gapped()), f"CASE WHEN p_partkey % 5 <> 0 THEN list_max({PART_ARR}) END")
scalar("array_min", "part", "p_partkey", lambda: c.array_min(gapped()), f"CASE WHEN p_partkey % 5 <> 0 THEN list_min({PART_ARR}) END")
scalar("element_at", "documents", "doc_id", lambda: c.element_at(F.split("text", " "), 40), "string_split(text, ' ')[40]")
scalar("flatten", "part", "p_partkey", lambda: listed(F.flatten(F.array(part_arr(), part_arr2()))),
       listed_sql(f"flatten([{PART_ARR}, {PART_ARR2}])"))
scalar("sequence", "part", "p_partkey", lambda: listed(F.sequence(lit(1), col("p_size"))), listed_sql("generate_series(1, p_size)"))
scalar("slice", "part", "p_partkey", lambda: listed(F.slice(part_arr(), 2, 2)), listed_sql(f"{PART_ARR}[2:3]"))
scalar("array_concat", "part", "p_partkey", lambda: listed(F.concat(part_arr(), part_arr2())),
       listed_sql(f"list_concat({PART_ARR}, {PART_ARR2})"))
scalar("array_union", "part", "p_partkey", lambda: listed(F.array_sort(F.array_union(part_arr(), part_arr2()))),
       listed_sql(f"list_sort(list_distinct(list_concat({PART_ARR}, {PART_ARR2})))"))
scalar("reduce_agg", "part", "p_partkey", lambda: F.aggregate(part_arr(), lit(0).cast("bigint"), lambda acc, e: acc + e),
       f"CAST(list_sum({PART_ARR}) AS BIGINT)")

# -- aggregates over events and lineitem ----------------------------------------------------------


def aggregate(rule: str, table: str, key: str, expr: Callable[[], Column], sql: str) -> None:
    REG.add(
        f"fn_{rule}",
        lambda tables: getattr(tables, table).groupBy(key).agg(expr().alias("value")),
        f"SELECT {key}, {sql} AS value FROM {table} GROUP BY {key}",
    )


aggregate("arbitrary", "lineitem", "l_orderkey", lambda: a.arbitrary(col("l_orderkey") + 1), "any_value(l_orderkey + 1)")
aggregate("bool_and", "lineitem", "l_orderkey", lambda: a.bool_and(col("l_quantity") > 5), "bool_and(l_quantity > 5)")
aggregate("bool_or", "lineitem", "l_orderkey", lambda: a.bool_or(col("l_quantity") > 45), "bool_or(l_quantity > 45)")
aggregate("every_agg", "lineitem", "l_suppkey", lambda: a.every(col("l_discount") <= 0.1), "bool_and(l_discount <= 0.1)")
aggregate("count_if", "lineitem", "l_returnflag", lambda: a.count_if(col("l_tax") > 0.04), "CAST(count_if(l_tax > 0.04) AS BIGINT)")
aggregate("count_star_filter", "lineitem", "l_linestatus", lambda: a.count_star_filter(col("l_quantity") > 25),
          "count(*) FILTER (WHERE l_quantity > 25)")
aggregate("max_by", "events", "user_id", lambda: a.max_by(col("event_id"), F.struct("value", "event_id")),
          "max_by(event_id, {'v': value, 'e': event_id})")
aggregate("min_by", "events", "user_id", lambda: a.min_by(col("event_id"), F.struct("value", "event_id")),
          "min_by(event_id, {'v': value, 'e': event_id})")


@REG.query(
    "fn_approx_distinct",
    "SELECT event_type, count(DISTINCT user_id) AS distinct_users, true AS within_bound FROM events GROUP BY 1",
)
def _approx_distinct(tables: Tables):
    # the estimate beside its exact twin: the standard error is 2.3 %, the bound here four times that
    # (in one aggregate, the sketch would travel once per user beside the exact count)
    events = tables.events.groupBy("event_type")
    exact = events.agg(F.count_distinct("user_id").alias("distinct_users"))
    return (
        exact.join(events.agg(a.approx_distinct(col("user_id")).alias("estimate")), "event_type")
        .select("event_type", "distinct_users", (F.abs(col("estimate") - col("distinct_users")) <= 0.092 * col("distinct_users")).alias("within_bound"))
    )


@REG.query(
    "fn_approx_percentile",
    """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
                        count(*) OVER (PARTITION BY event_type) AS n FROM events),
       e AS (SELECT event_type, count(*) AS n, min(CASE WHEN rn >= ceil(0.95 * n) THEN value END) AS exact_p95
             FROM v GROUP BY 1)
       SELECT event_type, n, true AS within_bound FROM e""",
)
def _approx_percentile(tables: Tables):
    # rank error is at most n / accuracy: at least 95 % - 0.05 % and at most 95 % + 0.05 % of rows lie below
    events = tables.events
    estimate = events.groupBy("event_type").agg(a.approx_percentile(col("value"), 0.95, 10000).alias("p95"))
    return (
        events.join(estimate, "event_type")
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.avg((col("value") < col("p95")).cast("double")).alias("below"),
            F.avg((col("value") <= col("p95")).cast("double")).alias("up_to"),
        )
        .select("event_type", "n", ((col("below") <= 0.9505) & (col("up_to") >= 0.9495)).alias("within_bound"))
    )


@REG.query(
    "fn_histogram",
    f"""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, {entries_sql("MAP(list(event_type ORDER BY event_type), list(n ORDER BY event_type))")} AS value
        FROM n GROUP BY 1""",
)
def _histogram(tables: Tables):
    return a.histogram(tables.events, ["user_id"], "event_type").select("user_id", entries(col("histogram")).alias("value"))


@REG.query(
    "fn_map_agg",
    f"""WITH n AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS v FROM lineitem GROUP BY 1, 2)
        SELECT l_orderkey, {entries_sql("MAP(list(l_linenumber ORDER BY l_linenumber), list(v ORDER BY l_linenumber))")} AS value
        FROM n GROUP BY 1""",
)
def _map_agg(tables: Tables):
    return a.map_agg(tables.lineitem, ["l_orderkey"], "l_linenumber", "l_partkey").select("l_orderkey", entries(col("map")).alias("value"))


@REG.query(
    "fn_multimap_agg",
    """WITH n AS (SELECT l_orderkey, l_linenumber, string_agg(CAST(l_partkey AS VARCHAR), '/' ORDER BY l_partkey) AS v
                  FROM lineitem GROUP BY 1, 2)
       SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || '=' || v, ',' ORDER BY l_linenumber) AS value
       FROM n GROUP BY 1""",
)
def _multimap_agg(tables: Tables):
    texts = F.transform_values("map", lambda _k, v: F.array_join(F.transform(v, lambda e: e.cast("string")), "/"))
    return a.multimap_agg(tables.lineitem, ["l_orderkey"], "l_linenumber", "l_partkey").select(
        "l_orderkey", entries(texts).alias("value")
    )


@REG.query(
    "fn_checksum",
    """SELECT event_type, count(*) AS rows, event_type <> 'error' AS same FROM events GROUP BY 1""",
)
def _checksum(tables: Tables):
    # checksums of the value column against a copy in another order with one type changed
    events = tables.events
    copy = events.withColumn("value", F.when(col("event_type") == "error", col("value") + 1).otherwise(col("value")))
    first = events.groupBy("event_type").agg(*a.checksum(col("value")))
    second = copy.groupBy("event_type").agg(*a.checksum(col("value")))
    parts = ["rows", "xor", "sum_low", "sum_mid", "sum_high"]
    both = first.join(second.select("event_type", *[col(p).alias(f"other_{p}") for p in parts]), "event_type")
    same = lit(True)
    for p in parts:
        same = same & (col(p) == col(f"other_{p}"))
    return both.select("event_type", "rows", same.alias("same"))


# -- casts over events, orders and part -----------------------------------------------------------

scalar("cast_varchar", "events", "event_id", lambda: s.cast_varchar(col("user_id")), "CAST(user_id AS VARCHAR)")
scalar("cast_varchar_n", "documents", "doc_id", lambda: s.cast_varchar(col("text"), 10), "left(CAST(text AS VARCHAR), 10)")
# whole numbers from text, and numbers with a fraction of either sign, which are rounded half away from zero
_HALF_AWAY = lambda v: f"CASE WHEN {v} < 0 THEN -floor(0.5 - ({v})) ELSE floor(({v}) + 0.5) END"
_tenths = lambda column, shift: (col(column) / lit(10).cast("decimal(4,0)") - lit(shift)).cast("decimal(20,1)")
scalar("cast_integer", "events", "event_id",
       lambda: s.cast_integer(col("user_id").cast("string")) * 1000 + s.cast_integer(col("value") - 20.0) + s.cast_integer(_tenths("event_id", 500)),
       f"CAST(CAST(user_id AS VARCHAR) AS INTEGER) * 1000 + CAST({_HALF_AWAY('CAST(CAST(value - 20.0 AS VARCHAR) AS DECIMAL(38,18))')} AS INTEGER) "
       f"+ CAST({_HALF_AWAY('CAST(event_id AS DECIMAL(20,1)) / 10 - 500')} AS INTEGER)")  # fmt: skip
scalar("cast_bigint", "events", "event_id",
       lambda: s.cast_bigint(F.concat(col("user_id").cast("string"), lit("000000000000"))) + s.cast_bigint(_tenths("event_id", 500)),
       f"CAST(CAST(user_id AS VARCHAR) || '000000000000' AS BIGINT) + CAST({_HALF_AWAY('CAST(event_id AS DECIMAL(20,1)) / 10 - 500')} AS BIGINT)")
scalar("cast_double", "orders", "o_orderkey", lambda: s.cast_double(F.concat(col("o_custkey").cast("string"), lit(".25"))),
       "CAST(CAST(o_custkey AS VARCHAR) || '.25' AS DOUBLE)")
scalar("cast_real", "orders", "o_orderkey", lambda: s.cast_real(F.concat(col("o_custkey").cast("string"), lit(".1"))).cast("double"),
       "CAST(CAST(CAST(o_custkey AS VARCHAR) || '.1' AS REAL) AS DOUBLE)")
scalar("cast_boolean", "orders", "o_orderkey",
       lambda: s.cast_boolean(F.when(col("o_orderstatus") == "F", "true").otherwise("false")),
       "CAST(CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS BOOLEAN)")
scalar("cast_tinyint", "part", "p_partkey",
       lambda: s.cast_tinyint(col("p_size").cast("string")).cast("int") * 1000 + s.cast_tinyint(_tenths("p_size", 3)).cast("int"),
       f"CAST(CAST(CAST(p_size AS VARCHAR) AS TINYINT) AS INTEGER) * 1000 + CAST({_HALF_AWAY('CAST(p_size AS DECIMAL(20,1)) / 10 - 3')} AS INTEGER)")
scalar("cast_smallint", "part", "p_partkey",
       lambda: s.cast_smallint(F.concat(col("p_size").cast("string"), lit("7"))).cast("int") * 1000 + s.cast_smallint(_tenths("p_size", 3)).cast("int"),
       f"CAST(CAST(CAST(p_size AS VARCHAR) || '7' AS SMALLINT) AS INTEGER) * 1000 + CAST({_HALF_AWAY('CAST(p_size AS DECIMAL(20,1)) / 10 - 3')} AS INTEGER)")
scalar("cast_varbinary", "part", "p_partkey", lambda: F.hex(s.cast_varbinary(col("p_name"))), "hex(encode(p_name))")

# -- conditionals and JSON over events ------------------------------------------------------------

scalar("try_function", "lineitem", "l_orderkey", lambda: s.try_divide(col("l_linenumber"), F.when(col("l_linenumber") > 3, 0).otherwise(2)),
       "CASE WHEN l_linenumber > 3 THEN NULL ELSE l_linenumber / 2.0 END")
scalar("nvl_function", "events", "event_id", lambda: s.nvl(s.try_cast(props_digits(), "int"), lit(0)),
       "coalesce(TRY_CAST(substr(props, 7, 2) AS INTEGER), 0)")
scalar("nvl2_function", "events", "event_id", lambda: s.nvl2(s.try_cast(props_digits(), "int"), lit("two digits"), lit("one digit")),
       "CASE WHEN TRY_CAST(substr(props, 7, 2) AS INTEGER) IS NOT NULL THEN 'two digits' ELSE 'one digit' END")
scalar("if_function", "events", "event_id", lambda: s.if_(col("value") > 50, "high", "low"),
       "CASE WHEN value > 50 THEN 'high' ELSE 'low' END")

event_json = lambda: F.concat(
    lit('{"u":'), col("user_id").cast("string"), lit(',"t":["'), col("event_type"), lit('",'), col("event_id").cast("string"),
    lit('],"p":'), col("props"), lit("}")
)
EVENT_JSON = """'{"u":' || user_id || ',"t":["' || event_type || '",' || event_id || '],"p":' || props || '}'"""
scalar("json_extract", "events", "event_id", lambda: s.json_extract(event_json(), "$.p"), "replace(props, ' ', '')")
scalar("json_extract_scalar", "events", "event_id",
       lambda: F.concat_ws("/", s.json_extract_scalar(event_json(), "$.u"), F.coalesce(s.json_extract_scalar(event_json(), "$.p"), lit("none")), s.json_extract_scalar(event_json(), "$.t[0]")),
       f"json_extract_string({EVENT_JSON}, '$.u') || '/none/' || json_extract_string({EVENT_JSON}, '$.t[0]')")
scalar("json_array_length", "events", "event_id", lambda: s.json_array_length(F.get_json_object(event_json(), "$.t")).cast("bigint"),
       f"CAST(json_array_length({EVENT_JSON}, '$.t') AS BIGINT)")
broken_json = lambda: F.when(col("event_type") == "error", F.substring("props", 1, 5)).otherwise(col("props"))
scalar("json_parse", "events", "event_id", lambda: F.coalesce(F.try_variant_get(s.json_parse(broken_json()), "$.k", "bigint"), lit(-1)),
       "CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END")
scalar("json_format", "events", "event_id", lambda: s.json_format(s.json_parse(col("props"))), "replace(props, ' ', '')")
scalar("json_array_get", "events", "event_id",
       lambda: F.concat_ws("/", *[F.coalesce(s.json_array_get(F.get_json_object(event_json(), "$.t"), i), lit("none")) for i in (1, -1, -9, 99)]),
       f"concat_ws('/', coalesce(json_extract_string({EVENT_JSON}, '$.t[1]'), 'none'), coalesce(json_extract_string({EVENT_JSON}, '$.t[#-1]'), 'none'), 'none', 'none')")

# -- windows: event types are few and hot; beyond a size they are ranked minute by minute ------------------------------

_RANK_SQL = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"


def ranked_events(tables: Tables):
    events = tables.events.select("event_id", "event_type", "ts", "value")
    return w.ranked(events, ["event_type"], ["ts", "event_id"], F.date_trunc("minute", "ts"))


REG.add("fn_row_number", lambda tables: ranked_events(tables).select("event_id", w.row_number().alias("value")),
        f"SELECT event_id, row_number() {_RANK_SQL} AS value FROM events")
REG.add("fn_cume_dist", lambda tables: ranked_events(tables).select("event_id", w.cume_dist().alias("value")),
        f"SELECT event_id, cume_dist() {_RANK_SQL} AS value FROM events")
REG.add("fn_ntile", lambda tables: ranked_events(tables).select("event_id", w.ntile(4).cast("bigint").alias("value")),
        f"SELECT event_id, ntile(4) {_RANK_SQL} AS value FROM events")
REG.add("fn_nth_value",
        lambda tables: w.with_nth_value(ranked_events(tables), ["event_type"], "event_id", 2, "nth").select("event_id", col("nth").cast("string").alias("value")),
        f"SELECT event_id, CAST(nth_value(event_id, 2) {_RANK_SQL} AS VARCHAR) AS value FROM events")

# -- table functions --------------------------------------------------------------------------------

REG.add("fn_unnest_with_ordinality",
        lambda tables: tb.unnest_with_ordinality(tables.part, F.split("p_name", " "), "word").select("p_partkey", col("ord").cast("bigint").alias("ord"), "word"),
        """SELECT p_partkey, CAST(u.i AS BIGINT) AS ord, string_split(p_name, ' ')[u.i] AS word
           FROM part, LATERAL (SELECT unnest(generate_series(1, len(string_split(p_name, ' ')))) AS i) u""")  # fmt: skip
REG.add("fn_cross_join_unnest_aliased",
        lambda tables: tb.unnest(tables.documents, F.split("text", "\n"), "line").groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("line")).cast("bigint").alias("longest")),
        """SELECT doc_id, count(*) AS lines, CAST(max(length(line)) AS BIGINT) AS longest
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")  # fmt: skip


@REG.query(
    "fn_values_clause",
    """SELECT o_orderkey, v.label FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) AS v(code, label)
       ON o_orderstatus = v.code""",
)
def _values(tables: Tables):
    orders = tables.orders
    labels = tb.values(orders, [("F", "finished"), ("O", "open"), ("P", "pending")], "code string, label string")
    return orders.join(F.broadcast(labels), col("o_orderstatus") == col("code")).select("o_orderkey", "label")  # three rows


_LATERAL = "SELECT o_orderkey, z.net AS net FROM orders, LATERAL (SELECT round(o_totalprice * 2, 2) AS net) z"
REG.add("fn_lateral_subquery",
        lambda tables: tb.lateral(tables.orders, tables.spark.sql("SELECT 1").select(F.round(col("o_totalprice").outer() * 2, 2).alias("net"))).select("o_orderkey", "net"),
        _LATERAL)

# -- bits and numbers -------------------------------------------------------------------------------

scalar("bitwise_and", "events", "event_id", lambda: s.bitwise_and(col("user_id"), 12), "user_id & 12")
scalar("bitwise_or", "events", "event_id", lambda: s.bitwise_or(col("user_id"), 12), "user_id | 12")
scalar("bitwise_xor", "events", "event_id", lambda: s.bitwise_xor(col("user_id"), 12), "xor(user_id, 12)")
scalar("bitwise_not", "events", "event_id", lambda: s.bitwise_not(col("user_id")), "~user_id")
scalar("bit_count", "events", "event_id", lambda: s.bit_count(-col("event_id"), 64).cast("bigint"), "CAST(bit_count(-event_id) AS BIGINT)")
odd_value = lambda: s.if_(col("event_type") == "error", s.infinity(), s.if_(col("event_type") == "click", s.nan(), col("value") - 20))
ODD_VALUE = "(CASE event_type WHEN 'error' THEN 'inf'::DOUBLE WHEN 'click' THEN 'nan'::DOUBLE ELSE value - 20 END)"
scalar("infinity", "events", "event_id", lambda: odd_value() == s.infinity(), f"{ODD_VALUE} = 'inf'::DOUBLE")
scalar("nan", "events", "event_id", lambda: s.is_nan(s.if_(col("value") > 50, s.nan(), col("value"))), "value > 50")
scalar("is_finite", "events", "event_id", lambda: s.is_finite(odd_value()), f"isfinite({ODD_VALUE})")
scalar("is_nan", "events", "event_id", lambda: s.is_nan(odd_value()), f"isnan({ODD_VALUE})")
scalar("truncate", "events", "event_id",
       lambda: s.truncate((col("value") - 20) * F.when(col("event_type") == "error", lit(1e30)).when(col("event_type") != "click", lit(1.0))),
       "trunc((value - 20) * CASE WHEN event_type = 'error' THEN 1e30 WHEN event_type <> 'click' THEN 1.0 END)")
scalar("to_base", "events", "event_id",
       lambda: s.to_base(F.when(col("event_type") == "error", -col("event_id")).when(col("event_type") != "click", col("event_id")), 16),
       "CASE WHEN event_type = 'error' AND event_id > 0 THEN '-' WHEN event_type = 'click' THEN NULL ELSE '' END || lower(to_base(event_id, 16))")
scalar("mod_function", "events", "event_id", lambda: s.mod(-col("event_id"), 3), "-event_id % 3")
scalar("cbrt", "orders", "o_orderkey", lambda: F.round(s.cbrt(col("o_totalprice")), 6), "round(cbrt(o_totalprice), 6)")
scalar("log2", "orders", "o_orderkey", lambda: F.round(s.log2(col("o_totalprice")), 6), "round(log2(o_totalprice), 6)")

# values drawn per row have no oracle value; type, range and number of rows have
REG.add("fn_random",
        lambda tables: tables.events.select("event_type", s.random().alias("r")).groupBy("event_type").agg(F.count("*").alias("n"), F.bool_and((col("r") >= 0) & (col("r") < 1)).alias("in_range")),
        "SELECT event_type, count(*) AS n, true AS in_range FROM events GROUP BY 1")
REG.add("fn_uuid",
        lambda tables: tables.events.select("event_type", x.uuid().alias("u")).groupBy("event_type").agg(
            F.count("*").alias("n"), F.bool_and(col("u").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed")),
        "SELECT event_type, count(*) AS n, true AS well_formed FROM events GROUP BY 1")
scalar("current_timestamp_no_parens", "orders", "o_orderkey", lambda: t.current_timestamp() > col("o_orderdate").cast("timestamp"),
       "CAST(CURRENT_TIMESTAMP AS TIMESTAMP) > o_orderdate")

# -- encodings and URLs -----------------------------------------------------------------------------

scalar("from_hex", "part", "p_partkey", lambda: x.from_hex(F.hex("p_name")).cast("string"), "p_name")
scalar("to_hex", "part", "p_partkey", lambda: x.to_hex(col("p_name").cast("binary")), "hex(encode(p_name))")
_URL = "regexp_extract(url, '^[a-z]+://([^/?#]*)([^?#]*)(\\?([^#]*))?', {})"
scalar("url_extract_host", "pages", "page_id", lambda: x.url_extract_host(col("url")), _URL.format(1))
scalar("url_extract_path", "pages", "page_id", lambda: x.url_extract_path(col("url")), _URL.format(2))
scalar("url_extract_parameter", "pages", "page_id", lambda: F.coalesce(x.url_extract_parameter(col("url"), "page"), lit("")),
       "regexp_extract(regexp_replace(url, '#.*$', ''), '[?&]page=([^&]*)', 1)")

# -- more maps, syntax --------------------------------------------------------------------------------

scalar("map_filter", "part", "p_partkey", lambda: entries(F.map_filter(part_map(), lambda _k, v: v > 20)),
       f"array_to_string(list_transform(list_sort(list_filter(map_entries({PART_MAP}), lambda e: e.value > 20)), lambda e: e.key || '=' || CAST(e.value AS VARCHAR)), ',')")
scalar("map_entries", "part", "p_partkey", lambda: F.array_join(F.transform(F.array_sort(F.map_entries(part_map())), lambda e: F.concat(e["key"], lit("="), e["value"].cast("string"))), ","),
       entries_sql(PART_MAP))
scalar("map_concat", "part", "p_partkey", lambda: entries(c.map_concat(part_map(), part_map2())), entries_sql(f"map_concat({PART_MAP}, {PART_MAP2})"))
scalar("map_from_entries", "part", "p_partkey",
       lambda: entries(F.map_from_entries(F.array(F.struct(col("p_name").alias("k"), col("p_size").alias("v")), F.struct(col("p_type").alias("k"), lit(0).alias("v"))))),
       entries_sql("map_from_entries([(p_name, p_size), (p_type, 0)])"))
scalar("double_pipe_concat", "part", "p_partkey", lambda: x.concat_pipes(col("p_name"), lit(" "), col("p_brand")), "p_name || ' ' || p_brand")
scalar("subscript_bracket", "part", "p_partkey", lambda: F.element_at(F.split("p_name", " "), 1), "string_split(p_name, ' ')[1]")
scalar("try_function_cast", "events", "event_id", lambda: s.try_cast(props_digits(), "bigint").cast("string"),
       "CAST(TRY_CAST(substr(props, 7, 2) AS BIGINT) AS VARCHAR)")
