"""Ordered rewrite rules for lake SQL."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    category: str
    pattern: str
    replacement: str


# Name, category, pattern and replacement of every rule, in the order they apply.
# Patterns ignore case; replacements refer to groups as \1, \2, ...
LAKE_SQL_RULES = (
    Rule("map_constructor_to_struct", "MAP_CONSTRUCTOR",
         r"MAP\(\s*ARRAY\[([^\]]+)\]\s*,\s*ARRAY\[([^\]]+)\]\s*\)",
         r"STRUCT(\1, \2)"),
    Rule("map_constructor_empty", "MAP_CONSTRUCTOR", r"\bMAP\(\s*\)", r"STRUCT()"),
    Rule("transform_array", "TRANSFORM",
         r"\bTRANSFORM\(\s*([^,]+)\s*,\s*([a-zA-Z_]\w*)\s*->\s*([^)]+)\)",
         r"ARRAY(SELECT \3 FROM UNNEST(\1) AS \2)"),
    Rule("transform_nested", "TRANSFORM",
         r"\bTRANSFORM\(\s*([^,]+)\s*,\s*([a-zA-Z_]\w*)\s*->\s*CAST\(([^)]+)\s+AS\s+([^)]+)\)\)",
         r"ARRAY(SELECT CAST(\3 AS \4) FROM UNNEST(\1) AS \2)"),
    Rule("filter_array", "FILTER",
         r"\bFILTER\(\s*([^,]+)\s*,\s*([a-zA-Z_]\w*)\s*->\s*([^)]+)\)",
         r"ARRAY(SELECT \2 FROM UNNEST(\1) AS \2 WHERE \3)"),
    Rule("date_trunc", "DATE_FUNCTIONS", r"\bDATE_TRUNC\(\s*'(\w+)'\s*,\s*([^)]+)\)", r"DATE_TRUNC(\2, \1)"),
    Rule("date_add", "DATE_FUNCTIONS",
         r"\bDATE_ADD\(\s*'(\w+)'\s*,\s*(-?\d+)\s*,\s*([^)]+)\)",
         r"DATE_ADD(\3, INTERVAL \2 \1)"),
    Rule("date_diff", "DATE_FUNCTIONS",
         r"\bDATE_DIFF\(\s*'(\w+)'\s*,\s*([^,]+)\s*,\s*([^)]+)\)",
         r"DATE_DIFF(\3, \2, \1)"),
    Rule("date_format", "DATE_FUNCTIONS", r"\bDATE_FORMAT\(\s*([^,]+)\s*,\s*([^)]+)\)", r"FORMAT_TIMESTAMP(\2, \1)"),
    Rule("date_parse", "DATE_FUNCTIONS", r"\bDATE_PARSE\(\s*([^,]+)\s*,\s*([^)]+)\)", r"PARSE_TIMESTAMP(\2, \1)"),
    Rule("from_unixtime", "DATE_FUNCTIONS", r"\bFROM_UNIXTIME\(\s*([^)]+)\)", r"TIMESTAMP_SECONDS(\1)"),
    Rule("to_unixtime", "DATE_FUNCTIONS", r"\bTO_UNIXTIME\(\s*([^)]+)\)", r"UNIX_SECONDS(\1)"),
    Rule("now_function", "DATE_FUNCTIONS", r"\bNOW\(\s*\)", r"CURRENT_TIMESTAMP()"),
    Rule("at_timezone", "DATE_FUNCTIONS", r"\bAT_TIMEZONE\(\s*([^,]+)\s*,\s*([^)]+)\)", r"TIMESTAMP(\1, \2)"),
    Rule("interval_quoted", "DATE_FUNCTIONS",
         r"\bINTERVAL\s+'(\d+)'\s+(DAY|HOUR|MINUTE|SECOND|MONTH|YEAR)",
         r"INTERVAL \1 \2"),
    Rule("year_extract", "DATE_FUNCTIONS", r"\bYEAR\(\s*([^)]+)\)", r"EXTRACT(YEAR FROM \1)"),
    Rule("month_extract", "DATE_FUNCTIONS", r"\bMONTH\(\s*([^)]+)\)", r"EXTRACT(MONTH FROM \1)"),
    Rule("day_extract", "DATE_FUNCTIONS", r"\bDAY\(\s*([^)]+)\)", r"EXTRACT(DAY FROM \1)"),
    Rule("hour_extract", "DATE_FUNCTIONS", r"\bHOUR\(\s*([^)]+)\)", r"EXTRACT(HOUR FROM \1)"),
    Rule("minute_extract", "DATE_FUNCTIONS", r"\bMINUTE\(\s*([^)]+)\)", r"EXTRACT(MINUTE FROM \1)"),
    Rule("second_extract", "DATE_FUNCTIONS", r"\bSECOND\(\s*([^)]+)\)", r"EXTRACT(SECOND FROM \1)"),
    Rule("day_of_week_extract", "DATE_FUNCTIONS", r"\bDAY_OF_WEEK\(\s*([^)]+)\)", r"EXTRACT(DAYOFWEEK FROM \1)"),
    Rule("day_of_year_extract", "DATE_FUNCTIONS", r"\bDAY_OF_YEAR\(\s*([^)]+)\)", r"EXTRACT(DAYOFYEAR FROM \1)"),
    Rule("week_extract", "DATE_FUNCTIONS", r"\bWEEK\(\s*([^)]+)\)", r"EXTRACT(WEEK FROM \1)"),
    Rule("date_sub", "DATE_FUNCTIONS",
         r"\bDATE_ADD\(\s*'(\w+)'\s*,\s*-(\d+)\s*,\s*([^)]+)\)",
         r"DATE_SUB(\3, INTERVAL \2 \1)"),
    Rule("try_cast", "TRY_CAST", r"\bTRY_CAST\(", r"SAFE_CAST("),
    Rule("regexp_like", "REGEXP_FUNCTIONS", r"\bREGEXP_LIKE\(", r"REGEXP_CONTAINS("),
    Rule("regexp_extract", "REGEXP_FUNCTIONS",
         r"\bREGEXP_EXTRACT\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"REGEXP_EXTRACT(\1, \2)"),
    Rule("regexp_extract_all", "REGEXP_FUNCTIONS",
         r"\bREGEXP_EXTRACT_ALL\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"REGEXP_EXTRACT_ALL(\1, \2)"),
    Rule("regexp_replace", "REGEXP_FUNCTIONS",
         r"\bREGEXP_REPLACE\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^)]+)\)",
         r"REGEXP_REPLACE(\1, \2, \3)"),
    Rule("regexp_count", "REGEXP_FUNCTIONS",
         r"\bREGEXP_COUNT\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"ARRAY_LENGTH(REGEXP_EXTRACT_ALL(\1, \2))"),
    Rule("approx_distinct", "APPROX_FUNCTIONS", r"\bAPPROX_DISTINCT\(", r"APPROX_COUNT_DISTINCT("),
    Rule("approx_percentile", "APPROX_FUNCTIONS",
         r"\bAPPROX_PERCENTILE\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"APPROX_QUANTILES(\1, 100)[OFFSET(CAST(\2 * 100 AS INT64))]"),
    Rule("histogram", "APPROX_FUNCTIONS", r"\bHISTOGRAM\(\s*([^)]+)\)", r"APPROX_TOP_COUNT(\1, 100)"),
    Rule("arbitrary", "ARBITRARY", r"\bARBITRARY\(", r"ANY_VALUE("),
    Rule("contains_function", "CONTAINS", r"\bCONTAINS\(\s*([^,]+)\s*,\s*([^)]+)\)", r"(\2 IN UNNEST(\1))"),
    Rule("map_keys", "MAP_KEYS", r"\bMAP_KEYS\(\s*([^)]+)\)", r"ARRAY(SELECT key FROM UNNEST(\1))"),
    Rule("map_values", "MAP_VALUES", r"\bMAP_VALUES\(\s*([^)]+)\)", r"ARRAY(SELECT value FROM UNNEST(\1))"),
    Rule("codepoint", "STRING_FUNCTIONS", r"\bCODEPOINT\(\s*([^)]+)\)", r"TO_CODE_POINTS(\1)[OFFSET(0)]"),
    Rule("split_with_limit", "STRING_FUNCTIONS",
         r"\bSPLIT\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*(\d+)\s*\)",
         r"ARRAY(SELECT x FROM UNNEST(SPLIT(\1, \2)) AS x WITH OFFSET WHERE OFFSET < \3)"),
    Rule("strpos", "STRING_FUNCTIONS", r"\bSTRPOS\(\s*([^,]+)\s*,\s*([^)]+)\)", r"STRPOS(\1, \2)"),
    Rule("chr", "STRING_FUNCTIONS", r"\bCHR\(\s*([^)]+)\)", r"CHR(\1)"),
    Rule("replace_function", "STRING_FUNCTIONS",
         r"\bREPLACE\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^)]+)\)",
         r"REPLACE(\1, \2, \3)"),
    Rule("split_basic", "STRING_FUNCTIONS", r"\bSPLIT\(\s*([^,]+)\s*,\s*([^),]+)\s*\)", r"SPLIT(\1, \2)"),
    Rule("reverse_string", "STRING_FUNCTIONS", r"\bREVERSE\(\s*([^)]+)\)", r"REVERSE(\1)"),
    Rule("lpad", "STRING_FUNCTIONS", r"\bLPAD\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^)]+)\)", r"LPAD(\1, \2, \3)"),
    Rule("rpad", "STRING_FUNCTIONS", r"\bRPAD\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^)]+)\)", r"RPAD(\1, \2, \3)"),
    Rule("position_function", "STRING_FUNCTIONS", r"\bPOSITION\(\s*([^\s]+)\s+IN\s+([^)]+)\)", r"STRPOS(\2, \1)"),
    Rule("cardinality", "ARRAY_FUNCTIONS", r"\bCARDINALITY\(\s*([^)]+)\)", r"ARRAY_LENGTH(\1)"),
    Rule("array_distinct", "ARRAY_FUNCTIONS",
         r"\bARRAY_DISTINCT\(\s*([^)]+)\)",
         r"(SELECT ARRAY_AGG(DISTINCT x) FROM UNNEST(\1) AS x)"),
    Rule("array_join", "ARRAY_FUNCTIONS", r"\bARRAY_JOIN\(\s*([^,]+)\s*,\s*([^)]+)\)", r"ARRAY_TO_STRING(\1, \2)"),
    Rule("array_sort", "ARRAY_FUNCTIONS",
         r"\bARRAY_SORT\(\s*([^)]+)\)",
         r"(SELECT ARRAY_AGG(x ORDER BY x) FROM UNNEST(\1) AS x)"),
    Rule("array_position", "ARRAY_FUNCTIONS",
         r"\bARRAY_POSITION\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"(SELECT OFFSET + 1 FROM UNNEST(\1) AS x WITH OFFSET WHERE x = \2 LIMIT 1)"),
    Rule("array_remove", "ARRAY_FUNCTIONS",
         r"\bARRAY_REMOVE\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"(SELECT ARRAY_AGG(x) FROM UNNEST(\1) AS x WHERE x != \2)"),
    Rule("array_max", "ARRAY_FUNCTIONS", r"\bARRAY_MAX\(\s*([^)]+)\)", r"(SELECT MAX(x) FROM UNNEST(\1) AS x)"),
    Rule("array_min", "ARRAY_FUNCTIONS", r"\bARRAY_MIN\(\s*([^)]+)\)", r"(SELECT MIN(x) FROM UNNEST(\1) AS x)"),
    Rule("element_at", "ARRAY_FUNCTIONS", r"\bELEMENT_AT\(\s*([^,]+)\s*,\s*(\d+)\s*\)", r"\1[SAFE_OFFSET(\2 - 1)]"),
    Rule("flatten", "ARRAY_FUNCTIONS",
         r"\bFLATTEN\(\s*([^)]+)\)",
         r"(SELECT ARRAY_AGG(x) FROM UNNEST(\1) AS arr, UNNEST(arr) AS x)"),
    Rule("sequence", "ARRAY_FUNCTIONS", r"\bSEQUENCE\(\s*([^,]+)\s*,\s*([^)]+)\)", r"GENERATE_ARRAY(\1, \2)"),
    Rule("slice", "ARRAY_FUNCTIONS",
         r"\bSLICE\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^)]+)\)",
         r"ARRAY(SELECT x FROM UNNEST(\1) AS x WITH OFFSET WHERE OFFSET >= \2 - 1 AND OFFSET < \2 - 1 + \3)"),
    Rule("array_concat", "ARRAY_FUNCTIONS",
         r"\bCONCAT\(\s*([^,]+)\s*,\s*([^)]+)\)\s*--\s*array",
         r"ARRAY_CONCAT(\1, \2)"),
    Rule("array_union", "ARRAY_FUNCTIONS",
         r"\bARRAY_UNION\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"(SELECT ARRAY_AGG(DISTINCT x) FROM UNNEST(ARRAY_CONCAT(\1, \2)) AS x)"),
    Rule("bool_and", "AGGREGATE_FUNCTIONS", r"\bBOOL_AND\(", r"LOGICAL_AND("),
    Rule("bool_or", "AGGREGATE_FUNCTIONS", r"\bBOOL_OR\(", r"LOGICAL_OR("),
    Rule("count_if", "AGGREGATE_FUNCTIONS", r"\bCOUNT_IF\(", r"COUNTIF("),
    Rule("max_by", "AGGREGATE_FUNCTIONS", r"\bMAX_BY\(\s*([^,]+)\s*,\s*([^)]+)\)", r"ANY_VALUE(\1 HAVING MAX \2)"),
    Rule("min_by", "AGGREGATE_FUNCTIONS", r"\bMIN_BY\(\s*([^,]+)\s*,\s*([^)]+)\)", r"ANY_VALUE(\1 HAVING MIN \2)"),
    Rule("map_agg", "AGGREGATE_FUNCTIONS", r"\bMAP_AGG\(\s*([^,]+)\s*,\s*([^)]+)\)", r"ARRAY_AGG(STRUCT(\1, \2))"),
    Rule("multimap_agg", "AGGREGATE_FUNCTIONS",
         r"\bMULTIMAP_AGG\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"ARRAY_AGG(STRUCT(\1, \2))"),
    Rule("checksum", "AGGREGATE_FUNCTIONS", r"\bCHECKSUM\(\s*([^)]+)\)", r"FARM_FINGERPRINT(CAST(\1 AS STRING))"),
    Rule("reduce_agg", "AGGREGATE_FUNCTIONS",
         r"\bREDUCE\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*\(([^,]+)\s*,\s*([^)]+)\)\s*->\s*([^,]+)\s*,\s*([^)]+)\)",
         r"(SELECT \5 FROM UNNEST(\1) AS \4 WITH OFFSET ORDER BY OFFSET)"),
    Rule("every_agg", "AGGREGATE_FUNCTIONS", r"\bEVERY\(", r"LOGICAL_AND("),
    Rule("count_star_filter", "AGGREGATE_FUNCTIONS",
         r"\bCOUNT\(\*\)\s+FILTER\s*\(\s*WHERE\s+([^)]+)\)",
         r"COUNTIF(\1)"),
    Rule("cast_varchar", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+VARCHAR\s*\)", r"CAST(\1 AS STRING)"),
    Rule("cast_varchar_n", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+VARCHAR\(\d+\)\s*\)", r"CAST(\1 AS STRING)"),
    Rule("cast_integer", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+INTEGER\s*\)", r"CAST(\1 AS INT64)"),
    Rule("cast_bigint", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+BIGINT\s*\)", r"CAST(\1 AS INT64)"),
    Rule("cast_double", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+DOUBLE\s*\)", r"CAST(\1 AS FLOAT64)"),
    Rule("cast_real", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+REAL\s*\)", r"CAST(\1 AS FLOAT64)"),
    Rule("cast_boolean", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+BOOLEAN\s*\)", r"CAST(\1 AS BOOL)"),
    Rule("cast_tinyint", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+TINYINT\s*\)", r"CAST(\1 AS INT64)"),
    Rule("cast_smallint", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+SMALLINT\s*\)", r"CAST(\1 AS INT64)"),
    Rule("cast_varbinary", "TYPE_CASTING", r"\bCAST\(\s*([^)]+?)\s+AS\s+VARBINARY\s*\)", r"CAST(\1 AS BYTES)"),
    Rule("try_function", "CONDITIONAL_FUNCTIONS", r"\bTRY\(\s*([^)]+)\)", r"SAFE_CAST(\1 AS STRING)"),
    Rule("nvl_function", "CONDITIONAL_FUNCTIONS", r"\bNVL\(\s*([^,]+)\s*,\s*([^)]+)\)", r"IFNULL(\1, \2)"),
    Rule("nvl2_function", "CONDITIONAL_FUNCTIONS",
         r"\bNVL2\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^)]+)\)",
         r"IF(\1 IS NOT NULL, \2, \3)"),
    Rule("if_function", "CONDITIONAL_FUNCTIONS",
         r"\bIF\(\s*([^,]+)\s*,\s*([^,]+)\s*,\s*([^)]+)\)",
         r"IF(\1, \2, \3)"),
    Rule("json_extract", "JSON_FUNCTIONS", r"\bJSON_EXTRACT\(\s*([^,]+)\s*,\s*([^)]+)\)", r"JSON_EXTRACT(\1, \2)"),
    Rule("json_extract_scalar", "JSON_FUNCTIONS",
         r"\bJSON_EXTRACT_SCALAR\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"JSON_EXTRACT_SCALAR(\1, \2)"),
    Rule("json_array_length", "JSON_FUNCTIONS",
         r"\bJSON_ARRAY_LENGTH\(\s*([^)]+)\)",
         r"ARRAY_LENGTH(JSON_EXTRACT_ARRAY(\1, '$'))"),
    Rule("json_parse", "JSON_FUNCTIONS", r"\bJSON_PARSE\(\s*([^)]+)\)", r"PARSE_JSON(\1)"),
    Rule("json_format", "JSON_FUNCTIONS", r"\bJSON_FORMAT\(\s*([^)]+)\)", r"TO_JSON_STRING(\1)"),
    Rule("json_array_get", "JSON_FUNCTIONS",
         r"\bJSON_ARRAY_GET\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"JSON_EXTRACT_ARRAY(\1, '$')[SAFE_OFFSET(\2)]"),
    Rule("nth_value", "WINDOW_FUNCTIONS", r"\bNTH_VALUE\(\s*([^,]+)\s*,\s*([^)]+)\)", r"NTH_VALUE(\1, \2)"),
    Rule("row_number", "WINDOW_FUNCTIONS", r"\bROW_NUMBER\(\s*\)", r"ROW_NUMBER()"),
    Rule("cume_dist", "WINDOW_FUNCTIONS", r"\bCUME_DIST\(\s*\)", r"CUME_DIST()"),
    Rule("ntile", "WINDOW_FUNCTIONS", r"\bNTILE\(\s*([^)]+)\)", r"NTILE(\1)"),
    Rule("unnest_with_ordinality", "TABLE_FUNCTIONS",
         r"\bUNNEST\(([^)]+)\)\s+WITH\s+ORDINALITY",
         r"UNNEST(\1) WITH OFFSET"),
    Rule("cross_join_unnest_aliased", "TABLE_FUNCTIONS",
         r"CROSS\s+JOIN\s+UNNEST\(([^)]+)\)\s+AS\s+\w+\((\w+)\)",
         r"CROSS JOIN UNNEST(\1) AS \2"),
    Rule("values_clause", "TABLE_FUNCTIONS",
         r"VALUES\s+\(([^)]+)\)(?:\s*,\s*\(([^)]+)\))*",
         r"SELECT * FROM UNNEST([\1, \2])"),
    Rule("lateral_subquery", "TABLE_FUNCTIONS", r",\s*LATERAL\s*", r", "),
    Rule("bitwise_and", "BITWISE_FUNCTIONS", r"\bBITWISE_AND\(\s*([^,]+)\s*,\s*([^)]+)\)", r"(\1 & \2)"),
    Rule("bitwise_or", "BITWISE_FUNCTIONS", r"\bBITWISE_OR\(\s*([^,]+)\s*,\s*([^)]+)\)", r"(\1 | \2)"),
    Rule("bitwise_xor", "BITWISE_FUNCTIONS", r"\bBITWISE_XOR\(\s*([^,]+)\s*,\s*([^)]+)\)", r"(\1 ^ \2)"),
    Rule("bitwise_not", "BITWISE_FUNCTIONS", r"\bBITWISE_NOT\(\s*([^)]+)\)", r"~\1"),
    Rule("bit_count", "BITWISE_FUNCTIONS", r"\bBIT_COUNT\(\s*([^,]+)\s*,\s*\d+\s*\)", r"BIT_COUNT(\1)"),
    Rule("infinity", "MATH_FUNCTIONS", r"\bINFINITY\(\s*\)", r"CAST('inf' AS FLOAT64)"),
    Rule("nan", "MATH_FUNCTIONS", r"\bNAN\(\s*\)", r"CAST('nan' AS FLOAT64)"),
    Rule("is_finite", "MATH_FUNCTIONS", r"\bIS_FINITE\(\s*([^)]+)\)", r"(NOT IS_INF(\1) AND NOT IS_NAN(\1))"),
    Rule("is_nan", "MATH_FUNCTIONS", r"\bIS_NAN\(\s*([^)]+)\)", r"IS_NAN(\1)"),
    Rule("truncate", "MATH_FUNCTIONS", r"\bTRUNCATE\(\s*([^)]+)\)", r"TRUNC(\1)"),
    Rule("random", "MATH_FUNCTIONS", r"\bRANDOM\(\s*\)", r"RAND()"),
    Rule("to_base", "MATH_FUNCTIONS", r"\bTO_BASE\(\s*([^,]+)\s*,\s*16\s*\)", r"FORMAT('%x', \1)"),
    Rule("mod_function", "MATH_FUNCTIONS", r"\bMOD\(\s*([^,]+)\s*,\s*([^)]+)\)", r"MOD(\1, \2)"),
    Rule("cbrt", "MATH_FUNCTIONS", r"\bCBRT\(\s*([^)]+)\)", r"POWER(\1, 1.0/3.0)"),
    Rule("log2", "MATH_FUNCTIONS", r"\bLOG2\(\s*([^)]+)\)", r"LOG(\1, 2)"),
    Rule("uuid", "MISC_FUNCTIONS", r"\bUUID\(\s*\)", r"GENERATE_UUID()"),
    Rule("from_hex", "MISC_FUNCTIONS", r"\bFROM_HEX\(\s*([^)]+)\)", r"FROM_HEX(\1)"),
    Rule("to_hex", "MISC_FUNCTIONS", r"\bTO_HEX\(\s*([^)]+)\)", r"TO_HEX(\1)"),
    Rule("url_extract_host", "MISC_FUNCTIONS", r"\bURL_EXTRACT_HOST\(\s*([^)]+)\)", r"NET.HOST(\1)"),
    Rule("url_extract_path", "MISC_FUNCTIONS",
         r"\bURL_EXTRACT_PATH\(\s*([^)]+)\)",
         r"REGEXP_EXTRACT(\1, r'://[^/]+(/[^?#]*)')"),
    Rule("url_extract_parameter", "MISC_FUNCTIONS",
         r"\bURL_EXTRACT_PARAMETER\(\s*([^,]+)\s*,\s*([^)]+)\)",
         r"REGEXP_EXTRACT(\1, CONCAT(\2, '=([^&]*)'))"),
    Rule("map_filter", "MAP_FUNCTIONS",
         r"\bMAP_FILTER\(\s*([^,]+)\s*,\s*\(([^,]+)\s*,\s*([^)]+)\)\s*->\s*([^)]+)\)",
         r"ARRAY(SELECT AS STRUCT \2, \3 FROM UNNEST(\1) WHERE \4)"),
    Rule("map_entries", "MAP_FUNCTIONS", r"\bMAP_ENTRIES\(\s*([^)]+)\)", r"\1"),
    Rule("map_concat", "MAP_FUNCTIONS", r"\bMAP_CONCAT\(\s*([^,]+)\s*,\s*([^)]+)\)", r"ARRAY_CONCAT(\1, \2)"),
    Rule("map_from_entries", "MAP_FUNCTIONS", r"\bMAP_FROM_ENTRIES\(\s*([^)]+)\)", r"\1"),
    Rule("double_pipe_concat", "PRESTO_SYNTAX", r"([^|])\|\|([^|])", r"\1||\2"),
    Rule("subscript_bracket", "PRESTO_SYNTAX", r"([a-zA-Z_]\w*)\[(\d+)\]", r"\1[OFFSET(\2 - 1)]"),
    Rule("try_function_cast", "PRESTO_SYNTAX",
         r"\bTRY\(\s*CAST\(\s*([^)]+?)\s+AS\s+(\w+)\s*\)\s*\)",
         r"SAFE_CAST(\1 AS \2)"),
    Rule("current_timestamp_no_parens", "PRESTO_SYNTAX", r"\bCURRENT_TIMESTAMP\b(?!\s*\()", r"CURRENT_TIMESTAMP()"),
)
