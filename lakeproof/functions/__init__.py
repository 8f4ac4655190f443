"""The 130 functions of the rule library, by rule name."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeproof.functions import aggregates as a
from lakeproof.functions import collections as c
from lakeproof.functions import scalars as s
from lakeproof.functions import tables as tb
from lakeproof.functions import temporal as t
from lakeproof.functions import text as x
from lakeproof.functions import windows as w

FUNCTIONS = {
    "map_constructor_to_struct": F.map_from_arrays,
    "map_constructor_empty": c.empty_map,
    "transform_array": F.transform,
    "transform_nested": c.array_transform_cast,
    "filter_array": F.filter,
    "date_trunc": t.date_trunc,
    "date_add": t.date_add,
    "date_diff": t.date_diff,
    "date_format": t.date_format,
    "date_parse": t.date_parse,
    "from_unixtime": t.from_unixtime,
    "to_unixtime": t.to_unixtime,
    "now_function": t.now,
    "at_timezone": t.at_timezone,
    "interval_quoted": t.plus_interval,
    "year_extract": t.year,
    "month_extract": t.month,
    "day_extract": t.day,
    "hour_extract": t.hour,
    "minute_extract": t.minute,
    "second_extract": t.second,
    "day_of_week_extract": t.day_of_week,
    "day_of_year_extract": t.day_of_year,
    "week_extract": t.week,
    "date_sub": t.date_sub,
    "try_cast": s.try_cast,
    "regexp_like": x.regexp_like,
    "regexp_extract": x.regexp_extract,
    "regexp_extract_all": x.regexp_extract_all,
    "regexp_replace": x.regexp_replace,
    "regexp_count": x.regexp_count,
    "approx_distinct": a.approx_distinct,
    "approx_percentile": a.approx_percentile,
    "histogram": a.histogram,
    "arbitrary": a.arbitrary,
    "contains_function": F.array_contains,
    "map_keys": F.map_keys,
    "map_values": F.map_values,
    "codepoint": x.codepoint,
    "split_with_limit": x.split,
    "strpos": x.strpos,
    "chr": x.chr,
    "replace_function": x.replace,
    "split_basic": x.split,
    "reverse_string": x.reverse,
    "lpad": x.lpad,
    "rpad": x.rpad,
    "position_function": x.position,
    "cardinality": F.cardinality,
    "array_distinct": F.array_distinct,
    "array_join": F.array_join,
    "array_sort": F.array_sort,
    "array_position": F.array_position,
    "array_remove": F.array_remove,
    "array_max": c.array_max,
    "array_min": c.array_min,
    "element_at": c.element_at,
    "flatten": F.flatten,
    "sequence": F.sequence,
    "slice": F.slice,
    "array_concat": F.concat,
    "array_union": F.array_union,
    "bool_and": a.bool_and,
    "bool_or": a.bool_or,
    "count_if": a.count_if,
    "max_by": a.max_by,
    "min_by": a.min_by,
    "map_agg": a.map_agg,
    "multimap_agg": a.multimap_agg,
    "checksum": a.checksum,
    "reduce_agg": F.aggregate,
    "every_agg": a.every,
    "count_star_filter": a.count_star_filter,
    "cast_varchar": s.cast_varchar,
    "cast_varchar_n": s.cast_varchar,
    "cast_integer": s.cast_integer,
    "cast_bigint": s.cast_bigint,
    "cast_double": s.cast_double,
    "cast_real": s.cast_real,
    "cast_boolean": s.cast_boolean,
    "cast_tinyint": s.cast_tinyint,
    "cast_smallint": s.cast_smallint,
    "cast_varbinary": s.cast_varbinary,
    "try_function": s.try_divide,
    "nvl_function": s.nvl,
    "nvl2_function": s.nvl2,
    "if_function": s.if_,
    "json_extract": s.json_extract,
    "json_extract_scalar": s.json_extract_scalar,
    "json_array_length": s.json_array_length,
    "json_parse": s.json_parse,
    "json_format": s.json_format,
    "json_array_get": s.json_array_get,
    "nth_value": w.with_nth_value,
    "row_number": w.row_number,
    "cume_dist": w.cume_dist,
    "ntile": w.ntile,
    "unnest_with_ordinality": tb.unnest_with_ordinality,
    "cross_join_unnest_aliased": tb.unnest,
    "values_clause": tb.values,
    "lateral_subquery": tb.lateral,
    "bitwise_and": s.bitwise_and,
    "bitwise_or": s.bitwise_or,
    "bitwise_xor": s.bitwise_xor,
    "bitwise_not": s.bitwise_not,
    "bit_count": s.bit_count,
    "infinity": s.infinity,
    "nan": s.nan,
    "is_finite": s.is_finite,
    "is_nan": s.is_nan,
    "truncate": s.truncate,
    "random": s.random,
    "to_base": s.to_base,
    "mod_function": s.mod,
    "cbrt": s.cbrt,
    "log2": s.log2,
    "uuid": x.uuid,
    "from_hex": x.from_hex,
    "to_hex": x.to_hex,
    "url_extract_host": x.url_extract_host,
    "url_extract_path": x.url_extract_path,
    "url_extract_parameter": x.url_extract_parameter,
    "map_filter": F.map_filter,
    "map_entries": F.map_entries,
    "map_concat": c.map_concat,
    "map_from_entries": F.map_from_entries,
    "double_pipe_concat": x.concat_pipes,
    "subscript_bracket": F.element_at,
    "try_function_cast": s.try_cast,
    "current_timestamp_no_parens": t.current_timestamp,
}
