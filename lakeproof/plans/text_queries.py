"""Text scans and rewrites over the corpus, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.operators import text_rules as tr
from lakeproof.plans.corpus import CORPUS_SQL, corpus
from lakeproof.plans.registry import Registry, Tables
from lakeproof.rulesets import code
from lakeproof.rulesets.lake_sql import LAKE_SQL_RULES

REG = Registry()
col, lit = F.col, F.lit


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# -- SQL twins of the rules: RE2 has no look-ahead, so that one rule is spelled out -------------------------

_AHEAD = "current_timestamp_no_parens"


def _rewrite_sql(rule, t: str) -> str:
    if rule.name == _AHEAD:
        hidden = f"regexp_replace({t}, '\\b(CURRENT_TIME)(STAMP\\s*\\()', '\\1' || chr(1) || '\\2', 'gi')"
        return f"replace(regexp_replace({hidden}, '\\bCURRENT_TIMESTAMP\\b', 'CURRENT_TIMESTAMP()', 'gi'), chr(1), '')"
    return f"regexp_replace({t}, {_text(rule.pattern)}, {_text(rule.replacement)}, 'gi')"


def _occurrences_sql(rule, t: str) -> str:
    if rule.name == _AHEAD:
        return (
            f"len(regexp_extract_all({t}, '(?i)\\bCURRENT_TIMESTAMP\\b')) "
            f"- len(regexp_extract_all({t}, '(?i)\\bCURRENT_TIMESTAMP\\s*\\('))"
        )
    return f"len(regexp_extract_all({t}, {_text('(?i)' + rule.pattern)}))"


def _chain_sql(rules) -> str:
    """One step per rule; each keeps the text and the applied names."""
    steps = [f"s0 AS MATERIALIZED (SELECT doc_id, path, source, n_chars, content AS t, '' AS applied FROM ({CORPUS_SQL}))"]
    for i, rule in enumerate(rules):
        steps.append(
            f"r{i + 1} AS (SELECT *, {_rewrite_sql(rule, 't')} AS u FROM s{i}), "
            f"s{i + 1} AS MATERIALIZED (SELECT doc_id, path, source, n_chars, u AS t, "
            f"CASE WHEN u <> t THEN applied || ',{rule.name}' ELSE applied END AS applied FROM r{i + 1})"
        )
    return f"WITH {', '.join(steps)} SELECT doc_id, path, source, n_chars, t AS rewritten, ltrim(applied, ',') AS applied FROM s{len(rules)}"


_APPLIED_SQL = _chain_sql(LAKE_SQL_RULES)
_HITS_SQL = f"""
WITH c AS MATERIALIZED ({CORPUS_SQL})
{" UNION ALL ".join(f"SELECT path, {i} AS ord, '{r.name}' AS name, '{r.category}' AS category, CAST({_occurrences_sql(r, 'content')} AS BIGINT) AS occurrences FROM c" for i, r in enumerate(LAKE_SQL_RULES))}
"""


def applied(t: Tables) -> DataFrame:
    return tr.apply_rules(corpus(t.documents), "content")


REG.add("match_rules",
        lambda t: tr.match_rules(corpus(t.documents), "content").select("path", F.array_join("matched", ",").alias("matched")),
        f"""SELECT path, coalesce(string_agg(name, ',' ORDER BY ord) FILTER (WHERE occurrences > 0), '') AS matched
            FROM ({_HITS_SQL}) GROUP BY path""")  # fmt: skip
REG.add("apply_rules",
        lambda t: applied(t).select("path", F.md5("rewritten").alias("rewritten"), F.array_join("applied", ",").alias("applied")),
        f"SELECT path, md5(rewritten) AS rewritten, applied FROM ({_APPLIED_SQL})")
REG.add("rule_coverage",
        lambda t: tr.rule_coverage(corpus(t.documents), "content").select("name", "category", "files", "occurrences"),
        f"""SELECT name, category, count(*) FILTER (WHERE occurrences > 0) AS files, CAST(sum(occurrences) AS BIGINT) AS occurrences
            FROM ({_HITS_SQL}) GROUP BY 1, 2""")  # fmt: skip
REG.add("unused_rules",
        lambda t: tr.unused_rules(t.conversations.select("text"), "text").select("name", "category"),
        f"""WITH c AS (SELECT text FROM conversations) {" UNION ALL ".join(
            f"SELECT '{r.name}' AS name, '{r.category}' AS category FROM c HAVING sum({_occurrences_sql(r, 'text')}) = 0" for r in LAKE_SQL_RULES)}""")  # fmt: skip
REG.add("translation_summary",
        lambda t: tr.translation_summary(
            applied(t).withColumn("status", F.when(col("n_chars") < 100, "failed").otherwise("translated")), ["source"])
        .withColumn("patterns_applied", F.array_join("patterns_applied", ",")),
        f"""WITH a AS MATERIALIZED (SELECT * FROM ({_APPLIED_SQL})),
            n AS (SELECT source, string_agg(DISTINCT name, ',' ORDER BY name) AS patterns_applied
                  FROM (SELECT source, unnest(string_split(applied, ',')) AS name FROM a) WHERE name <> '' GROUP BY 1)
            SELECT a.source, count(*) AS total_files, count(*) FILTER (WHERE n_chars >= 100) AS succeeded,
                   count(*) FILTER (WHERE n_chars < 100) AS failed, coalesce(any_value(patterns_applied), '') AS patterns_applied
            FROM a LEFT JOIN n ON a.source = n.source GROUP BY 1""")  # fmt: skip


@REG.query(
    "batch_completion",
    """WITH f AS (SELECT source AS batch_id, CASE WHEN lang = 'de' AND source <> 'src1' THEN 'pending' WHEN n_chars < 200 THEN 'failed' ELSE 'translated' END AS status FROM documents)
       SELECT batch_id, avg(CASE WHEN status = 'pending' THEN 0.0 ELSE 100.0 END) AS completion, count(*) FILTER (WHERE status = 'translated') AS succeeded,
              count(*) FILTER (WHERE status = 'failed') AS failed, CASE WHEN count(*) FILTER (WHERE status = 'pending') = 0 THEN 'completed' ELSE 'pending' END AS batch_status
       FROM f GROUP BY 1""",
)
def _completion(t: Tables):
    status = (
        F.when((col("lang") == "de") & (col("source") != "src1"), "pending").when(col("n_chars") < 200, "failed").otherwise("translated")
    )
    return tr.batch_completion(t.documents.select(col("source").alias("batch_id"), status.alias("status")))


def outcomes(t: Tables) -> DataFrame:
    """Every document is a query path; every page is a known text; conversations of toxic documents failed."""
    failed = t.labels.filter("toxic = 1").select("doc_id", lit("syntax error").alias("error"))
    paths = t.documents.select("doc_id").join(failed, "doc_id", "left")
    return tr.query_outcomes(paths, t.pages.select(col("page_id").alias("doc_id"), "html"), "doc_id", "html")


_OUTCOMES_SQL = """
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'syntax error' END AS error, octet_length(encode(coalesce(html, ''))) * 10 AS bytes_scanned
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND toxic = 1 LEFT JOIN pages ON page_id = d.doc_id
"""
REG.add("query_validation_report", lambda t: tr.query_validation_report(outcomes(t)),
        f"""SELECT count(*) AS total_queries, count(*) FILTER (WHERE error IS NULL) AS passed, count(*) FILTER (WHERE error IS NOT NULL) AS failed,
            CAST(coalesce(sum(bytes_scanned) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS total_bytes_scanned FROM ({_OUTCOMES_SQL})""")  # fmt: skip
REG.add("query_validation_failures", lambda t: tr.query_validation_failures(outcomes(t), "doc_id"),
        f"SELECT doc_id, error FROM ({_OUTCOMES_SQL}) WHERE error IS NOT NULL")

# -- dependencies -------------------------------------------------------------------------------------------------

_DEPENDENCIES_SQL = f"WITH c AS MATERIALIZED ({CORPUS_SQL}) " + " UNION ALL ".join(
    f"SELECT path, '{kind}' AS kind, '{job}' AS job_type, regexp_extract_all(content, {_text(('(?i)' if flags else '') + pattern)}) AS refs FROM c"
    for kind, job, pattern, flags in code.DEPENDENCY_PATTERNS
)


REG.add("scan_dependencies",
        lambda t: tr.scan_dependencies(corpus(t.documents).select("path", "content"), "content").select("path", "job_type", F.array_join("references", " & ").alias("refs")),
        f"SELECT path, job_type, array_to_string(refs, ' & ') AS refs FROM ({_DEPENDENCIES_SQL}) WHERE len(refs) > 0")
REG.add("dependency_report",
        lambda t: tr.dependency_report(tr.scan_dependencies(corpus(t.documents).select("path", "content"), "content")),
        f"""SELECT job_type, count(*) AS jobs, CAST(sum(len(refs)) AS BIGINT) AS total_references
            FROM ({_DEPENDENCIES_SQL}) WHERE len(refs) > 0 GROUP BY 1""")  # fmt: skip
REG.add("has_athena_reference",
        lambda t: tr.has_athena_reference(corpus(t.documents), "content").select("path", "status"),
        f"""SELECT path, CASE WHEN count(*) FILTER (WHERE len(refs) > 0 AND job_type IN ('LAMBDA', 'AIRFLOW_DAG')) > 0
            THEN 'needs_rewrite' ELSE 'no_athena_references' END AS status FROM ({_DEPENDENCIES_SQL}) GROUP BY 1""")  # fmt: skip

# -- code classes: word borders are Unicode-aware, which RE2's \b is not --------------------------------------------

_EDGE_L, _EDGE_R = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
_REMOTE_SQL = f"{_EDGE_L}(?:import|class|public|private|protected){_EDGE_R}|https?://|require\\s*\\(|from\\s+\\S+\\s+import"
_JS_SQL = f"{_EDGE_L}(?:var|let|const|function){_EDGE_R}|=>|JSON\\.parse|JSON\\.stringify|console\\.log"
_CLASS_SQL = """CASE WHEN regexp_matches({0}, '%s') THEN 'CLOUD_RUN_REMOTE' WHEN regexp_matches({0}, '%s') THEN 'JS_UDF' ELSE 'SQL_UDF' END""" % (
    _REMOTE_SQL.replace("{", "{{").replace("}", "}}"),
    _JS_SQL.replace("{", "{{").replace("}", "}}"),
)

REG.add("classify_code",
        lambda t: tr.classify_code(corpus(t.documents), "content").select("path", "category"),
        f"SELECT path, {_CLASS_SQL.format('content')} AS category FROM ({CORPUS_SQL})")
REG.add("classify_code_report",
        lambda t: tr.classify_code_report(
            tr.classify_code(t.pages.select(col("html").alias("body"), lit("page").alias("kind"))
                             .unionByName(t.conversations.select(col("text").alias("body"), col("role").alias("kind"))), "body"), ["kind"]),
        f"""WITH b AS (SELECT html AS body, 'page' AS kind FROM pages UNION ALL SELECT text, role FROM conversations),
            c AS (SELECT kind, {_CLASS_SQL.format('body')} AS category FROM b)
            SELECT kind, count(*) AS total, count(*) FILTER (WHERE category = 'CLOUD_RUN_REMOTE') AS cloud_run_remote,
                   count(*) FILTER (WHERE category = 'JS_UDF') AS js_udf, count(*) FILTER (WHERE category = 'SQL_UDF') AS sql_udf FROM c GROUP BY 1""")  # fmt: skip

# -- workflow files ---------------------------------------------------------------------------------------------------


def _workflow_sql() -> str:
    steps = [f"s0 AS MATERIALIZED (SELECT path, content AS t, '' AS changes FROM ({CORPUS_SQL}))"]
    edits = [(f"Import: {a} → {b}", a, f"replace(t, '{a}', '{b}')") for a, b in sorted(code.MODULE_PATHS.items(), key=lambda i: -len(i[0]))]
    edits += [(f"Operator: {a} → {b}", a, f"regexp_replace(t, '\\b{a}\\b', '{b}', 'g')") for a, b in code.OPERATOR_NAMES.items()]
    edits += [(f"Storage path: {a} → {b}", a, f"replace(t, '{a}', '{b}')") for a, b in code.STORAGE_SCHEMES.items()]
    for i, (label, _old, expression) in enumerate(edits):
        steps.append(
            f"r{i + 1} AS (SELECT *, {expression} AS u FROM s{i}), s{i + 1} AS MATERIALIZED (SELECT path, u AS t, "
            f"CASE WHEN u <> t THEN changes || '|' || {_text(label)} ELSE changes END AS changes FROM r{i + 1})"
        )
    return f"WITH {', '.join(steps)} SELECT path, t AS rewritten, ltrim(changes, '|') AS changes FROM s{len(edits)}"


WORKFLOW_SQL = _workflow_sql()


def workflows(t: Tables) -> DataFrame:
    return tr.rewrite_workflow_files(corpus(t.documents).select("path", "content"), "content")


REG.add("rewrite_workflow_files",
        lambda t: workflows(t).select("path", F.md5("rewritten").alias("rewritten"), F.array_join("changes", "|").alias("changes")),
        f"SELECT path, md5(rewritten) AS rewritten, changes FROM ({WORKFLOW_SQL})")
REG.add("rewrite_report",
        lambda t: tr.rewrite_report(workflows(t)),
        f"""SELECT count(*) AS processed, count(*) FILTER (WHERE changes <> '') AS rewritten,
            CAST(sum(CASE WHEN changes = '' THEN 0 ELSE len(string_split(changes, '|')) END) AS BIGINT) AS changes FROM ({WORKFLOW_SQL})""")  # fmt: skip
REG.add("rewrite_changes",
        lambda t: tr.rewrite_changes(workflows(t), "path"),
        f"SELECT path, unnest(string_split(changes, '|')) AS change FROM ({WORKFLOW_SQL}) WHERE changes <> ''")

# -- column references ----------------------------------------------------------------------------------------------------


def _wrap_sql(columns: list[str]) -> str:
    """RE2 has no look-behind: wrapped names are split by a mark first, and joined again afterwards."""
    steps = [f"w0 AS (SELECT path, content AS t, 0 AS n FROM ({CORPUS_SQL}))"]
    for i, c in enumerate(columns):
        marked = f"regexp_replace(t, '(UPPER\\({c[0]})({c[1:]}\\b)', '\\1' || chr(1) || '\\2', 'gi')"
        steps.append(
            f"m{i} AS (SELECT path, {marked} AS t, n FROM w{i}), w{i + 1} AS (SELECT path, "
            f"replace(regexp_replace(t, '\\b({c})\\b', 'UPPER(\\1)', 'gi'), chr(1), '') AS t, "
            f"n + len(regexp_extract_all(t, '(?i)\\b{c}\\b')) AS n FROM m{i})"
        )
    return f"WITH {', '.join(steps)} SELECT path, md5(t) AS wrapped, CAST(n AS BIGINT) AS columns_normalised FROM w{len(columns)}"


REG.add("wrap_columns",
        lambda t: tr.wrap_columns(corpus(t.documents), "content", ["region", "status", "the"]).select("path", F.md5("wrapped").alias("wrapped"), "columns_normalised"),
        _wrap_sql(["region", "status", "the"]))
