"""Scans and ordered rewrites of text corpora.

Patterns are written for a Unicode-aware, case-folding matcher, so they run with ``(?U)`` (and ``(?i)``);
``(?d)`` makes the dot stop at line feeds only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.rulesets import code
from lakeproof.rulesets.lake_sql import LAKE_SQL_RULES, Rule

_HEAD = re.compile(r"\\b([A-Z0-9_]+)\\\(")


def flagged(pattern: str, ignore_case: bool = True) -> str:
    return f"(?{'i' if ignore_case else ''}Ud){pattern}"


def spark_replacement(template: str) -> str:
    """Group references as $1 instead of \\1; other dollars and backslashes stay text."""
    return re.sub(r"\\(\d)|([$\\])", lambda m: f"${m[1]}" if m[1] else f"\\{m[2]}", template)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The two operators over the whole rule table are written as SQL expressions: they hold hundreds of calls,
# which take seconds to build one Column at a time and milliseconds to parse.

# -- which rules can match --------------------------------------------------------------------------
#
# Nearly all rules begin with a function name and its parenthesis. One pass over a text lists the names
# that are called in it; a rule is tried only if its name is among them. Rules of another form are tried
# only on texts holding a mark they cannot match without. The outcome is the same as trying all rules.

# What a text must hold for the pattern of a shipped rule without a head to match at all.
_MARKS = {
    "map_constructor_to_struct": "[",
    "interval_quoted": "'",
    "cross_join_unnest_aliased": "(",
    "values_clause": "(",
    "lateral_subquery": ",",
    "double_pipe_concat": "||",
    "subscript_bracket": "[",
    "current_timestamp_no_parens": "_",
}
# a mark belongs to the pattern: another rule of that name has none
_MARK_OF_PATTERN = {rule.pattern: _MARKS[rule.name] for rule in LAKE_SQL_RULES if rule.name in _MARKS}


def _has_alternatives(pattern: str) -> bool:
    """Whether a bar stands outside all groups and classes, so that the pattern's start is that of one branch only."""
    depth, in_class, escaped = 0, False, False
    for char in pattern:
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and not depth:
            return True
    return False


def _head(rule: Rule) -> str | None:
    """The function name that a text must call for the rule to match; None if its pattern does not tell."""
    found = _HEAD.match(rule.pattern)
    # a quantifier behind the parenthesis would make it optional
    if not found or _has_alternatives(rule.pattern) or rule.pattern[found.end() :][:1] in ("?", "*", "{"):
        return None
    return found.group(1)


def called_names(text: str) -> str:
    """Upper-cased names directly before a parenthesis; letters that fold to ASCII ones included.

    Looks for the parenthesis first and then back for the name: parentheses are far rarer than names.
    """
    names = f"regexp_extract_all({text}, {sql_text(BEFORE_PARENTHESIS)}, 1)"
    return f"array_distinct(transform({names}, n -> upper(translate(n, 'ıİſK', 'IISK'))))"


#: Looking back needs a bound. Names beyond it are longer than any rule's head: such a rule is tried always.
LONGEST_HEAD = 40
BEFORE_PARENTHESIS = rf"(?U)\((?<=\b(\w{{1,{LONGEST_HEAD}}})\()"


def _possible(rule: Rule, text: str, calls: str) -> str:
    head = _head(rule)
    if head and len(head) <= LONGEST_HEAD:
        return f"array_contains({calls}, '{head}')"
    mark = _MARK_OF_PATTERN.get(rule.pattern)
    return f"contains({text}, {sql_text(mark)})" if mark else "true"


def rule_hits(df: DataFrame, text: str, rules: Sequence[Rule] = LAKE_SQL_RULES) -> DataFrame:
    """Add hits: (name, category, occurrences) of every rule found in the text, in rule order."""
    found = ", ".join(
        f"CASE WHEN {_possible(r, text, 'calls')} THEN named_struct('name', '{r.name}', 'category', '{r.category}', "
        f"'occurrences', CAST(regexp_count({text}, {sql_text(flagged(r.pattern))}) AS BIGINT)) END"
        for r in rules
    )
    # transform over one element evaluates the called names once per row
    hits = f"transform(array({called_names(text)}), calls -> filter(array({found}), h -> h.occurrences > 0))[0]"
    return df.select("*", F.expr(hits).alias("hits"))


def match_rules(df: DataFrame, text: str, rules: Sequence[Rule] = LAKE_SQL_RULES) -> DataFrame:
    """Add matched: names of the rules found in the text."""
    return rule_hits(df, text, rules).withColumn("matched", F.transform("hits", lambda h: h["name"])).drop("hits")


# -- ordered rewriting --------------------------------------------------------------------------------


class Step(NamedTuple):
    """One rewrite as SQL: a label, when to try it (given text and called names), and the rewritten text."""

    label: str
    possible: Callable[[str, str], str]
    rewrite: Callable[[str], str]


MAX_CHUNK = 20


def rewrite(text: str, steps: Sequence[Step], chunk: int = 10) -> Column:
    """Run the steps in order, each on the output of the one before.

    Returns a struct of the text and the labels of the steps that changed it. The steps are folded over each
    row in chunks, and a chunk none of whose steps is possible is passed over as a whole. The plan holds each
    pattern once, where a chain of columns would need a projection per step. The steps of a chunk are
    nested, and the analyzer gives up on very deep nesting, so a chunk has at most ``MAX_CHUNK`` steps.
    """
    if not 1 <= chunk <= MAX_CHUNK:
        raise ValueError(f"chunk must be between 1 and {MAX_CHUNK}")
    chunks = [steps[i : i + chunk] for i in range(0, len(steps), chunk)]

    def run_step(before: str, step: Step) -> str:
        after = f"named_struct('text', new, 'calls', {called_names('new')}, 'applied', array_append(s.applied, {sql_text(step.label)}))"
        tried = f"transform(array({step.rewrite('s.text')}), new -> CASE WHEN new <=> s.text THEN s ELSE {after} END)[0]"
        return f"transform(array({before}), s -> CASE WHEN {step.possible('s.text', 's.calls')} THEN {tried} ELSE s END)[0]"

    def run_chunk(number: int, part: Sequence[Step]) -> str:
        possible = " OR ".join(step.possible("state.text", "state.calls") for step in part)
        return f"WHEN number = {number} AND ({possible}) THEN {reduce(run_step, part, 'state')}"

    start = f"named_struct('text', {text}, 'calls', {called_names(text)}, 'applied', CAST(array() AS ARRAY<STRING>))"
    cases = " ".join(run_chunk(i, part) for i, part in enumerate(chunks))
    return F.expr(
        f"aggregate(sequence(0, {len(chunks) - 1}), {start}, (state, number) -> CASE {cases} ELSE state END, "
        "state -> named_struct('text', state.text, 'applied', state.applied))"
    )


def rule_steps(rules: Sequence[Rule]) -> list[Step]:
    def step(rule: Rule) -> Step:
        pattern, replacement = sql_text(flagged(rule.pattern)), sql_text(spark_replacement(rule.replacement))
        return Step(
            rule.name,
            lambda text, calls: _possible(rule, text, calls),
            lambda text: f"regexp_replace({text}, {pattern}, {replacement})",
        )

    return [step(r) for r in rules]


def _with_result(df: DataFrame, result: Column, labels: str) -> DataFrame:
    return df.select("*", result.alias("__result")).select(
        *df.columns, F.col("__result.text").alias("rewritten"), F.col("__result.applied").alias(labels)
    )


def apply_rules(df: DataFrame, text: str, rules: Sequence[Rule] = LAKE_SQL_RULES) -> DataFrame:
    """Add rewritten and applied (names of the rules that changed the text, in order)."""
    return _with_result(df, rewrite(text, rule_steps(rules)), "applied")


# -- reports on rewritten corpora -----------------------------------------------------------------------


def rule_coverage(df: DataFrame, text: str, rules: Sequence[Rule] = LAKE_SQL_RULES) -> DataFrame:
    """Per rule: files hit and occurrences; rules never hit show 0."""
    # the plain inline adds a filter on the hits below itself, which would try all rules on each text again
    hits = rule_hits(df, text, rules).select(F.inline_outer("hits")).filter("name IS NOT NULL").groupBy("name").agg(
        F.count("*").alias("files"), F.sum("occurrences").alias("occurrences")
    )
    # as many rows as there are rules
    listed = df.sparkSession.createDataFrame(
        [(i, r.name, r.category) for i, r in enumerate(rules)], "ord int, name string, category string"
    )
    return listed.join(hits, "name", "left").fillna(0, ["files", "occurrences"])


def unused_rules(df: DataFrame, text: str, rules: Sequence[Rule] = LAKE_SQL_RULES) -> DataFrame:
    return rule_coverage(df, text, rules).filter("files = 0").select("ord", "name", "category")


def translation_summary(
    files: DataFrame, group: Sequence[str] = (), rules: Sequence[Rule] = LAKE_SQL_RULES
) -> DataFrame:
    """Totals of (status, applied) rows, with the sorted names of the rules applied.

    One flag per rule is aggregated, which stays small however many files a group has.
    """
    done = F.col("status") == "translated"
    names = sorted(r.name for r in rules)
    flags = [F.bool_or(F.array_contains("applied", n)).alias(f"__{n}") for n in names]
    totals = files.groupBy(*group).agg(
        F.count("*").alias("total_files"), F.count_if(done).alias("succeeded"), F.count_if(~done).alias("failed"), *flags
    )
    applied = F.array_compact(F.array(*[F.when(F.col(f"__{n}"), n) for n in names]))
    return totals.select(*group, "total_files", "succeeded", "failed", applied.alias("patterns_applied"))


def batch_completion(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Percent of files no longer pending and the batch status; a batch without files (NULL status) is complete."""
    pending = F.col("status") == "pending"
    return files.groupBy(batch).agg(
        F.coalesce(F.avg(F.when(F.col("status").isNotNull(), F.when(pending, 0.0).otherwise(100.0))), F.lit(100.0)).alias("completion"),
        F.count_if(F.col("status") == "translated").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.when(F.count_if(pending) == 0, "completed").otherwise("pending").alias("batch_status"),
    )


def query_outcomes(paths: DataFrame, texts: DataFrame, path: str, text: str) -> DataFrame:
    """Paths (path, error) with their texts; a missing text counts as empty, a passed query has an estimate."""
    joined = paths.join(texts.select(path, text), path, "left")
    return joined.select(
        path, "error", (F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint") * 10).alias("bytes_scanned")
    )


def query_validation_report(outcomes: DataFrame) -> DataFrame:
    passed = F.col("error").isNull()
    return outcomes.agg(
        F.count("*").alias("total_queries"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        F.coalesce(F.sum(F.when(passed, F.col("bytes_scanned"))), F.lit(0)).alias("total_bytes_scanned"),
    )


def query_validation_failures(outcomes: DataFrame, path: str) -> DataFrame:
    """The failure list, one row each."""
    return outcomes.filter("error IS NOT NULL").select(path, "error")


# -- dependencies ---------------------------------------------------------------------------------------


def _matches(text: Column, pattern: str, flags: str) -> Column:
    return F.regexp_extract_all(text, F.lit(flagged(pattern, "i" in flags)), 0)


def scan_dependencies(df: DataFrame, text: str) -> DataFrame:
    """Per file up to four rows (job_type, references): all matches of each kind of hit, in order."""
    column = F.col(text)
    rows = []
    for kind, job_type, pattern, flags in code.DEPENDENCY_PATTERNS:
        found = _matches(column, pattern, flags)
        if kind == "map_type":
            # both forms need one of the two names; without them the pattern could only backtrack
            found = F.when(column.rlike(flagged("MapType|StructField")), found).otherwise(F.array().cast("array<string>"))
        rows.append(F.struct(F.lit(job_type).alias("job_type"), found.alias("references")))
    hits = F.filter(F.array(*rows), lambda h: F.size(h["references"]) > 0)
    return df.select(*[c for c in df.columns if c != text], F.inline(hits))


def dependency_report(hits: DataFrame) -> DataFrame:
    return hits.groupBy("job_type").agg(
        F.count("*").alias("jobs"), F.sum(F.size("references").cast("bigint")).alias("total_references")
    )


def has_athena_reference(df: DataFrame, text: str) -> DataFrame:
    """Whether a file calls the old query service, through a client or an operator."""
    patterns = [p for _k, job_type, p, _f in code.DEPENDENCY_PATTERNS if job_type in code.REWRITE_JOB_TYPES]
    needs = F.lit(False)
    for p in patterns:
        needs = needs | F.col(text).rlike(flagged(p, ignore_case=False))
    return df.withColumn("status", F.when(needs, "needs_rewrite").otherwise("no_athena_references"))


# -- code -------------------------------------------------------------------------------------------------


def code_class(body: Column) -> Column:
    remote, js, rest = code.CODE_CLASSES
    return (
        F.when(body.rlike(flagged(code.REMOTE_CODE, ignore_case=False)), remote)
        .when(body.rlike(flagged(code.JS_CODE, ignore_case=False)), js)
        .otherwise(rest)
    )


def classify_code(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("category", code_class(F.col(text)))


def classify_code_report(classified: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return classified.groupBy(*group).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("category") == c).alias(c.lower()) for c in code.CODE_CLASSES],
    )


def workflow_steps(
    modules: Mapping[str, str] = code.MODULE_PATHS,
    operators: Mapping[str, str] = code.OPERATOR_NAMES,
    schemes: Mapping[str, str] = code.STORAGE_SCHEMES,
) -> list[Step]:
    """Module paths (longest first, as short ones begin long ones), whole-word operator names, schemes."""

    def step(label: str, old: str, new: str, edit: str) -> Step:
        return Step(label, lambda text, _calls: f"contains({text}, {sql_text(old)})", lambda text: edit.format(text))

    def literal(label: str, old: str, new: str) -> Step:
        return step(label, old, new, f"replace({{}}, {sql_text(old)}, {sql_text(new)})")

    def word(label: str, old: str, new: str) -> Step:
        pattern = flagged(rf"\b{old}\b", ignore_case=False)
        return step(label, old, new, f"regexp_replace({{}}, {sql_text(pattern)}, {sql_text(new)})")

    longest_first = sorted(modules.items(), key=lambda item: -len(item[0]))
    return [
        *[literal(f"Import: {a} → {b}", a, b) for a, b in longest_first],
        *[word(f"Operator: {a} → {b}", a, b) for a, b in operators.items()],
        *[literal(f"Storage path: {a} → {b}", a, b) for a, b in schemes.items()],
    ]


def rewrite_workflow_files(df: DataFrame, text: str) -> DataFrame:
    """Add rewritten and changes."""
    return _with_result(df, rewrite(text, workflow_steps()), "changes")


def rewrite_report(rewritten: DataFrame) -> DataFrame:
    return rewritten.agg(
        F.count("*").alias("processed"),
        F.count_if(F.size("changes") > 0).alias("rewritten"),
        F.coalesce(F.sum(F.size("changes").cast("bigint")), F.lit(0)).alias("changes"),
    )


def rewrite_changes(rewritten: DataFrame, path: str) -> DataFrame:
    """The change list, one row each."""
    return rewritten.select(path, F.explode("changes").alias("change"))


# -- column references ----------------------------------------------------------------------------------------


def wrap_columns(df: DataFrame, text: str, columns: Sequence[str], out: str = "wrapped") -> DataFrame:
    """Wrap references to the columns in UPPER(), unless wrapped already, and count the wraps.

    Letters, digits and underscores on either side make another name, so region2 is not region.
    """
    wrapped = df.withColumn(out, F.col(text)).withColumn("columns_normalised", F.lit(0).cast("bigint"))
    for name in columns:
        pattern = f"(?iu)(?<![A-Za-z_0-9])(?<!UPPER\\()({re.escape(name)})(?![A-Za-z_0-9])"
        wrapped = wrapped.withColumn(
            "columns_normalised", F.col("columns_normalised") + F.regexp_count(out, F.lit(pattern))
        ).withColumn(out, F.regexp_replace(out, pattern, r"UPPER($1)"))
    return wrapped
