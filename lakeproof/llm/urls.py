"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the urls that no rule fits.

A rule is a host and the beginning of a path; it fits its host and all subdomains. Rules are grouped by host, with one left
join per number of labels that rule hosts have, so a url is joined by equality with the last labels of its host and never
multiplied. The joins are broadcast joins up to ``MAX_RULES`` rules, beyond that they are left to Spark. The longest fitting rule wins; of
equally long ones the one with the longer host, then the greater text.

The model has a weight per bucket of hashed 4-grams of the host and of the path, each part with a start and an end mark. A
part's score is the mean weight of its grams, so long paths weigh no more than short ones. The weights are integers, so sums
are exact in any order. The model is fitted on the driver to a small table of labelled urls (``MAX_LABELLED`` at most) by
Newton's method on the kernel of the rows; it reaches the scan as one array literal. All of the scan is SQL functions: one pass over the
urls, one fold over the characters of each, no shuffle.

Defined cases: a NULL url, or one without ``://``, has an empty host and path, no rule fits it, and the model judges it by
its bias alone; repeated rows and rows without id are judged each by itself; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import quoted

GRAM = 4
#: Buckets of a part; a prime, as grams are hashed as numbers to the base ``BASE``.
BUCKETS, BASE = 2039, 257
SCALE = 1_000_000
PENALTY = 0.02
MAX_LABELLED = 10_000
MAX_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Verdict and rule, host and path together.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Urls to learn from: kinds of pages that training data leaves out, and kinds that it keeps. Most paths are of the same kinds
# in both, so that hosts decide, and some paths tell by themselves.
BLOCKED = (
    "http://www.casino-royal.example.com/en/5924", "http://online-casino.example.org/de/199/", "https://casino-bonus.example.com/fr/8475.html", "http://win-casino-now.example.org/en/1523.html",
    "http://m.poker-win.example.com/es/12?page=2", "https://bets-and-odds.example.org/en/2204", "http://free-bets-now.example.com/de/6749", "https://blog.lucky-slots.example.org/fr/3",
    "http://adult-video.example.com/en/1.html", "https://www.adult-x-chat.example.org/en/2039", "http://xxx-adult.example.com/es/2", "http://m.adult-x-club.example.org/de/6676/",
    "https://porn-tube.example.com/fr/77", "http://ads-track-net.example.com/en/4205#top", "https://ads-server.example.org/es/7", "http://www.track-ads.example.com/en/300",
    "http://ad-tracker.example.org/fr/55", "https://m.click-ads.example.com/de/51.html", "http://spam-links.example.org/en/404", "https://link-farm.example.com/en/8167",
    "http://www.spam-farms.example.org/es/1539", "http://cheap-pills-shop.example.com/en/9318#top", "https://www.cheap-pharma.example.org/de/3674", "http://pills-online.example.com/fr/4874",
    "http://free-warez.example.com/en/199", "https://payday-loan.example.org/en/5815", "http://garden-notes.example.org/slots/free-spins", "http://city-shop.example.com/viagra/order",
    "http://sports-bets.example.com/en/51.html", "https://m.best-bets.example.org/en/6073?page=2", "http://free-poker.example.com/es/4874", "https://free-casino.example.com/en/2615",
    "http://m.bets-today.example.com/en/3674", "https://free-pills.example.com/en/12", "http://farm-of-links.example.com/en/1881", "http://free-adult.example.org/en/77",
)
ALLOWED = (
    "https://www.daily-news.example.com/en/5924", "http://news-archive.example.org/de/1523.html", "https://en.encyclopedia.example.org/fr/2204", "http://blog.garden-notes.example.com/en/8475",
    "https://docs.software.example.org/es/199/", "http://library.example.com/en/1881", "https://www.university.example.org/en/1.html", "http://m.recipes.example.com/de/8475",
    "https://forum.travel.example.org/en/2204?page=2", "http://museum.example.com/fr/3", "https://city-council.example.org/en/300", "http://weather.example.com/es/12",
    "https://blog.astronomy.example.org/es/1539", "http://www.school-board.example.com/en/77", "https://science-journal.example.org/en/4205#top", "http://health-service.example.com/de/55",
    "http://www.poetry.example.org/en/404", "https://railway-museum.example.com/en/199/", "http://bird-watching.example.org/de/2615", "https://open-data.example.com/en/6073",
    "http://m.chess-club.example.org/fr/51.html", "https://law-review.example.com/de/6749.html", "http://maps.example.org/es/7", "https://www.handicraft.example.com/fr/4874",
    "http://blog.thermal.example.com/en/2039", "https://thread.example.org/en/8167", "http://m.station.example.com/es/6676", "https://www.theatre.example.org/en/9318#top",
    "http://www.other-things.example.com/en/5924", "https://m.thousand-lakes.example.com/en/12", "http://north-shore.example.com/de/8475.html", "https://www.mathematics.example.org/en/77",
    "https://blog.than-and-then.example.com/es/7", "http://this-month.example.com/en/4205#top", "http://mother-tongue.example.org/fr/199/", "https://m.whether-report.example.com/en/300",
    "http://the-reading-room.example.com/en/9318#top", "https://www.thirty-steps.example.com/fr/1523.html", "http://author.example.com/en/2204?page=2", "https://earth-notes.example.org/de/1",
    "http://m.other-theory.example.com/en/51.html", "https://method.example.com/es/404", "http://www.fourth-estate.example.org/en/2039", "https://blog.stones.example.com/en/6676/",
    "https://handbook.example.com/fr/55", "http://ancient-history.example.com/en/3674", "http://m.theory-of-art.example.org/es/3", "https://www.table-top.example.com/de/5815",
    "http://outing.example.com/en/8167", "https://www.reason.example.org/fr/6073?page=2", "http://blog.tension.example.com/en/2615", "https://nation.example.com/en/1539",
    "http://www.interest.example.com/de/2", "https://attention.example.org/en/1881", "http://m.answer.example.com/es/4874", "https://blog.house-and-home.example.com/en/6749",
)
LABELLED = tuple((url, 1) for url in BLOCKED) + tuple((url, 0) for url in ALLOWED)


def parts_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a url on the driver."""
    rest = (url or "").partition("://")[2]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))]
    return host.translate(str.maketrans(UPPER, LOWER)), path


def buckets(part: str) -> list[int]:
    """Buckets of the grams of a host or path."""
    codes = [ord(c) for c in f"^{part}$"]
    out = []
    for at in range(len(codes) - GRAM + 1):
        value = 0
        for code in codes[at : at + GRAM]:
            value = value * BASE + code
        out.append(value % BUCKETS)
    return out


@cache
def fit(labelled: Sequence[tuple[str, int]] = LABELLED, penalty: float = PENALTY) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """(bias, weights of host buckets, weights of path buckets) as integers in units of 1 / ``SCALE``."""
    if not 0 < len(labelled) <= MAX_LABELLED:
        raise ValueError(f"the model is fitted to 1 to {MAX_LABELLED} urls")
    x = np.zeros((len(labelled), 2 * BUCKETS))
    for row, (url, _) in enumerate(labelled):
        for begin, part in zip((0, BUCKETS), parts_of(url), strict=True):
            grams = buckets(part)
            for bucket in grams:
                x[row, begin + bucket] += 1 / len(grams)
    y = np.array([label for _, label in labelled], dtype=float)
    kernel = x @ x.T + 1 / BUCKETS
    dual = np.zeros(len(y))
    for _ in range(50):
        margin = kernel @ dual
        share = 1 / (1 + np.exp(-margin))
        curve = np.maximum(share * (1 - share), 1e-9)
        new = np.linalg.solve(curve[:, None] * kernel + penalty / len(y) * np.eye(len(y)), curve * margin + y - share)
        if np.abs(new - dual).max() < 1e-10:
            break
        dual = new
    weights = np.rint(x.T @ dual * SCALE).astype(int)
    return int(np.rint(dual.sum() / BUCKETS * SCALE)), tuple(weights[:BUCKETS].tolist()), tuple(weights[BUCKETS:].tolist())


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _mean_weight(part: Column, weights: Sequence[int]) -> Column:
    """Rounded down mean weight of a part's grams, 0 without any: one fold over its characters."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # a literal after constant folding
    zero = F.lit(0).cast("bigint")
    start = F.struct(*[zero.alias(f"c{j}") for j in range(1, GRAM)], zero.alias("seen"), zero.alias("total"))

    def step(state: Column, letter: Column) -> Column:
        code = F.ascii(letter).cast("bigint")
        value = state["c1"]
        for j in range(2, GRAM):
            value = value * BASE + state[f"c{j}"]
        weight = F.get(table, ((value * BASE + code) % BUCKETS).cast("int"))
        return F.struct(
            *[state[f"c{j + 1}"].alias(f"c{j}") for j in range(1, GRAM - 1)], code.alias(f"c{GRAM - 1}"), (state["seen"] + 1).alias("seen"),
            (state["total"] + F.when(state["seen"] >= GRAM - 1, weight).otherwise(zero)).alias("total"),
        )

    letters = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
    grams = lambda state: state["seen"] - (GRAM - 1)
    return F.aggregate(letters, start, step, lambda state: F.when(grams(state) > 0, F.floor(state["total"] / grams(state))).otherwise(zero))


def judged(
    pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED
) -> DataFrame:
    """``pages`` with the columns host, path, rule, verdict and margin (the model's, in millionths; block from 0 on)."""
    host, path = host_and_path(F.coalesce(quoted(url_col), F.lit("")))
    bias, of_host, of_path = fit(tuple(labelled))
    out = pages.withColumns({"host": host, "path": path})
    margin = F.lit(bias).cast("bigint") + _mean_weight(F.col("host"), of_host) + _mean_weight(F.col("path"), of_path)
    out = out.withColumn("margin", margin)
    listed = [(*rule.partition("/")[::2], rule, verdict) for verdict, rule in rules]
    if any("/" not in rule or verdict not in ("allow", "block") for verdict, rule in rules):
        raise ValueError("a rule is allow or block, and a host followed by the beginning of a path")
    best = F.lit(None).cast("struct<size:int,host:int,rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for host, path, rule, verdict in listed:
        by_host.setdefault(host, []).append(("/" + path, (len(rule), len(host), rule, verdict)))
    for labels in sorted({host.count(".") + 1 for host in by_host}):
        some = [(host, fitting) for host, fitting in by_host.items() if host.count(".") + 1 == labels]
        kind = f"`\u0001host{labels}` string, `\u0001rules{labels}` array<struct<begin:string,best:struct<size:int,host:int,rule:string,verdict:string>>>"
        table = pages.sparkSession.createDataFrame(some, kind)
        last = F.substring_index(F.col("host"), ".", -labels)
        out = out.join(F.broadcast(table) if len(rules) <= MAX_RULES else table, last == F.col(f"\u0001host{labels}"), "left")
        fitting = F.filter(F.col(f"\u0001rules{labels}"), lambda r: F.startswith(F.col("path"), r["begin"]))
        best = F.greatest(best, F.array_max(F.transform(fitting, lambda r: r["best"])))
    out = out.withColumn("\u0001best", best)
    verdict = F.coalesce(F.col("\u0001best.verdict"), F.when(F.col("margin") >= 0, F.lit("block")).otherwise(F.lit("allow")))
    out = out.withColumns({"rule": F.col("\u0001best.rule"), "verdict": verdict})
    return out.drop(*[c for c in out.columns if c.startswith("\u0001")])


def report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, margin), one row per row of ``pages``."""
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).cast("string").alias("url"))
    return judged(rows, **options).select("page_id", "host", "path", "rule", "verdict", "margin")


def keep(pages: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with all their columns."""
    names = [f"c{k}" for k in range(len(pages.columns))]
    rows = judged(pages.toDF(*names), url_col=names[pages.columns.index(url_col)], **options)
    return rows.filter(F.col("verdict") == "allow").select(*names).toDF(*pages.columns)


def sql(rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED) -> str:
    """The registered query for DuckDB, with the fitted weights as a table."""
    bias, *parts = fit(tuple(labelled))
    weights = ", ".join(f"('{kind}', {bucket}, {w})" for kind, part in zip(("host", "path"), parts, strict=True) for bucket, w in enumerate(part) if w)
    listed = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for verdict, rule in rules)
    value = " + ".join(f"CAST(unicode(part[i + {j}]) AS BIGINT) * {BASE ** (GRAM - 1 - j)}" for j in range(GRAM))
    return f"""
WITH rest AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rule(rule, rule_host, begin, verdict) AS (VALUES {listed}),
best AS (
  SELECT r, rule, verdict FROM page JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, begin)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, length(rule_host) DESC, rule DESC) = 1
),
weight(kind, bucket, w) AS (VALUES {weights}),
part AS (SELECT r, 'host' AS kind, '^' || host || '$' AS part FROM page UNION ALL SELECT r, 'path', '^' || path || '$' FROM page),
gram AS (SELECT r, kind, ({value}) % {BUCKETS} AS bucket FROM (SELECT *, unnest(range(1, length(part) - {GRAM - 2})) AS i FROM part)),
mean AS (SELECT r, kind, CAST(floor(CAST(sum(coalesce(w, 0)) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM gram LEFT JOIN weight USING (kind, bucket) GROUP BY r, kind),
margin AS (SELECT r, CAST(sum(m) AS BIGINT) AS m FROM mean GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {bias} + coalesce(m, 0) >= 0 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST({bias} + coalesce(m, 0) AS BIGINT) AS margin
FROM page LEFT JOIN best USING (r) LEFT JOIN margin USING (r)
"""
