"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

1. Lexicon: word heads (whole words and their first four to six letters) are counted per class over the labelled training
   texts, and the heads that stand out in toxic ones are kept. It is joined by a fixed list of insults.
2. Features of a text, all dense numbers: lexicon densities, closeness of lexicon words to second-person words, shares of
   capitals, punctuation and obfuscation (letters replaced by signs or digits, letters set apart by dots or spaces).
3. The training rows are dealt in ``PARTS`` by a hash of the id. The features of a part are made with a lexicon of the other
   parts, so trees see lexicon features as they are on texts that the lexicon has not been made from. Trees are fitted on
   all parts but the first, which calibrates them; texts are then scored with the lexicon of all parts.

Rows of the held-out fold (``crc32(id) mod 3 = 1``) and unlabelled rows are scored, never learned from. Id, source and
language are no inputs. The fit reads at most ``SAMPLE`` labelled rows, by a hash of the id; scoring reads all rows.

Defined cases: NULL texts count as empty, and an empty text gets the score of its (zero) features; rows without a label or
with labels that contradict each other are not learned from; without both classes in each part of the training rows every
score is their share of toxic rows (0 without any). Repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import quoted, utf8
from lakeproof.session import materialize

#: At most about this many labelled rows are read for the fit.
SAMPLE = 40_000
#: The lexicon's size, and what a head needs to enter it: toxic training texts it occurs in, and log odds.
LEXICON, MIN_TEXTS, MIN_ODDS = 4000, 4, 3.0
#: Parts of the training rows.
PARTS = 4
THRESHOLD = 0.7
#: Share of the calibrated score that follows the trees, so that texts of one isotonic step stay in order.
ORDER_SHARE = 0.002

# Common insults, and second-person words, of English, German, French and Spanish.
INSULTS = (
    "asshole bastard bitch clown crap cretin damn disgusting dumb filth filthy freak fuck garbage idiot imbecile loser moron "
    "pathetic pig rat retard scum shit stupid sucker trash ugly vermin whore worthless "
    "abschaum arsch depp dreck dumm idioten mistkerl schlampe schwein trottel versager wertlos widerlich "
    "abruti connard conne imbécile merde minable ordure pourri raclure salaud "
    "asqueroso basura cabrón escoria estúpido gilipollas inútil mierda patético"
)
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros"

_INSULTS = frozenset(w.encode() for w in INSULTS.split())
_SECOND = frozenset(w.encode() for w in SECOND_PERSON.split())
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MASKED = re.compile(rb"(?<![a-z0-9@$!*#\x80-\xff])[a-z0-9@$*#\x80-\xff]+[a-z0-9@$!*#\x80-\xff]*[a-z\x80-\xff0-9@$*#]")
_SIGN, _LETTER = re.compile(rb"[@$!*#0-9]"), re.compile(rb"[a-z\x80-\xff]")
_SPACED = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:[a-z][ ._*-]){3,}[a-z](?![0-9a-z\x80-\xff])")
_UNMASK = bytes.maketrans(b"013457@$!", b"oieastasi")
_NOT_LETTER = re.compile(rb"[^a-z\x80-\xff]+")
HEADS = (4, 5, 6)
FEATURES = (
    "insult_density", "insult_count", "learned_density", "learned_count", "learned_weight", "learned_distinct", "strongest",
    "near_second_person", "second_person", "capitals", "shouted_words", "punctuation", "exclamation", "digits", "obfuscated",
    "unmasked_hits", "spaced_letters", "length", "word_length",
)


def heads(word: bytes) -> list[bytes]:
    """A word, and its first letters: heads of four to six letters end in ``*``."""
    text = word.decode("utf-8", "replace")
    return [word, *((text[:n] + "*").encode() for n in HEADS if len(text) >= n)]


def features(text: bytes | None, learned: dict[bytes, float], weights: dict[bytes, float] | None = None) -> list[float]:
    """``weights`` remembers the weight of words between texts."""
    text = text or b""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(len(words), 1)
    weights = {} if weights is None else weights
    hits, insults, second = [], 0, []
    total, strongest, distinct = 0.0, 0.0, set()
    for at, word in enumerate(words):
        weight = weights.get(word)
        if weight is None:
            weight = max((learned.get(h, 0.0) for h in heads(word)), default=0.0)
            if word in _INSULTS:
                weight += 100.0
            elif word in _SECOND:
                weight = -1.0
            if len(weights) < 100_000:
                weights[word] = weight
        if weight == 0.0:
            continue
        if weight < 0:
            second.append(at)
            continue
        if weight >= 100.0:
            insults += 1
            weight -= 100.0
        hits.append(at)
        distinct.add(word)
        total += weight
        strongest = max(strongest, weight)
    near = 0
    if hits and second:
        places = np.array(second)
        gap = np.searchsorted(places, hits)
        for at, k in zip(hits, gap.tolist(), strict=True):
            near += any(abs(int(places[j]) - at) <= 5 for j in (k - 1, k) if 0 <= j < len(places))
    raw = np.frombuffer(text, dtype=np.uint8)
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, dtype=np.int64)
    size = max(len(raw), 1)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    shouted = len(re.findall(rb"\b[A-Z]{3,}\b", text)) if upper > 2 else 0
    signs = digits + counts[[33, 35, 36, 42, 64]].sum()
    masked = [m for m in _MASKED.findall(low) if len(m) > 3 and _SIGN.search(m) and _LETTER.search(m)] if signs else []
    unmasked = sum(1 for m in masked if _NOT_LETTER.sub(b"", m.translate(_UNMASK)) in _INSULTS or any(h in learned for h in heads(m.translate(_UNMASK))))
    spaced = _SPACED.findall(low)
    m = len(hits)
    return [
        insults / n, min(insults, 50), m / n, min(m, 50), total / n, min(len(distinct), 50), strongest,
        near / n, len(second) / n, upper / max(upper + lower, 1), shouted / n, marks / size, counts[33] / size, digits / size, len(masked) / n,
        float(min(unmasked, 20)), float(min(len(spaced), 20)), float(np.log1p(len(words))), sum(map(len, words)) / n,
    ]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


class Model(NamedTuple):
    learned: dict[bytes, float]
    trees: GBTClassificationModel | None
    isotonic: IsotonicRegressionModel | None
    share: float


def _count_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, part and class, in how many texts a head occurs."""
    counts: Counter[tuple[bytes, int, int]] = Counter()

    def flush() -> pa.RecordBatch:
        head, part, label = zip(*counts, strict=True)
        n = list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(head, pa.binary()), pa.array(part, pa.int32()), pa.array(label, pa.int32()), pa.array(n, pa.int64())], names=["head", "part", "label", "n"])

    for batch in batches:
        for text, part, label in zip(utf8(batch, "text"), batch.column("part").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts.update({(h, part, label) for w in set(_WORD.findall((text or b"").lower())) for h in heads(w)})
        if len(counts) > 300_000:
            yield flush()
    if counts:
        yield flush()


def _lexicons(rows: DataFrame) -> list[dict[bytes, float]]:
    """The lexicon of all parts but one, for each part, and last the one of all parts. The texts are counted once."""
    sizes = {(r["part"], r["label"]): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    counted = rows.select("text", "part", "label").mapInArrow(_count_heads, "head binary, part int, label int, n bigint")
    cells = [(part, label) for part in range(PARTS) for label in (0, 1)]
    table = counted.groupBy("head").agg(*[F.sum(F.when((F.col("part") == p) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{p}_{y}") for p, y in cells])
    toxic = sum((F.col(f"n{p}_1") for p in range(PARTS)), F.lit(0))
    table = materialize(table.filter(toxic >= MIN_TEXTS))
    found = []
    for left_out in [*range(PARTS), None]:
        parts = [p for p in range(PARTS) if p != left_out]
        clean, toxic = (sum((F.col(f"n{p}_{y}") for p in parts), F.lit(0)) for y in (0, 1))
        texts = [sum(sizes.get((p, y), 0) for p in parts) for y in (0, 1)]
        odds = F.log((toxic + 0.5) / (texts[1] + 1.0)) - F.log((clean + 0.5) / (texts[0] + 1.0))
        best = (
            table.select("head", toxic.alias("toxic"), odds.alias("odds")).filter((F.col("toxic") >= MIN_TEXTS) & (F.col("odds") >= MIN_ODDS))
            .orderBy(F.desc("odds"), "head").limit(LEXICON)
        )
        # heads seen in few texts weigh less
        found.append({bytes(r["head"]): r["odds"] * r["toxic"] / (r["toxic"] + MIN_TEXTS) for r in best.collect()})
    return found


def _with_features(rows: DataFrame, learned: dict[bytes, float], text: Column, out: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<double>")
    def dense(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, weights = shared.value, {}
        for part in parts:
            yield pd.Series([features(None if t is None else t.encode(), known, weights) for t in part])

    return rows.withColumn(out, array_to_vector(dense(text)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows outside the held-out fold: at most about ``sample`` of them, chosen by a hash of the id."""
    known = (
        labels.filter(quoted(label_col).isNotNull() & ~held_out(quoted(label_id)) & quoted(label_id).isNotNull())
        .groupBy(quoted(label_id).alias("id")).agg(F.min(quoted(label_col)).alias("label"), F.max(quoted(label_col)).alias("most"))
        .filter("label = most and label in (0, 1)").select("id", F.col("label").cast("int").alias("label"))
    )
    size = known.count()
    if size > sample:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * sample / size))
    # at most ``sample`` rows of two numbers
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = materialize(rows.select("id", "text", "label", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")))
    counts = {(r["part"], r["label"]): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    share = sum(n for (_, label), n in counts.items() if label) / max(sum(counts.values()), 1)
    if len(counts) < 2 * PARTS:
        return Model({}, None, None, share)
    *lexicons, learned = _lexicons(rows)
    parts = [_with_features(rows.filter(F.col("part") == part), lexicon, F.col("text"), "f") for part, lexicon in enumerate(lexicons)]
    dense = materialize(reduce(DataFrame.unionByName, parts).select("label", "part", vector_to_array("f").alias("features")))
    vectors = dense.select(F.col("label").cast("double").alias("label"), "part", array_to_vector("features").alias("features"))
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=3, maxBins=64, seed=7
    ).fit(vectors.filter("part > 0").coalesce(8))
    raw = trees.transform(vectors.filter("part = 0")).select(vector_to_array("probability")[1].alias("p"), "label")
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label").fit(raw)
    return Model(learned, trees, isotonic, share)


def _scored(rows: DataFrame, model: Model, text: Column, out: str) -> DataFrame:
    """``rows`` with a column ``out`` of scores from 0 to 1."""
    if model.trees is None:
        return rows.withColumn(out, F.lit(float(model.share)))
    vector, both, raw, guess, p, step = (f"\u0001{x}" for x in ("features", "probability", "raw", "guess", "p", "step"))
    trees, isotonic = model.trees, model.isotonic
    trees = trees.copy({trees.featuresCol: vector, trees.probabilityCol: both, trees.rawPredictionCol: raw, trees.predictionCol: guess})
    isotonic = isotonic.copy({isotonic.featuresCol: p, isotonic.predictionCol: step})
    applied = trees.transform(_with_features(rows, model.learned, text, vector))
    applied = isotonic.transform(applied.withColumn(p, vector_to_array(quoted(both))[1]))
    score = (1 - ORDER_SHARE) * quoted(step) + ORDER_SHARE * quoted(p)
    return applied.withColumn(out, score).drop(vector, both, raw, guess, p, step)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **names) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, **names)
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return _scored(rows, model, F.col("text"), "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **names) -> DataFrame:
    """``docs`` without the documents that score at least ``threshold``; columns stay as they are."""
    model = fit(docs, labels, id_col, text_col, **names)
    return _scored(docs, model, quoted(text_col), "\u0001score").filter(quoted("\u0001score") < threshold).select(*map(quoted, docs.columns))
