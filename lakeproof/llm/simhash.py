"""Near duplicates by SimHash, joined on Golay-code keys.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Two linked fingerprints differ in at most three bits,
so by the pigeonhole principle the errors of the segments (e0, e1, e2) fall into one of five cases, each of which names two
segments of which each has at most one error (see ``CASES``). A segment with no error is a key as it is. A segment with at
most one error is decoded to codewords of the perfect binary Golay code of length 23: of two words at distance one, the
codeword nearest to either is among the codewords within distance four of the other. There are one or six of those. So each
fingerprint is stored under its nearest codewords (one key per case) and looked up under all near ones, and every link is
found. Found pairs are verified by counting the differing bits.

Only distinct fingerprints are joined, so copies cost nothing here, however many there are. Inside one key no list of all
pairs is made: the members of a large bucket are linked by a breadth-first search over those not yet reached, which gives
a spanning forest. Groups are the connected components of the links, found by the star rounds of ``operators.graph``.

Defined cases: a NULL or empty text has fingerprint zero and is linked like any other; fewer words than a shingle are one
shingle; repeated rows each get their row; a group's id ignores NULL ids and is NULL if there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.llm.common import filter_words, numbered, quoted, split_by_filter, utf8
from lakeproof.operators.graph import connected_components
from lakeproof.session import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GENERATOR = 0xC75
#: (number, exactly equal segment or None, segments by near codewords). Errors: case 0 has e0, e1 <= 1. Otherwise e0 >= 2
#: leaves at most one error to e1 and e2 together, or e1 >= 2 at most one to e0 and e2.
CASES = ((0, None, (0, 1)), (1, 1, (2,)), (2, 2, (1,)), (3, 0, (2,)), (4, 2, (0,)))
#: Buckets with more than this many pairs to compare are searched breadth-first.
BUCKET_PAIRS = 4096
_FLIP = np.uint64(1 << 63)


def fingerprint(text: bytes | None) -> int:
    """SimHash over word shingles: a bit is set if it is set in over half of the shingles' XXH64 values."""
    words = text.lower().split() if text else []  # bytes: splits at ASCII white space only
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    hash_of = xxhash.xxh64_intdigest
    count = len(starts)
    hashes = np.fromiter((hash_of(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=count)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 16):  # a very long text in steps
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in utf8(batch, "text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values)], schema=FINGERPRINTS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the number of the error's data bits, and what the numbers of near codewords differ by from the nearest.

    A codeword is 12 data bits over 11 check bits; its number is its data bits. Row s of the last table starts with 0 for
    the nearest codeword; for an error of weight three the other five are at distance four, else they are -1.
    """
    remainders = np.zeros(1 << 12, dtype=np.int64)
    for data in range(1 << 12):
        rest = data << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        remainders[data] = rest
    codewords = np.arange(1 << 12) << 11 | remainders
    error = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[(e & 0x7FF) ^ remainders[e >> 11]] = e
    light = codewords[np.bitwise_count(codewords) == 7]
    near = np.full((1 << 11, 6), -1, dtype=np.int64)
    near[:, 0] = 0
    for s in range(1 << 11):
        if int(error[s]).bit_count() == 3:
            near[s, 1:] = light[(light & error[s]) == error[s]] >> 11
    return remainders, error, near


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: the number of the nearest codeword, and six numbers (-1: none) of those within distance four."""
    remainders, error, near = golay()
    syndrome = (words & 0x7FF) ^ remainders[words >> 11]
    nearest = (words ^ error[syndrome]) >> 11
    return nearest, np.where(near[syndrome] >= 0, nearest[:, None] ^ near[syndrome], -1)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys: an even key stores the fingerprint of that row, the odd number after it looks up."""
    parts = [(fps & np.uint64(0x7FFFFF)).astype(np.int64), (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (fps >> np.uint64(46)).astype(np.int64)]
    nearest, near = zip(*map(near_codewords, parts), strict=True)
    row = np.arange(len(fps))
    out_keys, out_rows = [], []
    for number, exact, coded in CASES:
        head = (row * 0 + number << 23) | (parts[exact] if exact is not None else 0)
        stored, looked, valid = head, head[:, None], np.ones((len(fps), 1), dtype=bool)
        for segment in coded:
            stored = stored << 12 | nearest[segment]
            looked = (looked[:, :, None] << 12 | near[segment][:, None, :] & 0xFFF).reshape(len(fps), -1)
            valid = (valid[:, :, None] & (near[segment][:, None, :] >= 0)).reshape(len(fps), -1)
        out_keys += [stored * 2, looked[valid] * 2 + 1]
        out_rows += [row, np.broadcast_to(row[:, None], valid.shape)[valid]]
    return np.concatenate(out_keys), np.concatenate(out_rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 8192):
            part = fps[at : at + 8192]
            key, row = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join all fingerprints which are connected through steps of at most ``distance`` bits.

    Breadth-first over the fingerprints not yet reached: dense groups, in which nearly all pairs are linked, take a few
    steps, and no list of pairs is made.
    """
    rest = np.unique(fps)
    links = []
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            reached = []
            for at in range(len(frontier)):
                if not len(rest):
                    break
                close = np.bitwise_count(rest ^ frontier[at]) <= distance
                if close.any():
                    reached.append(rest[close])
                    links += [(int(frontier[at]), int(x)) for x in rest[close]]
                    rest = rest[~close]
            frontier = np.concatenate(reached) if reached else rest[:0]
    return links


def _bucket_links(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of complete buckets; rows are sorted by key, so a bucket's stored rows come before its looked-up ones."""
    bucket = key >> 1
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.concatenate((starts[1:], [len(key)]))
    stored = np.add.reduceat(key & 1 == 0, starts)
    looked = ends - starts - stored
    pairs = stored * looked
    left, right = [], []
    for k in np.flatnonzero(pairs > BUCKET_PAIRS).tolist():
        links = np.array(spanning_links(fps[starts[k] : ends[k]]), dtype=np.uint64).reshape(-1, 2)
        left.append(links[:, 0])
        right.append(links[:, 1])
    some = np.flatnonzero((pairs > 0) & (pairs <= BUCKET_PAIRS))
    total = pairs[some]
    for at in np.array_split(np.arange(len(some)), max(1, int(total.sum()) >> 20)):
        if not len(at):
            continue
        n = total[at]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k = np.repeat(some[at], n)
        a = fps[starts[k] + offset // looked[k]]
        b = fps[starts[k] + stored[k] + offset % looked[k]]
        close = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
        left.append(a[close])
        right.append(b[close])
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    low, high = np.minimum(a ^ _FLIP, b ^ _FLIP) ^ _FLIP, np.maximum(a ^ _FLIP, b ^ _FLIP) ^ _FLIP
    both = np.unique(np.stack([low, high], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by key; a bucket is kept until it is complete."""
    names = ["src", "dst"]
    held_keys, held_fps, held = [], [], 0

    def found(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _bucket_links(key, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    for batch in batches:
        held_keys.append(batch.column("key").to_numpy(zero_copy_only=False))
        held_fps.append(batch.column("fp").to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held < 1 << 17:
            continue
        key, fps = np.concatenate(held_keys), np.concatenate(held_fps)
        cut = int(np.searchsorted(key >> 1, key[-1] >> 1))
        if cut:
            yield found(key[:cut], fps[:cut].view(np.uint64))
        held_keys, held_fps, held = [key[cut:]], [fps[cut:]], len(key) - cut if cut else 0
    if held_keys:
        key, fps = np.concatenate(held_keys), np.concatenate(held_fps)
        if len(key):
            yield found(key, fps.view(np.uint64))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column ``fp``) which connect all within ``DISTANCE`` bits."""
    rows = distinct.select("fp").mapInArrow(_keys, "key bigint, fp bigint")
    dealt = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(_links, "src bigint, dst bigint")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``."""
    marked = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = materialize(fingerprint_links(distinct).distinct())
    groups = materialize(connected_components(links))
    # written, so that Spark can split the members of a large component in the join
    smallest = materialize(groups.join(distinct, groups["member"] == distinct["fp"]).groupBy("component").agg(F.min("least").alias("least")))
    named = groups.join(smallest, "component").select(F.col("member").alias("fp"), F.col("least").alias("component_id"))
    ids = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # written, so that Spark can split the copies of a frequent fingerprint in the join
    ids = materialize(ids)
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id.

    Rows are dropped by id and fingerprint, so texts under one id are judged apart. Rows that repeat the smallest id all
    stay, and so do rows without an id.
    """
    rows, (id_name, text_name) = numbered(docs, id_col, text_col)
    return _deduplicate(rows, id_name, text_name).toDF(*docs.columns)


def _deduplicate(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, fp = "\u0001id", "\u0001fp"
    groups = report(docs, id_col, text_col)
    dropped = materialize(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("fingerprint").alias(fp)).distinct())
    # only rows whose id may be among the dropped ones get their fingerprint again, and are shuffled
    number = quoted(id_col).cast("bigint")
    words, bits = filter_words(dropped.select(F.xxhash64(quoted(key)).alias("hash")))
    maybe, clean = split_by_filter(docs, F.xxhash64(number), materialize(words), bits)
    own = "\u0001own"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(own, pa.array([f"{fingerprint(t):016x}" for t in utf8(batch, text_col)], pa.string()))

    marked = maybe.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.StringType())]))
    return clean.unionByName(marked.join(dropped, (number == quoted(key)) & (quoted(own) == quoted(fp)), "left_anti").drop(own))
