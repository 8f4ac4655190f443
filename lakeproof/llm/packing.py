"""Mixture-controlled packing of tokenised documents into windows of fixed length.

Tokens are dealt to windows by deficit round-robin over one queue per source. Each window adds to every source's deficit
its target share of the window; a queue is served while its deficit covers a grain of tokens (or the rest of its document),
and what it got is subtracted. What a source is owed or has had too much is carried to the next window.

1. Documents are tokenised once and written as items of at most ``ITEM_TOKENS`` tokens, so no document is too long for a task.
2. Items are dealt to blocks of about ``BLOCK_TOKENS`` tokens by a hash of their number in that table. A source that holds a
   third of all rows is spread over all blocks, and so are rows that share an id.
3. As a block drains its queues, its final deficits follow from its token counts alone: share x all tokens - the source's
   tokens. Their running sums over a lane of blocks are the deficits that the next block starts with, so deficits are
   carried across partitions although blocks are packed in parallel.
4. Windows of a block are full but for the last. That one is cut into sequences of power-of-two lengths, so there is no
   padding at all.

Defined cases: NULL and empty texts are one end token; NULL is a source like any other; repeated rows are packed each; a
source without a target gets what is left over; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.common import quoted, utf8
from lakeproof.session import materialize

WINDOW = 1024
END = 0
GRAIN = 256
ITEM_TOKENS = 1 << 16
BLOCK_TOKENS = 1 << 20
#: Blocks over which deficits are carried: a lane's counts are one small group.
LANE_BLOCKS = 1024
#: Number of a block's first sequence; a block has far fewer.
BLOCK_STRIDE = 1 << 20
VOCABULARY = "byte_bpe_50k"
#: The fast coder's pattern fails on runs of white space of some 500,000 characters: texts with runs from here on go to ``tokenizers``.
LONG_RUN = 100_000
RUNS = re.compile(r"\s+|\S+")


@cache
def encoder(vocabulary: str):
    """text -> ids of a public byte-level BPE vocabulary.

    The vocabulary's ranks give the ids of its ``tokenizers`` file several times faster. Texts with runs of ``LONG_RUN``
    characters without, or only of, white space go to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and any(run.end() - run.start() >= LONG_RUN for run in RUNS.finditer(text)):
            return _slow(vocabulary).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@cache
def _slow(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


ITEMS = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)


def _tokenise(vocabulary: str, width: str, item_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc, source, text in zip(ids, sources, utf8(batch, "text"), strict=True):
                tokens = np.array([*encode(text.decode() if text else ""), END], dtype=width)
                for start in range(0, len(tokens), item_tokens):
                    part = tokens[start : start + item_tokens]
                    rows.append((doc, source, start, len(part), len(tokens), part.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ITEMS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ITEMS, strict=True)], schema=ITEMS)

    return run


def deal(queues: dict, deficits: dict, shares: dict, window: int = WINDOW, grain: int = GRAIN) -> Iterator[list[tuple]]:
    """Windows as lists of (item, from, length); ``queues`` hold (item, length) and are drained.

    ``shares`` add up to one over all sources with a target. Sources are visited in turn.
    """
    turn = deque(sorted(queues, key=lambda s: (s is None, s)))
    heads = {s: 0 for s in queues}
    while turn:
        for s in deficits:
            deficits[s] += shares.get(s, 0.0) * window
        room, out, idle = window, [], 0
        while room and turn:
            source = turn[0]
            queue = queues[source]
            item, length = queue[0]
            left = length - heads[source]
            owed = deficits[source]
            if owed < min(grain, left, room) and idle < len(turn):
                idle += 1
                turn.rotate(-1)
                continue
            if idle >= len(turn):  # nobody is owed a grain: the one that is owed most is served ahead
                source = max(turn, key=lambda s: deficits[s])
                queue = queues[source]
                item, length = queue[0]
                left = length - heads[source]
                take = min(left, room, grain)
            else:
                take = min(left, room, max(int(owed), grain))
            idle = 0
            out.append((item, heads[source], take))
            deficits[source] -= take
            room -= take
            heads[source] += take
            if take == left:
                heads[source] = 0
                queue.popleft()
                if not queue:
                    turn.remove(source)
        yield out


def powers(length: int) -> list[int]:
    """A length as a sum of falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


PIECES = "doc_id bigint, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pack_block(window: int, grain: int, width: str, with_ids: bool):
    def sequences(windows: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for pieces in windows:
            size = sum(p[2] for p in pieces)
            if size == window:
                yield pieces
                continue
            rest = deque(pieces)
            for room in powers(size):
                out = []
                while room:
                    item, at, length = rest.popleft()
                    take = min(room, length)
                    out.append((item, at, take))
                    room -= take
                    if take < length:
                        rest.appendleft((item, at + take, length - take))
                yield out

    def run(key: tuple, items: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        items = items.sort_values("uid", kind="stable")
        docs = items["doc_id"].tolist()
        sources = [None if pd.isna(s) else s for s in items["source"]]
        starts, sizes, totals = items["start"].tolist(), items["n"].tolist(), items["doc_tokens"].tolist()
        blobs = [np.frombuffer(b, dtype=width) for b in items["ids"]]
        queues: dict = {}
        for k, (source, size) in enumerate(zip(sources, sizes, strict=True)):
            queues.setdefault(source, deque()).append((k, size))
        shares, deficits = {}, {s: 0.0 for s in queues}
        for source, share, deficit in zip(carried["source"], carried["share"], carried["deficit"], strict=True):
            source = None if pd.isna(source) else source
            if source in queues:
                shares[source], deficits[source] = share, deficit
        rows = []
        for number, pieces in enumerate(sequences(deal(queues, deficits, shares, window, grain))):
            offset = 0
            for k, at, length in pieces:
                part = blobs[k][at : at + length].astype("<u4").tobytes()
                doc = None if pd.isna(docs[k]) else int(docs[k])
                row = (doc, sources[k], starts[k] + at, length, zlib.crc32(part), totals[k], block * BLOCK_STRIDE + number, offset)
                rows.append((*row, part) if with_ids else row)
                offset += length
        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"doc_id": "Int64"})

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict[str | None, float] | None = None,
    vocabulary: str = VOCABULARY,
    window: int = WINDOW,
    grain: int = GRAIN,
    block_tokens: int = BLOCK_TOKENS,
    item_tokens: int = ITEM_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``targets`` are token proportions by source; by default those of the corpus, so that all sources last to the end.
    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    if window & (window - 1):
        raise ValueError("a window's length is a power of two")
    width = "<u2" if vocabulary.endswith("50k") else "<u4"
    rows = docs.select(quoted(id_col).cast("bigint").alias("doc_id"), quoted(source_col).cast("string").alias("source"), quoted(text_col).alias("text"))
    tokenised = rows.mapInArrow(_tokenise(vocabulary, width, item_tokens), "doc_id bigint, source string, start bigint, n bigint, doc_tokens bigint, ids binary")
    # the numbers of the items are fixed by writing them
    items = materialize(tokenised.withColumn("uid", F.monotonically_increasing_id()))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // block_tokens))
    items = items.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    counts = materialize(items.groupBy("block", "source").agg(F.sum("n").alias("n")))
    # one row per source
    sizes = counts.groupBy("source").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / float(max(total, 1)))
    if targets is not None:
        whole = float(sum(targets.values()))
        given = docs.sparkSession.createDataFrame([(s, float(t) / whole) for s, t in targets.items()], "name string, share double")
        sizes = sizes.drop("share").join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("share", F.lit(0.0)).alias("share"))
    shares = sizes.select("source", "share")
    carried = (
        counts.withColumnRenamed("source", "s").join(shares, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        .groupBy(F.expr(f"block div {LANE_BLOCKS}").alias("lane")).applyInPandas(_carry, "block bigint, source string, share double, deficit double")
    )
    packed = items.groupBy("block").cogroup(carried.groupBy("block")).applyInPandas(
        _pack_block(window, grain, width, with_ids), PIECES + (", ids binary" if with_ids else "")
    )
    return packed


def _carry(counts: pd.DataFrame) -> pd.DataFrame:
    """Deficits with which the blocks of a lane start: running sums of what the blocks before left."""
    counts = counts.assign(source=counts["source"].astype(object).where(counts["source"].notna(), None))
    names = list(dict.fromkeys(counts["source"]))
    column = {s: i for i, s in enumerate(names)}
    at = counts["source"].map(lambda s: column[s]).to_numpy()
    blocks, row = np.unique(counts["block"].to_numpy(), return_inverse=True)
    tokens = np.zeros((len(blocks), len(names)))
    np.add.at(tokens, (row, at), counts["n"].to_numpy())
    share = np.zeros(len(names))
    share[at] = counts["share"].to_numpy()
    left = share * tokens.sum(axis=1, keepdims=True) - tokens
    before = np.cumsum(left, axis=0) - left
    return pd.DataFrame(
        {"block": np.repeat(blocks, len(names)), "source": names * len(blocks), "share": np.tile(share, len(blocks)), "deficit": before.reshape(-1)}
    )
