"""Problem 6: documents put into containers of fixed capacity, sized in tokens.

Sizes are tokens of a public byte-pair vocabulary, whose file is a parameter. A
text that alone exceeds the capacity is cut into full containers and a rest; no
other text is cut. Texts and rests are packed best-fit decreasing: from the
largest on, each goes into the open container with the least room that takes
it. The open containers are kept by their room in a segment tree over the
capacity, which finds that container in logarithmic time; the tree has only the
nodes above rooms that occur, so its memory follows the documents of a shard
and not the capacity.

Rows are spread by a hash of their number over shards of about SHARD_ITEMS, so
repeated and null ids are spread too; each shard and capacity is packed by one
task. Best fit leaves at most one container of a
shard half empty or more, so the room lost to sharding is at most half a
container in SHARD_ITEMS documents.

Defined cases: null and empty texts have no tokens and are not packed; windows
with a null or non-positive capacity are left out; repeated ids are separate
documents. Windows may be any number: they are packed in blocks of WINDOW_BLOCK,
each from one reading of the texts.
"""

from __future__ import annotations

import base64
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's text is split before its merges; the public pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 25_000
WINDOW_BLOCK = 64


class RoomTree:
    """Open containers by their room, with the tightest that takes a size."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count: dict[int, int] = {}
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        at = self.open.get(room)
        if at:
            at.append(container)
            return
        self.open[room] = [container]
        count, i = self.count, room + self.width
        while i:
            count[i] = count.get(i, 0) + 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, container) of the container with the least room of ``size`` or more; it is no longer open."""
        count, i = self.count, size + self.width
        if i not in count:
            # Up to the first subtree to the right that isn't empty, then down its left edge.
            while True:
                if i <= 1:
                    return None
                if not i & 1 and i + 1 in count:
                    i += 1
                    break
                i >>= 1
            while i < self.width:
                i *= 2
                if i not in count:
                    i += 1
        room = i - self.width
        at = self.open[room]
        container = at.pop()
        if not at:
            # The last container of this room: nodes count rooms, and those without any are dropped.
            while i:
                if count[i] == 1:
                    del count[i]
                else:
                    count[i] -= 1
                i >>= 1
        return room, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; sizes are from 1 to capacity."""
    tree = RoomTree(capacity)
    where = [0] * len(sizes)
    n = 0
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = sizes[i]
        got = tree.take(size)
        if got is None:
            room, container, n = capacity, n, n + 1
        else:
            room, container = got
        where[i] = container
        if room > size:
            tree.add(room - size, container)
    return where


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, carry: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each text, with an integer column ``carry``; the vocabulary file is read once and sent to the tasks."""
    data = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def make():
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def fn(cols):
            counts = {"doc_id": cols["key"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in cols["body"]]}
            return counts | ({carry: cols["more"]} if carry else {})

        return fn

    src = df.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).cast("string").alias("body"), *([F.col(carry).cast("int").alias("more")] if carry else []))
    return map_rows(src, make, "doc_id bigint, n_tokens bigint" + (f", {carry} int" if carry else ""))


PLACE_DDL = "window_id int, capacity int, container string, doc_id bigint, piece int, token_start bigint, n_tokens int"


def pack(df: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Rows of PLACE_DDL: the container of each text, or of each of its pieces, for each window."""
    import pandas as pd

    wanted = [(w.window_id, w.capacity) for w in windows.select(F.col("window_id").cast("int"), F.col("capacity").cast("int")).filter("capacity > 0").distinct().orderBy("window_id", "capacity").toLocalIterator()]
    if not wanted:
        return df.sparkSession.createDataFrame([], PLACE_DDL)
    shards = max(1, -(-df.count() // shard_items))
    # The number of a row, which is the same whenever its partition is read, spreads equal ids and equal rows.
    numbered = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("body"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    sizes = token_counts(numbered, "key", "body", vocabulary, "shard").filter("n_tokens > 0")
    columns = [x.split()[0] for x in PLACE_DDL.split(", ")]

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        window, capacity, shard = (int(x) for x in key)
        n = pdf["n_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        ids = pdf["doc_id"].to_numpy()
        # Full containers of texts that exceed the capacity.
        owner = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        labels = [f"{shard}:full:{i}" for i in range(len(owner))]
        some = np.flatnonzero(rest)
        where = best_fit_decreasing(rest[some].tolist(), capacity)
        out = pd.DataFrame(
            {
                "window_id": window,
                "capacity": capacity,
                "container": labels + [f"{shard}:{c}" for c in where],
                "doc_id": np.concatenate([ids[owner], ids[some]]),
                "piece": np.concatenate([piece, full[some]]),
                "token_start": np.concatenate([piece * capacity, full[some] * capacity]),
                "n_tokens": np.concatenate([np.full(len(owner), capacity), rest[some]]),
            }
        )
        return out[columns]

    parts = []
    for at in range(0, len(wanted), WINDOW_BLOCK):
        block = F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).alias("capacity")) for w, c in wanted[at : at + WINDOW_BLOCK]])
        rows = sizes.select("doc_id", "n_tokens", "shard", F.explode(block).alias("w")).select("doc_id", "n_tokens", "shard", "w.*")
        parts.append(rows.groupBy("window_id", "capacity", "shard").applyInPandas(fill, PLACE_DDL))
    return reduce(DataFrame.unionByName, parts)


def fill_report(places: DataFrame) -> DataFrame:
    """For each window: containers, tokens and the share of room that is used."""
    return places.groupBy("window_id", "capacity").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")).withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity")))
