"""Problem 7: held-out passages in the documents.

A document leaks an item if the two share RUN consecutive words. Each window of
RUN words holds RUN - SHINGLE + 1 shingles of SHINGLE words, and all of them
must be in the document. So one shingle of each window is enough as a
necessary prefix token: the rarest, by its count over all documents.

This is a join of two tables of shingles, whatever the number of items:

1. The items' shingles are counted over the whole corpus (first scan).
2. Each item's windows choose their rarest shingle; windows next to each other
   mostly choose the same one, which leaves few prefix tokens.
3. The documents' shingles meet the prefix tokens in an equi-join on their hash
   (second scan). A length and position bound is part of the join: a window
   must fit around the shingle on both sides.
4. What meets is verified word by word around the shingle, over at most RUN
   words to each side, so every window of a run is seen by its own prefix
   token; overlapping places on one diagonal are one run.

Before a document's shingles leave Python they pass a bitmap of the hashes that
the other side has at all; it has at most 2 ** FILTER_BITS bits and only saves
rows, as the join decides. The prefix tokens are broadcast up to BROADCAST_ROWS
rows; beyond, the join is a shuffle with the documents' rows salted, as one
shingle may be in a third of all documents.

Defined cases: null or empty texts and items of fewer than RUN words match
nothing; repeated rows give one result; an id may have several texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Filter, arrow_schema, bitmap, cut_lineage

RUN, SHINGLE = 10, 5
#: Words to each side of a shingle that a window around it can have.
SIDE = RUN - SHINGLE
BATCH_ROWS = 4000
BROADCAST_ROWS = 100_000
SALT = 16
#: Words whose hashes a task keeps.
KEPT_WORDS = 500_000

_MARKUP = re.compile(r"(?<=\])\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|(?<=\])\[[^\]\n]{0,200}\]|</?[A-Za-z][^<>\n]{0,200}>|&(?:nbsp|shy|amp|quot|#\d{1,6});")
_UNSEEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_MARKS = re.compile("[\u0300-\u036f\uff01-\uff5e]")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits in small letters, without markup and unseen characters."""
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        if _MARKS.search(text):
            text = unicodedata.normalize("NFKC", text)
    if "](" in text or "][" in text or "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())




class _WordHashes(dict):
    """The hash of each word, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _hashes(ws: list[str], memo: _WordHashes) -> np.ndarray:
    """A hash of the shingle that begins at each word; the last SHINGLE - 1 words have none."""
    h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    n = len(ws) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        out += h[k : n + k] * _MIX[k]
    out ^= out >> np.uint64(29)
    return out


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, twin, body): texts that aren't empty; ``twin`` tells apart the texts of one id."""
    body = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(body).alias("twin"), body.alias("body")).filter("body <> ''")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[str], np.ndarray, np.ndarray]]:
    """(ids, twins, words of all texts, first word of each text, hashes) of each part of a batch."""
    memo = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(at, BATCH_ROWS)
            ids, twins, texts = (part.column(i).to_pylist() for i in range(3))
            flat: list[str] = []
            starts = [0]
            for t in texts:
                flat.extend(words(t))
                starts.append(len(flat))
            if flat:
                yield ids, twins, flat, np.array(starts), _hashes(flat, memo)


def _within(h: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places of shingles those that lie in one text, and that text."""
    owner = np.searchsorted(starts, at, side="right") - 1
    own = at + SHINGLE <= starts[owner + 1]
    return at[own], owner[own]


SHINGLE_DDL = "id bigint, twin bigint, pos int, hash bigint, n_words int, shingle string, before array<string>, after array<string>"


def shingles(texts: DataFrame, only: tuple[int, Broadcast] | None = None) -> DataFrame:
    """Rows of SHINGLE_DDL: shingles with up to SIDE words before (nearest first) and after; with ``only`` those that pass a bitmap."""
    schema = arrow_schema(SHINGLE_DDL)

    def run(batches):
        keep = Filter(only[0], only[1].value) if only else None
        for ids, twins, flat, starts, h in _batches(batches):
            at, owner = _within(h, starts, keep.passing(h) if keep else np.arange(len(h)))
            for lo in range(0, len(at), 50_000):
                rows = []
                for i, d in zip(at[lo : lo + 50_000].tolist(), owner[lo : lo + 50_000].tolist()):
                    a, b = int(starts[d]), int(starts[d + 1])
                    rows.append((ids[d], twins[d], i - a, b - a, " ".join(flat[i : i + SHINGLE]), flat[max(a, i - SIDE) : i][::-1], flat[i + SHINGLE : min(b, i + RUN)]))
                if rows:
                    c = list(zip(*rows))
                    hashes = h[at[lo : lo + 50_000]].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*c[:3], hashes, *c[3:]), schema)], schema=schema)

    return texts.mapInArrow(run, SHINGLE_DDL)


def shingle_counts(texts: DataFrame, only: tuple[int, Broadcast]) -> DataFrame:
    """(hash, n): how often the shingles that pass a bitmap are in all texts."""
    schema = arrow_schema("hash bigint, n bigint")

    def run(batches):
        keep = Filter(only[0], only[1].value)
        for _, _, _, starts, h in _batches(batches):
            at, _ = _within(h, starts, keep.passing(h))
            if len(at):
                found, n = np.unique(h[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], schema=schema)

    return texts.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def prefix_tokens(item_shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """The shingles that the windows of the items choose: the rarest of each, the first of equals."""
    counted = item_shingles.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = Window.partitionBy("id", "twin").orderBy("pos")
    chosen = F.min(F.struct("n", "pos")).over(own.rowsBetween(0, SIDE))
    # Every row also learns whether one of the windows that hold it has chosen it.
    by_window = F.when(F.col("pos") <= F.col("n_words") - RUN, F.col("chosen.pos"))
    picks = F.array_contains(F.collect_list(by_window).over(own.rowsBetween(-SIDE, 0)), F.col("pos"))
    return counted.withColumn("chosen", chosen).withColumn("picked", picks).filter("picked").drop("chosen", "picked")


def _alike(a: Column, b: Column) -> Column:
    """How many words two lists share from their beginning, up to SIDE."""
    return sum((((F.size(a) >= k) & (F.slice(a, 1, k) == F.slice(b, 1, k))).cast("int") for k in range(1, SIDE + 1)), F.lit(0))


LEAK_DDL = "doc_id bigint, item_id bigint, longest_run int, item_words int, places int"


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS, salt: int = SALT
) -> DataFrame:
    """Rows of LEAK_DDL: each document and item that share RUN consecutive words, with the longest run and the number of runs."""
    corpus = _texts(docs, id_col, text_col)
    known = shingles(_texts(items, item_id, item_text).filter("id IS NOT NULL").distinct()).filter(f"n_words >= {RUN}")
    n = known.count()
    if not n:
        return docs.sparkSession.createDataFrame([], LEAK_DDL)
    tokens = cut_lineage(prefix_tokens(known, shingle_counts(corpus, bitmap(known, n))))
    n = tokens.count()
    hits = shingles(corpus, bitmap(tokens, n)).select(F.col("id").alias("doc_id"), F.col("twin").alias("d_twin"), "pos", "hash", F.col("shingle").alias("d_shingle"), F.col("before").alias("d_before"), F.col("after").alias("d_after"))
    tokens = tokens.select(F.col("id").alias("item_id"), F.col("twin").alias("i_twin"), F.col("pos").alias("i_pos"), "hash", F.col("n_words").alias("item_words"), "shingle", "before", "after")
    if n <= broadcast_rows:
        met = hits.join(F.broadcast(tokens), "hash")
    else:
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "d_twin", "pos"), F.lit(salt)))
        met = hits.join(tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))), ["hash", "salt"])
    room = F.least(F.size("d_before"), F.size("before")) + F.least(F.size("d_after"), F.size("after")) >= RUN - SHINGLE
    left, right = _alike(F.col("d_before"), F.col("before")), _alike(F.col("d_after"), F.col("after"))
    runs = met.filter(room & (F.col("d_shingle") == F.col("shingle"))).withColumns({"left": left, "right": right}).filter(f"left + right >= {RUN - SHINGLE}")
    diagonal = ["doc_id", "d_twin", "item_id", "i_twin", "shift"]
    # Copies of a document give the same places: they are dropped before and in the shuffle.
    places = runs.select(
        "doc_id", "d_twin", "item_id", "i_twin", (F.col("pos") - F.col("i_pos")).alias("shift"), (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + SHINGLE + F.col("right")).alias("hi"), "item_words"
    ).distinct()
    own = Window.partitionBy(*diagonal).orderBy("lo", "hi")
    before = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    run_no = F.sum(F.coalesce(F.col("lo") > F.col("before"), F.lit(True)).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    whole = places.withColumn("before", before).withColumn("run", run_no).groupBy(*diagonal, "run").agg((F.max("hi") - F.min("lo")).alias("words"), F.max("item_words").alias("item_words"))
    per_text = whole.groupBy("doc_id", "d_twin", "item_id", "i_twin").agg(F.max("words").alias("longest_run"), F.max("item_words").alias("item_words"), F.count("*").cast("int").alias("places"))
    return per_text.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.max("item_words").alias("item_words"), F.max("places").alias("places"))
