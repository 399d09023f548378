"""Benchmark decontamination with suffix arrays of the training texts.

Each task takes the documents it reads as shards, sorts the suffixes of a shard's words into a
suffix array and binary-searches every suffix of every benchmark item in it. That gives verbatim
matches with their places; those of consecutive words join to the longest matches. A document lies
in one shard, so nothing is shuffled: the work is one pass over the documents.

A suffix that has a word outside the benchmark's vocabulary among its first words cannot match and
is left out of the array before it is sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Chunk, chunks

#: A benchmark of more bytes is dealt with in several passes over the documents, so this bounds
#: what is sent to every executor. A worker holds about 30 times these bytes in its windows.
BLOCK_BYTES = 8 << 20

_made: dict[str, Windows] = {}


def _windows(key: str, items: list[tuple[str, str]], width: int) -> Windows:
    """A worker is used for many tasks; it keeps the windows of one benchmark block."""
    if key not in _made:
        _made.clear()
        _made[key] = Windows(items, width)
    return _made[key]


class Windows:
    """The distinct windows of benchmark items, as word numbers; made once in a Python worker."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        words = list(chunks(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True))
        self.items, self.width = [i for i, _ in items], width
        self.vocabulary = np.unique(np.concatenate([c.hashes for c in words] or [np.zeros(0, np.uint64)]))
        n_items = len(items)
        n = np.zeros(n_items, np.int64)
        for c in words:
            n[c.at : c.at + len(c)] = c.counts()
        n = np.where(n > 0, np.maximum(n - width + 1, 1), 0)  # windows of each item
        kind = np.int32 if len(self.vocabulary) < 2**31 - 1 else np.int64
        rows, at = np.zeros((int(n.sum()), width), kind), 0
        for c in words:
            ids = (np.searchsorted(self.vocabulary, c.hashes) + 1).astype(kind)
            own = n[c.at : c.at + len(c)]
            begin = np.repeat(c.first[:-1] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            end = np.repeat(c.first[1:], own)
            for k in range(width):
                to = begin + k
                rows[at : at + len(begin), k] = np.where(to < end, ids[np.minimum(to, max(len(ids) - 1, 0))], 0) if len(ids) else 0
            at += len(begin)
        item = np.repeat(np.arange(n_items), n)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        order = np.argsort(inverse, kind="stable")
        self.of = np.searchsorted(inverse[order], np.arange(len(self.rows) + 1))
        self.item, self.offset = item[order].astype(np.int32), offset[order].astype(np.int32)

    def _bound(self, array: np.ndarray, after: bool) -> np.ndarray:
        """For each window, how many suffixes sort before it (``after``: or begin with it)."""
        lo, hi = np.zeros(len(self.rows), np.int64), np.full(len(self.rows), len(array))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(array) - 1)
            less, alike = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k in range(self.width):
                ours, theirs = self.rows[:, k], array[mid, k]
                less |= alike & (k < self.lengths) & (theirs < ours)
                alike &= (theirs == ours) | (k >= self.lengths)
            before = (less | alike if after else less) & (lo < hi)
            lo, hi = np.where(before, mid + 1, lo), np.where(before, hi, np.where(lo < hi, mid, hi))
        return lo

    def matches(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Places (words of the chunk) and windows of all occurrences."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.rows) or not len(c.hashes):
            return none
        at = np.searchsorted(self.vocabulary, c.hashes)
        at[at == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[at] == c.hashes, at + 1, 0)
        text = np.repeat(np.arange(len(c)), c.counts())
        end = c.first[1:][text]
        least = int(self.lengths.min())
        gap = np.concatenate([[0], np.cumsum(ids == 0)])
        place = np.arange(len(ids))
        suffixes = np.flatnonzero((place + least <= end) & (gap[np.minimum(place + least, len(ids))] == gap[:-1]))
        if not len(suffixes):
            return none
        to = suffixes[:, None] + np.arange(self.width)
        array = np.where(to < end[suffixes][:, None], ids[np.minimum(to, len(ids) - 1)], 0)
        order = np.lexsort(array.T[::-1])
        suffixes, array = suffixes[order], array[order]
        lo, hi = self._bound(array, False), self._bound(array, True)
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        return suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)], window


def _hits(c: Chunk, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words of each text; places and windows of all occurrences."""
    place, window = w.matches(c)
    edge = np.zeros(len(c.hashes) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + w.lengths[window], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return hit[c.first[1:]] - hit[c.first[:-1]], place, window


def _judge(c: Chunk, w: Windows) -> tuple[np.ndarray, list, list, list]:
    """Per text: hit words; spans of hit words; items; longest matches."""
    n_hit, place, window = _hits(c, w)
    spans, items, longest = ([[] for _ in range(len(c))] for _ in range(3))
    if not len(place):
        return n_hit, spans, items, longest
    text = np.searchsorted(c.first, place, "right") - 1
    n = w.of[window + 1] - w.of[window]
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.of[window], n)
    text, place, length = (np.repeat(x, n) for x in (text, place - c.first[text], w.lengths[window]))
    item, offset = w.item[own], w.offset[own]
    order = np.lexsort((place, place - offset, item, text))
    text, place, length, item, offset = (x[order] for x in (text, place, length, item, offset))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(place - offset) != 0) | (np.diff(place) > 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(text)) - 1
    for b, e in zip(begin.tolist(), last.tolist()):
        k, size = int(text[b]), int(place[e] + length[e] - place[b])
        items[k].append(w.items[item[b]])
        longest[k].append({"item": w.items[item[b]], "doc_word": int(place[b]), "item_word": int(offset[b]), "n_words": size})
        spans[k].append({"begin": int(place[b]), "end": int(place[b]) + size})
    return n_hit, spans, [sorted(set(x)) for x in items], longest


_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_MATCH = pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
_RESULT = "n_words long, n_hit long, spans array<struct<begin:long,end:long>>, items array<string>, matches array<struct<item:string,doc_word:long,item_word:long,n_words:long>>"


def _pass(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _windows(key, sent.value, window)
        for b in batches:
            for c in chunks(b.column(1), ALNUM, lower=True):
                n_hit, spans, found, longest = _judge(c, w)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.at, len(c)), pa.array(c.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(pa.string())), pa.array(longest, pa.list_(_MATCH)), b.column(2).slice(c.at, len(c))],
                    names=["doc_id", "n_words", "n_hit", "spans", "items", "matches", "same"],
                )

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(judge, f"doc_id {kind}, {_RESULT}, same long")


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark as (item, text) in parts of about ``block_bytes``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).where("item is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 64)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


def _items(block: DataFrame) -> list[tuple[str, str]]:
    return [tuple(r) for r in block.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is
    ``window`` consecutive words of an item; an item of fewer words is one window. Returns, for
    every row of ``docs``: doc_id, n_words, n_hit, items (ids as sorted strings) and matches, the
    longest verbatim matches with their first words in document and item.

    Null texts and texts without words have no words and no hits. Items with a null id are left
    out; rows that repeat an item's id count as one item. Repeated documents each get their row,
    null ids included. Empty tables give no hits or no rows. Other columns are not looked at.

    The benchmark is a stated set. Up to ``block_bytes`` of it are sent to the executors at once;
    of a larger one each block gets its own pass over the documents and the passes are merged.
    """
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    n, first = len(blocks), blocks[0]
    if n == 1:
        return _pass(docs, _items(first), window).drop("spans", "same")
    passes = None
    for block in blocks:  # as many as the benchmark has, whatever the documents
        one = _pass(docs, _items(block), window)
        passes = one if passes is None else passes.unionAll(one)
    add = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["begin"]))).alias("n"),
    )
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    merged = passes.groupBy("doc_id", "same", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("matches")).alias("matches"),
        (F.count(F.lit(1)) / n).cast("int").alias("rows"),
    )
    merged = merged.withColumn("n_hit", F.aggregate("spans", start, add)["n"])
    return merged.select("doc_id", "n_words", "n_hit", "items", F.array_distinct("matches").alias("matches"), F.explode(F.sequence(F.lit(1), "rows"))).drop("col")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns; each row is judged by its own text, whatever its id.

    Null and empty texts have no hits and stay. Columns may have any names; those of ``documents`` are not looked
    at but for the text.
    """
    place, names = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*map(str, range(len(names))))  # mapInArrow takes no names with dots
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent, key = docs.sparkSession.sparkContext.broadcast(_items(block)), uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            w = _windows(key, sent.value, window)
            for b in batches:
                for c in chunks(b.column(place), ALNUM, lower=True):
                    yield b.slice(c.at, len(c)).filter(pa.array(_hits(c, w)[0] == 0))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)
