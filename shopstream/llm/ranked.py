"""Ranked lexical search by one automaton over all documents.

An Aho-Corasick automaton holds every distinct term of the query items, each with a guard of one space
on both sides. A text is mapped to lower-case terms with spaces between them, so the automaton's outputs
are the whole terms that it shares with the items, and their numbers are the term frequencies; no index
of the documents is made. The documents are read twice: for the statistics that weights need, counted
in tasks and summed, and for the scores, of which a task keeps only an item's best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import ALNUM, _LOWER, _texts

#: Items are searched for together as long as their distinct terms have so many bytes: an automaton
#: takes some 200 times that in a worker. More items take one more reading of the documents each.
BLOCK_BYTES = 1 << 20
#: Pairs of a matched term and an item with it that are summed at a time, and scores held meanwhile.
STEP, SCORES = 1 << 20, 1 << 21
#: Parts that an item's best rows are reduced in before they meet.
SALTS = 64
_DOCUMENTS, _TERMS = -1, -2
_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MAP = np.where(ALNUM[_LOWER], _LOWER, 0x20).astype(np.uint8)


class Automaton:
    """The terms of a block of items; built once in a task."""

    def __init__(self, terms: list[str]):
        self.terms, self._built = terms, None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "_built": None}

    def built(self) -> ahocorasick.Automaton:
        if self._built is None:
            self._built = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):  # bytes as characters of one byte each
                self._built.add_word(f" {term.encode().decode('latin-1')} ", k)
            self._built.make_automaton()
        return self._built

    def counts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each text: how many terms it has, which of the automaton's terms, and how often."""
        built = self.built()
        offsets, data = _texts(column)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = np.full(b - a + 2, 0x20, np.uint8)
            own[1:-1] = _MAP[data[a:b]]
            n = int(np.count_nonzero((own[1:] != 0x20) & (own[:-1] == 0x20)))
            found = np.fromiter((k for _, k in built.iter(own.tobytes().decode("latin-1"))), np.int64) if n and self.terms else np.zeros(0, np.int64)
            yield n, *np.unique(found, return_counts=True)


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, term, times and block: blocks have about ``BLOCK_BYTES``, an item is in one."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(item_col).alias("item_id"), lower.alias("text")).where("item_id is not null and text is not null").distinct()
    return rows.select("item_id", F.explode(F.regexp_extract_all("text", F.lit(_CLASS), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _blocked(terms: DataFrame, most: int) -> DataFrame:
    """Items are dealt to buckets by hash; a bucket is cut where its running sum passes ``most``."""
    sizes = terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 2).alias("bytes"))
    buckets = max(1, math.ceil((sizes.agg(F.sum("bytes")).first()[0] or 0) / most))
    own = Window.partitionBy("bucket").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(own), F.lit(0))
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets))).select("item_id", F.struct("bucket", F.floor(before / most).alias("part")).alias("block"))
    return terms.join(dealt, "item_id")


def _statistics(docs: DataFrame, automaton: Automaton) -> dict[int, int]:
    """Documents with a term of the automaton by its number, documents with any term, and all terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, total, documents = np.zeros(len(automaton.terms), np.int64), 0, 0
        for b in batches:
            for n, terms, _ in automaton.counts(b.column(0)):
                holding[terms] += 1
                total += n
                documents += n > 0
        own = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([*own.tolist(), _DOCUMENTS, _TERMS], pa.int64()), pa.array([*holding[own].tolist(), documents, total], pa.int64())], names=["k", "n"])

    found = docs.select("text").mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return dict(map(tuple, found.collect()))  # two rows more than the automaton has terms


class _Best:
    """The best ``k`` documents of each item so far, by score and then by least id; a document counts once."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        by_doc = np.lexsort((-score, doc, item))
        item, score, doc = item[by_doc], score[by_doc], doc[by_doc]
        once = np.ones(len(item), bool)
        once[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
        item, score, doc = item[once], score[once], doc[once]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        last = rank == self.k - 1
        self.least[item[last]] = score[last]


class Scorer:
    """Scores of texts for all items of a block."""

    def __init__(self, automaton: Automaton, weights: list[int], postings: list[list[tuple[int, int]]], items: int, documents: int, terms: int):
        self.automaton, self.items, self.documents, self.terms = automaton, items, documents, terms
        self.weights = np.array(weights, np.int64)
        self.first = np.cumsum([0, *map(len, postings)])
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.times = np.array([c for p in postings for _, c in p], np.int64)
        most = np.zeros(items)
        np.add.at(most, self.item, self.times * np.repeat(self.weights, np.diff(self.first)) * 1e6)
        #: Sums of integers are exact in doubles up to here.
        self.exact = float(most.max(initial=0)) < 2**53

    def scores(self, own: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """A row for each text, a column for each item."""
        value = []
        for n, terms, tf in own:
            m = 25 + 75 * n * self.documents // self.terms
            value.append(self.weights[terms] * (1_000_000_000 * tf // (1_000 * tf + 8 * m)))
        value, terms = np.concatenate(value), np.concatenate([t for _, t, _ in own])
        row = np.repeat(np.arange(len(own)), [len(t) for _, t, _ in own])
        n = self.first[terms + 1] - self.first[terms]
        place = np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        to, gives = np.repeat(row * self.items, n) + self.item[place], np.repeat(value, n) * self.times[place]
        if self.exact:
            out = np.bincount(to, gives, len(own) * self.items).astype(np.int64)
        else:
            np.add.at(out := np.zeros(len(own) * self.items, np.int64), to, gives)
        return out.reshape(len(own), self.items)

    def best(self, ids: pa.Array, texts: pa.Array, best: _Best) -> None:
        held, ids_held, cost = [], [], 0

        def judge() -> None:
            found = self.scores(held)
            row, item = np.nonzero(found >= best.least)
            best.add(item, found[row, item], np.array(ids_held, np.int64)[row])
            held.clear()
            ids_held.clear()

        for doc, counted in zip(ids.to_pylist(), self.automaton.counts(texts)):
            if doc is None or not len(counted[1]):
                continue
            held.append(counted)
            ids_held.append(doc)
            cost += int((self.first[counted[1] + 1] - self.first[counted[1]]).sum())
            if cost > STEP or len(held) * self.items > SCORES:
                judge()
                cost = 0
        if held:
            judge()


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The best of each item, in parts first, so that no task gets all rows of an item that many tasks know."""
    for part in ([F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], []):
        own = Window.partitionBy("item", *part).orderBy(F.desc("score"), "doc_id")
        same = Window.partitionBy("item", "doc_id").orderBy(F.desc("score"))
        rows = (rows.withColumn("rank", F.row_number().over(same)).where("rank = 1") if part else rows).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return rows


def search(documents: DataFrame, items: DataFrame, k: int = 10, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents of the highest score for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters, digits and non-ASCII characters, with A-Z as a-z. Scores are the
    integers of the job's formula: weights fall with the documents that hold a term, frequencies are
    damped and divided by a document's length. Equal scores rank by least doc_id; only scores above 0 count.

    Null texts have no terms. A document without terms scores nothing and is not counted. Rows with a
    null doc_id count in the statistics but are no results; rows that repeat a doc_id count each in the
    statistics, and the best of them is the document's result. Items with a null id or text, and those
    without a term that a document holds, have no results; equal rows of an item count once, different
    texts of one item_id are taken together. Ids of documents are integers; other columns are not looked
    at. Empty tables give an empty result. Whole texts are read, whatever their length.

    Items are searched for in blocks of ``block_bytes`` of distinct terms (one item is never divided);
    each block reads the documents twice. The driver holds the terms of one block.
    """
    spark = documents.sparkSession
    tables = Scratch(spark, "ranked")
    docs = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    item_kind = items.schema[item_col].dataType.simpleString()
    terms = tables.put(_blocked(_items(items, item_col, item_text_col), block_bytes), "items")
    found = []
    for block in [r[0] for r in terms.select("block").distinct().orderBy("block").collect()]:
        own = terms.where((F.col("block.bucket") == block["bucket"]) & (F.col("block.part") == block["part"])).orderBy("term", "item_id").collect()
        ids = list(dict.fromkeys(r["item_id"] for r in own))
        place = {x: i for i, x in enumerate(ids)}
        postings: dict[str, list[tuple[int, int]]] = {}
        for r in own:
            postings.setdefault(r["term"], []).append((place[r["item_id"]], r["times"]))
        automaton = Automaton(list(postings))
        counted = _statistics(docs, automaton)
        n, total = counted.get(_DOCUMENTS, 0), counted.get(_TERMS, 0)
        if n:
            weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * counted.get(j, 0) + 1))) for j in range(len(automaton.terms))]
            scorer = Scorer(automaton, weights, list(postings.values()), len(ids), n, total)
            found.append(tables.put(_scored(docs, scorer, k, spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_kind}")), f"block{len(found)}"))
    out = found[0] if found else spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id long, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    return tables.keep(out, *[f"block{i}" for i in range(len(found))])


def _scored(docs: DataFrame, scorer: Scorer, k: int, ids: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(scorer.items, k)
        for b in batches:
            scorer.best(b.column(0), b.column(1), best)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.doc), pa.array(best.score)], names=["item", "doc_id", "score"])

    best = _top(docs.mapInArrow(work, "item int, doc_id long, score long"), k)
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
