"""Substring dedup: windows of words repeated in other documents, found by level-wise doubling.

A window can only be repeated if its parts are. So windows of a short length are counted first; those
that are repeated alone are extended to twice the length (at most the wanted one), and so on until
the wanted length is reached or no candidates survive. At each length a window of the wanted length
is tested by one of its parts, the one with the least hash: equal windows choose equal parts, and
neighbouring windows mostly share theirs, so only a small part of all positions is counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import CHECK_POWERS, SPACED, Chunk, chunks, sliding

_TOP = np.uint64(2**64 - 1)


def levels(window: int, least: int = 4) -> list[int]:
    """Lengths, each at most twice the one before: 13 gives 7, 13."""
    out = [window]
    while out[0] > 2 * least - 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _anchors(c: Chunk, width: int, window: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word windows of a chunk, and which of them some alive window chooses."""
    hashes, inside = c.windows(width)
    n = len(alive)
    hashes = np.minimum(np.where(inside, hashes, _TOP), _TOP - np.uint64(1))
    parts = window - width + 1
    least = np.where(alive, sliding(hashes, parts, np.minimum)[:n], np.uint64(0))
    pad = np.zeros(parts - 1, np.uint64)
    chosen = sliding(np.concatenate([pad, least, pad]), parts, np.maximum)
    return hashes, (chosen == hashes) & (hashes > 0) & inside


def _alive(c: Chunk, width: int, window: int, alive: np.ndarray, repeated: list[np.ndarray]) -> np.ndarray:
    """The windows whose part of ``width`` words is repeated; ``repeated``: hashes of each text."""
    hashes, chosen = _anchors(c, width, window, alive)
    text = np.repeat(np.arange(len(c)), c.counts())[: len(hashes)]
    known = np.zeros(len(hashes), bool)
    bounds = np.searchsorted(text, np.arange(len(c) + 1))
    for k, own in enumerate(repeated):
        part = slice(bounds[k], bounds[k + 1])
        known[part] = np.isin(hashes[part], own)
    parts = window - width + 1
    least = sliding(hashes, parts, np.minimum)[: len(alive)]
    left = sliding(np.where(known & chosen, hashes, _TOP), parts, np.minimum)[: len(alive)]
    return alive & (least == left)


def _parts(rows: DataFrame, widths: list[int], window: int) -> DataFrame:
    """(doc_id, hash, check, place) of the parts of the last width; ``rows`` has doc_id, text and, for each width before, the repeated hashes of the text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    last = widths[-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), SPACED, lower=False):
                alive = c.windows(window)[1]
                for k, width in enumerate(widths[:-1]):
                    own = b.column(2 + k).slice(c.at, len(c))
                    alive = _alive(c, width, window, alive, [np.array(x or [], np.int64).view(np.uint64) for x in own.to_pylist()])
                if not alive.any():
                    continue
                hashes, chosen = _anchors(c, last, window, alive)
                place = np.flatnonzero(chosen)
                text = np.searchsorted(c.first, place, "right") - 1
                check = c.windows(last, CHECK_POWERS)[0][place] if last == window else hashes[place]
                found, place = hashes[place], place - c.first[text]
                if last < window:  # one row for a hash and text is enough
                    order = np.lexsort((found, text))
                    text, found, check, place = text[order], found[order], check[order], place[order]
                    new = np.concatenate([[True], (text[1:] != text[:-1]) | (found[1:] != found[:-1])])[: len(text)]
                    text, found, check, place = text[new], found[new], check[new], place[new]
                ids = b.column(0).slice(c.at, len(c)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64)), pa.array((check & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)), pa.array(place, pa.int32())], names=["doc_id", "hash", "check", "place"])

    return rows.mapInArrow(work, f"doc_id {kind}, hash long, check int, place int")


def repeated_windows(docs: DataFrame, window: int, tables: Scratch) -> DataFrame:
    """(doc_id, place) of each window that starts in a document with a smaller id, too.

    Windows of the wanted length are equal if two hashes of 64 and 32 bits are, as what is removed is gone: of
    10^13 windows, some 10^-3 pairs of different ones are alike by accident.
    """
    docs = docs.where("doc_id is not null")
    rows, widths = docs, []
    for width in levels(window):
        widths.append(width)
        parts = _parts(rows, widths, window)
        if width < window:
            parts = tables.put(parts.select("doc_id", "hash"), f"parts-{width}")
            often = tables.put(parts.groupBy("hash").count().where("count > 1").select("hash"), f"often-{width}")
            found = parts.select("doc_id", "hash").join(often, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias(f"hashes_{width}"))
            found = tables.put(found, f"alive-{width}")
            tables.drop(f"parts-{width}")
            rows = rows.join(found, "doc_id")
        else:
            parts = tables.put(parts, "windows")
            first = parts.groupBy("hash", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
            first = tables.put(first.drop("last"), "first")
            return parts.join(first, ["hash", "check"]).where("doc_id > first").select("doc_id", "place")
    raise AssertionError


def dedupe(docs: DataFrame, window: int = 13, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Removes words that lie in a window of ``window`` words which a document with a smaller id has, too.

    Words are runs of bytes that are no ASCII white space. Windows are judged on the input. Returns a
    row for every row of ``docs``: doc_id, n_words, n_removed and kept (the other words joined by one
    space), or with ``digest`` kept_sha256 instead.

    Null texts and texts without words have no words. Rows with a null id keep all words and remove
    none elsewhere. Rows that repeat an id are one document: they don't remove each other's words, and
    a window's place counts for each of them. Empty tables give no rows; other columns are not looked at.
    """
    tables = Scratch(docs.sparkSession, "substring")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = repeated_windows(docs, window, tables).groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    gone = tables.keep(tables.put(gone, "gone"), "gone")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), SPACED, lower=False):
                removed, kept = [], []
                for k, places in enumerate(b.column(2).slice(c.at, len(c)).to_pylist()):
                    first, end = c.first[k], c.first[k + 1]
                    edge = np.zeros(end - first + 1, np.int64)
                    if places:
                        at = np.array(places)
                        at = at[at + window <= end - first]
                        edge[at] += 1
                        np.add.at(edge, at + window, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    own = first + np.flatnonzero(~out)
                    text = b" ".join([c.data[s:e].tobytes() for s, e in zip(c.starts[own].tolist(), c.ends[own].tolist())])
                    removed.append(int(out.sum()))
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.at, len(c)), pa.array(c.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
                )

    rows = docs.join(gone, "doc_id", "left").select("doc_id", "text", "places")
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")
