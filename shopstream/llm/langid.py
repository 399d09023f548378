"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its letters'
vectors, each permuted (rotated) by its place; the vector of a text bundles (sums) its n-grams; a
language's prototype bundles its texts. A text gets the language whose prototype has the largest
cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the vectors, letters in an n-gram.
DIMENSIONS, GRAM = 2_048, 3
#: Texts of so many characters are worked on together; bounds a task's arrays.
CHUNK_CHARS, ROWS = 100_000, 64
#: n-grams whose vectors are made at a time.
GRAMS = 8_192
#: Languages that can be learnt; a label column with more isn't one of languages.
MOST_LANGUAGES = 5_000
#: Learning takes about so many documents of a language, chosen by a hash of their ids.
TRAIN_DOCS = 10_000
#: A text of so many letters in a learnt language has a far larger cosine with its prototype than this;
#: one of fewer letters may not. Unlike texts have a cosine of 0.02 or so (one over the root of ``DIMENSIONS``).
SURE_LETTERS, SURE_SCORE = 200, 0.15


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(4096)
def _letter(code: int) -> np.ndarray:
    """Code 0 stands for what is between words."""
    return np.random.default_rng([7, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def _numbered(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and, for each value, its place among them."""
    if below > 1 << 22:
        return np.unique(values, return_inverse=True)
    there = np.zeros(below, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


def _chunk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, zeros for those without letters; letters of each."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    is_letter = _letters()[codes]
    letters = np.bincount(text[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (text[1:] == text[:-1])
    keep[:-1] |= is_letter[1:] & ~is_letter[:-1] & (text[1:] == text[:-1])
    codes, text = np.where(is_letter, codes, 0)[keep], text[keep]
    known, small = _numbered(codes, 0x110000)
    n = len(small) - GRAM + 1
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if n <= 0:
        return out, letters
    gram = np.zeros(n, np.int64)
    for k in range(GRAM):
        gram = gram * len(known) + small[k : k + n]
    inside = text[:n] == text[GRAM - 1 :]
    text = text[:n][inside]
    grams, gram = _numbered(gram[inside], len(known) ** GRAM)
    table = np.stack([_letter(c) for c in known.tolist()])
    for first in range(0, len(grams), GRAMS):
        rest = grams[first : first + GRAMS].copy()
        vectors = np.ones((len(rest), DIMENSIONS), np.int8)
        for k in range(GRAM):  # the last letter is not rotated, the one before by one place, ...
            vectors *= np.roll(table, k, axis=1)[rest % len(known)]
            rest //= len(known)
        vectors = vectors.astype(np.float32)
        own = slice(None) if len(grams) <= GRAMS else (gram >= first) & (gram < first + GRAMS)
        _bundle(out, text[own], gram[own] - first, vectors)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0), letters


def _bundle(out: np.ndarray, text: np.ndarray, gram: np.ndarray, vectors: np.ndarray) -> None:
    """Adds the vectors of n-grams to those of their texts, as often as they occur; sorted by text."""
    for at in range(0, len(out), ROWS):
        own = slice(*np.searchsorted(text, [at, at + ROWS]))
        rows = min(ROWS, len(out) - at)
        times = np.bincount((text[own] - at) * len(vectors) + gram[own], minlength=rows * len(vectors))
        out[at : at + rows] += times.reshape(rows, len(vectors)).astype(np.float32) @ vectors


def vectors(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For consecutive texts: place of the first one, unit vectors, numbers of letters."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n < CHUNK_CHARS or end == at):
            n += len(texts[end] or "")
            end += 1
        yield at, *_chunk([t or "" for t in texts[at:end]])
        at = end


def held_out(id_col: str = "doc_id") -> Column:
    """Documents never learnt from: crc32 of the id as text divides by 5. So are null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages in ``lang_col``.

    All rows of ``docs`` are labelled rows to learn from; ``train_docs`` of each language are taken
    in expectation. Null labels and texts are left out. Every language is learnt, however rare; the
    driver gets a row of ``DIMENSIONS`` sums for each, and more than ``MOST_LANGUAGES`` are a ``ValueError``.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    frequent = [r for r in counts if r["count"] > train_docs]
    place = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    taken = F.lit(True)
    if frequent:  # only these are sampled, all others count whole
        share = F.create_map(*[F.lit(x) for r in frequent for x in (r["lang"], train_docs / r["count"])])
        taken = F.coalesce(place < F.try_element_at(share, F.col("lang")), F.lit(True))
    sample = docs.where(taken).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for at, vecs, _ in vectors(b.column(1).to_pylist()):
                own = langs[at : at + len(vecs)]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + vecs[own == lang].sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], names=["lang", "k", "x"])

    summed = sample.mapInArrow(bundle, "lang string, k int, x double").groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("x")).toArrow()
    out = {r["lang"]: np.array(r["x"]) for r in rows.to_pylist()}
    return {lang: v / (np.linalg.norm(v) or 1) for lang, v in sorted(out.items())}


def _named(texts: list[str | None], langs: list[str], table: np.ndarray) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """For consecutive texts: place of the first one, languages, scores, numbers of letters."""
    for at, vecs, letters in vectors(texts):
        some = (letters > 0) & bool(langs)
        cosines = vecs @ table.T if langs else np.zeros((len(vecs), 1))
        best = cosines.argmax(axis=1)
        score = np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float)
        yield at, [langs[k] if s else "und" for k, s in zip(best.tolist(), some.tolist())], score, letters


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row, from its whole text alone.

    ``und`` with score 0 is given to null texts, texts without a letter, and all texts if no
    language was learnt. The score is the cosine with the language's prototype, at least 0.
    Ids may be null or repeat; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast((list(prototypes), np.array([*prototypes.values()], np.float32).reshape(-1, DIMENSIONS)))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[0].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = sent.value
        for b in batches:
            for at, names, score, _ in _named(b.column(1).to_pylist(), langs, table):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(names)), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")


def keep_recognised(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", sure_letters: int = SURE_LETTERS, sure_score: float = SURE_SCORE) -> DataFrame:
    """The rows, with all their columns, in one of the languages that were learnt.

    Rejected are the texts that ``predict`` calls ``und``, and those of ``sure_letters`` letters or more
    whose largest cosine is below ``sure_score``: their letters don't follow each other as in any language
    that was learnt. Of shorter texts the cosine doesn't tell that, so they stay. Each row is judged by its
    own text: null and empty texts go, ids may be null or repeat, columns may have any names.
    """
    sent = docs.sparkSession.sparkContext.broadcast((list(prototypes), np.array([*prototypes.values()], np.float32).reshape(-1, DIMENSIONS)))
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, names, score, letters in _named(b.column(place).to_pylist(), *sent.value):
                known = (np.array(names) != "und") & ((score >= sure_score) | (letters < sure_letters))
                yield b.slice(at, len(names)).filter(pa.array(known))

    plain = docs.toDF(*map(str, range(len(docs.columns))))  # mapInArrow takes no names with dots
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
