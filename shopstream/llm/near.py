"""MinHash near-duplicates: banding, signature verification, components by large-star and small-star.

1. One pass makes each document's set of shingles, its minima under many universal hashes and from
   these its band keys and a signature (a byte of each minimum). Documents with equal sets are one
   class; only its first document goes on.
2. In each bucket (documents with one band key) the others are compared by signature with the first
   one. Buckets whose documents are not connected by that are looked at again: all pairs of different
   components meet, but those of the bucket's largest component only meet the others. Signatures
   travel, texts do not; what leaves a task are ties that connect, never all pairs.
3. The texts of a component of the ties come together, each once, in blocks of bounded size, where
   links are confirmed on the full sets. If a component has several blocks, one document of each class
   that was found stands for it in a further round; documents that still are in another class than
   most of their component visit its blocks, as in 2.
4. Components of the confirmed links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .words import SPACED, Chunk, chunks, mix

#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.99992 at 0.85,
#: 0.9977 at 0.8.
BANDS, ROWS = 20, 6
#: A block holds about so many shingles and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 200_000, 256
#: Standard errors that an estimate may lie below the threshold before a pair is ruled out by it.
SLACK = 5

_RANDOM = np.random.default_rng(9)
_A = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(c: Chunk, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a shorter text is one shingle, one without words has none."""
    hashes, _ = c.windows(width)
    out = []
    for a, b in zip(c.first[:-1].tolist(), c.first[1:].tolist()):
        if b - a >= width:
            own = np.sort(hashes[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for h in c.hashes[a:b]:
                short = mix(short * np.uint64(3) + h + np.uint64(b - a))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash (a * x + b) >> 32 over the set."""
    out = np.full(len(_A), 2**32 - 1, np.uint32)
    x = shingles >> np.uint64(32)
    for k in range(0, len(x), 256):  # a few rows of the product fit into the cache
        product = (_A[:, None] * x[None, k : k + 256] + _B[:, None]) >> np.uint64(32)
        np.minimum(out, product.min(axis=1).astype(np.uint32), out=out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _keys(low: np.ndarray) -> np.ndarray:
    """One number for each band."""
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = mix(key * np.uint64(5) + low.reshape(BANDS, ROWS)[:, k])
    return key


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, the signature and the band keys of each row."""
    kind = docs.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), SPACED, lower=True):
                sets = shingle_sets(c, width)
                sums = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(77)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2)
                low = [minima(s) if len(s) else None for s in sets]
                signatures = [None if x is None else (x & np.uint32(255)).astype(np.uint8).tobytes() for x in low]
                keys = [None if x is None else _signed(_keys(x)) for x in low]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.at, len(c)), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(sums[:, 0])), pa.array(_signed(sums[:, 1])), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "sum1", "sum2", "signature", "keys"],
                )

    return docs.mapInArrow(work, f"doc_id {kind}, n_shingles long, sum1 long, sum2 long, signature binary, keys array<long>")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i


def _link(ids: list, texts: list[str], classes: list, sides: list[int], width: int, percent: int) -> Iterator[tuple]:
    """Ties (class, least linked class) of a block; at first each document is its own class.

    With two sides only pairs across are looked at; documents of one class are connected already.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    sets: list[np.ndarray] = []
    for c in chunks(pa.array([texts[i] for i in order], pa.large_string()), SPACED, lower=True):
        sets += shingle_sets(c, width)
    low = np.stack([minima(s) for s in sets])
    size, side = np.array([len(s) for s in sets]), np.array([sides[i] for i in order])
    linked, first = _Union(len(order)), {}
    for k, i in enumerate(order):
        linked.join(first.setdefault(classes[i], k), k)
    least = _least_alike(percent)
    two = side.min() != side.max()
    for k in range(1, len(order)):
        alike = (low[:k] == low[k]).sum(axis=1)
        near = (alike >= least) & (100 * np.minimum(size[:k], size[k]) >= percent * np.maximum(size[:k], size[k]))
        if two:
            near &= side[:k] != side[k]
        near = np.flatnonzero(near)
        tried = set()
        for j in near[np.argsort(-alike[near], kind="stable")].tolist():
            if j in tried or linked.root(j) == linked.root(k):
                continue
            tried.add(j)
            both = len(np.intersect1d(sets[j], sets[k], assume_unique=True))
            if 100 * both >= percent * (len(sets[j]) + len(sets[k]) - both):
                linked.join(j, k)
    yield from {(classes[i], classes[order[linked.root(k)]]) for k, i in enumerate(order) if classes[i] != classes[order[linked.root(k)]]}


def _least_alike(percent: int) -> float:
    """Minima that two documents at the threshold have in common at least, but for ``SLACK`` standard errors."""
    share = percent / 100
    return len(_A) * share - SLACK * np.sqrt(len(_A) * share * (1 - share))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(_A))


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and the numbers of shingles and signatures of both) that signatures don't rule out."""
    kind = pairs.schema["a"].dataType.simpleString()
    least = _least_alike(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            near = ((_signatures(b.column(4)) == _signatures(b.column(5))).sum(axis=1) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield b.select(["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "n", "m", "s", "t").mapInArrow(work, f"a {kind}, b {kind}")


def _meetings(members: DataFrame, by: list[str], block: int, tables: Scratch, name: str) -> DataFrame:
    """(group, side, doc_id, label): blocks in which all rows of a ``by`` that differ in label meet.

    The rows of the most frequent label need not meet each other: each of their blocks meets the blocks
    of the others, which meet each other, too. So a few strays of a large group cost a few copies of its
    rows. In a group with two sides only rows of different sides are new to each other.
    """
    sizes = members.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.where(F.col("all") > F.col("most.n")).select(*by, F.col("most.label").alias("main"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("all") - F.col("most.n")).alias("others"))
    rows, main = members.join(tables.put(sizes, name), by), F.col("label") == F.col("main")
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    last = F.col("mains") + F.col("others") - 1
    rows = rows.withColumn("own", F.when(main, place(F.col("mains"))).otherwise(F.col("mains") + place(F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(main, F.col("mains")).otherwise(F.lit(0)), last)))
    group = F.xxhash64(*by, F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(group.alias("group"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "doc_id", "label")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group of sorted batches, whose first columns are the group's."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        own = np.stack([c.to_numpy() for c in b.columns[:keys]], axis=1)
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        for at, end in zip(cuts[:-1], cuts[1:]):
            if held and own[at].tolist() != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own[at].tolist() if end > at else key
            held += [b.slice(at, end - at)] if end > at else []
    if held:
        yield pa.Table.from_batches(held)


def _ties(rows: DataFrame, percent: int) -> DataFrame:
    """Of rows (group, side, doc_id, label, n_shingles, signature): pairs of ids that connect the labels of rows that are alike."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    least = _least_alike(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1):
            own = t.combine_chunks().to_batches()[0]
            _, side, ids, label, size = (c.to_numpy() for c in own.columns[:5])
            low, linked, found = _signatures(own.column(5)), _Union(len(ids)), []
            label = np.unique(label, return_inverse=True)[1].tolist()  # labels are less than rows, so they serve as their roots
            across = side.min() >= 0
            for k in range(1, len(ids)):
                near = (100 * np.minimum(size[:k], size[k]) >= percent * np.maximum(size[:k], size[k])) & ((low[:k] == low[k]).sum(axis=1) >= least)
                if across:
                    near &= side[:k] != side[k]
                for j in np.flatnonzero(near).tolist():
                    if linked.root(label[j]) != linked.root(label[k]):
                        linked.join(label[j], label[k])
                        found.append((ids[j], ids[k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

    rows = rows.select("group", "side", "doc_id", "label", "n_shingles", "signature").repartition("group").sortWithinPartitions("group", "doc_id")
    return rows.mapInArrow(work, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))


def _links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Ties of classes within each group of rows (group..., doc_id, class, side, text)."""
    kind = members.schema["doc_id"].dataType.simpleString()
    by = members.columns[: members.columns.index("doc_id")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, len(by)):
            ids, of, side, text = (c.to_pylist() for c in t.columns[len(by) :])
            found = list(_link(ids, text, of, side, width, percent)) if len(ids) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

    rows = members.repartition(*by).sortWithinPartitions(*by, "doc_id")
    return rows.mapInArrow(work, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind))


def _candidates(own: DataFrame, percent: int, block: int, tables: Scratch) -> DataFrame:
    """(node, component) of all pairs of a bucket that signatures don't rule out."""
    bands = own.select("doc_id", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    members = bands.join(tables.put(shared, "shared"), "key").where("doc_id != first").select("key", "doc_id", "first").distinct()
    members = tables.put(members, "members")
    ids = tables.put(members.select("doc_id").unionAll(members.select("first")).distinct(), "ids")
    # tables of known size: Spark shuffles the larger side only if it must
    signed = tables.put(own.join(ids, "doc_id", "left_semi").select("doc_id", "n_shingles", "signature"), "signed")
    pairs = members.select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    pairs = pairs.join(signed.toDF("a", "n", "s"), "a").join(signed.toDF("b", "m", "t"), "b")
    alike = tables.put(_alike(pairs, percent), "alike")
    of = tables.put(connected_components(alike, tables, "alike-cc"), "alike-of")
    name = lambda df, c: df.join(of.toDF(c, f"{c}_in"), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    mixed = tables.put(name(name(members, "doc_id"), "first").where("doc_id_in != first_in").select("key").distinct(), "buckets")
    if mixed.isEmpty():
        return of
    rows = members.join(mixed, "key", "left_semi")
    rows = rows.select("key", "doc_id").unionAll(rows.select("key", "first").distinct())
    rows = tables.put(name(rows, "doc_id").select("key", "doc_id", F.col("doc_id_in").alias("label")), "bucket-rows")
    met = _meetings(rows, ["key"], block, tables, "bucket-sizes").join(signed, "doc_id")
    more = tables.put(_ties(met, percent), "bucket-ties")
    return of if more.isEmpty() else connected_components(of.toDF("a", "b").unionAll(more), tables, "ties")


def _confirmed(docs: DataFrame, groups: DataFrame, some: DataFrame, width: int, percent: int, block_shingles: int, block: int, tables: Scratch) -> DataFrame:
    """(doc_id, class): the least id linked on full sets, for the documents of ``groups`` (node, component) that have a smaller one."""
    sizes = some.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    groups = tables.put(groups.withColumnRenamed("node", "doc_id").join(sizes, "doc_id"), "groups")

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        """Rows (component, doc_id, n) with the number of blocks of their component and their own one."""
        blocks = F.ceil(F.greatest(F.sum("n") / block_shingles, F.count(F.lit(1)) / block)).cast("int")
        large = tables.put(rows.groupBy("component").agg(blocks.alias("blocks")).where("blocks > 1"), f"{name}-large")
        blocks = F.coalesce("blocks", F.lit(1))
        rows = rows.join(large, "component", "left").select("component", "doc_id", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"))
        return tables.put(rows, f"{name}-blocks")

    def linked(rows: DataFrame, name: str) -> DataFrame:
        texts = docs.join(rows.select("component", "block", "doc_id"), "doc_id")
        return tables.put(_links(texts.select("component", "block", "doc_id", F.col("doc_id").alias("class"), F.lit(0).alias("side"), "text"), width, percent).toDF("doc_id", "class"), name)

    groups = dealt(groups, "groups")
    classes = linked(groups, "in-blocks")
    large = groups.where("blocks > 1").select("component", "doc_id", "n")
    if large.isEmpty():
        return classes
    found, heads, before, k = classes, large, None, 0
    while True:  # one document stands for each class, until those of a component fit into a block or don't get fewer
        heads = tables.put(heads.join(found.select("doc_id"), "doc_id", "left_anti"), f"heads-{k}")
        heads = heads.join(heads.groupBy("component").count().where("count > 1").select("component"), "component")
        heads = dealt(heads, f"heads-{k}")
        n, several = heads.agg(F.count(F.lit(1)), F.max("blocks")).first()
        if not n or n == before:
            break
        found = linked(heads, f"heads-{k}-links")
        classes = classes.unionAll(found)
        if several == 1:
            break
        heads, before, k = heads.where("blocks > 1").select("component", "doc_id", "n"), n, k + 1
    of = tables.put(connected_components(classes, tables, "classes-cc"), "classes-of")
    rows = large.join(of.toDF("doc_id", "label"), "doc_id", "left").select("component", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    met = _meetings(tables.put(rows, "large-rows"), ["component"], block, tables, "large-sizes")
    met = docs.join(tables.put(met, "large-met"), "doc_id").select("group", "doc_id", F.col("label").alias("class"), "side", "text")
    across = tables.put(_links(met, width, percent), "across")
    of = connected_components(of.select("node", "component").unionAll(across.toDF("node", "component")), tables, "across-cc")
    return of.toDF("doc_id", "class").where("doc_id != class")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Groups of documents that are linked by a Jaccard similarity of at least ``percent`` / 100.

    Words are runs of bytes that are no ASCII white space, A-Z lower-cased; a document's set is its
    distinct runs of ``shingle`` words, or all its words as one if there are fewer. Returns a row for
    every row of ``docs``: doc_id, n_shingles, component_id (the least id reachable by links, the own
    one included) and kept (doc_id = component_id).

    Null texts and texts without words have no shingles and link with nothing; rows with a null id
    link with nothing, have a null component_id and are kept. Rows that repeat an id are one
    document (they get the same component_id, and each row is kept or not as the others). Ids are
    integers. Other columns are not looked at. No link is dropped for the size of its group; pairs
    at the threshold are missed with the probability said at ``BANDS``.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    profile = tables.put(_profile(docs, shingle), "profile")
    some = profile.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "sum1", "sum2"]
    classes = some.groupBy(same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    classes = tables.put(classes, "classes")
    copies = some.select("doc_id", *same).join(classes, same).where("doc_id != first").select("doc_id", "first")
    # an id that repeats with several sets is no mere copy: all its texts look for partners
    ends = [f(c).alias(f"{name}_{c}") for c in same for name, f in (("min", F.min), ("max", F.max))]
    mixed = some.groupBy("doc_id").agg(*ends).where(" or ".join(f"min_{c} != max_{c}" for c in same)).select("doc_id")
    copies = copies.join(tables.put(mixed, "mixed"), "doc_id", "left_anti")
    copies = tables.put(copies.groupBy("doc_id").agg(F.min("first").alias("first")), "copies")
    groups = _candidates(some.join(copies.select("doc_id"), "doc_id", "left_anti"), percent, block_docs, tables)
    classes = _confirmed(docs.where("doc_id is not null"), groups, some, shingle, percent, block_shingles, block_docs, tables)
    whole = copies.join(classes.withColumnRenamed("doc_id", "first"), "first", "left").select("doc_id", F.coalesce("class", "first").alias("class"))
    whole = tables.keep(tables.put(classes.unionAll(whole), "whole"), "whole", "profile")
    component = F.coalesce("class", "doc_id")
    return profile.select("doc_id", "n_shingles").join(whole, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, with one of each group of near-duplicates: the one with the least id.

    Null and empty texts and rows with a null id link with nothing, so they stay. Rows that repeat an id are
    one document: they stay, or go, together. Columns may have any names.
    """
    gone = near_duplicates(docs, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    gone = Scratch(docs.sparkSession, "near").put(gone, "gone")  # of known size: the join shuffles texts only if it must
    return docs.join(gone, id_col, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
