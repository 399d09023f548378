"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and stored as the signs of its coordinates with one correction
factor, its inner product with the unit vector of these signs. Another vector's inner product with
the signs, over that factor, is an unbiased estimate of the two vectors' inner product, with an error
bound that holds with known confidence. Only pairs whose bound reaches the threshold are recomputed
from the vectors themselves, in double precision; a link is never made by an estimate.

Candidate pairs share a label and one of several bands of sign bits (of further rotations, too). The
members of a band's bucket meet in blocks of bounded size, each two blocks of a large bucket in a
task of their own, so all pairs of a bucket are judged but none are written. First only the codes
travel, with the rotated vector rounded to bytes; vectors are sent for those members alone that have a
partner which the bound doesn't rule out. What leaves a task then are the links of each vector,
counted, and ties that connect the linked ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import Scratch



def missed(cosine: float, bits: int, bands: int) -> float:
    """The probability that two vectors share no band: they agree in a bit with 1 - angle / pi."""
    return float((1 - (1 - np.arccos(cosine) / np.pi) ** bits) ** bands)


def bands_for(bits: int, cosine: float = 0.93, most: float = 0.003) -> int:
    """So many bands that a pair of ``cosine`` is missed with probability ``most`` at most."""
    return int(np.ceil(np.log(most) / np.log(missed(cosine, bits, 1))))


#: Least bits of a band and number of bands. Two vectors of cosine 0.93 agree in a bit with probability
#: 0.88, so they share one of 24 bands with probability 1 - (1 - 0.88^12)^24 = 0.997; at 0.96, 0.99991.
BITS = 12
BANDS = bands_for(BITS)


def bits_for(n: int) -> int:
    """Bits of a band for labels of ``n`` vectors at most: a bucket of unlike vectors stays at about 100."""
    return max(BITS, int(np.ceil(np.log2(max(n, 1) / 100))))


#: Standard errors of an estimate: the true value lies beyond with probability under 1e-6.
CONFIDENCE = 5.0
BLOCK, SMALL = 1_024, 48


@lru_cache(32)
def _rotation(dims: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dims, k]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, times a power of two each, so that norms neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _units(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _bands(units: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The bits of each band as a number."""
    dims = units.shape[1]
    bits = min(bits, dims)
    each = dims // bits
    weights, out = 1 << np.arange(bits, dtype=np.int64), []
    for k in range(-(-bands // each)):
        signs = units @ _rotation(dims, k) > 0
        out += [signs[:, bits * i : bits * i + bits] @ weights for i in range(each)]
    return np.stack(out[:bands], axis=1).astype(np.int64)


def _encode(vectors: DataFrame, kind: np.dtype, band_bits: int, n_bands: int) -> DataFrame:
    """The usable vectors with codes: vec_id, label, dims, hash1, hash2, bands, code, factor, rounded, step, vec."""
    id_kind, label_kind = (vectors.schema[k].dataType.simpleString() for k in range(2))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = b.column(2).flatten().cast(pa.from_numpy_dtype(kind)).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dims)
                rows = values[starts[own][:, None] + np.arange(dims)]
                usable = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
                if not usable.any():
                    continue
                own, rows = own[usable], rows[usable] + kind.type(0)  # no negative zeros
                units = _units(rows)
                turned = units @ _rotation(dims, 0)
                step = np.abs(turned).max(axis=1) / 127
                words = np.random.default_rng(dims).integers(0, 2**64, (2, rows.shape[1] * kind.itemsize // 4), dtype=np.uint64)
                parts = rows.view(np.uint32).astype(np.uint64)
                hashes = [((parts + w) * (w | np.uint64(1)) ^ (parts * w >> np.uint64(29))).sum(axis=1, dtype=np.uint64).view(np.int64) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(own)),
                        b.column(1).take(pa.array(own)),
                        pa.array([dims] * len(own), pa.int32()),
                        *map(pa.array, hashes),
                        pa.array(list(_bands(units, band_bits, n_bands)), pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in np.packbits(turned > 0, axis=1)], pa.binary()),
                        pa.array(np.abs(turned).sum(axis=1) / np.sqrt(dims)),
                        pa.array([x.tobytes() for x in np.rint(turned / step[:, None]).astype(np.int8)], pa.binary()),
                        pa.array(step),
                        pa.array([x.tobytes() for x in rows], pa.binary()),
                    ],
                    names=["vec_id", "label", "dims", "hash1", "hash2", "bands", "code", "factor", "rounded", "step", "vec"],
                )

    return vectors.mapInArrow(work, f"vec_id {id_kind}, label {label_kind}, dims int, hash1 long, hash2 long, bands array<long>, code binary, factor double, rounded binary, step double, vec binary")


def _together(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Rows:
    """Rows of one number of dimensions: what the judgement of pairs needs, with or without the vectors."""

    def __init__(self, columns: dict[str, pa.Array], kind: np.dtype, threshold: float):
        self.exact, self.factor, self.threshold = "vec" in columns, columns["factor"].to_numpy(), threshold
        dims = columns["dims"][0].as_py()
        if self.exact:
            self.rows = _scaled(_together(columns["vec"], kind))
            self.norms = np.linalg.norm(self.rows, axis=1)
            self.turned = (self.rows / self.norms[:, None] @ _rotation(dims, 0)).astype(np.float32)
            self.rough = np.zeros(len(self.rows))
            self.bands = np.stack(columns["bands"].to_numpy(zero_copy_only=False))
        else:
            step = columns["step"].to_numpy()
            self.turned = (_together(columns["rounded"], np.dtype(np.int8)) * step[:, None]).astype(np.float32)
            self.rough = step / 2 * np.sqrt(dims)  # what rounding can change the product with signs by
        bits = np.unpackbits(_together(columns["code"], np.dtype(np.uint8)), axis=1, count=dims)
        self.signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))
        self.slack = CONFIDENCE * np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / np.sqrt(max(dims - 1, 1)) + 1e-5

    def links(self, i: np.ndarray, j: np.ndarray, estimate: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs in a bucket of ``band``: those that the bound leaves; with vectors, those linked that share no earlier band."""
        near = (estimate + self.rough[i]) / self.factor[j] + self.slack[j] >= self.threshold
        i, j, band = i[near], j[near], band[near]
        if not self.exact:
            return i, j
        keep = []
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            cosine = np.einsum("ij,ij->i", self.rows[a], self.rows[b]) / (self.norms[a] * self.norms[b])
            first = (self.bands[a] == self.bands[b]).argmax(axis=1)
            keep.append((cosine >= self.threshold) & (first == band[k : k + 20_000]))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return i[keep], j[keep]


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives connected rows the same, least label."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _pairs(starts: np.ndarray, ends: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of small groups, of all groups at once."""
    for step in range(1, SMALL):
        own = ends - starts > step
        if not own.any():
            return
        n = (ends - starts - step)[own]
        first = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        across = (sides[first] < 0) | (sides[first] != sides[first + step])
        yield first[across], first[across] + step


#: What a member of a bucket is; code and factor tell different vectors of one id.
_MEMBER = "vec_id", "times", "dims", "code", "factor", "band", "side", "group"


def _judge(table: pa.Table, kind: np.dtype, threshold: float) -> pa.RecordBatch | None:
    """Of whole groups: vec_id, links and a tie for each row that has links; without vectors, the rows that may have some."""
    columns = {n: table.column(n).combine_chunks() for n in table.column_names}
    group = columns["group"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(starts[1:], len(group))
    dims, ids = columns["dims"].to_numpy(), columns["vec_id"]
    times, band, sides = (columns[n].to_numpy() for n in ("times", "band", "side"))
    links, label = np.zeros(len(group), np.int64), np.arange(len(group))
    exact = "vec" in columns

    def count(i: np.ndarray, j: np.ndarray) -> None:
        if not exact:
            links[i] = links[j] = 1
            return
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        _connect(label, i, j)

    for d in np.unique(dims):  # a group has one number of dimensions
        own = np.flatnonzero(dims == d)
        place = np.zeros(len(group), np.int64)
        place[own] = np.arange(len(own))
        rows = _Rows({n: c.take(pa.array(own)) for n, c in columns.items()}, kind, threshold)
        mine = dims[starts] == d
        small = mine & (ends - starts <= SMALL)
        for i, j in _pairs(starts[small], ends[small], sides):
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000], j[k : k + 50_000]
                estimate = np.einsum("ij,ij->i", rows.turned[place[a]], rows.signs[place[b]])
                a, b = rows.links(place[a], place[b], estimate, band[a])
                count(own[a], own[b])
        for s, e in zip(starts[mine & ~small].tolist(), ends[mine & ~small].tolist()):
            p = place[s:e]
            for k in range(0, e - s, 256):
                estimate = rows.turned[p[k : k + 256]] @ rows.signs[p].T
                a, b = np.divmod(np.arange(estimate.size), e - s)
                use = a + k < b
                if sides[s] >= 0:
                    use &= sides[s + k + a] != sides[s + b]
                a, b = rows.links(p[k + a[use]], p[b[use]], estimate.ravel()[use], np.full(int(use.sum()), band[s]))
                count(own[a], own[b])
    there = pa.array(np.flatnonzero(links))
    if not len(there):
        return None
    if not exact:
        return pa.RecordBatch.from_arrays([columns[n].take(there) for n in _MEMBER], names=list(_MEMBER))
    return pa.RecordBatch.from_arrays([ids.take(there), pa.array(links).take(there), ids.take(pa.array(label)).take(there)], names=["vec_id", "n", "tie"])


def _links(members: DataFrame, kind: np.dtype, threshold: float) -> DataFrame:
    """Counted links and ties of rows that are brought together by group; without vectors, the rows that may have links."""
    members = members.repartition("group").sortWithinPartitions("group")
    id_kind = members.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            for at in range(0, len(b), 4_096):  # groups end where the next begins; the last one waits
                part = pa.Table.from_batches([b.slice(at, 4_096)])
                group = part.column("group").to_numpy()
                last = int(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[-1])
                if held and held[-1].column("group")[-1].as_py() == group[-1]:
                    held.append(part)
                    continue
                out = _judge(pa.concat_tables([*held, part.slice(0, last)]), kind, threshold) if held or last else None
                held = [part.slice(last)]
                if out is not None:
                    yield out
        if held and (out := _judge(pa.concat_tables(held), kind, threshold)) is not None:
            yield out

    may = f"vec_id {id_kind}, times long, dims int, code binary, factor double, band int, side int, group long"
    return members.mapInArrow(work, f"vec_id {id_kind}, n long, tie {id_kind}" if "vec" in members.columns else may)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """Links between vectors of one label whose cosine is at least ``threshold``.

    Returns a row for every row: vec_id, n_links (other vectors linked directly), component_id (the
    least id reachable by links, the own one included) and kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label, link with nothing; neither do vectors of different lengths. Rows with a null id link with
    nothing, have a null component_id and are kept. Rows that repeat an id are one vector if they are
    equal; different vectors of one id add up their links. Equal vectors are one class: one of them is
    compared and stands for all. Ids are integers; other columns are not looked at. No bucket is cut
    short; links at the very threshold are missed with the probability said at ``BANDS``. The bits of a
    band follow from the vectors of the largest label (``bits_for``), the number of bands from the bits,
    so that the miss is the same at every size.
    """
    tables = Scratch(vectors.sparkSession, "vectors")
    element = vectors.schema[vector_col].dataType.elementType
    kind = np.dtype(np.float32 if isinstance(element, T.FloatType) else np.float64)
    ids = vectors.select(F.col(id_col).alias("vec_id"))
    usable = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")).where("vec_id is not null and label is not null")
    largest = usable.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = bits_for(largest)
    coded = tables.put(_encode(usable, kind, bits, bands_for(bits)), "coded")
    same = ["label", "dims", "hash1", "hash2"]
    own = coded.select("vec_id", *same).distinct()
    classes = tables.put(own.groupBy(same).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("times")), "classes")
    members = tables.put(own.join(classes, same).select("vec_id", "first", "times", *same), "members")
    kept = members.where("vec_id = first").select("vec_id", "times", *same)
    kept = tables.put(coded.join(kept, ["vec_id", *same]).drop("hash1", "hash2").dropDuplicates(["vec_id", "label", "dims", "code", "vec"]), "kept")
    keys = kept.select("vec_id", "label", "dims", F.posexplode("bands").alias("band", "bucket"))
    key = ["label", "dims", "band", "bucket"]
    blocks = F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    shared = tables.put(keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"), blocks).where("n > 1").drop("n"), "shared")
    rows = kept.select("*", F.posexplode("bands").alias("band", "bucket")).drop("bands", "vec").join(shared, key)
    mine = F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.select("vec_id", "times", "dims", "code", "factor", "rounded", "step", "band", F.when(one == two, -1).otherwise(F.col("mine")).alias("side"), F.xxhash64(*key, one, two).alias("group"))
    rows = tables.put(_links(rows, kind, threshold), "open").join(kept.select("vec_id", "dims", "code", "factor", "bands", "vec"), ["vec_id", "dims", "code", "factor"])
    found = tables.put(_links(rows, kind, threshold), "links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("linked"))
    ties = found.where("vec_id != tie").select("vec_id", "tie").unionAll(members.where("vec_id != first").select("vec_id", F.col("first").alias("tie")))
    components = connected_components(ties, tables)
    each = members.select("vec_id", "first", "times").join(links.withColumnRenamed("vec_id", "first"), "first", "left")
    each = each.groupBy("vec_id").agg(F.sum(F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    component = F.coalesce("component", "vec_id")
    result = each.join(components.withColumnRenamed("node", "vec_id"), "vec_id", "full")
    out = ids.join(tables.keep(tables.put(result, "result"), "result"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
