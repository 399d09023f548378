"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

Every byte prefix of a piece of text has one encoding, and that encoding has one last token. So
``last[i]``, the last token of the first ``i`` bytes, says everything: the encoding is read back
from it, appending bytes only adds entries, and after an edit all entries before it stay. ``last[i]``
is the one token that ends at ``i`` and can stand after ``last[i - len(token)]``: merging the two
tokens' bytes from scratch would give these two tokens again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import OF_BYTE, POWERS, mix

#: Distinct pieces whose ids a task remembers; beyond it forgets all and goes on.
REMEMBERED = 250_000
#: Texts of so many characters are split and encoded together.
GROUP_CHARS = 1_000_000
_NEVER = 1 << 62


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a tokenizer file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


class Vocabulary:
    """Tokens by rank and, for each, the tokens along its left and right edge while it is merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.bytes = {r: t for t, r in ranks.items()}
        self._left: dict[bytes, list[bytes]] = {}
        self._right: dict[bytes, list[bytes]] = {}
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._lengths: dict[bytes, list[int]] = {}
        for token in ranks:  # by the last bytes, how long tokens with such an end are
            self._lengths.setdefault(token[-2:], []).append(len(token))
        for end, sizes in self._lengths.items():
            self._lengths[end] = sorted(set(sizes), reverse=True)

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that no merges make."""
        if token not in self._split:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank == _NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def made(self, token: bytes) -> bool:
        """Whether merging the token's bytes gives the token."""
        return len(token) == 1 or self.split(token) is not None

    def _edge(self, token: bytes, side: int, known: dict[bytes, list[bytes]]) -> list[bytes]:
        if token not in known:
            halves = self.split(token) if len(token) > 1 else None
            known[token] = [*(self._edge(halves[side], side, known) if halves else []), token]
        return known[token]

    def can_follow(self, one: bytes, two: bytes) -> bool:
        """Whether the bytes of both together are encoded as these two tokens.

        Merges inside the two go on in order of rank, the leftmost first; the pair fails if at some
        time the tokens that meet at the seam would be merged before the next merge on either side.
        """
        if (known := self._pairs.get((one, two))) is not None:
            return known
        left, right = self._edge(one, 1, self._right), self._edge(two, 0, self._left)
        i = j = 0
        rank = self.ranks.get
        while True:
            seam = rank(left[i] + right[j], _NEVER)
            a = rank(left[i + 1]) if i + 1 < len(left) else _NEVER
            b = rank(right[j + 1]) if j + 1 < len(right) else _NEVER
            if seam < a and seam <= b:
                good = False
                break
            if a == b == _NEVER:
                good = True
                break
            if a <= b:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        self._pairs[one, two] = good
        return good


class Encoding:
    """The encoding of a byte string that can grow and be edited; ``last[i]`` is as said above."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [b""]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: what is stored for the bytes so far stays as it is."""
        v, ranks, last = self.vocabulary, self.vocabulary.ranks, self.last
        lengths, pairs = v._lengths, v._pairs
        begin, self.data = len(self.data), self.data + data
        whole = self.data
        for end in range(begin + 1, len(whole) + 1):
            found = None
            sizes = lengths.get(whole[max(0, end - 2) : end], ())
            for size in (*sizes, 1) if end > 1 else (1,):
                if size > end:
                    continue
                token = whole[end - size : end]
                if token not in ranks or not v.made(token):
                    continue
                before = last[end - size]
                if not before:
                    if size == end:
                        found = token
                        break
                    continue
                good = pairs.get((before, token))
                if v.can_follow(before, token) if good is None else good:
                    found = token
                    break
            if found is None:
                raise ValueError("the vocabulary lacks single bytes")
            last.append(found)

    def edit(self, begin: int, end: int, data: bytes) -> None:
        """Replaces bytes; only entries from ``begin`` on are made anew."""
        rest = data + self.data[end:]
        self.data, self.last = self.data[:begin], self.last[: begin + 1]
        self.append(rest)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.vocabulary.ranks[self.last[at]])
            at -= len(self.last[at])
        return out[::-1]


class _Table:
    """Numbers of distinct 64-bit hashes, looked up for many hashes at once."""

    def __init__(self, hashes: np.ndarray, bits: int = 18):
        self.shift, self.layers = np.uint64(64 - bits), []
        left = np.arange(len(hashes), dtype=np.int32)
        while len(left):  # hashes that share a slot go to the next layer
            _, first = np.unique(hashes[left] >> self.shift, return_index=True)
            keys, ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            slots = hashes[left[first]] >> self.shift
            keys[slots], ids[slots] = hashes[left[first]], left[first]
            self.layers.append((keys, ids))
            left = np.delete(left, first)
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        for keys, ids in self.layers:
            slots = hashes >> self.shift
            out = np.where(keys[slots] == hashes, np.maximum(out, ids[slots]), out)
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15)
        return out


class _Many:
    """``Encoding`` for many short pieces at once: the same entries, filled one end after the other."""

    LONGEST, SLOTS = 40, 1 << 20

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.tokens = [t for t in v.ranks if len(t) <= self.LONGEST and v.made(t)]
        self.rank = np.array([v.ranks[t] for t in self.tokens], "<u4")
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        data = np.frombuffer(b"".join(self.tokens), np.uint8)
        ends = np.cumsum(self.size)
        total, down = self._prefix(data)
        self.table = _Table(mix((total[ends] - total[ends - self.size]) * down[ends - self.size] + self.size.astype(np.uint64)))
        self.possible = np.zeros((1 << 16, self.LONGEST + 1), bool)  # by the last two bytes
        two = ends[self.size > 1]
        self.possible[data[two - 2].astype(int) << 8 | data[two - 1], self.size[self.size > 1]] = True
        self.keys, self.good = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    @staticmethod
    def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = POWERS.upto(len(data) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(OF_BYTE[data] * up[:-1])]), down

    def _can_follow(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one.astype(np.int64) << 32 | two
        slot = (mix(key.astype(np.uint64)) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = self.good[slot]
        missing = np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            keys, first, inverse = np.unique(key[missing], return_index=True, return_inverse=True)
            tokens, judge = self.tokens, self.vocabulary.can_follow
            good = np.array([judge(tokens[k >> 32], tokens[k & 0xFFFFFFFF]) for k in keys.tolist()], bool)
            out[missing] = good[inverse]
            at = slot[missing[first]]
            self.keys[at], self.good[at] = keys, good
            now = self.keys[at] == keys  # of two in one slot the last stays, with its own answer
            self.good[at[now]] = good[now]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of 1 to LONGEST bytes, in order of falling length."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(sizes) - sizes
        total, down = self._prefix(data)
        last = np.full((len(pieces), int(sizes[0]) + 1), -1, np.int32)
        for end in range(1, int(sizes[0]) + 1):
            todo = np.arange(int(np.searchsorted(-sizes, -end, "right")))
            if end > 1:
                at = begin[todo] + end
                pair = data[at - 2].astype(np.int64) << 8 | data[at - 1]
            for size in range(end, 0, -1):
                pick = np.flatnonzero(self.possible[pair, size]) if size > 1 else np.arange(len(todo))
                if not len(pick):
                    continue
                own = todo[pick]
                start = begin[own] + end - size
                token = self.table.find(mix((total[start + size] - total[start]) * down[start] + np.uint64(size)))
                before = last[own, end - size]
                good = token >= 0
                if size < end:
                    good[good] = self._can_follow(before[good], token[good])
                last[own[good], end] = token[good]
                todo = np.delete(todo, pick[good])
                if end > 1:
                    pair = np.delete(pair, pick[good])
                if not len(todo):
                    break
            if len(todo):
                raise ValueError("the vocabulary lacks single bytes")
        at, n = sizes.copy(), np.zeros(len(pieces), np.int64)
        out = np.zeros(last.shape, "<u4")
        left = np.arange(len(pieces))
        while len(left):  # read back from the ends, into the ends of the rows
            token = last[left, at[left]]
            n[left] += 1
            out[left, -n[left]] = self.rank[token]
            at[left] -= self.size[token]
            left = left[at[left] > 0]
        packed, width = out.tobytes(), 4 * out.shape[1]
        return [packed[e - 4 * k : e] for e, k in zip(range(width, len(packed) + 1, width), n.tolist())]


class Encoder(dict):
    """Ids of pieces as packed little-endian numbers."""

    SLAB = 10_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.vocabulary, self.pieces = Vocabulary(ranks), regex.compile(pattern).findall
        self.many = _Many(self.vocabulary)
        tokens = sorted(ranks, key=ranks.get)
        ids = np.array([ranks[t] for t in tokens])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size, self.begin = np.zeros(int(ids.max()) + 1, np.int64), np.zeros(int(ids.max()) + 1, np.int64)
        self.size[ids] = [len(t) for t in tokens]
        self.begin[ids] = np.cumsum(self.size[ids]) - self.size[ids]

    def learn(self, pieces: set[str]) -> None:
        """Makes sure that all of these pieces are known."""
        if len(self) + len(pieces) > REMEMBERED:
            self.clear()
        ranks, new = self.vocabulary.ranks, []
        for piece in pieces:
            if piece not in self:
                data = piece.encode()
                if (whole := ranks.get(data)) is not None:  # a piece that is a token is that token
                    self[piece] = whole.to_bytes(4, "little")
                elif len(data) > _Many.LONGEST:
                    self[piece] = np.array(Encoding(self.vocabulary, data).tokens(), "<u4").tobytes()
                else:
                    new.append((len(data), data, piece))
        new.sort(key=lambda x: -x[0])
        for k in range(0, len(new), self.SLAB):
            slab = new[k : k + self.SLAB]
            self.update(zip((x[2] for x in slab), self.many.encode([x[1] for x in slab])))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text; the texts' pieces are learnt together."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(set().union(*pieces))
        for own in pieces:
            yield b"".join(map(self.__getitem__, own))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        sizes = self.size[ids]
        to = np.repeat(self.begin[ids] - (np.cumsum(sizes) - sizes), sizes)
        to += np.arange(len(to))
        return self.flat[to].tobytes()


def _groups(column: pa.Array, size: int) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together; a null is empty."""
    group, n = [], 0
    for text in column:
        text = text.as_py() or ""
        group.append(text)
        n += len(text)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def encode(docs: DataFrame, tokenizer: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encodes every whole text and decodes its ids again.

    ``tokenizer`` is the path of a file of ranks on the driver (some hundreds of KB, sent to the
    executors once); each match of ``pattern`` is encoded by itself, without special tokens.
    Returns a row for each row of ``docs``: doc_id, n_tokens, ids (array<int>) and decoded
    (binary), or with ``digest`` the sha256 of the packed ids and of the decoded bytes instead,
    as lowercase hex. A null text counts as empty: no ids. Ids may be null or repeat; other
    columns are not looked at. A text is one row's work, however long: no state crosses rows but
    remembered pieces, which a bound keeps small.
    """
    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[0].dataType.simpleString()
    columns = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, split = sent.value
        encoder = Encoder(load_ranks(lines), split)
        types = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
        for b in batches:
            at = 0
            for texts in _groups(b.column(1), GROUP_CHARS):
                n, ids, decoded = [], [], []
                for packed in encoder.encode_all(texts):
                    back = encoder.decode(packed)
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest() if digest else np.frombuffer(packed, "<i4"))
                    decoded.append(hashlib.sha256(back).hexdigest() if digest else back)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(ids, types[0]), pa.array(decoded, types[1])], names=["doc_id", "n_tokens", *columns])
                at += len(n)

    types = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return docs.mapInArrow(work, f"doc_id {kind}, n_tokens long, {types}")
