"""Exact similarity join of shingle sets: documents link when 100 * intersection >= least * union.

Two sets of which the smaller has n shingles and that link differ in at most (100 - least) * n / least shingles, H of them. Each set
signs pairs of cells of the hash space such that two sets that link share a signature (``Signatures``). Signatures
follow size classes (a set signs for its own class and for the one below), are combined within each block of documents and shuffled in
packed rows, a block's and a bucket's together (``Block``), of a size that doesn't depend on the number of partitions; shingles of very many texts are left out of them as far as that is exact. Sets that share one are candidates; a block and a task hand on a forest of their candidate links, the components
of all are families, and no link leaves a family.

A family is opened in a token-group matrix: its sets are parted into groups of similar ones (by their least shingle), each group's
row is the union of its tokens, a query set's overlap with that union bounds its overlap with every member, and only groups whose
bound reaches the query's need are opened and counted exactly. Large families are cut into blocks; each pair of blocks is a
task of bounded size; before that, shingles common in the family are set aside and it is sought anew for families in what is left.
Tasks return forests of true links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, discard, in_slices, materialise, mix64, shingle_hashes, word_hashes
from millrace.llm.components import components, forest
from millrace.shipping import ship

_BLOCK_SHINGLES = 1_500_000
_BLOCK_SIGNATURES = 500_000
_HELD_LINKS = 200_000
_LEAST_SLOT_BITS, _MOST_SLOT_BITS = 20, 25
_SLOT_TEXTS = 32768
_SIGNED = np.int64


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words of the text in lower case (A-Z); of all words where there are fewer."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode("utf-8", "replace").translate(LOWER)), n))


def set_hash(s: np.ndarray) -> int | None:
    """A 64-bit hash of a set, null for the empty one."""
    if not len(s):
        return None
    return int(mix64(np.array([np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))), len(s)], dtype=np.uint64).sum(keepdims=True)).view(_SIGNED)[0])


class Signatures:
    """Signatures of shingle sets for one threshold in percent: partition and enumeration."""

    CELLS = 3
    SCHEMES = 8

    def __init__(self, least: int):
        self.least, self.starts, self.edges = least, [1], {}

    def size_class(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.least + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def most_apart(self, c: int) -> int:
        """H: in how many shingles two sets can differ that link, the smaller of them in class c."""
        while len(self.starts) < c + 2:
            self.starts.append(self.starts[-1] * 100 // self.least + 1)
        return (self.starts[c + 1] - 1) * (100 - self.least) // self.least

    def of(self, sorted_set: np.ndarray, size: int | None = None, rare: np.ndarray | None = None) -> np.ndarray:
        """Cut the hash space into more than H / 2 parts of three cells. Of two sets that link at most H / 2 parts hold two differences
        or more; in every other part two of the three cells are equal in both sets, and a signature is such a pair of cells.

        A set's strength is the largest w such that in more than H / 2 parts all pairs hold w shingles or more: one of these parts is among
        the others, so the sets share a pair of at least w shingles, and the stronger set's w counts for both. Pairs of fewer shingles
        need no signature. A set of strength 0 also signs in further hash orders until it is strong in one, since two sets that link
        share a signature in the first order in which one of them is strong; sets that never are share one more signature.

        What two sets hold outside some fixed set of shingles differs in at most H shingles as well. ``rare``: the part of the set outside
        the common ones, which is signed first, so that passages of many texts make no candidates; the whole set follows where that part is
        weak. ``size``: that of the whole set, where only a part is given.
        """
        own, out = self.size_class(len(sorted_set) if size is None else size), []
        for c in (own, own - 1):
            if c < 0 or (h := self.most_apart(c)) < 1:
                continue  # sets of this class link only if they are equal
            need = h // 2 + 1
            parts = need + need // 6
            if parts not in self.edges:
                self.edges[parts] = np.array([k * (1 << 64) // (self.CELLS * parts) for k in range(1, self.CELLS * parts)], dtype=np.uint64)
            for scheme in range(0 if rare is not None else 1, self.SCHEMES):
                if scheme < 2:
                    s = sorted_set if scheme else rare
                else:
                    s = np.sort(mix64(sorted_set ^ np.uint64(scheme * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
                sums = np.zeros(len(s) + 1, dtype=np.uint64)
                np.cumsum(mix64(s), out=sums[1:])
                at = np.concatenate(([0], np.searchsorted(s, self.edges[parts]), [len(s)]))
                held, cell = np.diff(at).reshape(parts, self.CELLS), (sums[at[1:]] - sums[at[:-1]]).reshape(parts, self.CELLS)
                held = held.sum(axis=1, keepdims=True) - held  # of the pair that leaves each cell out
                weakest = held.min(axis=1)
                strength = int(np.partition(weakest, parts - need)[parts - need])
                number = np.arange(parts * self.CELLS, dtype=np.uint64).reshape(parts, self.CELLS) + np.uint64((c << 4 | scheme) << 32)
                out.append(mix64(cell.sum(axis=1, keepdims=True) - cell + mix64(number))[held >= max(1, strength)])
                if strength:
                    break
            else:
                out.append(mix64(np.array([(c << 4 | 15) << 32], dtype=np.uint64)))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _stars(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key, member): each key with its least member, and links from that member to the others of the key."""
    order = np.lexsort((members, keys))
    k, m = keys[order], members[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    first = m[head][np.cumsum(head) - 1]
    other = first != m
    return k[head], m[head], first[other], m[other]


_SIGNED_ROWS = "kind byte, at long, x long, y long, z long, text_key long, packed binary"
#: What a row is: a document, a bucket's signatures of a block, a link of set hashes, a set's number and hash, a link of numbers.
_DOCUMENT, _PACKED, _LINK, _NUMBER, _NUMBERED_LINK = range(5)
_NUMBERED = 20


def _rows(kind: int, x, y, z=None, text_key=None, at=None, packed=None) -> pa.RecordBatch:
    """``at`` deals the rows out: signatures by their buckets, rows that meet no others one by one."""
    n = len(x)
    at = np.arange(n) if at is None else at
    rest = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (z, text_key)]
    packed = pa.nulls(n, pa.binary()) if packed is None else packed
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int8)), pa.array(at, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), *rest, packed], names=["kind", "at", "x", "y", "z", "text_key", "packed"])


def _width(most: int) -> int:
    return max(1, (int(most).bit_length() + 7) // 8)


class Block:
    """The signatures of some sets, combined and packed. A set has a number: the task's, the block's and its own in the block.

    A signature loses its last byte, which may add candidates but takes none. A bucket is a range of signatures; its row holds the first of
    them, then for each how far it lies from the one before and the number in the block of the least set that has it.
    """

    def __init__(self, buckets: int):
        self.buckets, self.task, self.number = buckets, TaskContext.get().partitionId(), 0
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.sigs, self.signed = [], [], 0

    def add(self, set_hash: int, signatures: np.ndarray) -> None:
        if len(signatures):
            self.hashes.append(set_hash)
            self.sigs.append(signatures)
            self.signed += len(signatures)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The block's rows; an empty block follows."""
        if self.sigs:
            hashes, base = np.array(self.hashes, dtype=_SIGNED), (self.task << _NUMBERED | self.number) << _NUMBERED
            keys, first, a, b = _stars(np.concatenate(self.sigs) >> np.uint64(8), np.repeat(np.arange(len(hashes)), [len(s) for s in self.sigs]))
            yield _rows(_NUMBER, base + np.arange(len(hashes)), hashes)
            if len(a):
                x, y = forest(a, b)
                yield _rows(_LINK, hashes[x], hashes[y])
            bucket = ((keys >> np.uint64(24)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            step = np.diff(keys, prepend=keys[:1])
            step[new] = 0
            wide, own = _width(step.max()), _width(len(hashes) - 1)
            records = np.concatenate((step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide], first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :own]), axis=1)
            ends = np.concatenate((new, [len(keys)])).astype(np.int32) * np.int32(wide + own)
            packed = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(records.tobytes())])
            rows = _rows(_PACKED, np.full(len(new), base), keys[new].view(_SIGNED), np.full(len(new), wide), np.full(len(new), own), bucket[new], packed)
            yield from (rows.slice(k, 4096) for k in range(0, rows.num_rows, 4096))
            self.number += 1
        self._clear()


def unpacked(base: int, first: int, wide: int, own: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, numbers of their sets) of a packed row."""
    records = np.frombuffer(packed, dtype=np.uint8).reshape(-1, wide + own)
    parts = []
    for part in (records[:, :wide], records[:, wide:]):
        whole = np.zeros((len(records), 8), dtype=np.uint8)
        whole[:, : part.shape[1]] = part
        parts.append(whole.view("<u8").ravel())
    return np.cumsum(parts[0]) + np.uint64(first), parts[1].astype(np.int64) + base


def bucket_count(spark: SparkSession, shingles: int) -> int:
    """Some buckets a partition, and as many as keep the signatures of one, about one for each shingle, in the memory of a task."""
    return max(1024, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), shingles >> 20)


def slot_bits(text_bytes: int) -> int:
    """Slots of shingle hashes grow with the texts, some eight shingles a slot, up to what a task can hold."""
    return min(_MOST_SLOT_BITS, max(_LEAST_SLOT_BITS, (text_bytes // 48).bit_length()))


def common_slots(docs: DataFrame, text_col: str, words: int, times: float = 4.0) -> tuple[np.ndarray, int]:
    """Which slots of shingle hashes (``slot_bits``) are common: those that hold more than ``times`` the mean number of (text, shingle), and a
    hundred more; and the number of all (text, shingle). Every text counts; tasks send packed counts of all slots, and packed bits reach the driver."""
    text, cell = docs[text_col].cast("string"), 1 << 14
    size = 1 << slot_bits(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)

    def packed(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(0, size, cell):
            part = found[k : k + cell]
            if part.any():
                planes = np.ascontiguousarray(part.view(np.uint8).reshape(-1, 2).T)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pack.compress(planes.tobytes())], pa.binary())], names=["cell", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts = np.zeros(size, dtype=np.uint16), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(found, _slot(shingle_set(t, words), size), np.uint16(1))
            texts += b.num_rows
            if texts > _SLOT_TEXTS:
                yield from packed(found)
                found[:], texts = 0, 0
        yield from packed(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, unpack = None, None, zstandard.ZstdDecompressor()

        def done() -> pa.RecordBatch:
            counts = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([int(total.sum())], pa.int64()), pa.array([counts], pa.binary())], names=["cell", "n", "counts"])

        for k, data in (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if k != at and at is not None:
                yield done()
            low, high = np.frombuffer(unpack.decompress(data), dtype=np.uint8).reshape(2, -1).astype(np.int64)
            part = low + (high << 8)
            at, total = k, total + part if k == at else part
        if at is not None:
            yield done()

    cells = docs.select(text.alias("t")).mapInArrow(in_slices(count), "cell long, counts binary")
    slots = materialise(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(in_slices(add), "cell long, n long, counts binary"), "slots")
    total = slots.agg(F.sum("n")).first()[0] or 0
    least = times * total / size + 100

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            bits = [np.packbits(np.frombuffer(unpack.decompress(data), dtype=np.int64) > least).tobytes() for data in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], names=["cell", "bits"])

    out = np.zeros(size, dtype=bool)
    for r in slots.mapInArrow(in_slices(above), "cell long, bits binary").collect():
        out[r.cell : r.cell + cell] = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8)).view(bool)
    discard(slots)
    return out, total


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size``: a power of two."""
    return (mix64(hashes) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def sets_and_signatures(docs: DataFrame, id_col: str, text_col: str, words: int, least: int) -> DataFrame:
    """One pass: rows (kind, at, x, y, z, text_key, packed) of documents (id, set size, set hash, hash of the text) and of ``Block``."""
    often_slots, shingles = common_slots(docs, text_col, words)
    common, buckets = docs.sparkSession.sparkContext.broadcast(np.packbits(often_slots)), bucket_count(docs.sparkSession, shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, often = Signatures(least), np.unpackbits(common.value).view(bool)
        block, seen, load = Block(buckets), set(), 0
        for batch in batches:
            ids, sizes, hashes = batch.column(0).to_pylist(), [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, words)
                h = set_hash(s)
                sizes.append(len(s))
                hashes.append(h)
                if h is not None and h not in seen:
                    seen.add(h)
                    block.add(h, sign.of(s, rare=s[~often[_slot(s, len(often))]]))
                    load += len(s)
                    if load > _BLOCK_SHINGLES or block.signed > _BLOCK_SIGNATURES:
                        yield from block.flush()
                        seen, load = set(), 0
            yield _rows(_DOCUMENT, ids, sizes, hashes, batch.column(2).to_pylist())
        yield from block.flush()

    return docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("t"), _text_key(docs[text_col])).mapInArrow(in_slices(run), _SIGNED_ROWS)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("text_key")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``at``: a bucket's signatures of all blocks become a forest of the links from the first set of each signature to its
    others, the rest passes. What is held is one bucket and a forest that goes out when it has grown beyond a bound."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    bucket, parts, load = None, [], 0

    def links() -> Iterator[pa.RecordBatch]:
        nonlocal held, load
        keys, numbers = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        shared = np.concatenate((same, [False]))
        shared[1:] |= same
        if not shared.any():
            return
        _, _, a, b = _stars(keys[shared], numbers[order[shared]])
        held.append((a, b))
        load += len(a)
        if load > _HELD_LINKS:
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            load = len(held[0][0])
            if load > _HELD_LINKS // 2:
                yield _rows(_NUMBERED_LINK, *held[0])
                held, load = [], 0

    for batch in batches:
        met = batch.column(0).to_numpy() == _PACKED
        if not met.all():
            yield batch.filter(pa.array(~met))
        if met.any():
            for at, *row in zip(*(batch.filter(pa.array(met)).column(k).to_pylist() for k in range(1, 7))):
                if at != bucket and parts:
                    yield from links()
                    parts = []
                bucket = at
                parts.append(unpacked(*row))
    if parts:
        yield from links()
    if held:
        yield _rows(_NUMBERED_LINK, *forest(*(np.concatenate(x) for x in zip(*held))))


def candidates(signed: DataFrame, label: str) -> DataFrame:
    """The rows of documents and all candidate links, of set numbers or hashes, as a table."""
    return materialise(signed.repartition("at").sortWithinPartitions("at").mapInArrow(in_slices(_meet, 1 << 12), _SIGNED_ROWS), label)


def candidate_links(found: DataFrame) -> DataFrame:
    """(a, b): the candidate links as set hashes."""
    of_kind = lambda kind, x, y: found.filter(F.col("kind") == kind).select(F.col("x").alias(x), F.col("y").alias(y))
    names = of_kind(_NUMBER, "number", "hash")
    one_end = of_kind(_NUMBERED_LINK, "p", "q").distinct().join(names, F.col("p") == F.col("number")).select(F.col("hash").alias("a"), "q")
    both = one_end.join(names, F.col("q") == F.col("number")).select("a", F.col("hash").alias("b"))
    return of_kind(_LINK, "a", "b").unionByName(both)


class TokenGroupMatrix:
    """Sets parted into groups of similar ones; the matrix has a row a group: the union of its members' tokens."""

    def __init__(self, sets: list[np.ndarray], group_size: int = 32):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        tokens, counts = np.unique(every, return_counts=True)
        self.tokens = tokens[counts > 1]  # a token of one set is in no intersection
        self.columns = [self._known(s) for s in sets]
        order = sorted(range(len(sets)), key=lambda i: (self.columns[i][:3].tolist(), self.sizes[i]))
        self.groups = [np.array(order[k : k + group_size]) for k in range(0, len(order), group_size)]

    def _known(self, s: np.ndarray) -> np.ndarray:
        """The numbers of the set's tokens that other sets have too."""
        at = np.searchsorted(self.tokens, s)
        at[at == len(self.tokens)] = 0
        return at[self.tokens[at] == s] if len(self.tokens) else at[:0]

    def rows(self, which, low: int, high: int) -> np.ndarray:
        out = np.zeros((len(which), high - low), dtype=np.float32)
        for r, i in enumerate(which):
            c = self.columns[i]
            out[r, c[np.searchsorted(c, low) : np.searchsorted(c, high)] - low] = 1
        return out

    def overlaps(self, left, right) -> np.ndarray:
        """How many tokens each left set shares with each right one; a slice of tokens at a time."""
        out = np.zeros((len(left), len(right)), dtype=np.float32)
        for low in range(0, len(self.tokens), 4096):
            high = min(low + 4096, len(self.tokens))
            out += self.rows(left, low, high) @ self.rows(right, low, high).T
        return out

    def bounds(self) -> np.ndarray:
        """How many tokens each set shares with the union of each group."""
        out = np.zeros((len(self.sets), len(self.groups)), dtype=np.float32)
        for low in range(0, len(self.tokens), 4096):
            high = min(low + 4096, len(self.tokens))
            union = np.stack([self.rows(g, low, high).max(axis=0) for g in self.groups])
            for k in range(0, len(self.sets), 512):
                some = range(k, min(k + 512, len(self.sets)))
                out[k : k + 512] += self.rows(some, low, high) @ union.T
        return out

    def links(self, least: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join the true components: for every pair of sets that link, its ends are joined by the links returned.
        ``side``: only pairs of different sides count."""
        parent = list(range(len(self.sets)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out, qualifies = [], self.bounds() + 1e-3 >= self.sizes[:, None] * least / 100
        for queries in self.groups:
            opened = np.flatnonzero(qualifies[queries].any(axis=0))
            for g in opened:
                members = self.groups[g]
                if len({root(int(i)) for i in (*queries, *members)}) == 1:
                    continue
                inter = self.overlaps(queries, members).astype(np.int64)
                union = self.sizes[queries][:, None] + self.sizes[members][None, :] - inter
                for a, b in zip(*np.nonzero(100 * inter >= least * union)):
                    i, j = int(queries[a]), int(members[b])
                    if i != j and (side is None or side[i] != side[j]) and root(i) != root(j):
                        parent[root(i)] = root(j)
                        out.append((i, j))
        return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack.compress((t or "").encode("utf-8", "replace")) for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=["doc_id", "text", "text_key"])


def _refined(members: DataFrame, weight: DataFrame, texts: DataFrame, words: int, least: int, common: float = 0.05) -> DataFrame:
    """The members of the families that don't fit one task, in smaller families: shingles that more than ``common`` of a family's sets hold
    are left out, the sets sign what remains, and the components of the new candidates are families. So texts that only share
    passages of many texts part, and the pairs of blocks of a large family stay few. Members without a candidate go.

    Whatever is left out, no link is lost, so 32 to 128 sets of a family tell what is common in it. Shingles are rows for these sets
    alone; all sets are shuffled as packed texts and meet their family's common shingles, block by block, where they sign.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for label, h, t in (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)))):
            s = shingle_set(unpack.decompress(t).decode(), words)
            if set_hash(s) == h:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), label)), pa.array(s.view(_SIGNED))], names=["label", "token"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by family and block, the common shingles before the sets."""
        sign, block, unpack = Signatures(least), Block(buckets), zstandard.ZstdDecompressor()
        of, often = None, np.empty(0, dtype=np.uint64)
        for b in batches:
            for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                label, part, h, n, t = row
                if of != (label, part):
                    of, often = (label, part), np.empty(0, dtype=np.uint64)
                if t is None:
                    often = np.sort(np.array(b.column(5)[k].as_py(), dtype=_SIGNED).view(np.uint64))
                    continue
                s = shingle_set(unpack.decompress(t).decode(), words)
                if set_hash(s) != h:
                    continue
                own = sign.of(np.setdiff1d(s, often, assume_unique=True), n)
                block.add(h, mix64(own ^ mix64(np.array([label], dtype=_SIGNED).view(np.uint64))))
                if block.signed > _BLOCK_SIGNATURES:
                    yield from block.flush()
        yield from block.flush()

    wide = members.join(weight.filter("blocks > 1").select("label", "m", "blocks"), "label")
    buckets = bucket_count(members.sparkSession, wide.agg(F.sum("n")).first()[0])
    keyed = wide.select("label", "hash", "n", "m", "blocks", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key")
    held = materialise(keyed.join(texts.hint("merge"), ["id", "no_id", "text_key"]).select("label", "hash", "n", "m", "blocks", "text"), "wide")
    lot = F.pmod(F.xxhash64("hash", F.lit("often")), F.col("m"))
    asked = F.least(F.greatest(F.lit(32), F.least(F.lit(128), F.col("m") / 8)), "m")
    found = held.filter(lot < asked).select("label", "hash", "text").mapInArrow(in_slices(tokens), "label long, token long")
    often = found.groupBy("label", "token").agg(F.count("*").alias("c")).join(weight, "label").filter((F.col("c") > 1) & (F.col("c") > asked * F.lit(common)))
    often = often.groupBy("label", "blocks").agg(F.collect_list("token").alias("often"))
    none = lambda kind: F.lit(None).cast(kind)
    lists = often.select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), none("long").alias("hash"), none("long").alias("n"), none("binary").alias("text"), "often")
    sets = held.select("label", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int").alias("part"), "hash", "n", "text", none("array<long>").alias("often"))
    rows = lists.unionByName(sets).repartition("label", "part").sortWithinPartitions("label", "part", F.col("text").isNotNull())
    resigned = candidates(rows.mapInArrow(in_slices(signed), _SIGNED_ROWS), "resigned")
    finer = components(candidate_links(resigned))
    parted = wide.select("label", "hash", "doc_id", "text_key", "n").withColumnRenamed("label", "wide").join(finer, F.col("hash") == finer.node).select("label", "hash", "doc_id", "text_key", "n")
    out = materialise(members.join(weight.filter("blocks = 1").select("label"), "label").select(*members.columns).unionByName(parted), "members")
    for table in (held, resigned, finer):
        discard(table)
    return out


def _open(words: int, least: int):
    """Rows (task, side, set, text) sorted by task: the links found in each task."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows, texts, unpack = [], rows, zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}
        for side, h, t in texts:  # rows that share an id may bring the text of another set
            if h not in sets and set_hash(s := shingle_set(unpack.decompress(t).decode(), words)) == h:
                sets[h] = s
                rows.append((side, h))
        matrix = TokenGroupMatrix(list(sets.values()))
        sides = np.array([s for s, _ in rows])
        found = matrix.links(least, sides if len(set(sides.tolist())) > 1 else None)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in found], pa.int64()), pa.array([rows[j][1] for _, j in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            for k, s, h, t in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if k != task and rows:
                    yield solve(rows)
                    rows = []
                task = k
                rows.append((s, h, t))
        if rows:
            yield solve(rows)

    return run


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, least: int = 90, task_sets: int = 2048, task_shingles: int = 1_500_000) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links, its own included) of every row.

    A null text, or one without words, has an empty set and links with nothing; equal sets are one node, so copies cost one row each;
    repeated ids keep a row each; rows with a null id link like others, and their component is null only where no id is in it.
    ``task_sets`` and ``task_shingles`` bound what one task opens at once; larger families are cut into blocks that all meet pair by pair.
    """
    spark = docs.sparkSession
    ship(spark)
    signed = sets_and_signatures(docs, id_col, text_col, words, least)
    found = candidates(signed, "sets")
    sets = found.filter(F.col("kind") == _DOCUMENT).select(F.col("x").alias("doc_id"), F.col("y").alias("n_shingles"), F.col("z").alias("hash"), "text_key")
    families = components(candidate_links(found))
    # the row whose text stands for a set: the least id, and any text of it that gives the set
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    nodes = sets.filter("hash is not null").groupBy("hash").agg(first.alias("row"), F.min("n_shingles").alias("n")).select("hash", F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("text_key"), "n")
    members = materialise(families.join(nodes, families.node == nodes.hash).select("label", "hash", "doc_id", "text_key", "n"), "members")
    discard(families)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), _text_key(docs[text_col])).mapInArrow(in_slices(_packed), "doc_id long, text binary, text_key long")
    texts = texts.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key", "text")
    blocks = F.greatest(F.ceil(F.col("m") / F.lit(task_sets)), F.ceil(F.col("w") / F.lit(task_shingles))).cast("int")
    weigh = lambda df: df.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("blocks", blocks)
    if weigh(members).filter("blocks > 1").limit(1).count():
        coarse, members = members, _refined(members, weigh(members), texts, words, least)
        discard(coarse)
    large = weigh(members).select("label", "blocks")
    own = F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")
    tasks = members.join(large, "label").withColumn("own", own)
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))).alias("other")
    tasks = tasks.select("label", "hash", "doc_id", "text_key", "own", other)
    side = F.when(F.col("own") > F.col("other"), F.lit(1)).otherwise(F.lit(0)).alias("side")
    tasks = tasks.select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("task"), side, "hash", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key")
    opened = tasks.join(texts.hint("merge"), ["id", "no_id", "text_key"]).select("task", "side", "hash", "text")
    links = materialise(opened.repartition("task").sortWithinPartitions("task", "hash").mapInArrow(in_slices(_open(words, least)), "a long, b long"), "joined")
    discard(members)
    joined = components(links)
    discard(links)
    named = nodes.join(joined, nodes.hash == joined.node, "left").select("hash", "doc_id", F.coalesce("label", "hash").alias("label"))
    named = materialise(named, "named")
    discard(joined)
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(least_id, "label").select(F.col("hash").alias("of"), "component_id")
    out = sets.join(classes, sets.hash == classes.of, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: int = 80) -> DataFrame:
    """The documents that are the least of their group of near duplicates; a document that links with nothing stays.

    A document whose id is null stays. Rows that repeat a kept id with a text of the same group stay as that document does.
    """
    linked = link_documents(docs, id_col, text_col, words, least)
    gone = linked.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
