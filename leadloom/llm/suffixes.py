"""Suffix-array duplicates: exact repeats of `length` bytes across documents.

Every byte that a string of `length` bytes covers, which also starts in a document with
a smaller doc_id, is removed. The strings are compared in suffix order, which is
built blockwise over a difference cover:

1. Documents are dealt into chunks of a few MB by doc_id. In each, every window of
   `length` bytes gets the smallest hash of its `gram`-byte strings; maximal runs of
   windows with one such hash form a run. Equal windows have equal hashes, wherever
   they stand, so windows only have to be compared within a hash.
2. Hashes are counted over chunks (each chunk sends a hash once). Those of a
   single document are done with: their windows have no equals.
3. The distinct runs of the others go, each once for a chunk with its smallest doc_id,
   to blocks by hash. In a block, equal runs are one text with the smallest of their
   doc_ids. The windows of texts that share a hash with another are put into suffix order, one bucket of
   suffixes at a time: by PERIOD leading bytes, where suffixes that differ from all others
   drop out 8 bytes at a time, as their place in the order is certain; long ties
   are resolved by ranks of the difference-cover sample, computed before for the
   texts that have such ties. Equal windows are then neighbours.
4. Owners (the smallest doc_ids) of windows go back to the chunks, and mark the bytes.

A hash with very many runs (a passage in a third of all documents, with a new
context in each) would crowd one block: it is split into its windows, which are
dealt by hashes of their own.

Chunks, blocks and the sample are bounded; work is linear but for the sort in a block.

Defined results: a null text counts as no bytes; rows with equal doc_ids don't
remove from each other; a null doc_id ranks before all others; texts shorter
than `length` stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks_for


@dataclass(frozen=True)
class Repeats:
    length: int = 50
    gram: int = 16
    chunk_bytes: int = 4 << 20
    #: Runs in a block, about.
    block_runs: int = 400_000
    #: A hash with more runs than this is dealt by windows.
    crowded: int = 20_000
    #: Suffixes that are sorted at a time.
    bucket: int = 1 << 18


# --- suffix order over a difference cover ---

#: A difference cover modulo 32: every residue is the difference of two elements.
PERIOD, COVER = 32, (0, 1, 2, 3, 7, 11, 19)


@functools.cache
def _shifts() -> np.ndarray:
    """shift[a, b]: the least s with a + s and b + s in the cover, modulo the period."""
    cover = set(COVER)
    out = np.empty((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(s for s in range(PERIOD) if (a + s) % PERIOD in cover and (b + s) % PERIOD in cover)
    return out


def _leading(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their PERIOD leading bytes, and which of them are the same there as the
    one before: sorted by 8 bytes, then those that tie by the next 8, and so on."""
    key = words[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    same = key[1:] == key[:-1]
    for j in range(8, PERIOD, 8):
        if not same.any():
            break
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        places = np.flatnonzero(tied)
        group = np.cumsum(np.concatenate([[True], ~same]))[places]
        part = at[places]
        key = words[part + j].astype(np.uint64)
        order = np.lexsort((key, group))
        at[places] = part[order]
        key = key[order]
        again = np.zeros(len(at), bool)
        again[places[1:]] = (group[1:] == group[:-1]) & (key[1:] == key[:-1])
        same = again[1:]
    return at, same


class SuffixOrder:
    """Sorts suffixes of `text` (by `depth` bytes at least), a bucket at a time."""

    def __init__(self, text: bytes, depth: int):
        self.n = len(text)
        padded = np.frombuffer(text + bytes(depth + 3 * PERIOD), np.uint8)
        self.words = np.ndarray(len(padded) - 7, ">u8", padded.tobytes(), strides=(1,))
        # Ranks of the sample: by PERIOD bytes, then twice as many again and again.
        at = np.flatnonzero(np.isin(np.arange(self.n + 2 * PERIOD) % PERIOD, COVER))
        self.rank = np.zeros(self.n + 4 * PERIOD, np.int64)
        keys = self._keys(np.minimum(at, self.n + PERIOD))
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        self.rank[at[order]] = np.cumsum(new) + 1
        reach = PERIOD
        while reach < depth:
            far = np.where(at + reach < len(self.rank), self.rank[np.minimum(at + reach, len(self.rank) - 1)], 0)
            own = self.rank[at]
            order = np.lexsort((far, own))
            new = np.zeros(len(at), bool)
            new[1:] = (own[order][1:] != own[order][:-1]) | (far[order][1:] != far[order][:-1])
            self.rank[at[order]] = np.cumsum(new) + 1
            reach *= 2

    def _keys(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.words[at + 8 * j].astype(np.uint64) for j in range(PERIOD // 8)]

    def sorted(self, at: np.ndarray) -> np.ndarray:
        """The positions of one bucket in suffix order."""
        at, same = _leading(self.words, at)
        # Ties of PERIOD bytes: groups of neighbours that are the same so far.
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(first, len(at)))
        shifts, rank = _shifts(), self.rank
        two = first[size == 2]
        a, b = at[two], at[two + 1]
        s = shifts[a % PERIOD, b % PERIOD]
        swap = rank[a + s] > rank[b + s]
        at[two], at[two + 1] = np.where(swap, b, a), np.where(swap, a, b)

        def compare(a: int, b: int) -> int:
            s = shifts[a % PERIOD, b % PERIOD]
            return int(rank[a + s] - rank[b + s])

        for f, n in zip(first[size > 2], size[size > 2], strict=True):
            part = at[f : f + n]
            classes = part % PERIOD
            if (classes == classes[0]).all():
                s = shifts[classes[0], classes[0]]
                at[f : f + n] = part[np.argsort(rank[part + s], kind="stable")]
            else:
                at[f : f + n] = sorted(part.tolist(), key=functools.cmp_to_key(compare))
        return at

    def buckets(self, at: np.ndarray, most: int):
        """Buckets of suffixes, in order: by leading bytes, split further while too large."""
        todo = [(at, 0)]
        while todo:
            part, shift = todo.pop()
            if len(part) <= most or shift >= 48:
                yield self.sorted(part)
                continue
            lead = (self.words[part].astype(np.uint64) >> np.uint64(48 - shift)) & np.uint64(0xFFFF)
            order = np.argsort(lead, kind="stable")
            cuts = np.flatnonzero(np.diff(lead[order])) + 1
            groups = np.split(part[order], cuts)
            # Neighbouring small groups are sorted together.
            merged, held = [], []
            for g in groups:
                if held and sum(map(len, held)) + len(g) > most:
                    merged.append((held, len(held)))
                    held = []
                held.append(g)
            merged.append((held, len(held)))
            todo += [(np.concatenate(h), shift + 16 if n == 1 else 64) for h, n in reversed(merged)]

    def equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        out = np.ones(len(a), bool)
        for j in [*range(0, length - 8, 8), length - 8]:
            out &= self.words[a + j] == self.words[b + j]
        return out


# --- runs of windows with one smallest hash ---


def _smallest(buf: np.ndarray, r: Repeats) -> np.ndarray:
    """The smallest hash of each window of buf (as many as there are windows)."""
    n = len(buf) - r.length + 1
    out = np.empty(max(0, n), np.uint64)
    step = 1 << 19
    for at in range(0, n, step):
        part = np.ascontiguousarray(buf[at : at + step + r.length - 1])
        m = len(part) - r.gram + 1
        words = np.ndarray(len(part) - 7, "<u8", part.tobytes(), strides=(1,))
        h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
        last = words[r.gram - 8 : r.gram - 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F)
        last ^= last >> np.uint64(29)
        h += last
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        span, width = 1, r.length - r.gram + 1
        while span * 2 <= width:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if width > span:
            h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
        out[at : at + len(h)] = h
    return out


class Chunk:
    """Documents of a chunk, in the order of doc_id and text, and their runs."""

    def __init__(self, table: pa.Table, r: Repeats):
        ids = [x if x is not None else -(1 << 63) for x in table.column("doc_id").to_pylist()]
        texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.real = [table.column("doc_id")[i].as_py() for i in order]
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.text = b"".join(texts[i] for i in order)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.r = r
        m = _smallest(np.frombuffer(self.text, np.uint8), r)
        good = np.ones(len(m) + 2, bool)
        good[0] = good[-1] = False
        for a, b in zip(self.begins[:-1].tolist(), self.begins[1:].tolist(), strict=True):
            good[max(a, b - r.length + 1) + 1 : b + 1] = False
        good[len(m) + 1] = False
        change = np.ones(len(m) + 1, bool)
        change[1:-1] = m[1:] != m[:-1]
        here = good[1:-1]
        self.start = np.flatnonzero(here & (~good[:-2] | change[:-1]))
        self.count = np.flatnonzero(here & (~good[2:] | change[1:])) - self.start + 1
        self.key = m[self.start]
        self.doc = np.searchsorted(self.begins, self.start, "right") - 1

    def dealt(self, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, how often each comes, their blocks, in order of the blocks, and cuts."""
        keys, often = np.unique(self.key, return_counts=True)
        to = _block(keys, blocks)
        order = np.argsort(to, kind="stable")
        return keys[order], often[order], to[order], np.flatnonzero(np.diff(to[order], prepend=-1))

    def local(self) -> np.ndarray:
        """Keys in two documents of the chunk, or more."""
        order = np.lexsort((self.doc, self.key))
        k, d = self.key[order], self.ids[self.doc[order]]
        return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])

    def entries(self, shared: np.ndarray, crowded: np.ndarray) -> Entries:
        """The distinct runs of shared keys, in order of first appearance; runs of
        crowded keys are split into windows."""
        length, text = self.r.length, self.text
        use = np.flatnonzero(_among(self.key, shared))
        start, count, key, doc = self.start[use], self.count[use], self.key[use], self.ids[self.doc[use]]
        split = _among(key, crowded)
        if split.any():
            times = np.where(split, count, 1)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start, count, key, doc, split = np.repeat(start, times) + inner, np.repeat(np.where(split, 1, count), times), np.repeat(key, times), np.repeat(doc, times), np.repeat(split, times)
        found: dict[bytes, int] = {}
        entry = np.fromiter((found.setdefault(text[a:b], len(found)) for a, b in zip(start.tolist(), (start + count + (length - 1)).tolist(), strict=True)), np.int64, len(start))
        texts = list(found)
        first = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(first, entry, doc)
        keys = np.zeros(len(texts), np.uint64)
        keys[entry] = key
        if split.any():  # windows of crowded keys go by hashes of their own
            for i in np.unique(entry[split]).tolist():
                keys[i] = xxhash.xxh3_64_intdigest(texts[i])
        return Entries(texts, keys, first, start, count, doc, entry)


@dataclass(frozen=True)
class Entries:
    """Distinct texts with keys and smallest doc_ids; and the runs that have them."""

    texts: list[bytes]
    keys: np.ndarray
    first: np.ndarray
    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    entry: np.ndarray

    def dealt(self, blocks: int) -> list[tuple[int, np.ndarray]]:
        """(block, numbers of its texts), the same whenever the chunk is read again."""
        if not self.texts:
            return []
        to = _block(self.keys, blocks)
        order = np.argsort(to, kind="stable")
        return [(int(to[part[0]]), part) for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1)]


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in `some`, which has few distinct values or is empty."""
    if not len(some) or not len(x):
        return np.zeros(len(x), bool)
    some = np.unique(some)
    at = np.minimum(np.searchsorted(some, x), len(some) - 1)
    return some[at] == x


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    x = keys * np.uint64(0xFF51AFD7ED558CCD)
    return ((x >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a.tobytes()) for a in arrays]], "<i8").tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, "<i8", 1 + len(kinds))[1:]
    out, at = [], 8 * (1 + len(kinds))
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _sent(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = {"block": pa.int64(), "chunk": pa.int64(), "data": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)})


def _equals(joined: bytes, at: np.ndarray, own: np.ndarray, r: Repeats) -> np.ndarray:
    """The smallest owner of each window at `at` and its equals."""
    place = np.full(len(joined), -1, np.int64)
    place[at] = np.arange(len(at))
    order = SuffixOrder(joined, r.length)
    best = own.copy()
    for bucket in order.buckets(at, r.bucket):
        same = order.equal(bucket[:-1], bucket[1:], r.length)
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        i = place[bucket]
        best[i] = np.repeat(np.minimum.reduceat(own[i], heads), np.diff(np.append(heads, len(i))))
    return best


def _windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows in the joined texts, and the text of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = sizes - length + 1
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), windows)
    return np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum()), text


def _tied(texts: list[bytes], at: np.ndarray, most: int) -> np.ndarray:
    """Which windows tie with another one in their leading bytes, a bucket at a time."""
    joined = np.frombuffer(b"".join(texts) + bytes(PERIOD), np.uint8)
    words = np.ndarray(len(joined) - 7, ">u8", joined.tobytes(), strides=(1,))
    out = np.zeros(len(joined), bool)
    lead = words[at].astype(np.uint64) >> np.uint64(48)
    parts = [np.arange(len(at))]
    if len(at) > most:
        order = np.argsort(lead, kind="stable")
        edges = np.searchsorted(np.cumsum(np.bincount((lead[order]).astype(np.int64), minlength=1 << 16)), np.arange(most, len(at), most))
        parts = np.split(order, np.searchsorted(lead[order], (np.unique(edges) + 1).astype(np.uint64)))
    for part in parts:
        if len(part) > 1:
            mine, same = _leading(words, at[part])
            out[mine[1:][same]] = True
            out[mine[:-1][same]] = True
    return out[at]


def decided(parts: list[tuple[int, bytes]], r: Repeats) -> list[tuple[int, bytes]]:
    """One block: (chunk, packed entries) in, (chunk, packed runs of removed windows) out."""
    number: dict[bytes, int] = {}
    each, all_docs, all_keys = [], [], []
    for chunk, raw in parts:
        keys, docs, sizes, text = _unpack(raw, "<u8", "<i8", "<u4", "u1")
        text, ends = text.tobytes(), np.cumsum(sizes.astype(np.int64))
        own = np.fromiter((number.setdefault(text[a:b], len(number)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)), np.int64, len(ends))
        each.append((chunk, own, docs))
        all_docs.append(docs)
        all_keys.append(keys)
    texts = list(number)
    own = np.concatenate([e[1] for e in each])
    owner = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(owner, own, np.concatenate(all_docs))
    key = np.zeros(len(texts), np.uint64)
    key[own] = np.concatenate(all_keys)
    # Texts that share a key with others: their windows are put into suffix order, at first by leading
    # bytes; those that tie there go on to the ranks of the sample.
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(size[group] > 1)
    start = count = of = np.empty(0, np.int64)
    if len(open_):
        at, text = _windows([texts[i] for i in open_], r.length)
        twice = _tied([texts[i] for i in open_], at, 4 * r.bucket)
        if twice.any():
            some = np.unique(text[twice])
            chosen = open_[some]
            at, text = _windows([texts[i] for i in chosen], r.length)
            twice = twice[np.isin(np.repeat(np.arange(len(open_)), np.fromiter((len(texts[i]) for i in open_), np.int64) - r.length + 1), some)]
            first = owner[chosen][text]
            better = np.zeros(len(at), bool)
            better[twice] = _equals(b"".join(texts[i] for i in chosen), at[twice], first[twice], r) < first[twice]
            # Runs of windows that an earlier document has, within a text.
            begin = better & np.concatenate([[True], ~better[:-1] | (text[1:] != text[:-1])])
            end = better & np.concatenate([~better[1:] | (text[1:] != text[:-1]), [True]])
            s, e = np.flatnonzero(begin), np.flatnonzero(end)
            heads = np.searchsorted(text, np.arange(len(chosen)))
            of, start, count = chosen[text[s]], s - heads[text[s]], e - s + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) - r.length + 1
    where = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for chunk, mine, docs in each:
        whole = np.flatnonzero(owner[mine] < docs)
        rest = np.flatnonzero((owner[mine] == docs) & (where[mine + 1] > where[mine]))
        times = where[mine[rest] + 1] - where[mine[rest]]
        i = np.repeat(where[mine[rest]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        n = np.concatenate([whole, np.repeat(rest, times)])
        if len(n):
            s, c = np.concatenate([np.zeros(len(whole), np.int64), start[i]]), np.concatenate([lengths[mine[whole]], count[i]])
            out.append((chunk, _pack(n.astype("<u4"), s.astype("<u4"), c.astype("<u4"))))
    return out


def removed(docs: DataFrame, r: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and
    end in bytes); one row per row of `docs` (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = total // r.chunk_bytes + 1
    # Of all windows, about 2 / (width + 1) start a run.
    blocks = int(total * 2 / (r.length - r.gram + 2)) // r.block_runs + 1
    # Rows of one doc_id are spread; they don't remove from each other wherever they are.
    tasks = tasks_for(own.sparkSession, total)
    dealt = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(tasks, "chunk")
    sent = "block long, chunk long, data binary"

    def count(table: pa.Table) -> pa.Table:
        c, chunk, rows = Chunk(table, r), table.column("chunk")[0].as_py(), []
        keys, often, to, cuts = c.dealt(blocks)
        for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
            rows.append((int(to[a]), chunk, _pack(keys[a:b].astype("<u8"), often[a:b].astype("<u4"))))
        return _sent(rows, ("block", "chunk", "data"))

    def compare(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts = [(ch, *_unpack(raw, "<u8", "<u4")) for ch, raw in zip(table.column("chunk").to_pylist(), table.column("data").to_pylist(), strict=True)]
        keys, often = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] ^ np.uint64(1)))
        runs = np.add.reduceat(often[order].astype(np.int64), heads)
        sizes = np.diff(np.append(heads, len(keys)))
        many, busy = np.empty(len(keys), bool), np.empty(len(keys), bool)
        many[order], busy[order] = np.repeat(sizes > 1, sizes), np.repeat(runs > r.crowded, sizes)
        rows, at = [], 0
        for ch, k, _ in parts:
            s, w = many[at : at + len(k)], busy[at : at + len(k)]
            at += len(k)
            if s.any() or w.any():
                rows.append((block, ch, _pack(np.packbits(s), np.packbits(w) if w.any() else np.empty(0, "u1"))))
        return _sent(rows, ("block", "chunk", "data"))

    def _shared(c: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys, _, to, cuts = c.dealt(blocks)
        at = {int(to[a]): (a, b) for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True)}
        shared, crowded = [c.local()], [np.empty(0, np.uint64)]
        for block, raw in zip(answers.column("block").to_pylist(), answers.column("data").to_pylist(), strict=True):
            a, b = at[block]
            s, w = _unpack(raw, "u1", "u1")
            shared.append(keys[a:b][np.unpackbits(s, count=b - a).astype(bool)])
            if len(w):
                crowded.append(keys[a:b][np.unpackbits(w, count=b - a).astype(bool)])
        return np.concatenate(shared), np.concatenate(crowded)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent([], ("block", "chunk", "data"))
        c, chunk, rows = Chunk(table, r), table.column("chunk")[0].as_py(), []
        shared, crowded = _shared(c, answers)
        found = c.entries(shared, crowded)
        for block, part in found.dealt(blocks):
            texts = [found.texts[i] for i in part.tolist()]
            rows.append((block, chunk, _pack(found.keys[part].astype("<u8"), found.first[part].astype("<i8"), np.fromiter(map(len, texts), "<u4", len(texts)), np.frombuffer(b"".join(texts), "u1"))))
        # The masks are needed again at the end: they go along to the chunk's own answers.
        rows += [(-1 - b, chunk, d) for b, d in zip(answers.column("block").to_pylist(), answers.column("data").to_pylist(), strict=True)]
        return _sent(rows, ("block", "chunk", "data"))

    def decide(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts = list(zip(table.column("chunk").to_pylist(), table.column("data").to_pylist(), strict=True))
        rows = [(block, ch, d) for ch, d in (parts if block < 0 else decided(parts, r))]
        return _sent(rows, ("block", "chunk", "data"))

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        if not table.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        c, length = Chunk(table, r), r.length
        blocks_of = np.array(answers.column("block").to_pylist(), np.int64)
        masks = answers.filter(pa.array(blocks_of < 0))
        masks = pa.table({"block": pa.array(-1 - blocks_of[blocks_of < 0]), "data": masks.column("data")})
        shared, crowded = _shared(c, masks)
        found = c.entries(shared, crowded)
        dealt_to = dict(found.dealt(blocks))
        # Runs of a text that an earlier document of the chunk has are removed whole; of the others,
        # what the block has found. Answers are joined to runs by the text's number.
        edge = np.zeros(len(c.text) + 1, np.int32)
        later = found.first[found.entry] < found.doc
        np.add.at(edge, found.start[later], 1)
        np.add.at(edge, found.start[later] + found.count[later] + length - 1, -1)
        told = [(dealt_to[block], *_unpack(raw, "<u4", "<u4", "<u4")) for block, raw in zip(blocks_of.tolist(), answers.column("data").to_pylist(), strict=True) if block >= 0]
        if told:
            entry = np.concatenate([part[n] for part, n, _, _ in told])
            shift, many = (np.concatenate([x[i] for x in told]).astype(np.int64) for i in (2, 3))
            order = np.argsort(entry, kind="stable")
            entry, shift, many = entry[order], shift[order], many[order]
            low, high = np.searchsorted(entry, found.entry), np.searchsorted(entry, found.entry, "right")
            times = np.where(later, 0, high - low)
            i = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
            at = np.repeat(found.start, times) + shift[i]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + many[i] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = []
        for i, doc in enumerate(c.real):
            a, b = int(c.begins[i]), int(c.begins[i + 1])
            g = gone[a:b]
            flips = np.flatnonzero(np.diff(g, prepend=False, append=False))
            spans = list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))
            h, at = hashlib.sha256(), a
            for s, e in spans:
                h.update(c.text[at : a + s])
                at = a + e
            h.update(c.text[at:b])
            rows.append((doc, b - a, int(g.sum()), len(spans), h.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        return pa.table({n: pa.array([x[j] for x in rows], k) for j, (n, k) in enumerate(zip(names, kinds, strict=True))})

    def by(df: DataFrame, key: str):
        return df.repartition(tasks, key).groupBy(key)

    counted = dealt.groupBy("chunk").applyInArrow(count, sent)
    answers = by(counted, "block").applyInArrow(compare, sent)
    entries = dealt.groupBy("chunk").cogroup(by(answers, "chunk")).applyInArrow(send, sent)
    owners = by(entries, "block").applyInArrow(decide, sent)
    return dealt.groupBy("chunk").cogroup(by(owners, "chunk")).applyInArrow(mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
