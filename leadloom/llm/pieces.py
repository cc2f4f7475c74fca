"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (runs of the mark U+2581 and what follows them up
to the next mark); no piece reaches over such a cut, which is checked when the
model is read. The distinct words of a batch are sorted, which puts them in the
order of a depth-first walk of their trie, and are encoded in that order: the
forward states of the prefix that a word shares with the one before are kept,
only the rest is computed.

Forward states follow the model's own kind. Unigram models: the best sum of scores
of each prefix (Viterbi). BPE models (such as the 32k vocabulary, the only model file at hand, so the one of
the registered query): of each prefix the one last piece of its encoding. That is enough, as the merges never cross
the pieces of a result: a prefix that ends between two pieces is encoded by the
pieces before; and a piece may follow another if the pair, encoded together,
gives just that pair. So the same walk gives exactly the library's ids, which
plain Viterbi over BPE ranks would not.

No shuffle: a task's memory is one batch and a bounded cache of words.

Defined results: a null text gives null ids (and null when decoded), an empty one
no ids; unknown characters become byte pieces or, without these, the unknown id;
the mark itself in a text counts as a space, so such texts don't decode to
themselves; repeated rows are encoded alike; columns named ids or decoded are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Kinds of models and pieces, as the format numbers them.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = raw[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + n]
            at += n


class Model:
    """Pieces, scores and options of a model file's bytes."""

    def __init__(self, raw: bytes):
        self.pieces, self.kind, self.dummy_prefix, self.squeeze, escape, chars = [], UNIGRAM, True, True, True, b""
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0" * 4))[0], own.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                chars, self.dummy_prefix, self.squeeze, escape = own.get(2, b""), own.get(3, 1), own.get(4, 1), own.get(5, 1)
        if self.kind not in (UNIGRAM, BPE) or chars or self.squeeze or not escape:
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        if any(t in (USER, UNUSED) for _, _, t in self.pieces) or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces of this model reach over words")
        self.scores = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.penalty = min(self.scores.values(), default=0.0) - 10.0
        self.plain = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in self.pieces]
        #: By piece, whether other strings may follow it as the next piece.
        self.after: dict[str, dict[str, bool]] = {}
        self.learnt = 0

    def ids_of(self, pieces: list[str]) -> bytes:
        try:
            return array("i", [self.ids[p] for p in pieces]).tobytes()
        except KeyError:
            out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif out[-1:] != [self.unknown]:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best pair first, then the leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether the pair, encoded together, gives just that pair; it is remembered."""
        known = (len(piece) == 1 or piece in self.scores) and self.merged(before + piece) == ([before, piece] if before else [piece])
        self.learnt += 1
        self.after.setdefault(before, {})[piece] = known
        return known

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of sorted distinct words, in their order."""
        return self._merges_walk(words) if self.kind == BPE else self._scores_walk(words)

    def _merges_walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """last[i]: the last piece of the prefix of length i; nexts[i]: what may follow it.
        Only one piece fits at each place, so the shortest are tried first."""
        if self.learnt > 400_000:
            self.after, self.learnt = {}, 0
        after, before = self.after, ""
        last, nexts = [""], [after.setdefault("", {})]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], nexts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                while True:
                    piece = word[start:end]
                    fits = nexts[start].get(piece)
                    if fits is None:
                        fits = self.may_follow(last[start], piece)
                    if fits:
                        break
                    start -= 1
                last.append(piece)
                follow = after.get(piece)
                nexts.append(after.setdefault(piece, {}) if follow is None else follow)
            before, cut, end = word, [], len(word)
            while end:
                cut.append(last[end])
                end -= len(last[end])
            yield word, self.ids_of(cut[::-1])

    def _scores_walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """state[i]: where the last piece of the best way to prefix i starts, and its score."""
        state: list = [(0, 0.0)]
        before, pieces, longest = "", self.scores, self.longest
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best = None
                for start in range(max(0, end - longest), end):
                    score = pieces.get(word[start:end])
                    if score is not None or end - start == 1:
                        total = state[start][1] + (self.penalty if score is None else score)
                        if best is None or total > best[1]:
                            best = (start, total)
                state.append(best)
            before, cut, end = word, [], len(word)
            while end:
                start = state[end][0]
                cut.append(word[start:end])
                end = start
            yield word, self.ids_of(cut[::-1])

    def words(self, text: str) -> list[str]:
        marked = text.replace(" ", MARK)
        if self.dummy_prefix and text:
            marked = MARK + marked
        return _WORDS.findall(marked)

    def encode(self, texts: list[str | None], known: dict[str, bytes], room: int = 400_000) -> list[bytes | None]:
        """Ids of each text, as little-endian 32-bit numbers; `known` is a cache."""
        cut = [None if t is None else self.words(t) for t in texts]
        if len(known) > room:
            known.clear()
        new = sorted({w for ws in cut if ws for w in ws}.difference(known))
        found = dict(self.encode_sorted(new))
        # Long words (sentences of scripts without spaces) aren't kept, so the cache has a size.
        known.update((w, b) for w, b in found.items() if len(w) <= 32)
        return [None if ws is None else b"".join([known[w] if w in known else found[w] for w in ws]) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.plain.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def read_model(path: str = MODEL) -> bytes:
    """The model's bytes, read once on the driver; tasks get them with the code."""
    with open(path, "rb") as f:
        return f.read()


def _chunks(texts: pa.Array, most_rows: int = 512, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list]]:
    at = 0
    while at < len(texts):
        n, size = 0, 0
        while at + n < len(texts) and n < most_rows and (not n or size < most_bytes):
            size += len(texts[at + n].as_buffer() or b"") if texts[at + n].is_valid else 0
            n += 1
        yield n, texts.slice(at, n).to_pylist()
        at += n


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """Adds ids array<int> to the columns of `docs`; it has to have a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = Model(model), {}
        for batch in batches:
            at = 0
            for n, texts in _chunks(batch.column(batch.schema.get_field_index("text"))):
                found = [None if b is None else np.frombuffer(b, "<i4") for b in m.encode(texts, known)]
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], [*part.schema.names, "ids"])
                at += n

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    rest = small_batches(docs).drop("ids")
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("ids", ArrayType(IntegerType(), False))]))


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """Adds decoded string to rows with ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model)
        for batch in batches:
            texts = [None if not x.is_valid else m.decode(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    rest = small_batches(rows).drop("decoded")
    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField("decoded", StringType())]))


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) and
    round_trip (whether decoding gives the text again), without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = Model(model), {}
        for batch in batches:
            at = 0
            for n, texts in _chunks(batch.column(1)):
                ids = m.encode(texts, known)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array([None if b is None else len(b) // 4 for b in ids], pa.int64()),
                        pa.array([None if b is None else zlib.crc32(b) for b in ids], pa.int64()),
                        pa.array([None if b is None else m.decode(np.frombuffer(b, "<i4")) == t for b, t in zip(ids, texts, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
                )
                at += n

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
