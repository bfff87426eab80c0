"""Exact-complement packing of tokenized documents into sequences.

Only the histogram of piece lengths decides the plan: at most `capacity`
counts, whatever the number of documents, so it is the one thing that comes to
the driver. Bit sets index the sums of one, two and three present lengths. The
planner goes through the lengths from the longest down and consumes what fills
the gap exactly: a single length, else pairs, else triples, the most even ones
first so that short pieces last, each as often as the available counts allow.
What no combination takes is packed by best fit on counts. Where that leaves
more sequences than the sum of lengths needs at least, the last exact fills are
given back to the rest, a growing share of them until the bound is met. The
plan is a list of patterns (lengths of one sequence) with multiplicities.

Pieces are numbered when they are stored and get ranks within their length by
(bucket of the number, number), the bucket offsets coming from counts, and a rank determines pattern, sequence and
offset. No task holds all pieces of a length.

Nulls: a null text is empty, its only token the end id. A null doc_id is a
document like another. Repeated rows are packed each. An empty table gives an
empty result. Very long texts are cut at multiples of the capacity. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, pick, shuffle_width, table

CAPACITY = 4096
END = 1
#: Entries of one generation of a cache.
CACHE = 150_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent(dict):
    """Two generations of a cache: when the young one is full it becomes the old one. Found entries stay young."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of a text, joined from the ids of its white-space separated runs.

    The tokenizer drops white space (runs are parted at ASCII's only) and none of its rules looks across it, so
    a run has the same ids wherever it stands. It also parts letters from
    other marks: a run of letters and final punctuation is the ids of the
    letters followed by those of the punctuation. All are kept while the caches
    hold them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the tokenizer's names of the UTF-8 bytes of each letter up to U+024F
        self.names = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 0x250) if chr(c).isalpha()}
        self.pieces = model.tokenize
        self.letters, self.marks, self.runs = Recent(self._word, CACHE), Recent(self._encode, 10_000), Recent(self._run, 2 * CACHE)

    def _encode(self, run: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([run.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        """Ids of lower-case letters up to U+024F, which normalization and splitting leave as they are, from the model itself."""
        text = word.decode()
        ids = [t.id for t in self.pieces(text if word.isascii() else text.translate(self.names))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: bytes) -> bytes:
        core = run.rstrip(b".,;:!?#*$%&|")
        if core.isalpha():  # of ASCII
            ids = self.letters[core.lower()]
        else:
            # small letters count: some capitals up to U+024F have theirs beyond it
            text = core.decode("utf-8", "replace").lower()
            if not text.isalpha() or max(text) > "\u024f":
                return self._encode(run)
            ids = self.letters[text.encode()]
        return ids + self.marks[run[len(core) :]] if len(core) < len(run) else ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.runs.__getitem__, text.encode("utf-8", "replace").split()))


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, kept from task to task."""
    import sys
    import types

    kept = sys.modules.setdefault("plenum_worker_state", types.ModuleType("plenum_worker_state")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenized documents cut into pieces of at most capacity ids."""
    path = path or tokenizer_path()

    def cut(batches):
        encode, end, step = encoder(path), np.asarray([END], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                rows += [(doc, i // step, i // 4, min(step, len(ids) - i) // 4, zlib.crc32(ids[i : i + step])) for i in range(0, len(ids), step)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, "doc_id", "text").mapInArrow(cut, PIECES).withColumn("piece", F.col("piece").cast("int"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) with multiplicities that use up the counts: exact fills, then best fit."""
    fills, left = exact_fills(counts, capacity)
    size = lambda made: sum(n for _, n in made)
    bound = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    best = None
    for share in (0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1):
        kept = fills[: len(fills) - int(np.ceil(share * len(fills)))]
        rest = Counter(left)
        for contents, n in fills[len(kept) :]:
            for length in contents:
                rest[length] += n
        made = kept + _best_fit(+rest, capacity)
        if best is None or size(made) < size(best):
            best = made
        if size(best) <= bound:
            break
    return best


def _bits(x: int) -> Iterator[int]:
    """The set bits of x, lowest first."""
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class Sums:
    """Bit sets of the present lengths and of the sums of two and three of them, up to the capacity."""

    def __init__(self, present: list[int], capacity: int):
        self.capacity, self.mask = capacity, (2 << capacity) - 1
        self.one = self.mirror = 0
        for x in present:
            self.one |= 1 << x
            self.mirror |= 1 << capacity - x
        self.index()

    def index(self) -> None:
        self.two = self.three = 0
        for x in _bits(self.one):
            self.two |= self.one << x & self.mask
        for x in _bits(self.one):
            self.three |= self.two << x & self.mask
        self.stale = False

    def remove(self, x: int) -> None:
        self.one &= ~(1 << x)
        self.mirror &= ~(1 << self.capacity - x)
        self.stale = True

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Present (b, c), b >= c, of the total, the most even first."""
        half = -(-total // 2)
        for b in _bits((self.one & self.mirror >> self.capacity - total) >> half):
            yield b + half, total - b - half

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        third = -(-total // 3)
        for b in _bits(self.one >> third):
            rest = total - b - third
            if rest > 0 and self.two >> rest & 1:
                for c, d in self.pairs(rest):
                    if c <= b + third:
                        yield b + third, c, d


def exact_fills(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """Patterns that fill the capacity exactly, and the counts that are left."""
    left, patterns = Counter({k: v for k, v in counts.items() if v > 0}), []
    if left[capacity]:
        patterns.append(((capacity,), left.pop(capacity)))
    sums = Sums(list(left), capacity)

    def take(parts: tuple[int, ...]) -> None:
        n = min(left[p] // k for p, k in Counter(parts).items())
        if n > 0:
            patterns.append((parts, n))
            for p in parts:
                left[p] -= n
                if not left[p]:
                    sums.remove(p)

    for a in sorted(left, reverse=True):
        gap = capacity - a
        if left[a] and left[gap]:
            take((a, gap))
        if sums.stale and left[a]:
            sums.index()
        if left[a] and sums.two >> gap & 1:
            for p in sums.pairs(gap):
                take((a, *p))
                if not left[a]:
                    break
        if left[a] and sums.three >> gap & 1:
            for p in sums.triples(gap):
                take((a, *p))
                if not left[a]:
                    break
    return patterns, +left


def _best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: bins with equal contents are one entry with a multiplicity."""
    open_bins: dict[int, list[list]] = {}  # room -> [contents, multiplicity]
    rooms: list[int] = []
    done = []

    def put(contents: tuple[int, ...], n: int) -> None:
        room = capacity - sum(contents)
        if not room:
            done.append((contents, n))
            return
        if room not in open_bins:
            bisect.insort(rooms, room)
        open_bins.setdefault(room, []).append([contents, n])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                per = min(capacity // length, n)
                full, rest = divmod(n, per)
                put((length,) * per, full)
                if rest:
                    put((length,) * rest, 1)
                break
            room = rooms[i]
            contents, have = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[i]
            fit = min(room // length, n)
            bins = min(have, n // fit)
            put(contents + (length,) * fit, bins)
            if have > bins:
                put(contents, have - bins)
            n -= bins * fit
    return done + [(tuple(c), n) for entries in open_bins.values() for c, n in entries]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of slots, in order of rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks, sequence = Counter(), 0
    for contents, n in patterns:
        at = 0
        for length in contents:
            runs.setdefault(length, []).append((ranks[length], sequence, at))
            ranks[length] += n
            at += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces plus sequence_id and offset. made: a stored table of pieces, each with a number `row` of its own."""
    spark = made.sparkSession
    buckets = max(8, shuffle_width(spark))
    rows = made.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    by = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))  # bounded by the number of patterns, not of pieces
    w = Window.partitionBy("length").orderBy("bucket")
    base = by.select("length", "bucket", (F.sum("n").over(w) - F.col("n")).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = rows.withColumn("__rank", F.row_number().over(own) - 1).join(base, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("__rank")).alias("rank"))

    def place(batches):
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, sequence, offset = runs.value[int(length)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = sequence[i] + rank[at] - first[i], offset[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES.replace("piece long", "piece int") + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
