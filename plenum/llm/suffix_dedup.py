"""Removal of repeated passages by merging Burrows-Wheeler transforms of shards.

Every byte that a `LENGTH`-byte string covers is removed, if the string also
starts in a document with a smaller id.

1. Documents are stored in chunks. Each 50-byte string has a minimizer, the
   smallest hash among its `KMER`-byte substrings; equal strings have equal
   minimizers. Buckets of minimizers find those that occur in more than one
   document. Only passages around such can hold a repeated string.
2. Each chunk sends its distinct passages (runs of strings that share a
   repeated minimizer) to the minimizer's bucket, with the smallest id. A
   minimizer with more than `HOT` passages sends its strings one by one to the
   buckets of their own hashes, so that no bucket grows with a frequent line.
3. A bucket builds the Burrows-Wheeler transform of each shard (group of
   chunks): the symbols before its suffixes, these in the order of their first
   50 bytes. The transforms are merged by refining an interleave vector, which
   names the shard of each suffix in the common order: it starts as
   a merge of the shards' runs by contexts of 8 bytes, and each round deals it
   by the symbols that the transforms hold, which takes it two symbols deeper.
   Beyond the contexts no suffixes of different shards are compared. A boundary
   between neighbours appears in the round after their common prefix; suffixes alone between two boundaries are
   settled and leave. The intervals at depth 50 are the repeated strings, and
   the smallest id of an interval is that of its members' passages.
4. The smallest ids return to the chunks, which mark the covered bytes.

Nulls: a null text is empty. A row with a null doc_id comes after all others:
nothing is removed on its account, and what others hold is removed from it.
Rows with equal ids remove nothing from each other. Texts under 50 bytes stay.
An empty table gives an empty result. Very long texts form chunks of their own.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick, scratch_path, shuffle_width, table
from .minhash_dedup import mix
from .warc import filesystem

LENGTH = 50
KMER = 16
#: Strings in one passage at most.
RUN = 50
CHUNK = 4 << 20
#: Bytes of text for each bucket.
BUCKET = 3 << 20
#: Passages of one minimizer, over all chunks, above which its strings are dealt out singly.
HOT = 20_000
SHARDS = 8
#: Passage bytes that a bucket merges at once.
MERGE = 2 << 20
LAST_ID = np.iinfo(np.int64).max

_BASE = np.uint64(0x9E3779B97F4A7C15)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: Bytes hashed at a time: what fits a core's cache.
BLOCK = 1 << 15


def blockwise(data: np.ndarray, width: int, work) -> np.ndarray:
    """work(data) of a function whose results look `width` bytes ahead, block by block."""
    n = len(data) - width + 1
    if n <= BLOCK:
        return work(data)
    return np.concatenate([work(data[lo : min(lo + BLOCK, n) + width - 1]) for lo in range(0, n, BLOCK)])


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte substrings, from hashes of substrings of doubling length."""
    part, size, out, have = _BYTE[data], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, have = part, size
            else:
                m = len(data) - have - size + 1
                out = out[:m] * _BASE + part[have : have + m]
                have += size
        if size * 2 > k:
            return mix(out[: len(data) - k + 1])
        m = len(part) - size
        part = part[:m] * (_BASE + np.uint64(2 * size)) + part[size:]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Chunk:
    """The concatenated texts of some documents and the passages in them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: np.ndarray, carried: pa.Table | None = None):
        self.ids, self.lengths, self.data, self.carried = ids, lengths, data, carried
        self.ends = np.cumsum(lengths)
        if len(data) < LENGTH:
            self.start = self.count = self.doc = np.empty(0, np.int64)
            self.minimizer = np.empty(0, np.uint64)
            return
        low = blockwise(data, LENGTH, lambda x: sliding_min(rolling(x, KMER), LENGTH - KMER + 1))
        # a string belongs to a document if its last byte does
        valid = np.zeros(len(low) + 1, bool)
        for end, n in zip(self.ends.tolist(), lengths.tolist(), strict=True):
            valid[end - n : max(end - n, end - LENGTH + 1)] = True
        valid = valid[: len(low)]
        first = valid.copy()
        first[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        starts_of_docs = (self.ends - lengths)[lengths >= LENGTH]
        first[starts_of_docs] = True
        at = np.flatnonzero(valid)
        run = np.cumsum(first)[at]
        head = np.flatnonzero(first)
        cut = first[at] | ((at - head[run - 1]) % RUN == 0)
        self.start = at[cut]
        bounds = np.append(np.flatnonzero(cut), len(at))
        self.count = np.diff(bounds)
        self.minimizer = low[self.start]
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    @classmethod
    def load(cls, uri: str) -> Chunk:
        files, path = filesystem(uri)
        with files.open_input_file(path) as f:
            t = pa.ipc.open_file(f).read_all()
        return cls(t.column("id").to_numpy(), t.column("n").to_numpy(), np.frombuffer(b"".join(t.column("text").to_pylist()), np.uint8), t.select(t.column_names[3:]))

    @staticmethod
    def save(uri: str, ids: list[int], texts: list[bytes], carried: list[pa.Array]) -> None:
        files, path = filesystem(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        t = pa.table([pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(texts, pa.large_binary()), *carried], ["id", "n", "text", *[f"carried{i}" for i in range(len(carried))]])
        with files.open_output_stream(path, compression=None) as f, pa.ipc.new_file(f, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers by (bucket, hash): bucket, hash, passages, and whether in more than one document."""
        h, inverse, n = np.unique(self.minimizer, return_inverse=True, return_counts=True)
        lo, hi = np.full(len(h), len(self.ids)), np.full(len(h), -1)
        np.minimum.at(lo, inverse, self.doc)
        np.maximum.at(hi, inverse, self.doc)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((h, bucket))
        return bucket[order], h[order], n[order], (lo < hi)[order]

    def passages(self, buckets: int, flags: dict[int, np.ndarray]) -> Passages:
        """The distinct passages of the flagged minimizers (1 repeated, 2 hot), in order of bucket and hash."""
        bucket, h, _, _ = self.anchors(buckets)
        flag = np.zeros(len(h), np.uint8)
        for b, got in flags.items():
            lo = np.searchsorted(bucket, b)
            flag[lo : lo + len(got)] = got
        by_hash = np.argsort(h)
        mine = flag[by_hash][np.searchsorted(h[by_hash], self.minimizer)]
        start, count, key = self.start[mine == 1], self.count[mine == 1], self.minimizer[mine == 1]
        string = blockwise(self.data, LENGTH, lambda x: rolling(x, LENGTH)) if len(self.data) >= LENGTH else np.empty(0, np.uint64)
        if (mine == 2).any():
            s, c = self.start[mine == 2], self.count[mine == 2]
            single = np.repeat(s, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            start, count = np.append(start, single), np.append(count, np.ones(len(single), np.int64))
            key = np.append(key, string[single])
        return Passages(self, buckets, start, count, key, string)


class Passages:
    """Passages of a chunk: instances (start, count), and `which` of the distinct ones each is."""

    def __init__(self, chunk: Chunk, buckets: int, start: np.ndarray, count: np.ndarray, key: np.ndarray, string: np.ndarray):
        self.start, self.count = start, count
        self.ids = chunk.ids[np.searchsorted(chunk.ends, start, side="right")]
        # the strings at both ends cover the passage, so their hashes name it
        a, b = string[start], string[start + count - 1]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((count, b, a, key, bucket))
        same = np.ones(max(0, len(order) - 1), bool)
        for x in (count, a, b, key):
            y = x[order]
            same &= y[1:] == y[:-1]
        new = np.append(np.ones(min(1, len(order)), bool), ~same)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        rep = order[new]
        self.bucket, self.key, self.first, self.n = bucket[rep], key[rep], start[rep], count[rep]
        self.low = np.full(len(rep), LAST_ID)
        np.minimum.at(self.low, self.which, self.ids)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices data[start : start + length] one after another."""
    total = int(length.sum())
    skip = np.repeat(start - (np.cumsum(length) - length), length)
    return data[skip + np.arange(total)]


#: Bytes of context that a shard's suffixes are sorted by at first, and that the interleave starts from.
CONTEXT = 8
#: Symbols that a round of the interleave goes deeper.
DEEPER = 2
#: Of each round of that sort, how many bytes on the suffix lies whose interval it joins; after them LENGTH bytes are in order.
STEPS = (8, 16, LENGTH - 32)


def contexts(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The CONTEXT bytes at each position as a number that sorts like them; zeros beyond the end of a passage."""
    padded = np.append(text, np.zeros(CONTEXT, np.uint8)).astype(np.uint64)
    key = padded[:-1] << np.uint64(8) | padded[1:]
    key = key[:-2] << np.uint64(16) | key[2:]
    key = (key[:-4] << np.uint64(32) | key[4:])[: len(text)]
    short = np.flatnonzero(left < CONTEXT)
    bits = (8 * (CONTEXT - left[short])).astype(np.uint64)
    key[short] = key[short] >> bits << bits
    return key


def _begins(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new interval begins in sorted keys, and which rows share theirs with others."""
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    return new[:-1], ~(new[:-1] & new[1:])


def suffix_order(key: np.ndarray, left: np.ndarray, lo: int, hi: int, interval: np.ndarray) -> np.ndarray:
    """The suffixes of the shard at lo..hi in the order of their first LENGTH bytes; passages end with a mark below all bytes.

    interval is scratch space of the length of the text.
    """
    order = lo + np.argsort(key[lo:hi])
    new, shared = _begins(key[order])
    interval[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    slots = np.flatnonzero(shared)
    for step in STEPS:
        if not len(slots):
            break
        rows = order[slots]
        ahead = np.where(left[rows] > step, interval[np.minimum(rows + step, hi - 1)] + 1, 0)
        k = interval[rows] << 32 | ahead
        dealt = np.argsort(k)
        rows = order[slots] = rows[dealt]
        new, shared = _begins(k[dealt])
        interval[rows] = slots[new][np.cumsum(new) - 1]
        slots = slots[shared]
    return order


class Transform:
    """The Burrows-Wheeler transform of a shard of passages: the DEEPER symbols before each suffix, in the order of the suffixes.

    first and last bound the depths at which a suffix counts: a string at p is
    reached, going ahead of the suffix, from the one LENGTH - k bytes on at
    depth k. Suffixes shorter than the context never count.
    """

    def __init__(self, key: np.ndarray, before: np.ndarray, order: np.ndarray, offset: np.ndarray, left: np.ndarray):
        self.rows = order = order[left[order] >= CONTEXT]
        self.key = key[order]
        self.symbol = before[order]  # of a passage's first suffixes it is never asked
        self.first = np.maximum(LENGTH - offset[order], CONTEXT).astype(np.uint8)
        # the last of n strings starts at n - 1, and n = offset + left - LENGTH + 1
        self.last = np.minimum(left[order], LENGTH).astype(np.uint8)


class Interleave:
    """The merge of transforms: of which shard each suffix of the common order is, at a depth that grows round by round.

    The next suffix of a shard is always the next in its own transform, so the
    vector of shards says it all. It starts as a merge of the shards' runs of
    contexts. A round deals it, stably, by the symbols before the suffixes; a
    boundary between neighbours appears in the first round in which they
    differ, so that it tells their common prefix, to DEEPER symbols.
    A suffix alone in its interval is settled, and so are all that lead on
    from it: they leave the vector.
    """

    def __init__(self, shards: list[Transform], n: int):
        self.rows = np.concatenate([t.rows for t in shards])
        self.key = np.concatenate([t.key for t in shards])
        self.symbol = np.concatenate([t.symbol for t in shards])
        self.first = np.concatenate([t.first for t in shards])
        self.last = np.concatenate([t.last for t in shards])
        self.shard = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(t.rows) for t in shards])
        #: Of each position at which a string starts: may it be repeated still?
        self.open = np.ones(n, bool)
        self.depth = CONTEXT
        live = self.live()
        key = self.key[live]
        dealt = np.argsort(key, kind="stable")  # merges sorted runs
        self.vector, self.begins = self.shard[live][dealt], _begins(key[dealt])[0]

    def live(self) -> np.ndarray:
        """What counts at this depth, shard by shard in the order of the transforms."""
        at = np.flatnonzero((self.first <= self.depth) & (self.depth <= self.last))
        return at[self.open[self.rows[at] - (LENGTH - self.depth)]]

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Drop what is alone in its interval; what stays, and its place in the vector."""
        live, place = self.live(), np.argsort(self.vector, kind="stable")
        shared = ~(self.begins & np.append(self.begins[1:], True))
        here = shared[place]
        if not here.all():
            self.open[self.rows[live[~here]] - (LENGTH - self.depth)] = False
            live, place = live[here], (np.cumsum(shared) - 1)[place[here]]
            self.vector, self.begins = self.vector[shared], self.begins[shared]
        return live, place

    def refine(self) -> None:
        """DEEPER symbols on."""
        live, place = self.settle()
        symbol = np.empty(len(live), self.symbol.dtype)
        symbol[place] = self.symbol[live]
        dealt = np.argsort(symbol, kind="stable")
        interval = np.cumsum(self.begins, dtype=np.int32)[dealt]
        symbol = symbol[dealt]
        self.vector = self.vector[dealt]
        self.begins = np.ones(len(dealt), bool)
        self.begins[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        self.depth += DEEPER

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, interval), by interval, of all that share theirs."""
        live, place = self.settle()
        rows = np.empty(len(live), np.int64)
        rows[place] = self.rows[live]
        return rows, np.cumsum(self.begins)


def transforms(text: np.ndarray, length: np.ndarray, shard: np.ndarray) -> list[Transform]:
    """The transform of each shard of passages of the given lengths; shard: of each passage, ascending."""
    key_of = np.arange(len(text))
    start = np.cumsum(length) - length
    left = np.repeat(start + length, length) - key_of
    offset = key_of - np.repeat(start, length)
    key, interval = contexts(text, left), np.empty(len(text), np.int64)
    before = np.zeros(len(text), np.uint16)
    before[DEEPER:] = text[:-DEEPER].astype(np.uint16) << 8 | text[1 : 1 - DEEPER]
    size = np.bincount(shard, length, minlength=int(shard.max()) + 1).astype(np.int64)
    ends = np.cumsum(size)
    return [Transform(key, before, suffix_order(key, left, lo, hi, interval), offset, left) for lo, hi in zip(ends - size, ends, strict=True)]


def repeated_intervals(text: np.ndarray, length: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, interval), by interval, of the strings of LENGTH bytes that occur twice or more in passages of the given lengths."""
    merge = Interleave(transforms(text, length, shard), len(text))
    while merge.depth < LENGTH and len(merge.vector):
        merge.refine()
    return merge.repeated()


def smallest_ids(text: np.ndarray, length: np.ndarray, low: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each string of each passage, in order, the smallest id of the passages that hold it; shard: of each passage, ascending."""
    start = np.cumsum(length) - length
    count = length - LENGTH + 1
    offset = np.cumsum(count) - count
    out = np.repeat(low, count)
    if len(text):
        suffix, group = repeated_intervals(text, length, shard)
        if len(suffix):
            passage = np.searchsorted(start, suffix, side="right") - 1
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(low[passage], heads)
            out[offset[passage] + suffix - start[passage]] = np.repeat(least, np.diff(np.append(heads, len(group))))
    return out


def _blob(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a.tobytes()) for a in arrays], np.int64)
    return sizes.tobytes() + b"".join(a.tobytes() for a in arrays)


def _arrays(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


ROW = "chunk string, bucket int, kind int, data binary"
ROW_SCHEMA = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
HEADER, ANCHORS, FLAGS, PASSAGES, REPLY = range(5)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ROW_SCHEMA.types, strict=True)], schema=ROW_SCHEMA) if rows else ROW_SCHEMA.empty_table()


def _store(docs: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Write the chunks of docs (doc_id, text and what is carried along); a header and the anchors by bucket for each."""
    def store(batches):
        from uuid import uuid4

        ids: list[int] = []
        texts: list[bytes] = []
        others: list[list] = []
        kinds: list[pa.DataType] = []

        def close():
            uri = f"{folder}/{uuid4().hex}.arrow"
            Chunk.save(uri, ids, texts, [pa.array(x, k) for x, k in zip(others, kinds, strict=True)])
            chunk = Chunk(np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
            bucket, h, n, several = chunk.anchors(buckets)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = [(uri, -1, HEADER, b"")]
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if hi > lo:
                    # half of the hash tells anchors of a bucket apart well enough: a mistake only lets a passage through to the merge
                    rows.append((uri, int(bucket[lo]), ANCHORS, _blob((h[lo:hi] >> np.uint64(32)).astype(np.uint32), np.minimum(n[lo:hi], 65535).astype(np.uint16), several[lo:hi])))
            yield from _rows(rows).to_batches()
            for x in (ids, texts, *others):
                x.clear()

        held = 0
        for batch in batches:
            if not kinds and batch.num_columns > 2:
                kinds += batch.schema.types[2:]
                others += [[] for _ in kinds]
            rest = zip(*[batch.column(i).to_pylist() for i in range(2, batch.num_columns)], strict=True) if kinds else iter([()] * len(batch))
            for doc, text, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rest, strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if ids and held + len(data) > CHUNK:
                    yield from close()
                    held = 0
                ids.append(LAST_ID if doc is None else doc)
                texts.append(data)
                for x, v in zip(others, more, strict=True):
                    x.append(v)
                held += len(data)
        if ids:
            yield from close()

    return docs.mapInArrow(store, ROW)


def _flag(t: pa.Table, hot: int) -> pa.Table:
    """Which anchors of a bucket are in more than one document, and which are hot."""
    blobs = [_arrays(b, np.uint32, np.uint16, bool) for b in t.column("data").to_pylist()]
    h, n, several = (np.concatenate(x) for x in zip(*blobs, strict=True))
    values, inverse, chunks = np.unique(h, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, n)
    many = (chunks > 1) | (np.bincount(inverse, several) > 0)
    flag = np.where(many, np.where(total > hot, 2, 1), 0).astype(np.uint8)[inverse]
    rows, at = [], 0
    for chunk, bucket, blob in zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), blobs, strict=True):
        mine = flag[at : at + len(blob[0])]
        at += len(mine)
        if mine.any():
            rows.append((chunk, bucket, FLAGS, mine.tobytes()))
    return _rows(rows)


def _flags_of(t: pa.Table) -> dict[int, np.ndarray]:
    return {b: np.frombuffer(d, np.uint8) for b, k, d in zip(t.column("bucket").to_pylist(), t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True) if k == FLAGS}


def _send(t: pa.Table, buckets: int) -> pa.Table:
    """The distinct passages of a chunk by bucket."""
    uri = t.column("chunk")[0].as_py()
    flags = _flags_of(t)
    if not flags:
        return _rows([])
    chunk = Chunk.load(uri)
    p = chunk.passages(buckets, flags)
    rows = []
    cuts = np.flatnonzero(np.diff(p.bucket)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(p.bucket)], strict=True):
        if hi > lo:
            length = p.n[lo:hi] + LENGTH - 1
            rows.append((uri, int(p.bucket[lo]), PASSAGES, _blob(p.key[lo:hi], p.n[lo:hi].astype(np.uint8), p.low[lo:hi], gather(chunk.data, p.first[lo:hi], length))))
    return _rows(rows)


def _merge(t: pa.Table) -> pa.Table:
    """Merge the shards of a bucket; for each chunk the runs of smallest ids of its passages."""
    t = t.sort_by("chunk")
    blobs = [_arrays(b, np.uint64, np.uint8, np.int64, np.uint8) for b in t.column("data").to_pylist()]
    key, n, low, text = (np.concatenate(x) for x in zip(*blobs, strict=True))
    n = n.astype(np.int64)
    length = n + LENGTH - 1
    start = np.cumsum(length) - length
    source = np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])
    # passages that several chunks hold are merged once, in the first one's shard
    string = blockwise(text, LENGTH, lambda x: rolling(x, LENGTH))
    a, b = string[start], string[start + n - 1]
    order = np.lexsort((source, n, b, a, key))
    same = np.ones(len(order) - 1, bool)
    for x in (n, a, b, key):
        y = x[order]
        same &= y[1:] == y[:-1]
    heads = np.flatnonzero(np.append(True, ~same))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    rep = order[heads]
    lowest = np.minimum.reduceat(low[order], heads)
    shard = source[rep] * SHARDS // len(blobs)
    # equal strings have equal keys: whole keys at a time, up to MERGE bytes
    size = np.cumsum(length[rep])
    whole = np.flatnonzero(np.append(key[rep][1:] != key[rep][:-1], True))
    out, lo = [], 0
    while lo < len(rep):
        limit = (size[lo - 1] if lo else 0) + MERGE
        i = np.searchsorted(size[whole], limit, side="right")
        hi = int(whole[max(i - 1, np.searchsorted(whole, lo))]) + 1
        part = np.arange(lo, hi)
        part = part[np.argsort(shard[part], kind="stable")]
        r = rep[part]
        got = smallest_ids(gather(text, start[r], length[r]), length[r], lowest[part], shard[part])
        # back to the order of the distinct passages
        begin = np.cumsum(n[r]) - n[r]
        back = np.argsort(part)
        out.append(gather(got, begin[back], n[r][back]))
        lo = hi
    ids = np.concatenate(out)
    count = n[rep]
    first = np.zeros(len(ids), bool)
    first[np.cumsum(count) - count] = True
    first[1:] |= ids[1:] != ids[:-1]
    run_at = np.flatnonzero(first)
    run_n = np.diff(np.append(run_at, len(ids))).astype(np.uint8)
    runs = np.diff(np.append(np.searchsorted(run_at, np.cumsum(count) - count), len(run_at)))
    run_start = np.cumsum(runs) - runs
    rows = []
    cuts = np.cumsum([0] + [len(b[0]) for b in blobs])
    for chunk, bucket, lo, hi in zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), cuts[:-1], cuts[1:], strict=True):
        w = which[lo:hi]
        rows.append((chunk, bucket, REPLY, _blob(runs[w].astype(np.uint8), gather(run_n, run_start[w], runs[w]), gather(ids[run_at], run_start[w], runs[w]))))
    return _rows(rows)


def _covered(t: pa.Table, buckets: int) -> tuple[Chunk, np.ndarray]:
    """The chunk and which of its bytes are covered by a string of a smaller id."""
    chunk = Chunk.load(t.column("chunk")[0].as_py())
    edge = np.zeros(len(chunk.data) + LENGTH + 1, np.int64)
    replies = sorted((b, d) for b, k, d in zip(t.column("bucket").to_pylist(), t.column("kind").to_pylist(), t.column("data").to_pylist(), strict=True) if k == REPLY)
    if replies:
        p = chunk.passages(buckets, _flags_of(t))
        runs, run_n, ids = (np.concatenate(x) for x in zip(*[_arrays(d, np.uint8, np.uint8, np.int64) for _, d in replies], strict=True))
        ids = np.repeat(ids, run_n)  # of every string of every distinct passage
        begin = np.cumsum(p.n) - p.n
        least = gather(ids, begin[p.which], p.count)
        own = np.repeat(p.ids, p.count)
        at = np.repeat(p.start - (np.cumsum(p.count) - p.count), p.count) + np.arange(len(own))
        at = at[least < own]
        edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + LENGTH, minlength=len(edge))
    return chunk, np.cumsum(edge)[: len(chunk.data)] > 0


def _results(t: pa.Table, buckets: int, characters: bool) -> pa.Table:
    chunk, gone = _covered(t, buckets)
    if characters and len(gone):
        # a character goes only if all its bytes go
        lead = (chunk.data & 0xC0) != 0x80
        lead[0] = True
        at = np.flatnonzero(lead)
        gone = np.repeat(np.minimum.reduceat(gone, at), np.diff(np.append(at, len(gone))))
    rows = []
    for doc, n, end in zip(chunk.ids.tolist(), chunk.lengths.tolist(), chunk.ends.tolist(), strict=True):
        mask, data = gone[end - n : end], chunk.data[end - n : end]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
        kept = data[~mask].tobytes()
        rows.append((None if doc == LAST_ID else doc, n, int(mask.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist(), kept if characters else None))
    made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)], schema=RESULT)
    for name, column in zip(chunk.carried.column_names, chunk.carried.columns, strict=True):
        made = made.append_column(name, column)
    return made


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, characters: bool = False, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its removed spans (byte offsets, start and end in turn), counts, and the digest of the rest.

    With `characters` no character is split and `kept` holds the remaining
    bytes. `carry` names columns of docs that go along with each row, so that
    nothing need be joined afterwards.
    """
    spark = docs.sparkSession
    columns = pick(docs, "doc_id", "text", *carry).columns
    texts = pick(docs, *columns).toDF(*[f"c{i}" for i in range(len(columns))]).withColumnsRenamed({"c0": "doc_id", "c1": "text"})
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    buckets = max(8, -(-total // BUCKET))
    stored = materialize(_store(texts, scratch_path(spark, "chunks"), buckets), "anchors")
    headers = materialize(stored.filter(F.col("kind") == HEADER), "headers")
    flags = materialize(stored.filter(F.col("kind") == ANCHORS).groupBy("bucket").applyInArrow(lambda t: _flag(t, hot), ROW), "flags")
    discard(stored)
    # chunks are few rows and much work, so their number, not their bytes, says how many tasks there are
    tasks = max(1, min(headers.count(), 8 * shuffle_width(spark)))
    sent = flags.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(lambda t: _send(t, buckets), ROW)
    replies = materialize(sent.groupBy("bucket").applyInArrow(_merge, ROW), "replies")
    chunks = headers.unionByName(flags).unionByName(replies).repartition(tasks, "chunk")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary" + "".join(f", carried{i} {kind}" for i, (_, kind) in enumerate(texts.dtypes[2:]))
    got = chunks.groupBy("chunk").applyInArrow(lambda t: _results(t, buckets, characters), kinds)
    return got.withColumnsRenamed({f"carried{i}": c for i, c in enumerate(carry)})


def without_repeats(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The given columns with the repeated passages cut out of text, and n_chars to match.

    The columns travel with the texts, so that nothing is joined. A text of
    which nothing is left stays as an empty one, a null text stays null.
    """
    rows = pick(docs, *columns)
    others = [c for c in columns if c != "text"]
    named = rows.select(F.col("doc_id"), F.col("text"), *[F.col(c).alias(f"__{c}") for c in others], F.col("text").isNull().alias("__null"))
    cut = remove_repeats(named, characters=True, carry=(*[f"__{c}" for c in others], "__null"))
    text = F.when(~F.col("__null"), F.col("kept").cast("string"))
    out = cut.select(*[text.alias("text") if c == "text" else F.col(f"__{c}").alias(c) for c in columns])
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(*columns)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")
