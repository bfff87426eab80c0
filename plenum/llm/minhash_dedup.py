"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the 64-bit hashes of its distinct 5-word shingles.
Documents with equal sets are one node of the join, known by the 128-bit
digest of the set. Each of `TREES` independent trees branches the sets
recursively by selected minwise tokens: the first level by one token, each
further one by `FANOUT` tokens, so that a pair at the threshold is likely to
stay together in some branch however deep the tree gets. Nodes of at most
`LEAF` sets are compared exhaustively; larger ones branch again, up to `DEPTH`
levels or until a branch keeps most of its sets. What is still larger there is
mostly a group of near copies; it is dealt into blocks of `BLOCK` sets, without any cap. Recall: a pair with
similarity 0.75 meets in a tree with probability 0.75 at the first level and
at least 0.61 at the last, so ten trees miss it with a probability between
1e-6 and 1e-4; nearer pairs less.

Comparing: signatures of `COORDS` minwise hashes rule out pairs whose estimate
lies more than four deviations below the threshold.

1. Each block proposes a spanning forest of its candidate pairs. A node's
   smallest set is its hub: it joins every block of the node, and what lies
   close to it is proposed with it, the same pair in every tree and block. So
   a group of n near copies proposes about n pairs. They are confirmed on the
   full sets, and what they link are parts.
2. Nodes that hold several parts are looked at again. The blocks of a node's
   largest part meet the blocks of the rest, and those of the rest each other,
   but two blocks of one part never meet. Parts with a candidate pair form
   families.
3. The parts of a family are compared on their full sets in the same pairs of
   blocks, by matrix products inside tasks of bounded size. A task returns a
   link for two parts that a pair holds together, never the pairs.

Nulls: a null or blank text has an empty set and links with nothing, and so
does a row with a null doc_id (its component is null, it is kept). Texts of
fewer than five words are one shingle; very long texts are sets like others.
Repeated rows have equal sets and link; of equal ids the smallest names the
component. Other columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick, shuffle_width, table
from .components import components

WORDS = 5
THRESHOLD = 75  # percent
COORDS = 96
TREES = 10
DEPTH = 5
FANOUT = 2
LEAF = 48
#: A branch that keeps this share of its parent's sets parts them no further and is compared as it is.
STALL = 0.7
BLOCK = 512
#: Estimates below this are more than four deviations under the threshold.
CUT = int(COORDS * (0.75 - 4.2 * (0.75 * 0.25 / COORDS) ** 0.5))
#: Pairs with a hub from this estimate on are proposed as such.
HUB = int(COORDS * 0.8)
WORD_CACHE = 150_000
#: Documents whose sets a task holds at once.
HELD = 2_000
#: Bytes of text whose shingles are hashed together.
GROUP = 1 << 20

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_ODD = np.random.default_rng(5).integers(0, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(m: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words from the mixed hashes of the words."""
    h = np.full(len(m) - k + 1, _ODD[WORDS], np.uint64) * np.uint64(k)
    for i in range(k):
        h += m[i : len(m) - k + 1 + i] * _ODD[i]
    return mix(h)


def shingle_sets(texts: list[str | None], hashes: WordHashes):
    """For each text its sorted distinct shingle hashes, ASCII letters lower-cased."""
    group: list[list[bytes]] = []
    held = 0
    for i, text in enumerate(texts, 1):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        group.append(words)
        held += len(text or "")
        if held < GROUP and i < len(texts):
            continue
        n = [len(w) for w in group]
        m = mix(np.fromiter(map(hashes.__getitem__, chain.from_iterable(group)), np.uint64, sum(n)))
        h = _windows(m, WORDS) if len(m) >= WORDS else m[:0]
        at = 0
        for k in n:
            s = np.sort(h[at : at + k - WORDS + 1] if k >= WORDS else _windows(m[at : at + k], k) if k else h[:0])
            yield s[np.append(True, s[1:] != s[:-1])] if k > 1 else s
            at += k
        group, held = [], 0


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return next(shingle_sets([text], hashes))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minwise hashes of each set, 32 bits each; the sets are not empty."""
    rng = np.random.default_rng(10)
    a = rng.integers(0, 1 << 31, COORDS, np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, COORDS, np.uint32)
    out = np.empty((len(sets), COORDS), np.uint32)
    size = np.cumsum([len(s) for s in sets])
    lo = 0
    while lo < len(sets):
        # as many sets at a time as fit a core's cache
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 14), side="right")))
        x = np.concatenate(sets[lo:hi])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.append(0, np.cumsum([len(s) for s in sets[lo : hi - 1]])).astype(np.int64)
        buffer = np.empty_like(x)
        for k in range(COORDS):
            np.multiply(x, a[k], out=buffer)
            np.add(buffer, b[k], out=buffer)
            out[lo:hi, k] = np.minimum.reduceat(buffer, starts)
        lo = hi
    return out


def child(node: np.ndarray, level: int, branch: int, token: np.ndarray) -> np.ndarray:
    """The child that a selected token leads to; nodes are 64-bit hashes of their path."""
    return mix(mix(node + np.uint64(2 * (level * 16 + branch) + 1)) ^ (token.astype(np.uint64) * _MIX[1] + np.uint64(branch)))


def coordinate(tree: np.ndarray | int, level: int, branch: int):
    """Which minwise token a tree selects: trees have 9 coordinates each, shared by none of the first levels."""
    return (tree * 9 + (0 if level == 1 else 1 + (level - 2) * FANOUT + branch)) % COORDS


def _slices(batches):
    """Batches of at most `HELD` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            yield batch.slice(at, HELD)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sid (digest of the set, null if empty), sig."""
    def compute(batches):
        import xxhash

        hashes = WordHashes()
        for batch in _slices(batches):
            sets = list(shingle_sets(batch.column("text").to_pylist(), hashes))
            sid = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            made = iter(signatures([s for s in sets if len(s)]))
            sig = [next(made).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "sid", "sig"])

    return docs.mapInArrow(compute, "doc_id long, n_shingles long, sid binary, sig binary")


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """(tree, node, sid, above) of the next level from rows (tree, node, sid, sig, size), above their size; level 1 starts every tree from (sid, sig)."""
    def first(batches):
        for pdf in batches:
            m = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDS)
            for t in range(TREES):
                node = child(np.full(len(m), t, np.uint64), 1, 0, m[:, coordinate(t, 1, 0)])
                yield pd.DataFrame({"tree": np.full(len(m), t, np.int32), "node": node.view(np.int64), "sid": pdf["sid"], "above": np.full(len(m), 1 << 62)})

    def deeper(batches):
        for pdf in batches:
            m = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, COORDS)
            tree, node = pdf["tree"].to_numpy(), pdf["node"].to_numpy().view(np.uint64)
            for b in range(FANOUT):
                token = m[np.arange(len(m)), coordinate(tree.astype(np.int64), level, b)]
                yield pd.DataFrame({"tree": tree, "node": child(node, level, b, token).view(np.int64), "sid": pdf["sid"], "above": pdf["size"]})

    return rows.mapInPandas(first if level == 1 else deeper, "tree int, node long, sid binary, above long")


def leaves(sigs: DataFrame) -> DataFrame:
    """(node, size, hub, sid): the nodes to compare, of two sets or more, with their smallest set."""
    out, rows, spent = None, sigs.select("sid", "sig"), []
    for level in range(1, DEPTH + 1):
        nodes = materialize(_branch(rows, level), f"nodes{level}")
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("hub")).filter("size > 1")
        shared = materialize(nodes.join(sizes, "node"), f"shared{level}")
        discard(nodes)
        spent.append(shared)
        done = (F.col("size") <= LEAF) | (F.col("size") >= STALL * F.col("above"))
        here = shared.filter(done) if level < DEPTH else shared
        here = here.select("node", "size", "hub", "sid")
        out = here if out is None else out.unionByName(here)
        large = shared.filter(~done)
        if level == DEPTH or large.isEmpty():
            break
        rows = large.select("tree", "node", "sid", "size").join(sigs.select("sid", "sig"), "sid")
    found = materialize(out, "leaves")
    discard(*spent)
    return found


def _units(found: DataFrame) -> DataFrame:
    """(unit, sid): the blocks of the nodes, each with the node's hub."""
    rows = found.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = rows.select(F.xxhash64("node", F.pmod(F.xxhash64("sid", "node"), F.col("blocks")).cast("int")).alias("unit"), "sid")
    hubs = rows.filter("blocks > 1 and sid = hub").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.unionByName(hubs.select(F.xxhash64("node", "block").alias("unit"), "sid"))


def _meetings(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows (key, part, sid, ...) plus unit, once for each unit: members of different parts of a key meet in a unit.

    A key of at most `block` rows is one unit. Of larger ones the largest part
    is told apart: its blocks meet those of the other parts, which also meet
    each other. Keys with one part have no unit.
    """
    parts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy(key).agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n")).filter("n > top.n")
    ceil = lambda n: F.ceil(n / block).cast("int")
    small = F.col("n") <= block
    sizes = sizes.select(key, F.col("top.part").alias("main"), F.when(small, 0).otherwise(ceil(F.col("top.n"))).alias("mains"), F.when(small, 1).otherwise(ceil(F.col("n") - F.col("top.n"))).alias("others"))
    got = rows.join(sizes, key)
    place = F.xxhash64("sid", F.lit("block"))
    is_main = (F.col("part") == F.col("main")) & (F.col("mains") > 0)
    got = got.withColumn("__own", F.when(is_main, F.pmod(place, F.col("mains"))).otherwise(F.col("mains") + F.pmod(place, F.col("others"))).cast("int"))
    got = got.withColumn("__met", F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    return got.withColumn("unit", F.xxhash64(key, F.least("__own", "__met"), F.greatest("__own", "__met"))).drop("main", "mains", "others", "__own", "__met")


def agreement(m: np.ndarray) -> np.ndarray:
    """Equal coordinates of every pair of signatures."""
    out = np.zeros((len(m), len(m)), np.uint8)
    for k in range(m.shape[1]):
        out += m[:, k, None] == m[None, :, k]
    return out


def forest(m: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with CUT equal coordinates or more: the first row with all close to it, then the most similar pairs first."""
    same = agreement(m)
    root, edges = list(range(len(m))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    close = np.flatnonzero(same[0, 1:] >= HUB) + 1
    for k in close.tolist():
        root[k] = 0
        edges.append((0, k))
    near = same >= CUT
    joined = np.append(0, close)
    near[joined[:, None], joined[None, :]] = False
    i, j = np.nonzero(np.triu(near, 1))
    for e in np.argsort(-same[i, j].astype(np.int16), kind="stable"):
        a, b = find(i[e]), find(j[e])
        if a != b:
            root[a] = b
            edges.append((int(i[e]), int(j[e])))
            if len(edges) == len(m) - 1:
                break
    return edges


def neighbours(m: np.ndarray, part: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the parts that hold a pair with CUT equal coordinates or more, as pairs of members."""
    names = {p: k for k, p in enumerate(dict.fromkeys(part))}
    code = np.array(list(map(names.__getitem__, part)))
    i, j = np.nonzero(np.triu(agreement(m) >= CUT, 1) & (code[:, None] != code[None, :]))
    pairs, first = np.unique(np.minimum(code[i], code[j]) * len(names) + np.maximum(code[i], code[j]), return_index=True)
    root, out = list(range(len(names))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for pair, k in zip(pairs.tolist(), first.tolist(), strict=True):
        a, b = find(pair // len(names)), find(pair % len(names))
        if a != b:
            root[a] = b
            out.append((int(i[k]), int(j[k])))
    return out


def _propose(units: DataFrame, crossing: bool) -> DataFrame:
    """Pairs (a, b), a < b, from units (unit, sid, sig[, part]), run by run of the sorted partitions: of sets, or of parts if crossing."""
    def run(batches):
        held = None

        def pairs(t: pa.Table):
            m = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            name = t.column("part" if crossing else "sid").to_pylist()
            got = neighbours(m, name) if crossing else forest(m)
            return [(min(name[i], name[j]), max(name[i], name[j])) for i, j in got]

        def flush(t: pa.Table):
            unit = t.column("unit").to_numpy()
            cuts = np.flatnonzero(np.diff(unit)) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(unit)], strict=True):
                if hi - lo > 1:
                    out += pairs(t.slice(lo, hi - lo))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            unit = held.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            if last:
                yield flush(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield flush(held)

    cols = ["unit", "sid", "sig", *(["part"] if crossing else [])]
    return units.select(*cols).repartition(shuffle_width(units.sparkSession), "unit").sortWithinPartitions("unit", "sid").mapInArrow(run, "a binary, b binary").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets (sid, s) reach the threshold."""
    left = sets.select(F.col("sid").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= THRESHOLD * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, s) of the wanted sets, from one document (doc_id) of each."""
    def compute(batches):
        import xxhash

        hashes = WordHashes()
        for batch in _slices(batches):
            sets = list(shingle_sets(batch.column("text").to_pylist(), hashes))
            out = [(xxhash.xxh3_128_digest(s.tobytes()), s.view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["sid", "s"])

    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return texts.mapInArrow(compute, "sid binary, s array<long>").join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _between(members: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between parts of a family, from its members (family, part, sid, s).

    A task counts the common shingles of all pairs of a unit by one product of
    incidence matrices, and returns a link for each pair of parts that one
    holds together, never the pairs.
    """
    rows = _meetings(members, "family", BLOCK // 2)

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, sid, part = [np.asarray(x, np.int64) for x in pdf["s"]], pdf["sid"].tolist(), pdf["part"].tolist()
        size = np.array([len(x) for x in sets])
        token, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, len(token), 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], column[a:b] - lo] = 1
            common += m @ m.T
        n = common.astype(np.int64)
        code = np.unique(np.array([p.hex() for p in part]), return_inverse=True)[1]
        near = (100 * n >= THRESHOLD * (size[:, None] + size[None, :] - n)) & (code[:, None] != code[None, :])
        i, j = np.nonzero(np.triu(near, 1))
        _, k = np.unique(np.minimum(code[i], code[j]) * len(sets) + np.maximum(code[i], code[j]), return_index=True)
        return pd.DataFrame({"a": [min(sid[i[x]], sid[j[x]]) for x in k], "b": [max(sid[i[x]], sid[j[x]]) for x in k]})

    return rows.select("unit", "part", "sid", "s").groupBy("unit").applyInPandas(confirm, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    texts = pick(docs, "doc_id", "text")
    rows = materialize(_sets(texts), "sets")
    live = rows.filter("sid is not null and doc_id is not null")
    sigs = materialize(live.groupBy("sid").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id")), "signatures")
    bare = sigs.select("sid", "sig")
    found = leaves(sigs)
    tried = materialize(_propose(_units(found).join(bare, "sid"), False), "proposed")
    ends = tried.select(F.col("a").alias("sid")).union(tried.select(F.col("b").alias("sid"))).distinct()
    sets = materialize(_full_sets(texts, sigs.select("sid", "doc_id").join(ends, "sid")), "full")
    links = materialize(_confirmed(tried, sets), "confirmed")
    parts = _parts(links)
    # a node that is one block has shown all its candidates; of larger ones every set is looked at again
    known = ends.join(parts, "sid", "left").select("sid", F.coalesce("part", "sid").alias("part"))
    placed = found.join(known, "sid", "left").filter(f"part is not null or size > {BLOCK}").select("node", "sid", F.coalesce("part", "sid").alias("part"))
    again = _meetings(materialize(placed, "placed"), "node", BLOCK)
    families = components(_propose(again.join(bare, "sid"), True)).select(F.col("id").alias("part"), F.col("component_id").alias("family"))
    members = sigs.select("sid", "doc_id").join(parts, "sid", "left").select("sid", "doc_id", F.coalesce("part", "sid").alias("part")).join(families, "part")
    members = materialize(members, "members")
    late = members.join(sets.select("sid"), "sid", "left_anti").select("sid", "doc_id")
    if not late.isEmpty():
        sets = sets.unionByName(materialize(_full_sets(texts, late), "late"))
    more = materialize(_between(members.drop("doc_id").join(sets, "sid")), "between")
    discard(found, tried)
    if not more.isEmpty():
        parts = _parts(links.union(more))
    placed = sigs.select("sid", "doc_id").join(parts, "sid", "left").select("sid", "doc_id", F.coalesce("part", "sid").alias("part"))
    smallest = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(smallest, "part").select("sid", "component_id")
    out = live.select("doc_id", "n_shingles", "sid").join(named, "sid").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("sid is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _parts(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("id").alias("sid"), F.col("component_id").alias("part"))


def keep_one(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One document of each group: the rows whose doc_id names their component; a repeated id is judged as one."""
    rows = pick(docs, *columns)
    verdict = near_duplicates(rows).groupBy("doc_id").agg(F.min("kept").alias("__kept"))
    named = rows.filter("doc_id is not null").join(verdict.filter("__kept and doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    return named.unionByName(rows.filter("doc_id is null")).select(*columns)


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
