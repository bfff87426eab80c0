"""Hard negatives by Four-Russians scoring.

Components become integers. A row is stored as bit planes in two's complement:
bit p of eight neighbouring components is a byte. For every anchor and group of
eight components a table holds the sums of all 256 subsets of the anchor's
components. The inner product of an anchor and a row is then one lookup for
every group and plane, added over the groups and shifted by the plane, the top
plane being negative: a full exact score without a product.

Scores are computed twice over disjoint pairs. First rows of an anchor's own
label, which give its positives; then rows of other labels, of which each
positive keeps the best inside its window. A unit of work is a block of
`ANCHORS` anchors with a block of `ROWS` rows; labels and dimensions are split
into as many blocks as their sizes ask for, so that a task's memory does not
depend on the table. A unit returns the best few of each anchor only, and
`row_number` under a limit cuts them again before they are shuffled.

The anchors are a set of queries, which all rows are held against: the work
grows with anchors times rows.

Higher scores come first, ties by smaller vec_id (null last). Rows whose label
or vector is null, or hold a null or non-finite component, take no part; nor do
those whose integers have a squared length of 2^62 or more, as their scores need
not fit a long. Vectors of different dimension do not meet. Rows of one id are
rows of their own: each is an anchor, and none is its own positive. An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, pick, shuffle_width, table

SCALE = 256
ANCHORS = 1024
ROWS = 16384
#: Rows scored at once.
STRIP = 1024
LONGEST = 1 << 62
PACKED = "row long, vec_id long, label long, anchor boolean, dim int, planes binary"


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(rows, planes, groups) bytes of integer rows in two's complement, eight components a group."""
    n = max(1, int(np.abs(x).max(initial=0)).bit_length()) + 1
    bits = (x[:, None, :] >> np.arange(n)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def integers(planes: np.ndarray, dim: int) -> np.ndarray:
    """The integer rows of bit planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little")[:, :, :dim].astype(np.int64)
    weight = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weight[-1] *= -1
    return np.einsum("rpd,p->rd", bits, weight)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sums of each subset of eight components, built by doubling."""
    n, dim = anchors.shape
    groups = -(-dim // 8)
    padded = np.zeros((n, groups * 8), anchors.dtype)
    padded[:, :dim] = anchors
    out = np.zeros((groups, 256, n), anchors.dtype)
    for g in range(groups):
        for k in range(8):
            out[g, 1 << k : 2 << k] = out[g, : 1 << k] + padded[:, g * 8 + k]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products by lookups, from the top plane down."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    looked = np.empty_like(total)
    for p in range(planes.shape[1] - 1, -1, -1):
        total += total
        for g in range(planes.shape[2]):
            np.take(tables[g], planes[:, p, g], axis=0, out=looked, mode="clip")
            if p == planes.shape[1] - 1:
                total -= looked
            else:
                total += looked
    return total


def unpack(data: list[bytes], dim: int) -> np.ndarray:
    """Planes of many rows; the sign plane of rows with fewer is repeated."""
    groups = -(-dim // 8)
    if not groups:
        return np.zeros((len(data), 1, 0), np.uint8)
    length = np.array([len(x) for x in data]) // groups
    out = np.empty((len(data), int(length.max(initial=1)), groups), np.uint8)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        own = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), n, groups)
        out[at, :n] = own
        out[at, n:] = own[:, -1:]
    return out


def pack(rows: DataFrame, anchor: Column) -> DataFrame:
    """The rows that take part as PACKED, stored; anchor marks the anchors."""
    plain = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    plain = plain.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    scaled = plain.withColumn("embedding", F.transform("embedding", lambda x: x * SCALE)).filter(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) < float(LONGEST) * 0.999)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            size = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            start = np.concatenate(([0], np.cumsum(size)))[:-1]
            planes: list[bytes] = [b""] * len(size)
            for dim in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dim)
                for i, p in zip(at, bit_planes(flat[start[at][:, None] + np.arange(dim)])):
                    planes[i] = p.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(size, pa.int32()), pa.array(planes, pa.binary())], names=["vec_id", "label", "anchor", "dim", "planes"])

    out = scaled.mapInArrow(packed, PACKED.partition(", ")[2])
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "planes")


def _units(anchors: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors and rows of equal keys dealt into blocks, every block of the one beside every block of the other."""
    n = F.count(F.lit(1))
    # small tables get more blocks of rows than they need, so that all cores have work
    width = shuffle_width(rows.sparkSession)
    least = F.least(F.ceil(n / STRIP), F.lit(width))
    sizes = anchors.groupBy(*keys).agg(F.ceil(n / ANCHORS).cast("int").alias("anchor_blocks"))
    sizes = sizes.join(rows.groupBy(*keys).agg(F.greatest(F.ceil(n / ROWS), least).cast("int").alias("row_blocks")), keys)
    a = anchors.join(sizes, keys).withColumn("ab", F.pmod(F.xxhash64("row"), "anchor_blocks").cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    r = rows.join(sizes, keys).withColumn("rb", F.pmod(F.xxhash64("row"), "row_blocks").cast("int")).withColumn("ab", F.explode(F.sequence(F.lit(0), F.col("anchor_blocks") - 1)))
    both = a.withColumn("asks", F.lit(True)).unionByName(r.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    # units are few bytes and much work, so their number of partitions is given
    return both.drop("anchor_blocks", "row_blocks").repartition(width, *keys, "ab", "rb")


def _scored(asked: pa.Table, rows: pa.Table, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of a strip of rows, their scores with all anchors)."""
    anchors = integers(unpack(asked.column("planes").to_pylist(), dim), dim)
    planes = unpack(rows.column("planes").to_pylist(), dim)
    wide = dim * int(np.abs(anchors).max(initial=0)) << planes.shape[1] >= 1 << 31
    tables = subset_sums(anchors.astype(np.int64 if wide else np.int32))
    for s in range(0, len(planes), STRIP):
        at = np.arange(s, min(s + STRIP, len(planes)))
        yield at, scores(tables, planes[at])


def _first(anchor: np.ndarray, score: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first of every anchor by higher score, then smaller order."""
    by = np.lexsort((order, -score.astype(np.int64), anchor))
    start = np.concatenate(([0], np.flatnonzero(np.diff(anchor[by])) + 1)) if len(by) else np.zeros(0, int)
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return by[rank < n]


def _order(ids: np.ndarray) -> np.ndarray:
    """Ids as places in ascending order, equal ones equal, nulls last."""
    known = np.array([x is not None for x in ids], bool)
    out = np.full(len(ids), len(ids), np.int64)
    out[known] = np.unique(ids[known].astype(np.int64), return_inverse=True)[1]
    return out


def positives(packed: DataFrame, n: int = 5) -> DataFrame:
    """row of the anchor, rank, positive_id, positive_score: the first n other rows of its label."""
    schema = "anchor long, positive_id long, positive_score long"

    def best(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        asked, rows = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        own, other = asked.column("row").to_numpy(), rows.column("row").to_numpy()
        ids = rows.column("vec_id").to_numpy(zero_copy_only=False) if rows.column("vec_id").null_count == 0 else np.array(rows.column("vec_id").to_pylist(), object)
        order = _order(ids)
        kept: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int),) * 3]
        for at, score in _scored(asked, rows, t.column("dim")[0].as_py()) if len(own) and len(other) else ():
            another = other[at][:, None] != own[None, :]
            least = np.partition(np.where(another, score, np.iinfo(score.dtype).min), -n, axis=0)[-n] if len(at) > n else np.iinfo(score.dtype).min
            i, j = np.nonzero(another & (score >= least))
            a, s, r = j, score[i, j], at[i]
            a, s, r = (np.concatenate(x) for x in zip(kept[-1], (a, s, r)))
            first = _first(a, s, order[r], n)
            kept = [(a[first], s[first], r[first])]
        a, s, r = kept[-1]
        return pa.table({"anchor": pa.array(own[a] if len(a) else [], pa.int64()), "positive_id": rows.column("vec_id").take(pa.array(r, pa.int64())), "positive_score": pa.array(s, pa.int64())})

    units = _units(packed.filter("anchor"), packed, ["dim", "label"]).select("dim", "label", "ab", "rb", "row", "vec_id", "planes", "asks")
    found = units.groupBy("dim", "label", "ab", "rb").applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id")))
    return found.withColumn("k", rank).filter(F.col("k") <= n)


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor is a condition on vec_id and label. For each anchor and positive the
    n_negatives best rows of other labels with a score from low to high percent
    of the positive's.
    """
    packed = pack(pick(rows, "vec_id", "embedding", "label"), anchor)
    near = positives(packed, n_positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("near"))
    asked = materialize(packed.filter("anchor").join(near.withColumnRenamed("anchor", "row"), "row"), "anchors")
    schema = "anchor long, k int, negative_id long, negative_score long"

    def best(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        asked, rows = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        own = asked.column("row").to_numpy()
        ids = rows.column("vec_id").to_numpy(zero_copy_only=False) if rows.column("vec_id").null_count == 0 else np.array(rows.column("vec_id").to_pylist(), object)
        order, label, theirs = _order(ids), asked.column("label").to_numpy(), rows.column("label").to_numpy()
        # windows as whole scores; a positive that an anchor lacks has an empty one
        lo, hi = np.full((n_positives, len(own)), 1, np.int64), np.zeros((n_positives, len(own)), np.int64)
        for i, near in enumerate(asked.column("near").to_pylist()):
            for x in near:
                lo[x["k"] - 1, i] = -(-low * x["positive_score"] // 100)
                hi[x["k"] - 1, i] = high * x["positive_score"] // 100
        open_ = lo <= hi
        least = np.where(open_, lo, np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
        most = np.where(open_, hi, np.iinfo(np.int64).min).max(axis=0, initial=np.iinfo(np.int64).min)
        kept = [(np.zeros(0, np.int64),) * 3 for _ in range(n_positives)]
        for at, score in _scored(asked, rows, t.column("dim")[0].as_py()) if len(own) and len(ids) else ():
            i, j = np.nonzero((score >= least) & (score <= most) & (theirs[at][:, None] != label[None, :]))
            s = score[i, j].astype(np.int64)
            for k in range(n_positives):
                fits = (s >= lo[k][j]) & (s <= hi[k][j])
                a, v, r = (np.concatenate(x) for x in zip(kept[k], (j[fits], s[fits], at[i[fits]])))
                first = _first(a, v, order[r], n_negatives)
                kept[k] = (a[first], v[first], r[first])
        a, s, r = (np.concatenate(x) for x in zip(*kept))
        k = np.repeat(np.arange(1, n_positives + 1), [len(x[0]) for x in kept])
        return pa.table({"anchor": pa.array(own[a] if len(a) else [], pa.int64()), "k": pa.array(k, pa.int32()), "negative_id": rows.column("vec_id").take(pa.array(r, pa.int64())), "negative_score": pa.array(s, pa.int64())})

    units = _units(asked, packed.withColumn("near", F.lit(None).cast(asked.schema["near"].dataType)), ["dim"]).select("dim", "ab", "rb", "row", "vec_id", "label", "planes", "near", "asks")
    found = units.groupBy("dim", "ab", "rb").applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("anchor", "k").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= n_negatives)
    named = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.explode("near").alias("p")).select("anchor", "anchor_id", F.col("p.k").alias("k"), F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score"))
    return found.join(named, ["anchor", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = """
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
w as (select r, vec_id, label, list_transform(e, lambda x: cast(floor(256 * x) as bigint)) as e from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.r as a, a.vec_id as anchor_id, a.label = b.label as same, b.r as b, b.vec_id as other, cast(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) as bigint) as score from w a join w b on a.vec_id % 100 = 0 and a.r <> b.r and len(a.e) = len(b.e)),
p as (select a, anchor_id, other as positive_id, score as positive_score, row_number() over (partition by a order by score desc, other) as k from s where same qualify k <= 5),
n as (select p.a, p.k, p.anchor_id, positive_id, positive_score, other as negative_id, score as negative_score, row_number() over (partition by p.a, p.k order by score desc, other) as rank from p join s on p.a = s.a and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
