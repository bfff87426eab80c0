"""Sampled subword segmentations without replacement, and decoding.

A text's lattice has a state per character boundary and an edge per vocabulary
piece; characters that no piece covers become their bytes, one edge each. Where
two neighbouring characters occur together in no piece, every segmentation has
a boundary; between such places lie runs, and equal runs of the texts at hand
share one lattice. Edges carry log weights;
summed from the end they give each edge's conditional probability, so a
segmentation's log probability is exact.

Sampling is a perturbed A-star search, top down. A subtree of segmentations (a
prefix and the edges not to be taken next) has a Gumbel variable located at
its log mass and truncated at its parent's. The queue pops the subtree with
the largest; its best leaf is a path drawn by the conditional probabilities,
and the rest of the subtree splits at every step of that path into the
subtrees that leave it there. Popping k times yields k distinct segmentations,
the Gumbel top-k without replacement; the next value in the queue is the
threshold kappa, and log(1 - exp(-exp(log_prob - kappa))) is the log of a
segmentation's inclusion probability given kappa. Random numbers are hashes of
(row key, sample, position), so a row's samples do not depend on partitions.

BPE models score a piece by its rank; their log weight is -log(2 + rank).
Scores of unigram models are log weights as they are.

Nulls: a null or empty text has one segmentation, the empty one. A null key
seeds like an empty one. Texts with fewer than k segmentations give as many as
they have. Repeated rows give equal samples. An empty table gives an empty
result. Very long texts are sampled whole; memory is bounded by GROUP or one
text. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table
from .minhash_dedup import mix

SAMPLES = 3
#: Characters of text that are sampled together.
GROUP = 1 << 21
#: Steps of a path that are looked at together.
STEPS = 512
MARK = "▁"
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model by the hashes of their beginnings, and their weights."""

    def __init__(self, path: str, bpe: bool = True):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.weight, self.bytes_of = np.zeros(n), [b""] * n
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        whole, heads, pairs = {}, set(), set()
        for i in range(n):
            piece, score = sp.id_to_piece(i), sp.get_score(i)
            self.weight[i] = -math.log(2 - score) if bpe else score
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
                self.weight[i] = -math.log(2 + n) if bpe else score
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                points = list(map(ord, piece))
                whole[self._hash(points)] = i
                heads.update(self._hash(points[:k]) for k in range(1, len(points) + 1))
                pairs.update(a << 21 | b for a, b in zip(points, points[1:]))
        self.size_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.begin_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.heads = np.array(sorted(heads), np.uint64)
        self.piece_of = np.array([whole.get(h, -1) for h in self.heads.tolist()], np.int64)
        self.pairs = np.array(sorted(pairs), np.int64)

    @staticmethod
    def _hash(points: list[int]) -> int:
        h = 0
        for c in points:
            h = (h * BASE + c + 1) & (1 << 64) - 1
        return h

    def in_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 21 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return self.pairs[at] == key

    def matches(self, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that begin at each of the points and fit in the room: (position, length, piece)."""
        live, h, out, k = np.arange(len(points)), np.zeros(len(points), np.uint64), [], 0
        while len(live):
            h = h * np.uint64(BASE) + points[live + k].astype(np.uint64) + np.uint64(1)
            k += 1
            at = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
            hit = self.heads[at] == h
            live, h, at = live[hit], h[hit], at[hit]
            piece = self.piece_of[at]
            out.append((live[piece >= 0], np.full(int((piece >= 0).sum()), k), piece[piece >= 0]))
            more = room[live] > k
            live, h = live[more], h[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        size = self.size_of[ids]
        return self.all_bytes[np.repeat(self.begin_of[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()

    def decode(self, ids) -> str:
        """The text of ids: their bytes without the space that encoding puts in front."""
        raw = self.raw(np.asarray(ids, np.int64))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of this worker process, kept from task to task."""
    import sys
    import types

    kept = sys.modules.setdefault("plenum_worker_state", types.ModuleType("plenum_worker_state")).__dict__
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) from hashes of the parts (arrays or scalars, uint64)."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p, np.uint64) + np.uint64(1))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class Group:
    """The lattices of some texts, each a chain of the lattices of its runs.

    A run is a stretch of characters every two neighbours of which occur in
    some piece together; no piece reaches over its ends. Equal runs share one
    lattice. States are the character boundaries of the distinct runs.
    """

    def __init__(self, voc: Vocabulary, texts: list[str], seeds: np.ndarray):
        points = np.frombuffer("".join(MARK + t if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        points[points == 32] = ord(MARK)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        doc_end = np.cumsum(sizes)
        new = np.ones(len(points), bool)
        new[1:] = ~voc.in_pairs(points[:-1], points[1:])
        new[(doc_end - sizes)[sizes > 0]] = True
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(points)))
        # a hash of each run, from prefix sums
        power = np.cumprod(np.full(len(points) + 1, BASE, np.uint64))
        back = np.cumprod(np.full(len(points) + 1, INVERSE, np.uint64))
        total = np.append(np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1]))
        name = mix((total[at + length] - total[at]) * back[at] + length.astype(np.uint64))
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        self._lattices(voc, points, at[first], length[first])
        run_end = np.cumsum(length[first]) + np.arange(len(first))
        run_start = run_end - length[first]
        cuts = np.searchsorted(at, doc_end[:-1]) if len(texts) else []
        self.start = np.split(run_start[which], cuts)
        self.end = np.split(run_end[which], cuts)
        self.seeds = seeds

    def _lattices(self, voc: Vocabulary, points: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        n = int(length.sum())
        begin = np.cumsum(length) - length
        run = np.repeat(np.arange(len(at)), length)
        inside = np.arange(n) - begin[run]
        chars = points[at[run] + inside] if n else points[:0]
        room = length[run] - inside
        pos, size, piece = voc.matches(chars, room)
        state = np.arange(n) + run  # each run has an end state besides
        source, target, weight, follow = state[pos], state[pos] + size, voc.weight[piece], state[pos] + size
        # characters without a piece of their own: their bytes, through states of their own
        single = np.zeros(n, bool)
        single[pos[size == 1]] = True
        states = n + len(at)
        rare, chain = [], []
        for i in np.flatnonzero(~single).tolist():
            ids = voc.byte_ids[list(chr(chars[i]).encode("utf-8", "replace"))].tolist()
            w, here = float(voc.weight[ids].sum()), int(state[i])
            rare.append((here, here + 1, ids[0], w, states if len(ids) > 1 else here + 1))
            for k, p in enumerate(ids[1:], 1):
                chain.append((states, p, states + 1 if k < len(ids) - 1 else here + 1))
                states += 1
        if rare:
            r = list(zip(*rare, strict=True))
            source, target, piece, weight, follow = (np.append(a, np.array(b)) for a, b in zip((source, target, piece, weight, follow), r, strict=True))
        # log sums from the end of the runs, all states at the same distance from it together
        beta = np.zeros(n + len(at))
        far = np.zeros(n + len(at), np.int64)
        far[state] = room
        order = np.argsort(far[source] << 32 | source << 4 | np.minimum(target - source, 15), kind="stable")
        source, target, piece, weight, follow = (x[order] for x in (source, target, piece, weight, follow))
        logp = np.empty(len(source))
        heads = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, np.int64)
        tails = np.append(heads[1:], len(source))
        level = far[source[heads]]
        bounds = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else np.zeros(1, np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = heads[lo], tails[hi - 1]
            v = weight[a:b] + beta[target[a:b]]
            local = heads[lo:hi] - a
            many = np.diff(np.append(local, b - a))
            top = np.maximum.reduceat(v, local)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), local))
            beta[source[heads[lo:hi]]] = total
            logp[a:b] = v - np.repeat(total, many)
        if chain:
            c = list(zip(*chain, strict=True))
            source, piece, follow, logp = np.append(source, c[0]), np.append(piece, c[1]), np.append(follow, c[2]), np.append(logp, np.zeros(len(chain)))
        # the likeliest edge of a state first, to 20 bits
        order = np.argsort(source << 32 | np.minimum(-logp * (1 << 20), (1 << 32) - 1).astype(np.int64), kind="stable")
        source, self.piece, self.following, self.logp = source[order], piece[order], follow[order], logp[order]
        self.p = np.exp(self.logp)
        self.first = np.append(0, np.cumsum(np.bincount(source, minlength=states)))
        cum = np.append(0.0, np.cumsum(self.p))
        self.upto = cum[1:] - cum[self.first[source]]
        self.upto[self.first[1:][np.diff(self.first) > 0] - 1] = 1.0
        self.owner = source

    def edge(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each state that the number u in (0, 1) falls to."""
        e = self.first[state]
        on = np.flatnonzero(u >= self.upto[e])
        while len(on):
            e[on] += 1
            on = on[u[on] >= self.upto[e[on]]]
        return e

    def complete(self, jobs: list[tuple[int, int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Paths for jobs (text, sample, run, state): from the state in the run to the text's end; edges and their runs."""
        state = np.concatenate([np.append(s, self.start[t][w + 1 :]) if s >= 0 else self.start[t][w:] for t, _, w, s in jobs])
        end = np.concatenate([self.end[t][w:] for t, _, w, _ in jobs])
        number = np.concatenate([np.arange(w, len(self.start[t])) for t, _, w, _ in jobs])
        sizes = np.array([len(self.start[t]) - w for t, _, w, _ in jobs])
        own = np.repeat(mix(self.seeds[[t for t, *_ in jobs]] * np.uint64(4) + np.array([s for _, s, *_ in jobs], np.uint64)), sizes)
        own = mix(own ^ (number.astype(np.uint64) * np.uint64(BASE)))
        live = np.flatnonzero(state != end)
        here, goal, seed = state[live], end[live], own[live]
        rounds, steps = [], np.zeros(len(state), np.int64)
        while len(live):
            e = self.edge(here, ((mix(seed + np.uint64(len(rounds))) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52))
            rounds.append((live, e))
            steps[live] += 1
            here = self.following[e]
            go = here != goal
            live, here, goal, seed = live[go], here[go], goal[go], seed[go]
        place = np.cumsum(steps) - steps
        edge = np.empty(int(steps.sum()), np.int64)
        for k, (slot, e) in enumerate(rounds):
            edge[place[slot] + k] = e
        cuts = np.append(place, len(edge))[np.cumsum(sizes)[:-1]]
        return list(zip(np.split(edge, cuts), np.split(np.repeat(number, steps), cuts), strict=True))

    def children(self, jobs: list[tuple[int, int, np.ndarray, int, tuple[int, ...], float]], keep: int) -> list[list[tuple[float, int, tuple[int, ...]]]]:
        """For each job (text, sample, path, begin, banned, value) the `keep` best subtrees that leave the path at step begin or later: (value, step, edges not to take).

        A subtree's value is at most its log mass plus 37, the largest Gumbel
        that a number of 52 bits gives, and at least that less 4. Log masses
        fall along the path, so steps 45 below the keep-th mass cannot be among
        the best and need not be looked at: all paths are looked at STEPS steps
        deep, and those that need it deeper again.
        """
        out: list = [None] * len(jobs)
        todo, size = list(range(len(jobs))), STEPS
        while todo:
            parts = [jobs[i][2][jobs[i][3] : jobs[i][3] + size] for i in todo]
            many = np.array([len(p) for p in parts])
            part = np.concatenate(parts)
            first = np.cumsum(many) - many
            row = np.repeat(np.arange(len(todo)), many)
            step = np.arange(len(part)) - first[row]
            run = np.cumsum(self.logp[part])
            prefix = np.array([jobs[i][5] for i in todo])
            before = np.append(0.0, run)[first]
            upto = run - before[row]
            gone, owner = self.p[part], self.owner[part]
            ways = self.first[owner + 1] - self.first[owner]
            for r, i in enumerate(todo):
                banned = jobs[i][4]
                if banned and many[r]:
                    gone[first[r]] += self.p[list(banned)].sum()
                    ways[first[r]] -= len(banned)
            heads = np.array([float(self.logp[jobs[i][2][: jobs[i][3]]].sum()) if jobs[i][3] else 0.0 for i in todo])
            upto += heads[row]
            at = np.flatnonzero(ways > 1)  # a single way on leaves nothing, whatever the rounding
            mass = upto[at] - self.logp[part[at]] + np.log(np.maximum(1.0 - gone[at], 1e-300))
            owner_row = row[at]
            begins = np.array([jobs[i][3] for i in todo])
            seeds = self.seeds[np.array([jobs[i][0] for i in todo])]
            samples = np.array([jobs[i][1] for i in todo], np.uint64)
            u = uniform(seeds[owner_row], samples[owner_row], (step[at] + begins[owner_row]).astype(np.uint64), np.uint64(7))
            # Gumbel at mass, truncated at value; log-sum in a form that does not overflow
            g = mass - np.logaddexp(mass - prefix[owner_row], np.log(-np.log(u)))
            cuts = np.searchsorted(owner_row, np.arange(len(todo) + 1))
            # the keep-th largest of the first masses is at most that of all
            head = keep + 24
            enough = np.diff(cuts) >= head
            low = np.full(len(todo), -np.inf)
            low[enough] = np.partition(mass[cuts[:-1][enough][:, None] + np.arange(head)], head - keep, axis=1)[:, head - keep]
            last = np.append(upto, 0.0)[np.maximum(first + many - 1, 0)]
            more = (many == size) & (begins + size < np.array([len(jobs[i][2]) for i in todo])) & ~(enough & (last < low - 45))
            ranked, h, full = np.full((len(todo), keep), -1), g.copy(), np.diff(cuts) > 0
            for j in range(keep if full.any() else 0):
                top = np.full(len(todo), -np.inf)
                top[full] = np.maximum.reduceat(h, cuts[:-1][full])
                hit = np.flatnonzero((h == top[owner_row]) & (h > -np.inf))
                of, where = np.unique(owner_row[hit], return_index=True)
                ranked[of, j] = hit[where]
                h[hit[where]] = -np.inf
            deeper = [i for i, m in zip(todo, more.tolist(), strict=True) if m]
            for r, i in enumerate(todo):
                if not more[r]:
                    best = ranked[r][ranked[r] >= 0]
                    out[i] = [(v, n + jobs[i][3], (*(jobs[i][4] if n == 0 else ()), e)) for v, n, e in zip(g[best].tolist(), step[at[best]].tolist(), part[at[best]].tolist(), strict=True)]
            todo, size = deeper, size * 4
        return out

    def sample(self, k: int):
        """For each text a list of (edges, log probability, perturbed value) in falling order, and kappa."""
        n = len(self.start)
        queues, found, runs_of, kappa = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)], [-math.inf] * n
        root = -np.log(-np.log(uniform(self.seeds, np.uint64(11))))
        jobs = [(t, 0, 0, -1) for t in range(n)]
        state = {t: (float(root[t]), 0, (), np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in range(n)}
        for number in range(k + 1):
            if number == k:
                for t, *_ in jobs:
                    kappa[t] = state[t][0]
                break
            paths = self.complete(jobs) if jobs else []
            nxt, opened = [], []
            for (t, _, _, _), (tail, tail_words) in zip(jobs, paths, strict=True):
                value, begin, banned, head, head_words = state[t]
                edge, word = (np.append(head, tail), np.append(head_words, tail_words)) if len(head) else (tail, tail_words)
                found[t].append((edge, float(self.logp[edge].sum()), value))
                runs_of[t].append(word)
                opened.append((t, number, edge, begin, banned, value))
            popped = []
            for (t, *_), subtrees in zip(opened, self.children(opened, k - number) if opened else [], strict=True):
                for g, step, ban in subtrees:
                    heapq.heappush(queues[t], (-g, len(found[t]), step, ban))
                if queues[t]:
                    popped.append((t, *heapq.heappop(queues[t])))
            us = uniform(self.seeds[[x[0] for x in popped]], np.uint64(number), np.array([x[3] for x in popped], np.uint64), np.uint64(13)).tolist() if popped else []
            for (t, g, origin, step, ban), u in zip(popped, us, strict=True):
                src_edge, src_word = found[t][origin - 1][0], runs_of[t][origin - 1]
                s = int(self.owner[src_edge[step]])
                options = np.array([e for e in range(self.first[s], self.first[s + 1]) if e not in ban])
                weights = np.cumsum(self.p[options])
                e = int(options[min(np.searchsorted(weights, u * weights[-1], side="right"), len(options) - 1)])
                w = int(src_word[step])
                state[t] = (-g, step, ban, np.append(src_edge[:step], e), src_word[: step + 1])
                nxt.append((t, number + 1, w, int(self.following[e])))
            jobs = nxt
        return found, kappa


RESULT = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document and sampled segmentation, in falling order of the perturbed value; with_ids adds the ids."""
    path = path or model_path()

    def rows_of(voc: Vocabulary, ids: list, texts: list[str]):
        seeds = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.uint64)
        group = Group(voc, texts, seeds)
        found, kappa = group.sample(k)
        for t, (doc, text) in enumerate(zip(ids, texts, strict=True)):
            for j, (edge, logp, value) in enumerate(found[t]):
                pieces = group.piece[edge]
                x = logp - kappa[t]
                inclusion = 0.0 if kappa[t] == -math.inf else (x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0)))))
                row = (doc, j, len(pieces), zlib.crc32(pieces.astype("<u4").tobytes()), round(logp, 6), round(value, 6), round(inclusion, 6), voc.decode(pieces) == text)
                yield row + (pieces,) if with_ids else row

    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def work(batches):
        voc = vocabulary(path)

        def made(ids: list, texts: list[str]):
            rows = list(rows_of(voc, ids, texts))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                if texts and held + len(text) > GROUP:
                    yield made(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(text)
                held += len(text)
        if texts:
            yield made(ids, texts)

    return pick(docs, "doc_id", "text").mapInArrow(work, RESULT + (", ids array<int>" if with_ids else ""))


def decode_ids(rows: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """rows with the text of the ids column; null ids give null."""
    path = path or model_path()

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        voc = vocabulary(path)
        return column.map(lambda x: None if x is None else voc.decode(list(x)))

    return rows.withColumn(into, decode(ids))


def op6_piece_sampling(spark, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"))
