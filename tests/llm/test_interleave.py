"""The merge of Burrows-Wheeler transforms against all strings compared, and what depends on the transforms."""

import numpy as np
import pytest

from plenum.llm import suffix_dedup as sd


def passages(seed: int, letters: int = 2, first: int = 97):
    """Slices of one text, half of them with a byte changed: text, lengths, smallest ids, shards."""
    rng = np.random.default_rng(seed)
    base = (rng.integers(0, letters, 300) + first).astype(np.uint8)
    slices = []
    for _ in range(int(rng.integers(1, 60))):
        n = int(rng.integers(sd.LENGTH, 100))
        at = int(rng.integers(0, 300 - n))
        slices.append(base[at : at + n].copy())
        if rng.random() < 0.5:
            slices[-1][rng.integers(0, n)] ^= 1
    length = np.array([len(x) for x in slices])
    return np.concatenate(slices), length, rng.integers(0, 1000, len(slices)), np.sort(rng.integers(0, sd.SHARDS, len(slices)))


def strings(text, length):
    start = np.cumsum(length) - length
    return [bytes(text[s + i : s + i + sd.LENGTH]) for s, n in zip(start, length, strict=True) for i in range(n - sd.LENGTH + 1)]


@pytest.mark.parametrize("seed", range(12))
def test_smallest_ids_of_all_strings(seed):
    text, length, low, shard = passages(seed, letters=1 + seed % 3, first=(0, 97)[seed % 2])
    every = strings(text, length)
    ids = np.repeat(low, length - sd.LENGTH + 1)
    least: dict[bytes, int] = {}
    for x, i in zip(every, ids.tolist(), strict=True):
        least[x] = min(least.get(x, i), i)
    assert sd.smallest_ids(text, length, low, shard).tolist() == [least[x] for x in every]


def test_boundaries_tell_common_prefixes():
    """A boundary first appears in the round after the common prefix of its neighbours, whatever the shards."""
    text, length, _, shard = passages(3, letters=3)
    start = np.cumsum(length) - length
    merge = sd.Interleave(sd.transforms(text, length, shard), len(text))
    while merge.depth < sd.LENGTH:
        k = merge.depth
        # the suffixes of this depth are those that lie LENGTH - k bytes beyond the start of an open string
        at = np.concatenate([s + np.arange(n - sd.LENGTH + 1) for s, n in zip(start, length, strict=True)])
        at = at[merge.open[at]] + sd.LENGTH - k
        prefixes = sorted(bytes(text[i : i + k]) for i in at)
        assert len(prefixes) == len(merge.vector)
        assert merge.begins.tolist() == [i == 0 or prefixes[i] != prefixes[i - 1] for i in range(len(prefixes))]
        merge.refine()


def test_wrong_symbols_give_wrong_intervals(monkeypatch):
    text, length, low, shard = passages(5, letters=3)
    right, built = sd.smallest_ids(text, length, low, shard), sd.transforms

    def spoilt(*args):
        out, rng = built(*args), np.random.default_rng(0)
        for t in out:
            t.symbol = rng.permutation(t.symbol)
        return out

    monkeypatch.setattr(sd, "transforms", spoilt)
    assert (sd.smallest_ids(text, length, low, shard) != right).any()


def test_a_wrong_order_of_suffixes_is_not_made_good(monkeypatch):
    """Nothing sorts the suffixes again: with another order the merge fails or finds other intervals."""
    text, length, low, shard = passages(5, letters=3)
    right = sd.smallest_ids(text, length, low, shard).tolist()
    monkeypatch.setattr(sd, "suffix_order", lambda key, left, lo, hi, interval: np.random.default_rng(lo).permutation(np.arange(lo, hi)))
    try:
        got = sd.smallest_ids(text, length, low, shard).tolist()
    except ValueError:
        got = None
    assert got != right


def test_no_passages_and_no_documents(spark):
    none = np.empty(0, np.int64)
    assert len(sd.smallest_ids(np.empty(0, np.uint8), none, none, none)) == 0
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
