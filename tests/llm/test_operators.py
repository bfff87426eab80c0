"""The corpus operators against brute force, on planted rows and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import embedding_dedup, minhash_dedup, packing, pii, piece_sampling, quality_classifier, quality_rules, sharding, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, Kept string, bucket int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[a] + WORDS[b][:3] + ("." if c == 0 else "") for a, b, c in zip(rng.integers(0, 24, n), rng.integers(0, 24, n), rng.integers(0, 9, n)))


def texts() -> list[tuple[int | None, str | None]]:
    base = [prose(i, 40 + 9 * i) for i in range(12)]
    near = base[3].split()
    near[7] = "changed"
    long = prose(99, 6000)
    rows = list(enumerate(base))
    rows += [(20, base[2]), (21, " ".join(near)), (22, "intro " + base[5][30:150] + " outro " + base[4][:60]), (23, long), (24, long[:9000])]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one two"), (34, "ONE Two"), (35, "é" * 60 + "\nß" * 40), (36, "a" * 3000), (37, "a" * 700)]
    rows += [(None, base[2]), (None, None), (7, base[7]), (8, "other " + base[9]), (40, "mail me at a.b@c.de or card 4111 1111 1111 1111, ip 10.0.0.1, +1 (202) 555-0147")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like an operator's own."""
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 1, "x", 2) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)



def covered(rows):
    """Brute force of the repeated passages: (id, text) -> mask, in the order of the rows."""
    first = {}
    key = lambda i: math.inf if i is None else i
    data = [(key(i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, math.inf), i)
    out = []
    for i, b in data:
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                m[p : p + 50] = True
        out.append((b, m))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_repeats(odd, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4000)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(odd, hot=hot).collect())
    want = Counter()
    for (i, _), (b, m) in zip(texts(), covered(texts())):
        spans = int((np.diff(np.concatenate(([0], m.astype(int), [0]))) == 1).sum())
        want[i, len(b), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()] += 1
    assert got == want


def test_repeats_keep_whole_characters(odd):
    cols = ("doc_id", "text", "lang", "source", "n_chars")
    rows = suffix_dedup.without_repeats(odd, cols).collect()
    assert len(rows) == len(texts()) and all("�" not in (r["text"] or "") for r in rows)
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)


def test_repeats_in_random_bytes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 400)))) for i in range(30)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(m.sum()) for (i, _), (_, m) in zip(rows, covered(rows))}


def test_warc_round_trip(spark, none):
    html = ["<p>x</p>" * 30, None, "", "short", "short", "<p>x</p>" * 30, "é" * 80, "<p>x</p>" * 30, "\x1f\x8b\x08" * 50]
    rows = [(i, None if i == 1 else f"http://h/{i}", h) for i, h in enumerate(html)] + [(None, "u", "q" * 200), (0, "u", "<p>x</p>" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.round_trip(spark, pages).collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "").encode() == b and j is not None), default=None)
        ref = first if len(b) >= 100 and i is not None and first is not None and i != first else None
        want[i, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back) == want
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in back if r["record_type"] == "response")
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_warc_ranges_own_each_record_once(tmp_path, split):
    rng = np.random.default_rng(2)
    data, starts = b"", []
    for i in range(40):
        body = bytes(rng.integers(0, 256, rng.integers(0, 3000), np.uint8)) + warc.MAGIC * 3
        starts.append(len(data))
        data += warc.member(warc._record(i, "u", body, hashlib.sha256(body).hexdigest(), None), level=0 if i % 2 else 6)
    path = tmp_path / "a.gz"
    path.write_bytes(data)
    found = [at for s in range(0, len(data), split) for at, _ in warc.records_in(str(path), s, s + split)]
    assert found == starts


def stats_of(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_base(odd, none):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_verdicts(odd).collect())
    assert got == Counter((i, *stats_of(t)) for i, t in texts())
    assert quality_rules.quality_verdicts(none).count() == 0


def mixed_quantile(own, lang):
    """The LEVEL percent quantile of own values and of the language's, these weighing PRIOR rows in all."""
    top, at = sorted(set(own) | set(lang)), 0
    for v in top:
        at = sum(x <= v for x in own) * len(lang) + quality_rules.PRIOR * sum(x <= v for x in lang)
        if 100 * at >= quality_rules.LEVEL * len(lang) * (len(own) + quality_rules.PRIOR):
            return v
    return None


def test_quality_thresholds_follow_the_groups(spark):
    """Sources of different size and habit: every threshold is the mixed quantile of its group, and kept follows."""
    rows = []
    for source, n, every in (("code", 300, 1), ("web", 300, 40), ("tiny", 3, 1), (None, 2, 2)):
        for k in range(n):
            rows.append((len(rows), prose(len(rows), 50) + (" ### $$$" * (1 + k % 7) if k % every == 0 else "") + ("\nsame line\nsame line" if k % 50 == 3 else ""), "en" if k % 3 else "de", source, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.asDict() | {"key": (rows[r["doc_id"]][2], rows[r["doc_id"]][3])} for r in quality_rules.quality_verdicts(docs).collect()]
    limits = {}
    for r in got:
        inside = True
        for f in quality_rules.FEATURES:
            if (r["key"], f) not in limits:
                limits[r["key"], f] = mixed_quantile([x[f] for x in got if x["key"] == r["key"]], [x[f] for x in got if x["key"][0] == r["key"][0]])
            assert r[f"max_{f}"] == limits[r["key"], f]
            inside &= r[f] <= r[f"max_{f}"]
        assert r["kept"] == (not r["base_failed"] and inside)
    assert len({limits[k, f] for k, f in limits if f == "symbol_pm"}) > 2
    assert quality_rules.quality_filter(docs, ("doc_id", "text", "lang", "source", "n_chars")).count() == sum(r["kept"] for r in got) < len(rows)


def cosine_links(rows):
    out = defaultdict(set)
    ok = [(k, v / np.linalg.norm(v), lab) for k, (_, e, lab) in enumerate(rows) if lab is not None and rows[k][0] is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e) for v in [np.array(e, float)]]
    for a, x, la in ok:
        for b, y, lb in ok:
            if a != b and la == lb and len(x) == len(y) and x @ y >= 0.93:
                out[a].add(b)
    return out


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        c = rng.standard_normal(24)
        rows += [(len(rows) + k, (c + rng.standard_normal(24) * 0.22).astype(np.float32).tolist(), g % 3) for k in range(9)]
    rows += [(200, rows[4][1], 0), (201, rows[4][1], 0), (202, [2 * x for x in rows[4][1]], 0), (203, rows[4][1], None), (204, None, 0), (205, [0.0] * 24, 0), (206, [float("nan")] + rows[4][1][1:], 0), (207, [None] + rows[4][1][1:], 0), (208, [], 0), (209, [1.0, 2.0], 0), (None, rows[4][1], 0), (3, rows[4][1], 0)]
    links = cosine_links(rows)
    comp = {}
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        comp[k] = None if i is None else min(rows[b][0] for b in seen)
    want = Counter((i, len(links[k]), comp[k], i is None or i == comp[k]) for k, (i, _, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, embedding_dedup.near_duplicates(df).collect())) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_collision_threshold_is_calibrated():
    c = embedding_dedup.needed_collisions(0.93)
    rng = np.random.default_rng(4)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    t = rng.standard_normal((4000, 64))
    t -= (t * a).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * t / np.linalg.norm(t, axis=1, keepdims=True)
    near = (np.abs(embedding_dedup._projected(a) - embedding_dedup._projected(b)) <= embedding_dedup.WINDOW).sum(1)
    assert near.min() >= c and 10 < c < embedding_dedup.PROJECTIONS


def test_packing(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(odd).collect()
    want = Counter()
    for i, text in texts():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for p in range(0, len(ids), 4096):
            want[i, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(ids[p : p + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(none).count() == 0


def test_packing_plan_fills_exactly():
    assert sum(n for _, n in packing.plan({3: 5, 7: 5}, 10)) == 5
    assert sum(n for _, n in packing.plan({2: 3, 3: 3, 5: 3}, 10)) == 3
    assert packing.plan({1: 1, 2: 1, 3: 1, 4: 1}, 10) and sum(n for _, n in packing.plan({1: 1, 2: 1, 3: 1, 4: 1}, 10)) == 1
    rng = np.random.default_rng(6)
    for _ in range(20):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 20), rng.integers(1, 40, 20))}
        used, made = Counter(), packing.plan(counts, 64)
        for contents, n in made:
            assert sum(contents) <= 64
            for c in contents:
                used[c] += n
        assert used == Counter(counts)
        assert sum(n for _, n in made) <= sum(n for _, n in packing._best_fit(Counter(counts), 64))
        assert sum(n for _, n in made) >= math.ceil(sum(k * v for k, v in counts.items()) / 64)


def test_piece_sampling(odd, none, spark):
    rows = piece_sampling.sample_segmentations(odd, 3, with_ids=True)
    got = rows.collect()
    assert all(r["round_trip"] for r in got)
    per = defaultdict(list)
    for r in got:
        per[r["doc_id"], r["ids_crc32"] if r["doc_id"] in (7, 8, None) else 0].append(r)
    for (i, _), rs in per.items():
        if i not in (7, 8, None):
            assert len({tuple(r["ids"]) for r in rs}) == len(rs) and [r["perturbed"] for r in rs] == sorted((r["perturbed"] for r in rs), reverse=True)
    again = piece_sampling.sample_segmentations(odd.repartition(1), 3).collect()
    key = lambda r: (r["doc_id"], r["sample"], r["ids_crc32"], r["log_prob"])
    assert Counter(map(key, again)) == Counter(map(key, got))
    decoded = piece_sampling.decode_ids(rows, into="back").join(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).dropDuplicates(["doc_id"]), "doc_id")
    assert decoded.filter("back <> t and doc_id not in (7, 8)").count() == 0
    assert piece_sampling.sample_segmentations(none).count() == 0


def test_piece_samples_follow_the_lattice():
    voc = piece_sampling.vocabulary(piece_sampling.model_path())
    n = 6000
    g = piece_sampling.Group(voc, ["the and"] * n, np.arange(n).astype(np.uint64))
    found, _ = g.sample(2)
    first = Counter(tuple(g.piece[e].tolist()) for x in found for e, _, _ in x[:1])
    second = Counter(tuple(g.piece[e].tolist()) for x in found for e, _, _ in x[1:])
    p = {tuple(g.piece[e].tolist()): math.exp(lp) for x in found for e, lp, _ in x}
    top = max(p, key=p.get)
    assert abs(first[top] / n - p[top]) < 0.03
    other = sorted(p, key=p.get)[-2]
    want = sum(q * p[other] / (1 - q) for s, q in p.items() if s != other)
    assert abs(second[other] / n - want) < 0.03


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


PERSONAL = [
    "", "a@b.c a@b.c_d@e.f.g x@y z.@q.r @a.b a@-.- Ä.ö@b.c é a+b%c@d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 001.002.003.004 1.2.3 0000300.1.1.1 12.34.56.78x", "4111111111111111 4111 1111 1111 1112 4111-1111-1111-1111-1 5500 0000 0000 0004 37828224631000537828 1 2 3",
    "+1 (202) 555-0147 +12 +123456789012345678 +1.5 ++49 30 1234567 +1 ((((", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not DE89370400440532013001", "ssn 123-45-6789; and then a good many words that say nothing at all, 987-65-4321 alone far from any of the words that would make it one, 1-123-45-6789", "1" * 5000 + "." + "2" * 30, "1 " * 3000 + "x", "a" * 20000 + "@", "日本語 a@b.co 😀 10.0.0.1\n+49 30 123456",
]


def test_pii_spans(spark, odd, none):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in pii.pii_spans(docs).collect():
        want = base_spans(PERSONAL[r["doc_id"]])
        listed = ",".join(f"{k}:{b}:{e}" for k, b, e in want)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE], r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (r["doc_id"], r["spans"], listed)
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
        if r["doc_id"] == 5:
            assert r["n_iban"] == 2
        if r["doc_id"] == 6:
            assert r["spans"] == "ssn:4:15"
    assert pii.pii_spans(odd).count() == len(texts()) and pii.pii_spans(none).count() == 0


def test_redaction(spark):
    rows = [(0, "to a@b.co, 4111 1111 1111 1111 end", 0), (1, None, 0), (2, "+4111111111111111 x", 0), (3, "plain", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(docs, ("doc_id", "text", "n_chars")).collect()}
    assert got[0] == ("to [EMAIL], [CARD] end", 22) and got[1] == (None, 0) and got[3] == ("plain", 5)
    assert not re.search("[0-9]{4}", got[2][0])


def test_classifier(spark, tiny, odd, none):
    docs, labels = spark.read.parquet(f"{tiny}/../sf0.01/documents.parquet"), spark.read.parquet(f"{tiny}/../sf0.01/labels.parquet")
    got = quality_classifier.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    same = quality_classifier.score_quality(docs, flipped).select("doc_id", F.round("score", 4).alias("s")).join(quality_classifier.score_quality(docs, labels).select("doc_id", F.round("score", 4).alias("t")), "doc_id")
    assert same.filter("abs(s - t) > 0.001").count() == 0  # labels of the held-out rows have no effect
    assert quality_classifier.score_quality(odd, labels.limit(0)).filter("score = 0.5").count() == len(texts())
    assert quality_classifier.score_quality(none, labels).count() == 0


def test_isotonic():
    y = np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8])
    fit = quality_classifier.isotonic(y, np.ones(6))
    assert np.all(np.diff(fit) >= -1e-12) and abs(fit.sum() - y.sum()) < 1e-9 and fit[-1] == pytest.approx(0.85)


def test_sharding(spark, odd, none):
    tree = sharding.even_tree(16)
    rows = sharding.assign(odd, tree, sharding.grown(tree)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign(many, tree, sharding.grown(tree)).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert abs(moved - 20000 / 17) < 150 and max(Counter(r["shard"] for r in got).values()) < 1.15 * 1250
    for r in got:
        assert r["region"] == f"region{r['shard'] // 8}" and r["rack"] == f"rack{r['shard'] // 4}"
    one_id = sharding.assign(many.withColumn("doc_id", F.lit(None).cast("long")), tree).collect()
    assert len({r["shard"] for r in one_id}) == 1 and sorted(r["slot"] for r in one_id) == list(range(20000))
    # a heavier shard moves rows into its region, its rack and itself, and none between others
    heavier = sharding.even_tree(16)
    heavier["region0"]["rack1"][5] = 3.0
    key = F.col("doc_id").cast("string")
    a, b = (sharding.descend(many.select("doc_id"), key, t).toDF("doc_id", *[f"{c}_{n}" for c in ("region", "rack", "shard")]) for t, n in ((tree, "a"), (heavier, "b")))
    changed = a.join(b, "doc_id").filter("shard_a <> shard_b").collect()
    assert changed and all(r["region_b"] == "region0" for r in changed)
    assert all(r["rack_b"] == "rack1" for r in changed if r["region_a"] == "region0") and all(r["shard_b"] == 5 for r in changed if r["rack_a"] == "rack1")
    assert sharding.assign(none, tree).count() == 0


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and rows[a][0] is not None and rows[b][0] is not None and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    return [(i, len(s), None if i is None else min(rows[b][0] for b in range(len(rows)) if find(b) == find(a))) for a, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("leaf", [48, 3])
def test_near_documents(spark, odd, none, monkeypatch, leaf):
    monkeypatch.setattr(minhash_dedup, "LEAF", leaf)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4 if leaf == 3 else 512)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(odd).collect()) == Counter(near_components(texts()))
    rng = np.random.default_rng(8)
    rows = []
    for g in range(3):  # families of near copies at all distances around the threshold
        base = prose(200 + g, 150).split()
        for k in range(14):
            w = list(base)
            for p in rng.integers(0, len(w), k):
                w[p] = f"new{g}{k}{p}"
            rows.append((len(rows), " ".join(w)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(near_components(rows))
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_context_moves_scores(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'x token = "{token}" y'), (2, f"commit {token} of today"), (3, "IBAN DE89 3704 0044 0532 0130 00"), (4, "for example DE89 3704 0044 0532 0130 00"), (5, "routing 021000021 ok"), (6, "number 021000021 ok"), (7, "routing 021000022 no"), (8, "born 1980-02-03 in"), (9, "on 1980-02-03 in"), (10, "mail a@b.cd as an example")]
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (f"secret:11:{11 + 40}", [0.6]) and got[2] == ("", []) and got[3] == ("iban:5:32", [1.0]) and got[4] == ("", [])
    assert got[5] == ("routing:8:17", [0.6]) and got[6] == got[7] == ("", []) and got[8][0] == "birth:5:15" and got[9] == ("", []) and got[10][0] == "email:5:11"


def test_many_matches_in_one_text(spark):
    """More matches than a block of running sums, with positions beyond the first plane."""
    text = " ".join(f"𝄞u{i}@h.de" for i in range(1000))
    want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    r = pii.pii_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert r["spans"] == ",".join(f"email:{a}:{b}" for a, b in want) and r["n_email"] == r["n_spans"] == 1000


def test_large_ids_beside_nulls(spark):
    ids = [(1 << 60) + 1, (1 << 60) + 3, None]
    df = spark.createDataFrame([(i, f"some words here {k}", 1) for k, i in enumerate(ids)], "doc_id long, text string, quality int").coalesce(1)
    assert {r["doc_id"] for r in packing.pack_documents(df).collect()} == {r["doc_id"] for r in piece_sampling.sample_segmentations(df).collect()} == {r["doc_id"] for r in quality_classifier.score_quality(df, df.select("doc_id", "quality")).collect()} == set(ids)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies around the threshold over many blocks: the components are those of brute force."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "LEAF", 8)
    rng = np.random.default_rng(8)
    base, rows = prose(1, 130).split(), []
    for i in range(150):
        words = list(base)
        for k in rng.choice(130, int(rng.integers(0, 9)), replace=False):
            words[k] = f"w{int(rng.integers(0, 1 << 30))}"
        rows.append((i, " ".join(words)))
    want = near_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, _, c in want} and 3 < len(set(got.values())) < 100


def test_ibans_before_upper_case_words(spark):
    one, two = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    rows = [f"{one} BIC COBADEFF", f"{one} {two} {one} X", f"AB12 {two} 7", f"{one}1 A", f"NO93 8601 1117 947 {one}x", "DE89370400440532013000 TO GB82WEST12345698765432"]
    want = ["0:27", "0:27,28:55,56:83", "5:32", "", "0:18", "0:22,26:48"]
    got = pii.pii_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [",".join(x[5:] for x in r["spans"].split(",") if x.startswith("iban")) for r in got] == want
