"""Conversation repair, URL filter and hard negatives against brute force and SQL, on planted rows and odd tables."""

import hashlib
import heapq
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plenum.llm import conversation_repair as cr
from plenum.llm import hard_negatives as hn
from plenum.llm import packing, pii, registry
from plenum.llm import url_filter as uf

TABLES = "documents embeddings pages benchmark labels conversations".split()


def same_rows(df, sql, con):
    columns = sorted(df.columns)
    ours = Counter(tuple(r[c] for c in columns) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == Counter(tuple(r[i] for i in at) for r in got.fetchall())
    return sum(ours.values())


@pytest.mark.parametrize("name", ["op12_url_filter", "op13_hard_negatives"])
def test_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    assert same_rows(registry.QUERIES[name](spark, tiny), registry.SQL[name], con)


# --- conversations ----------------------------------------------------------------

WHITE = " \t\n\v\f\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    """Fault of each (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(WHITE)
        out.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by shortest paths over whole strings: a search that knows nothing of halves."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, made, lines = heapq.heappop(heap)
        state = made[-1:] if made != "s" else "S"
        if i == len(rows) and LEGAL.fullmatch(made):
            return cost, audit, list(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        for c, role in (("u", "user"), ("a", "assistant")):
            if ok(made + c):
                heapq.heappush(heap, (cost + 2, audit + "I", i, made + c, (*lines, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] and ok(made + role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, made + role[:1], (*lines, f"{role}:{text}")))
                for c, new in (("u", "user"), ("a", "assistant")):
                    if ok(made + c):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, made + c, (*lines, f"{new}:{text}")))


def ok(made):
    """Whether the initials can begin a legal conversation."""
    return re.fullmatch(r"s?(ua)*u?", made) is not None


def reports(rows):
    """Brute force of the report over (conv_id, turn, role, text) after damage."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, each in by.items():
        each.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults = faults_of(each)
        cost, audit, lines = cheapest(each, faults)
        turns = {t for t, _, _ in each if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(each, each[1:]))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
CONVERSATION = "conv_id long, turn long, role string, text string, fault string, Pos string"


def planted(seed, n):
    rng = np.random.default_rng(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys"], ["Hello.", "What?", "cut off", " ", "", None, "Yes!\n", "tab.\t ", "Hello."]
    out = []
    for c in range(n):
        for t in range(rng.integers(1, 12)):
            if rng.random() < 0.75:
                role, text = ("user", "assistant")[t % 2], f"turn {t} of {c}."
            else:
                role, text = roles[rng.integers(9)], texts[rng.integers(9)]
            out.append((None if c == 3 else c, None if rng.random() < 0.03 else int(t * (1 + (rng.random() < 0.1))), role, text))
    return out


@pytest.mark.parametrize("piece", [4096, 4])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rows = planted(1, 60)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONVERSATION).repartition(5)
    got = {None if r["conversation"] == " " else int(r["conversation"][1:]): tuple(r[c] for c in COLUMNS) for r in cr.report(cr.repair(df)).collect()}
    assert got == reports(rows)


def test_repair_of_all_short_conversations():
    """Every sequence of up to four rows of every kind, whole and cut into pieces."""
    kinds = [("system", "Be."), ("user", "Why?"), ("assistant", "So."), ("tool", "x."), ("user", "cut"), ("assistant", "cut"), ("user", " ")]
    letters = [cr_kind(r, t) for r, t in kinds]
    for n in range(1, 5):
        for at in np.ndindex(*[len(kinds)] * n):
            rows = [(i, kinds[k][0], kinds[k][1] + " " * i if k < 6 else " ") for i, k in enumerate(at)]
            rows = [(i, r, f"{i}{t.strip()}" if t.strip() else t) for i, r, t in rows]
            code = "".join(letters[k] for k in at)
            cost, audit, _ = cheapest(rows, faults_of(rows))
            edits = cr.solve(code)
            assert cr.initials("".join(edits)) == audit, (rows, edits)
            # the same by way of two pieces
            cut = n // 2
            parts = [code[:cut], code[cut:]] if cut else [code]
            each = [cr.piece_steps(p) for p in parts]
            states = cr.hirschberg(lambda i: cr.FINISH_STEPS if i == len(each) else each[i], len(each) + 1, 0, 0)
            both = [e for i, p in enumerate(parts) for e in cr.solve(p, states[i], None if i == len(parts) - 1 else states[i + 1])]
            assert both == edits


def cr_kind(role, text):
    fault = faults_of([(0, role, text)])[0]
    return "0123456789ab"["sua".find(role[0]) % 4 + (8 if fault == "blank" else 4 if fault == "truncated" else 0)]


def test_repair_query(spark, tiny, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.op11_conversation_repair(spark, tiny).collect()}
    want = reports(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    assert any(v[2] for v in got.values()) and any("R" in v[6] for v in got.values())
    odd = planted(2, 30) + [(100, 0, "user", "?"), (101, None, None, None), (102, 5, "user", "word " * 100_000 + ".")] + [(103, 1, "user", "Same.")] * 50
    spark.createDataFrame([(*r, "x", "y") for r in odd], CONVERSATION).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = reports(damage(odd))
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in odd}}
    spark.createDataFrame([], CONVERSATION).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert cr.op11_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_repaired_rows_follow_the_grammar(spark):
    rows = cr.repaired(cr.repair(spark.createDataFrame([(*r, "x", "y") for r in planted(3, 20)], CONVERSATION))).orderBy("pos", "step").collect()
    by = defaultdict(str)
    for r in rows:
        by[r["conv_id"]] += r["role"][0]
    assert by and all(LEGAL.fullmatch(x) for x in by.values())


def test_long_conversation_in_pieces(spark, monkeypatch):
    """One conversation of most rows is dealt over several partitions and pieces."""
    monkeypatch.setattr(cr, "PIECE", 64)
    rng = np.random.default_rng(5)
    rows = [(1, t, ["user", "assistant", "system"][rng.choice(3, p=[0.55, 0.4, 0.05])], f"{t} says" + ("." if rng.random() < 0.8 else "")) for t in range(2000)]
    df = cr.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert df.select(F.shiftright("pos", 6)).distinct().count() > 20
    assert df.select(F.shiftright("pos", 33)).distinct().count() > 1
    whole = "".join(r["kind"] for r in df.orderBy("pos").select("kind").collect())
    got = [r["edits"] for r in cr.edits(df).orderBy("pos").collect()]
    assert got == cr.solve(whole)


# --- URLs -------------------------------------------------------------------------

URLS = [
    None, "", "no scheme/net/", "http://", "http:///en/x", "https://a.NET/", "https://a.net", "https://net/x", "https://anet/x", "http://Example.NET/en/1?q=1#f", "http://www.example.net/en", "http://x.example.net/de/#/en/",
    "http://b.example.com/de/", "http://b.example.com/d", "http://www.shop.org/fr/a?utm_source=x&b=2&a=1", "https://shop.org:443/fr/a/?a=1&b=2", "http://shop.org/en/?a=1", "http://u@c.org/fr/", "ftp://x://y.net/", "http://é.net/é", "http://a.net\n/x",
    "http://" + "a." * 3000 + "net/" + "p/" * 5000, "http://www.casino.org/x", "https://casino.org/x/?ref=me", "http://casino.org/x?page=2",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=(0, 0, None, None))[2:]


def test_urls(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:9])] + [(None, "http://a.net/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, ROW string").repartition(3)
    listed = spark.createDataFrame([("http://www.casino.org/x/",), ("https://shop.org/en?a=1",), (None,), ("nothing",)], "url string")
    got = uf.url_filter(pages, uf.rules_table(spark, uf.RULES), listed).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, url, *_ in rows:
        host, path, (rule, verdict) = judged(url)
        r = by[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        on_list = url in ("http://www.casino.org/x", "https://casino.org/x/?ref=me", "http://shop.org/en/?a=1")
        assert r["listed"] == on_list, url
        assert r["verdict"] == (verdict or ("block" if on_list else "allow"))
    assert by[14]["canonical_url"] == by[15]["canonical_url"] == "shop.org/fr/a?a=1&b=2"
    none = uf.url_filter(pages, uf.rules_table(spark, ()), listed.limit(0)).collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "allow")}
    assert uf.url_filter(pages.limit(0), uf.rules_table(spark, uf.RULES), listed).count() == 0


def test_filter_passes_what_is_listed_and_little_else(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("u "), F.col("id").cast("string")).alias("key"))
    table = uf.bloom(keys.filter("key like '%7'")).cache()
    assert uf.possible(keys.filter("key like '%7'"), table).count() == 2000
    assert uf.possible(keys.filter("key not like '%7'"), table).count() < 200


def test_false_positives_go(spark, monkeypatch):
    """A filter of one block lets everything pass; the join still decides."""
    monkeypatch.setattr(uf, "BLOCKS", 1)
    pages = spark.createDataFrame([(i, f"http://h{i}.com/{i}") for i in range(300)], "page_id long, url string")
    listed = pages.filter("page_id % 3 = 0").select("url")
    got = {r["page_id"]: r["verdict"] for r in uf.url_filter(pages, uf.rules_table(spark, (("h7.com", "/", "block"), ("h8.com", "/9", "block"))), listed).collect()}
    assert got == {i: "block" if i % 3 == 0 or i == 7 else "allow" for i in range(300)}


def test_filter_plan_has_no_python(spark, tiny):
    plan = uf.op12_url_filter(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


# --- hard negatives ---------------------------------------------------------------


@pytest.mark.parametrize("scale", [256, 1, 1 << 20])
def test_lookups_are_inner_products(scale):
    rng = np.random.default_rng(3)
    for dim in (1, 7, 8, 64, 65):
        a, c = (np.floor(rng.standard_normal((n, dim)) * scale).astype(np.int64) for n in (5, 9))
        assert (hn.integers(hn.bit_planes(c), dim) == c).all()
        assert (hn.scores(hn.subset_sums(a), hn.bit_planes(c)) == c @ a.T).all()


def mined(rows, n_pos=5, n_neg=10):
    live = [(i, v, [int(np.floor(256 * float(x))) for x in e], lab) for i, (v, e, lab) in enumerate(rows) if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    live = [x for x in live if sum(c * c for c in x[2]) < 1 << 61]
    out = Counter()
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, v, e, lab in live:
        if v is None or v % 100:
            continue
        score = lambda o: sum(x * y for x, y in zip(e, o[2]))  # noqa: E731,B023
        others = [o for o in live if o[0] != i and len(o[2]) == len(e)]
        for ps, p in sorted(((score(o), o[1]) for o in others if o[3] == lab), key=key)[:n_pos]:
            fits = sorted(((score(o), o[1]) for o in others if o[3] != lab and 30 * ps <= 100 * score(o) <= 90 * ps), key=key)[:n_neg]
            for r, (s, o) in enumerate(fits, 1):
                out[v, p, r, o, ps, s] += 1
    return out


@pytest.mark.parametrize("block", [16384, 40])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "ROWS", block)
    monkeypatch.setattr(hn, "ANCHORS", block // 10)
    monkeypatch.setattr(hn, "STRIP", 16)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((4, 12))
    rows = [(k * 25, [float(x) for x in (centre[k % 4] * 0.2 + rng.standard_normal(12) * 0.3) / 2], int(k % 3)) for k in range(200)]
    rows += [(100, rows[4][1], 1), (100, rows[4][1], 2), (None, rows[4][1], 1), (7, rows[8][1], None), (200, None, 1), (300, [1.0, None], 1), (400, [float("nan")] * 12, 0), (500, [float("inf")] * 12, 0)]
    rows += [(600, [0.0] * 12, 0), (700, [0.5] * 3, 1), (701, [0.4] * 3, 1), (702, [0.3] * 3, 2), (800, [], 1), (900, [1e30] * 12, 1), (1000, [30.0] * 12, 1), (1001, [20.0] * 12, 2), (1002, [30.0] * 12, 1), (1100, [-0.2] * 12, 0)]
    df = spark.createDataFrame([(v, e, lab, "x", 1) for v, e, lab in rows], "vec_id long, embedding array<double>, label int, anchor string, Dim int").repartition(4)
    got = Counter(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == mined(rows) and sum(got.values()) > 200
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(False)).count() == 0


# --- earlier operators: dense texts, letters, scratch -----------------------------


def iban(country, body):
    """The body with check digits."""
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def ibans_in(t):
    """Brute force: from each head the longest end of a word that passes, none inside another."""
    out, free = [], 0
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})", t):
        b, best = m.start(), None
        for e in range(b + 15, min(len(t), b + 67) + 1):
            part = t[b:e]
            plain = part.replace(" ", "")
            if re.fullmatch(r"[A-Z0-9]+(?: [A-Z0-9]+)*", part) and 15 <= len(plain) <= 34 and not re.match("[A-Za-z0-9]", t[e:]) and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                best = e
        if best and b >= free:
            out.append((b, best))
            free = best
    return out


def test_ibans_by_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 25)):
            one = iban("".join(rng.choice(list("ABGZ"), 2)), "".join(rng.choice(list("0123456789AZ"), rng.integers(11, 31))))
            one = " ".join(one[i : i + 4] for i in range(0, len(one), 4)) if rng.random() < 0.5 else one
            parts += [one[:-1] + "9" if rng.random() < 0.2 else one, str(rng.choice([" ", ", ", "\n", " GB82 ", " x ", "é"]))]
        texts.append("".join(parts))
    texts.append("GB82 WEST 1234 5698 7654 32")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(df).collect()}
    for i, t in enumerate(texts):
        found = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("iban:")]
        assert found == ibans_in(t), t
    assert sum(len(ibans_in(t)) for t in texts) > 300
    cut = {r["doc_id"]: r["text"] for r in pii.redact(df, ("doc_id", "text")).collect()}
    assert cut[60] == "[IBAN]"


def test_many_ibans_in_one_text(spark):
    one = iban("GB", "WEST12345698765432"[:18])
    df = spark.createDataFrame([(1, " ".join([one] * 8000)), (2, ", ".join([one] * 500))], "doc_id long, text string")
    began = time.time()
    assert {r["doc_id"]: r["n_spans"] for r in pii.pii_spans(df).collect()} == {1: 8000, 2: 500}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df, ("doc_id", "text")).collect()} == {1: " ".join(["[IBAN]"] * 8000), 2: ", ".join(["[IBAN]"] * 500)}
    assert time.time() - began < 60


def test_ids_of_all_letters():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    encode, plain = packing.WordEncoder(path), Tokenizer.from_file(path)
    for c in range(33, 0x600):
        for text in (chr(c), f"a{chr(c)}b {chr(c)}{chr(c)}."):
            assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, hex(c)


def test_two_lazy_results_of_the_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    a, b = corpus_pipeline.packing(spark, docs, tiny), corpus_pipeline.packing(spark, docs, tiny)
    assert a.count() == b.count() > 0


def test_components(spark):
    from plenum.llm import components

    chain = [10, *range(1000, 1030), 5]
    e = spark.createDataFrame(list(zip(chain, chain[1:])) + [(2000, 2001), (3000, 3000)], "a long, b long")
    assert {r["id"]: r["component_id"] for r in components.components(e).collect()} == dict.fromkeys(chain, 5) | {2000: 2000, 2001: 2000}
    assert components.components(e.limit(0)).count() == 0
