"""The pipeline against a plain Python version, stage by stage."""

from collections import Counter

from .test_operators import SCHEMA, base_spans, covered, near_components, stats_of, texts

import corpus_pipeline
from plenum.llm.quality_rules import quality_verdicts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "personal_data", "packing"]


def test_pipeline(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(120)
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_verdicts(docs).filter("kept").collect()}
    assert all(not stats_of(held[i])[5] for i in kept)
    rows = [(i, held[i]) for i in sorted(kept)]
    rows = [(i, t) for (i, t), (_, _, c) in zip(rows, near_components(rows)) if i == c]
    cut = {}
    for (i, _), (b, m) in zip(rows, covered(rows)):
        out, at = b"", 0
        for ch in b.decode():
            n = len(ch.encode())
            if not m[at : at + n].all():
                out += ch.encode()
            at += n
        cut[i] = out.decode()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == COLUMNS
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        got = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality":
            assert set(got) == kept
        elif name == "near_duplicates":
            assert got == dict(rows)
        elif name == "repeats":
            assert got == cut
        else:
            assert got.keys() == cut.keys() and all(got[i] == t for i, t in cut.items() if not base_spans(t))
            assert not any(base_spans(t) for t in got.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(cut)
    full = Counter()
    for r in packed:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 4096


def test_run_takes_odd_and_empty_tables(spark, tmp_path):
    odd = spark.createDataFrame([(i, t, None, None, 0, 1, "x", 2) for i, t in texts()], SCHEMA)
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        packed = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in packed} <= {i for i, _ in texts()} and (name == "odd") == bool(packed)
