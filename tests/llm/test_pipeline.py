"""The pipeline, stage by stage, against plain Python."""

import re

import pytest

import corpus_pipeline
from voxmill.llm import pii, simhash
from voxmill.llm.common import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns, items = docs.columns, [r["text"] for r in table(spark, sf, "benchmark").collect()]
    kept, before = {}, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "language":
            assert len(rows) >= 0.98 * len(before) and all(re.search(r"[^\W\d_]", r["text"]) for r in rows.values())
        if name == "near_duplicates":
            fps = {i: simhash.fingerprint(r["text"]) for i, r in before.items()}
            todo, want = set(fps), set()
            while todo:
                first = min(todo)
                front, seen = [first], {first}
                while front:
                    a = front.pop()
                    near = {b for b in todo - seen if (fps[a] ^ fps[b]).bit_count() <= 3}
                    seen |= near
                    front += near
                want.add(first)
                todo -= seen
            assert set(rows) == want
        if name == "decontamination":
            def shingles(t):
                w = re.findall(r"\w+", t.lower())
                return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

            sets = [shingles(t) for t in items]
            bad = {i for i, r in before.items() if any(s and len(s & shingles(r["text"])) >= 0.8 * len(s) - 1e-9 for s in sets)}
            assert set(rows) == set(before) - bad
        if name == "pii":
            for i, r in before.items():
                text, _ = pii.pseudonymise(r["text"], pii.session_key(spark))
                assert rows[i]["text"] == text and rows[i]["n_chars"] == len(text)
        if name == "mixing":
            assert set(rows) <= set(before) and 0.3 * len(before) < len(rows) < 0.8 * len(before)
            assert all(rows[i]["text"] == before[i]["text"] and 0 < rows[i]["mix_probability"] <= 1 for i in rows)
        kept[name] = len(rows)
        before = rows
    assert kept["pii"] == kept["decontamination"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "mix_probability"} <= set(out.columns) and out.count() > 0


def test_run_goes_on_where_it_was(spark, sf, tmp_path, monkeypatch):
    first = corpus_pipeline.run(spark, sf, str(tmp_path))
    want = sorted(r["doc_id"] for r in first.collect())
    done = {name for name, _ in corpus_pipeline.STAGES[:-1]}

    def never(*_):
        raise AssertionError("this stage is complete")

    import shutil

    shutil.rmtree(tmp_path / f"{len(done)}-{corpus_pipeline.STAGES[-1][0]}")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, never if n in done else f) for n, f in corpus_pipeline.STAGES])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3 + [(1, None, "en", "a", None)]])
def test_run_of_an_empty_or_null_table(spark, sf, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
