from __future__ import annotations

import json
import math

from lakesearch.operators import corpus
from lakesearch.sources import evals


def write(folder, name, value):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(value))


def pool(k, query, candidates):
    return {
        "version": 1, "kind": "live", "query": {"id": f"q{k:03d}", "query": query, "language": "en", "category": "concept", "sites": []}, "captured_at": "2024-01-01T00:00:00Z", "node": "n", "status": "partial", "elapsed_ms": 12.5, "response_sha256": None,
        "error_code": None, "candidates": [{"id": f"c{i}", "url": f"https://example.com/{i}", "title": t, "snippet": s, "original_rank": i + 1} for i, (t, s) in enumerate(candidates)], "evidence": {"target_results": 1, "verified_results": 1},
    }


def judge(k, grades):
    return {"version": 1, "query_id": f"q{k:03d}", "pool_sha256": "0" * 64, "assessor": {"kind": "human", "id": "x"}, "judged_at": "2024-01-01T00:00:00Z", "basis": "title_snippet", "judgments": [{"id": f"c{i}", "grade": g, "reason": "r"} for i, g in enumerate(grades)]}


def test_modes(spark, tmp_path):
    write(tmp_path / "pools", "a.json", pool(1, "rare words", [("common", "text"), ("rare words", "found"), ("other", "rare")]))
    write(tmp_path / "pools", "b.json", pool(2, "nothing", [("a", "b"), ("c", "d")]))
    write(tmp_path / "judged", "a.json", judge(1, [0, 2, 1]))
    write(tmp_path / "judged", "b.json", judge(2, [0, 0]))
    got = {r["mode"]: r for r in corpus.evaluate(spark, str(tmp_path / "pools"), str(tmp_path / "judged")).collect()}
    assert got["bm25"]["ndcg_10"] == 1.0 and got["bm25"]["mrr_10"] == 1.0 and got["bm25"]["judged"] == 1
    want = (3 / math.log2(3) + 1 / math.log2(4)) / (3 + 1 / math.log2(3))
    assert math.isclose(got["upstream"]["ndcg_10"], want) and got["upstream"]["mrr_10"] == 0.5
    rows, _ = corpus.load(spark, str(tmp_path / "pools"), str(tmp_path / "judged"))
    zero = {r["id"]: r["rank"] for r in corpus.rankings(rows).where("mode = 'bm25_mmr'").join(rows.where("query = 'q002'").select("pool").distinct(), "pool").collect()}
    assert zero == {1: 1, 2: 2}  # no score at all: upstream order stays


def test_freeze(spark):
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "id string, response_sha256 string")
    frozen = spark.createDataFrame([("a", "h1"), ("b", "other")], new.schema)
    write_, conflicts = evals.freeze(new, frozen)
    assert [r["id"] for r in write_.collect()] == ["c"] and [r["id"] for r in conflicts.collect()] == ["b"]
