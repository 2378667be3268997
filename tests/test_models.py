"""Chains around models: what is pending goes through the model in bounded calls and comes back to its row."""

from __future__ import annotations

import json

import pytest

from scholarium.operators import models as mo

PAPERS = "id long, title string, abstract string, llm_category string, embedding array<float>"


def test_embedding_calls_follow_a_sequential_packing(spark):
    tokens = [3, 4, 3, 0, 11, 10, 1, 9, 2, 2, 2, 2, 0, 0, 7, 5, 5]
    texts = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(tokens)], "id long, text string")
    got = {(r["batch"], r["sub_batch"], r["id"]) for r in mo.embedding_calls(texts, 6, 10).collect()}
    expected = set()
    for batch in range(0, len(tokens), 6):
        used = sub = 0
        for i in range(batch, min(batch + 6, len(tokens))):
            if tokens[i] > 10:
                continue
            if used + tokens[i] > 10:
                used, sub = 0, sub + 1
            used += tokens[i]
            expected.add((batch // 6, sub, i))
    assert got == expected


def test_embed_pending_fills_only_what_is_missing(spark):
    rows = [(1, "a", "", None, [9.0]), (2, "b", "", None, None), (3, "c", "", None, None), (4, "d", "", None, None)]
    papers = spark.createDataFrame(rows, PAPERS)
    texts = spark.createDataFrame([(1, "old"), (2, "two words"), (3, None), (4, "far too many words here"), (8, "no paper")], "id long, text string")
    done = mo.embed_pending(papers, texts, lambda ts: [[len(t)] for t in ts], per_call=2, token_limit=3)
    assert {r["id"]: r["embedding"] for r in done.collect()} == {1: [9.0], 2: [9.0], 3: [0.0], 4: None}
    assert done.columns == papers.columns
    assert mo.embed_pending(papers.limit(0), texts, lambda ts: [[1.0]] * len(ts)).count() == 0
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        mo.embed_pending(papers, texts, lambda ts: [[1.0]], per_call=2)


@pytest.mark.parametrize("size", [1, 4, 100])
def test_a_spoiled_prompt_loses_only_the_paper_that_spoils_it(spark, size):
    rows = [(i, f"t{i}", None if i == 5 else "bad" if i in (3, 12) else f"x{i}", "kept" if i == 7 else None, None) for i in range(17)]
    papers = spark.createDataFrame(rows, PAPERS)

    def label(prompts):
        for p in prompts:
            items = [x.split("\nAbstract: ") for x in p.split("\n\nTitle: ")[1:]]
            assert len(items) <= size
            yield "no json" if any(a == "bad" for _, a in items) else json.dumps([f"{t}/{a}" for t, a in items])

    done = {r["id"]: r["llm_category"] for r in mo.label_papers(papers, label, "Label these.", size).collect()}
    assert done == {
        i: None if i in (3, 12) else "kept" if i == 7 else f"t{i}/{'None' if i == 5 else f'x{i}'}" for i in range(17)
    }


def test_labels_of_nothing(spark):
    papers = spark.createDataFrame([(1, "a", "b", "kept", None)], PAPERS)
    assert [r["llm_category"] for r in mo.label_papers(papers, lambda ps: ["[]"] * len(ps), "Label.").collect()] == ["kept"]
