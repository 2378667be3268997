"""What the Python workers of the pipeline hold: how many of them a stage needs, and how much of a worker stays filled."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from scholarium.llm import exact_dedup, packing, tokens, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_copies_are_marked_in_one_call(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(30)], "doc_id long, text string")
    kept = exact_dedup.without_copies(docs)
    # The rows without copies and the possible copies: a call each.
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    assert sorted(r.text for r in kept.collect()) == [f"text {i}" for i in range(7)]


def test_remembered_words_are_freed_with_the_task(spark):
    docs = spark.createDataFrame([(i, f"word{i} of{i} text{i}", "s") for i in range(200)], "doc_id long, text string, source string")
    assert packing.pack(docs.repartition(16), TOKENIZER).count() >= 200

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._memory(TOKENIZER))] * batch.num_rows, pa.int32())], ["n"])

    assert {r.n for r in spark.range(32, numPartitions=32).mapInArrow(held, "n int").collect()} == {0}


def test_packed_sentences_sort_as_lists():
    rng = random.Random(3)
    given = [[[rng.randint(0, 3) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(0, 3))] for _ in range(300)]
    given += [[[0]], [[255]], [[256]], [[255], [256]], []]
    packed = [toxicity.packed_sentences(x) for x in given]
    assert sorted(range(len(given)), key=lambda i: (given[i], i)) == sorted(range(len(given)), key=lambda i: (packed[i], i))


def test_fit_holds_features_in_arrays():
    rng = np.random.default_rng(4)
    lists = [[np.sort(rng.choice(5000, 40, replace=False)).tolist() for _ in range(12)] for _ in range(400)]
    n = sum(len(s) for doc in lists for s in doc)
    docs = [(int(i % 9 == 0), i % 2, toxicity.packed_sentences(x)) for i, x in enumerate(lists)]
    tracemalloc.start()
    weights, _ = toxicity._fit(docs, 5000, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(weights) == 5000 and np.isfinite(weights).all()
    # Lists of numbers took some 70 bytes a feature, numbers included.
    assert most < 45 * n
    # Nothing but documents without features.
    weights, bias = toxicity._fit([(0, 1, b""), (1, 2, b"")], 3, rounds=2)
    assert (weights == 0).all() and np.isfinite(bias)
