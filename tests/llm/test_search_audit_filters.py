"""Ranked search, source audit and URL filters against brute force: nulls, ties, repeated rows, long and empty texts, clashing columns."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from scholarium.llm import blocked_search, divergence, url_filters

LOWER = {c: c + 32 for c in range(65, 91)}
AT_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AUDIT_TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(pattern, text):
    return [w.translate(LOWER) for w in pattern.findall(text or "")]


def key(row):
    return tuple(map(str, row))


def best_documents(docs, items, k):
    held = [(i, collections.Counter(ts), len(ts)) for i, ts in ((d[0], words(AT_TERM, d[1])) for d in docs) if ts]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item in items:
        scores = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(AT_TERM, item[1]) if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item[0], r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=key)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé1A", k=rng.randint(1, 3))) for _ in range(150)]

    def text(n):
        return rng.choice([" ", ". "]).join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(150)], k=n))

    docs = [(i, text(rng.randint(0, 80)), 1, "x") for i in range(400)] + [(900, None, 1, "x"), (901, "", 1, "x"), (902, " .,\n", 1, "x")]
    docs += [(None, text(50), 1, "x"), (5, text(50), 1, "x"), (903, text(20_000), 1, "x")]
    docs += [(1000 + d[0], *d[1:]) for d in docs[:60]] + docs[:3]
    items = [(i, text(rng.randint(0, 30)), 2) for i in range(30)] + [(100, None, 2), (101, "", 2), (None, text(9), 2), (3, text(300), 2), (7, "zzzz", 2)]
    return (
        docs, items, spark.createDataFrame(docs, "doc_id long, text string, row int, item_id string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string, score int"),
    )


@pytest.mark.parametrize(("pass_bytes", "block_terms", "shard_rows", "block_docs"), [(1 << 20, 4096, 2048, 64), (1500, 50, 64, 4)])
def test_ranked_search(corpus, monkeypatch, pass_bytes, block_terms, shard_rows, block_docs):
    """One pass and one shard, and many of both with small blocks."""
    for name, value in (("PASS_BYTES", pass_bytes), ("BLOCK_TERMS", block_terms), ("SHARD_ROWS", shard_rows), ("BLOCK_DOCS", block_docs)):
        monkeypatch.setattr(blocked_search, name, value)
    docs, items, df, asked = corpus
    found = blocked_search.ranked(df, asked, k=5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=key) == best_documents(docs, items, 5)


def test_ranked_search_of_empty_tables_and_text_ids(spark, corpus):
    _, _, df, asked = corpus
    assert blocked_search.ranked(df.limit(0), asked).count() == blocked_search.ranked(df, asked.limit(0)).count() == 0
    few = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "six")], "doc_id string, text string")
    top = blocked_search.ranked(few, spark.createDataFrame([(1, "Two TWO")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in top] == ["a", "b", None]


def test_blocks_are_skipped_and_no_best_document_is():
    """On documents in groups of like terms most blocks are skipped, with the scores of a full comparison."""
    rng = np.random.default_rng(4)
    weights = np.zeros((1024, 60), np.int32)
    for d in range(1024):
        own = (d % 12) * 5 + np.arange(5)
        weights[d, own] = rng.integers(1, 900_000, 5)
        weights[d, rng.integers(0, 60, 3)] = rng.integers(1, 100_000, 3)
    shard = blocked_search.Shard(weights, np.ones(60, np.int64))
    assert sorted(np.concatenate(shard.members[shard.first[7] : shard.first[8]]).tolist()) == np.flatnonzero(weights[:, 7]).tolist()
    opened = []
    for c in range(0, 60, 5):
        cols, value = np.array([c, c + 1, (c + 9) % 60]), np.array([3, 2, 1])
        docs, scores = shard.search(cols, value, 10, 1, opened)
        full = weights[:, cols].astype(np.int64) @ value
        assert sorted(scores.tolist())[-10:] == sorted(full.tolist())[-10:] and (full[docs] == scores).all()
    assert sum(a for a, _ in opened) < 0.8 * sum(n for _, n in opened)


def differences(rows, report):
    count = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    held = collections.defaultdict(collections.Counter)
    for _, text, lang, source, _ in rows:
        terms = words(AUDIT_TERM, text)
        count[lang or ""][source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang, sources in count.items():
        kept = [w for w, n in held[lang].items() if n >= 3]
        total = {w: sum(c[w] for c in sources.values()) for w in kept}

        def shares(c, kept=kept):
            n = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // n for w in kept}

        p, q = {s: shares(c) for s, c in sources.items()}, shares(total)
        for s in sources:
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if sources[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranks = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, r) for r, (v, o) in enumerate(ranks, 1) if part == "pair" or r <= report]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "matrix"), [(600_000, 4096, 1024), (40, 7, 3)])
def test_audit(spark, monkeypatch, block, chunk, matrix):
    """One run a task, and many short runs; sums in one matrix, and in many pieces."""
    for name, value in (("BLOCK_POSTINGS", block), ("CHUNK", chunk), ("MATRIX", matrix)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéB", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [
        (i, rng.choice([" ", ". ", "1"]).join(rng.choices(vocabulary, k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None, ""]),
         rng.choice(["s1", "s1", "s2", None, "é", "s3"]), 1) for i in range(400)
    ]
    rows += [(900, "zz zz", "xx", "s1", 1), (901, None, "xx", "s2", 1), (902, "", "xx", "s3", 1), (903, "A1b'C", "en", "s9", 1)]
    rows += [(904, "q", "solo", "s", 1), (905, "q q", "solo", "s", 1), (905, "q q", "solo", "s", 1), (None, "ab " * 20_000, "de", "s1", 1)]
    df = spark.createDataFrame(rows, "n long, text string, lang string, source string, p int").repartition(3)
    found = divergence.audit(df, report=20)
    assert sorted(map(tuple, found.collect())) == differences(rows, 20)
    assert divergence.audit(df.limit(0)).count() == 0


def test_large_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(20_000_000_000, 30_000_000_000, 7)], "c long, n long, v long")
    share = df.select(divergence._share(df.c, df.n, df.v)).first()[0]
    assert share == 1 + 10**9 * (20_000_000_000 + 1) // (30_000_000_000 + 7)


def test_runs_merge_in_order(monkeypatch):
    """Chunks of several runs that overlap: each list of cuts has all postings of its keys, and lists come in order."""
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "MERGE_POSTINGS", 20)
    rng = random.Random(9)
    chunks, want = [], collections.Counter()
    for _ in range(5):
        block = divergence.Block()
        for _ in range(30):
            lang, source = rng.choice(["x", "é", ""]), rng.choice("st")
            terms = rng.choices(["a", "ab", "b", "ba", "é", "zz"], k=4)
            block.add(lang, source, " ".join(terms).upper().encode())
            want.update((lang.encode().hex().encode() + b" " + t.upper().encode().lower(), source) for t in terms)
        chunks += [c[1:] for c in block.run(1)]
        assert block.size == 0 and not list(block.run(1))
    known, found, last = {}, collections.Counter(), b""
    for cuts in divergence.merged(sorted(chunks, key=lambda c: c[0]), known):
        keys = [k for c in cuts for k in c[0].to_pylist()]
        assert min(keys) > last
        last = max(keys)
        for k, s, n, docs in (r for c in cuts for r in zip(c[0].to_pylist(), *(x.tolist() for x in c[1:]), strict=True)):
            found[k, list(known)[s]] += n
            assert 1 <= docs <= n
    assert found == want


def verdicts(pages, rules, default="allow"):
    held = {}
    for host, path, verdict in rules:
        if host and path is not None and verdict is not None:
            at = (host.translate(LOWER), path)
            held[at] = max(verdict, held.get(at, ""))
    out = []
    for i, url in pages:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in held.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out.append((i, host, path, *best[2:]))
    return sorted(out, key=key)


def test_url_filters(spark):
    rng = random.Random(3)
    labels = ["a", "b", "A", "é", "", "net", "xn--1"]
    pages = []
    for i in range(1500):
        host = ".".join(rng.choices(labels, k=rng.randint(0, 5)))
        path = "".join(rng.choices(["/", "a", "/b", "é", "/a/"], k=rng.randint(0, 5)))
        path = path and "/" + path
        pages.append((i if i % 50 else None, rng.choice(["http://", "HTTPS://", "://"]) + host + path + rng.choice(["", "?q=://x/", "#f/", "?"])))
    pages += [(1, None), (1, ""), (1, "no"), (2, "a/b"), (5, "http://a.net"), (7, "x://" + "a." * 2000 + "net/" + "b" * 50_000), pages[3], pages[3]]
    rules = [
        (".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(["/", "", "/a", "/a/", "/aa/", "é", "/é"]) + rng.choice(["", "a", "/b"]),
         rng.choice(["allow", "block"])) for _ in range(60)
    ]
    rules += [(None, "/", "block"), ("a", None, "allow"), ("", "/", "block"), ("b", "/", None), ("net", "/", "allow"), ("NET", "/", "block")]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, range int, host string").repartition(3)
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = url_filters.judge(df, given)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in found.collect()), key=key) == verdicts(pages, rules)
    assert url_filters.judge(df.limit(0), given).count() == 0
    free = url_filters.judge(df, given.limit(0), default="block")
    assert {tuple(r) for r in free.groupBy("rule", "verdict").count().collect()} == {(None, "block", len(pages))}
