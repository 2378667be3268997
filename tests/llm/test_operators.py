"""The text operators on small fixtures with nulls, empty texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholarium.llm import alignment, exact_dedup, language, maxscore, mixing, near_dedup, packing, repeats, ring, tokens, toxicity, warc
from scholarium.llm.common import short_batches

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Columns named like helpers of the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, sha string, sketch int, f int"


@pytest.fixture(scope="module")
def docs(spark):
    short_batches(spark)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 200))) for _ in range(40)]
    near = texts[0].split()
    near[len(near) // 2] = "changed"
    texts += [None, "", " \t\n", texts[3], texts[3].replace(" ", "  "), " ".join(near), "x" * 50_000, "漢字 кот " * 30, "%%% 123"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, "r", "s", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id at all", None, None, None, None, None, None, None), (None,) * 9]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return [r.asDict() for r in df.collect()]


def plain(t):
    return (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def test_exact_groups(docs):
    given = rows(docs)
    groups = collections.defaultdict(list)
    for r in given:
        groups[plain(r["text"])].append(r)
    found = rows(exact_dedup.exact_groups(docs))
    assert len(found) == len(given) and sum(r["kept"] for r in found) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in found:
        g = by_hash[r["text_sha256"]]
        best = min(g, key=lambda x: (-len(x["text"] or ""), x["doc_id"] is None, x["doc_id"] or 0))
        assert (r["keep_id"], r["group_size"]) == (best["doc_id"], len(g))
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and sorted(plain(r["text"]) for r in rows(kept)) == sorted(groups)
    assert exact_dedup.without_copies(docs, max_bits=exact_dedup.bloom.SEGMENT_BITS).count() == len(groups)


def test_maxscore(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8)).round(1)
    vectors[7] = vectors[3]
    data = [(i, v.tolist(), "z") for i, v in enumerate(vectors)] + [(1000, None, "z"), (1001, [1.0, None] * 4, "z"), (1050, [float("nan")] * 8, "z")]
    df = spark.createDataFrame(data + data[:2], "vec_id long, embedding array<double>, score string")
    # Two rows repeat the ids 0 and 1: every row but the query's own is a candidate, and each row of id 0 asks.
    ids, w = [*range(400), 0, 1], np.floor(256 * np.r_[vectors, vectors[:2]]).astype(int)

    def wanted(scale=1):
        for q in (i for i, x in enumerate(ids) if x % 50 == 0):
            best = sorted((-(w[q] @ w[i]) * scale**2, ids[i]) for i in range(402) if i != q)[:5]
            yield from ((ids[q], k + 1, i, int(-s)) for k, (s, i) in enumerate(best))

    assert sorted(tuple(r) for r in maxscore.top_k(df).collect()) == sorted(wanted())
    # Many small shards and blocks, several groups of blocks, and weights that need more bytes.
    for name, value in (("SHARD_ROWS", 32), ("QUERY_ROWS", 1), ("BLOCKS_AT_ONCE", 2)):
        monkeypatch.setattr(maxscore, name, value)
    whole = df.where("vec_id < 1000").withColumn("embedding", F.expr("transform(embedding, x -> floor(256 * x) * 65536D)"))
    assert sorted(tuple(r) for r in maxscore.top_k(whole, scale=1.0).collect()) == sorted(wanted(65536))
    assert maxscore.top_k(df.limit(0)).count() == 0


def test_maxscore_strips(spark, monkeypatch):
    # Tasks that read several shards, each with the last places of those before it; nothing is broadcast, which copies of queries once were.
    for name, value in (("SHARD_ROWS", 64), ("QUERY_ROWS", 2), ("BLOCKS_AT_ONCE", 2), ("STRIP_SHARDS", 3), ("TASKS_PER_CORE", 0)):
        monkeypatch.setattr(maxscore, name, value)
    w = np.random.default_rng(3).integers(-3, 4, size=(300, 6))
    found = maxscore.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w.astype(float))], "vec_id long, embedding array<double>"), scale=1.0)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    wanted = []
    for q in range(0, 300, 50):
        best = sorted((-int(w[q] @ w[i]), i) for i in range(300) if i != q)[:5]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in found.collect()) == wanted


def test_mixing(docs):
    found = rows(mixing.mix(docs))
    sizes = collections.Counter()
    for r in rows(docs):
        sizes[r["source"]] += len((r["text"] or "").split())
    assert len(found) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in found)
    assert abs(sum(t for t, _ in {(r["target"], r["source_size"]) for r in found}) - sum(sizes.values())) < 1e-6
    taken = collections.Counter()
    for r in found:
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n - t) < 0.1 * t + 20 for (t, _), n in taken.items())
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows(mixing.mix(docs)))
    assert sorted(map(str, found)) == sorted(map(str, rows(mixing.mix(docs.repartition(2)))))
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append((len(b), sum(cover), bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return out


def test_repeats(spark):
    rng = random.Random(3)
    piece = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = piece(700)
    texts = [piece(300) + shared + piece(200), shared[:450] + piece(100), piece(900), None, "", "é" * 500, shared, shared, piece(20) + shared[100:505]]
    texts += [piece(399), texts[2][:400]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.without_repeats(df).collect()}
    assert [found[i] for i in range(len(texts))] == brute_repeats(texts, 400)
    assert repeats.without_repeats(df.limit(0)).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    data, marks = [], []
    for i in range(400):
        sents = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(1, 10))]
        bad = i % 4 == 0
        if bad:
            sents[rng.randrange(len(sents))] += " vileword nastyword"
        data.append((i, ". ".join(sents)))
        marks.append((i, int(bad)))
    df = spark.createDataFrame([*data, (900, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, marks[0], (5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in rows(toxicity.toxic_scores(df, labels))}
    held = [i for i, _ in data if found[i]["held_out"]]
    assert held and all(found[i]["predicted"] == marks[i][1] for i in held) and found[900]["score"] == 0
    model = toxicity.train(df, labels)
    spots = rows(toxicity.offending_sentences(df, model))
    assert {r["doc_id"] for r in spots} == {i for i, y in marks if y} and all("vileword" in r["sentence"] for r in spots)
    assert toxicity.toxic_scores(docs, labels.limit(0)).agg({"score": "max"}).first()[0] < 1e-6
    assert toxicity.clean_rows(docs, labels.limit(0)).count() == docs.count()


def test_sharding(docs):
    found = rows(ring.shard_rows(docs, 7))
    loads = collections.defaultdict(list)
    for r in found:
        loads[r["shard"]].append(r["slot"])
    assert len(found) == docs.count() and max(map(len, loads.values())) - min(map(len, loads.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in loads.values())
    # One more shard moves few rows beyond its share when there is slack.
    counts = {a: 10 for a in range(0, 1 << ring.ARC_BITS, 16)}
    place = lambda n: {(a, k): s for a, lo, hi, s, _ in ring.walk(counts, n, slack=0.25) for k in range(lo, hi)}
    old, new = place(10), place(11)
    assert sum(old[k] != new[k] for k in old) < 0.3 * len(old)
    assert ring.shard_rows(docs.limit(0), 7).count() == 0


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/", "one\r\n\r\ntwo"), (2, "u\r\nx", "same"), (3, None, "same"), (4, "v", None), (5, "w", ""), (None, "n", "same"), (3, None, "same")]
    pages += [(i, f"http://h/{i}", "ßx" * i) for i in range(10, 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/archive"
    warc.write_archives(warc.as_records(df), path)
    back = rows(warc.read_archives(spark, path, split_bytes=700))
    assert len(back) == len(pages)
    texts = {f"urn:page:{'' if i is None else i}": (h or "").encode() for i, _, h in pages}
    for r in back:
        raw = texts[r["record_id"]]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["payload_bytes"] == len(raw)
        assert bytes(r["payload"]) == (raw if r["record_type"] == "response" else b"")
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows(warc.archived_pages(df)) if (r["page_id"] or 0) < 10}
    assert kinds == {(1, "response", None), (2, "revisit", 3), (3, "response", None), (4, "revisit", 5), (5, "response", None), (None, "revisit", 3)}
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(60))
    alphabets = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "бвгдежз"}
    data = [(i, make(alphabets[x]), x) for i, x in enumerate(list(alphabets) * 30)]
    df = spark.createDataFrame([*data, (500, None, "aa"), (501, "123 !", "aa"), (502, "", None)], "doc_id long, text string, lang string")
    model = language.train(df)
    found = {r["doc_id"]: r for r in rows(language.languages(df, model))}
    assert all(found[i]["lang_pred"] == x for i, _, x in data)
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (500, 501, 502))
    a, b = make("abcdefg"), make("mnopqrs")
    mixed = spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string")
    assert [(r.start, r.end, r.lang) for r in language.language_spans(mixed, model).collect()] == [
        (0, len(a), "aa"), (len(a) + 1, len(a) + 1 + len(b), "bb")
    ]
    assert language.languages(df.limit(0)).count() == 0


def test_viterbi_is_optimal():
    """All paths compared, with and without the short way for texts of one language."""
    rng = np.random.default_rng(6)
    cases = [(rng.normal(size=(5, 3)) * rng.choice([1, 3, 9]), rng.choice([1.0, 2.0, 12.0])) for _ in range(600)]
    # Two languages that gain less than one switch each, and more together.
    cases.append((np.array([[-10.8, 0, -21.6], [-10.8, -21.6, 0]]), 12.0))
    for s, switch in cases:
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - switch * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(value(p) for p in np.ndindex(*(3,) * len(s)))
        assert value(language.viterbi(s, switch).tolist()) == pytest.approx(best)
    lengths = np.array([len(s) for s, _ in cases[:200]])
    main, sure = language.single(np.concatenate([s for s, _ in cases[:200]]), lengths, 2.0)
    for (s, _), m, ok in zip(cases[:200], main, sure, strict=True):
        one, own = language.single(s, np.array([len(s)]), 2.0)
        assert (m, ok) == (one[0], own[0])
    assert sure.any() and not sure.all()


def test_new_words_are_scored_at_once(monkeypatch):
    counts = {(x, g): n for x, t, n in (("aa", "abcde", 3), ("bb", "cdeab", 2)) for w in (t, t[::-1]) for g in language.grams(w)}
    model = language.Model(["aa", "bb"], counts, {"aa": {"Latin"}, "bb": {"Latin", "Cyrillic"}})
    words = [w.encode() for w in ("abcde", "edc", "a", "zzz", "\u0436\u0430", "\u6f22", *(f"cde{chr(97 + i)}b" for i in range(20)))]
    calls, learn = [], language.Model._learn
    monkeypatch.setattr(language.Model, "_learn", lambda self, new: calls.append(new) or learn(self, new))
    scores = model.scores(words * 2)
    assert len(calls) == 1
    seen = {g for _, g in counts}
    for word, row in zip(words, scores, strict=False):
        text = word.decode()
        sums = [sum(np.log(counts.get((x, g), 0) + 1) + model.rare[i] for g in language.grams(text) if g in seen) for i, x in enumerate(model.langs)]
        allowed = [language.script(text) in model.scripts[x] for x in model.langs]
        best = max((v for v, ok in zip(sums, allowed, strict=True) if ok), default=0.0)
        wanted = [max(-50.0, v - best) if ok else -50.0 for v, ok in zip(sums, allowed, strict=True)] if any(allowed) else [0.0, 0.0]
        assert np.allclose(row, wanted)


def test_words_and_batches_of_languages(monkeypatch):
    """Words are those of the pattern, whatever the letters; texts in batches get what they get alone."""
    texts = ["Ärger über ÀÉÎ×÷ß x_1 2y", "plain ASCII, it's", "кот und 漢字 ² ª", "İx\u00a0y", "", None, "12 _"]
    for t in texts[:5]:
        assert language.words_of(t) == [w.encode() for w in language.LETTERS.findall(t.lower())]
    counts = {("aa", g): 5 for w in ("plain", "it") for g in language.grams(w)} | {("bb", g): 5 for g in language.grams("über")}
    model = language.Model(["aa", "bb"], counts, {"aa": {"Latin"}, "bb": {"Latin", "Cyrillic"}})
    want = [language.predict(model, [t])[0] for t in texts]
    assert want[4:] == [("und", 0.0)] * 3
    for words in (1, 4, 1000):
        monkeypatch.setattr(language, "BATCH_WORDS", words)
        assert language.predict(model, texts) == want


def test_packing(docs):
    given = rows(docs)
    found = rows(packing.pack(docs, TOKENIZER, window=64))
    tok = Tokenizer.from_file(TOKENIZER)
    want = sorted(tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids) + (1,) for r in given)
    pieces = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        pieces[r["sequence_id"]].append(r)
    total = sum(map(len, want))
    for i, ps in pieces.items():
        assert [p["offset"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps[:-1]]]).tolist()
        assert sum(p["length"] for p in ps) == min(64, total - 64 * i)
    single = [r for r in given if r["doc_id"] is not None and r["doc_id"] != 5]
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for r in single:
        ids = [x for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]) for x in p["ids"]]
        assert ids == [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
    assert sum(r["length"] for r in found) == total
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_tokens_of_odd_texts():
    tok = Tokenizer.from_file(TOKENIZER)
    texts = ["İstanbul ΣΑΣ <|endoftext|> a\x85b it's 3²½ I'LL don't…́ é é 漢字", " ' ''s 'sx s's 1a2 ÷×", "a\xa0b\x1cc"]
    for t, ids in zip(texts, tokens.encode(TOKENIZER, texts, None), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_distance():
    rng = random.Random(8)
    for _ in range(2000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randint(0, 3) for _ in range(rng.randint(0, 3))]
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        limit = rng.randint(0, 16)
        assert alignment.distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == min(last[-1], limit + 1)


def test_near_classes(docs):
    given = [r for r in rows(docs) if r["doc_id"] is not None]
    found = rows(near_dedup.near_classes(docs))
    assert len(found) == docs.count()
    known = near_dedup.Numbers()
    words = [near_dedup.word_ids(r["text"], known) for r in given]
    root = list(range(len(given)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, x in enumerate(words):
        for j in range(i):
            if near_dedup.near(x.tobytes(), words[j].tobytes()) or not len(x) and not len(words[j]):
                root[top(i)] = top(j)
    classes = collections.defaultdict(set)
    for i, r in enumerate(given):
        classes[top(i)].add(r["doc_id"])
    want = {d: min(c) for c in classes.values() for d in c}
    assert {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None} == want
    kept = near_dedup.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert near_dedup.near_classes(docs.limit(0)).count() == 0


def test_near_classes_of_chains(spark, monkeypatch):
    """Each text is near the next ones only, so that leaders do not finish their bands; blocks are smaller than bands."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    data = []
    for chain in range(3):
        text = rng.choices(words, k=120)
        for _ in range(30):
            data.append((len(data), " ".join(text)))
            at = rng.randrange(110)
            text = [*text[:at], *rng.choices(words, k=4), *text[at + 4 :]]
    # The first ids are not at one end of the chain.
    order = rng.sample(range(len(data)), len(data))
    df = spark.createDataFrame([(order[i], t) for i, t in data], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()}
    for chain in range(3):
        ids = order[30 * chain : 30 * chain + 30]
        assert {found[i] for i in ids} == {min(ids)}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, seen = corpus_pipeline.table(spark, sf, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept_step(stage(spark, docs, sf))
        seen.append((name, docs.count()))
        assert name == "packing" or docs.columns == columns
    assert all(n > 0 for _, n in seen) and seen[0][1] >= seen[1][1] >= seen[2][1]
    assert docs.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_rows_that_are_no_copies_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, b"a" if i < 4 else bytes([i]), i, [i]) for i in range(60)], "row long, seq binary, n int, sketch array<long>")
    firsts = near_dedup.step(rows.groupBy("seq").agg(F.min("row").alias("first"), F.count("*").alias("copies")))
    texts = near_dedup._one_of_each(rows, firsts)
    assert sorted(tuple(r) for r in texts.collect()) == [(i, i, [i]) for i in [0, *range(4, 60)]]
    # The filter of the later rows tells all but few of the others.
    later = near_dedup._among(spark.createDataFrame([(1,), (2,), (3,)], "row long"))
    assert rows.where(later("row")).count() < 8
    # No copies at all.
    alone = rows.where("row > 3")
    firsts = near_dedup.step(alone.groupBy("seq").agg(F.min("row").alias("first"), F.count("*").alias("copies")))
    assert near_dedup._one_of_each(alone, firsts).count() == 56
