"""Language of texts and of their spans: scripts narrow the candidates, Viterbi smooths scores of words.

Every word gets a score per language from character trigrams; languages that do not use the word's script are out.
The best labelling of a text maximises the sum of the scores minus a penalty for each switch, so that mixed texts come
apart into spans and single odd words do not.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.llm.common import column, fold
from scholarium.llm.sampling import SCALE

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled documents that the model is fitted on, at most, dealt evenly among the languages.
SAMPLE_DOCS = 20_000
#: Entries (language, trigram) of the model, at most, dealt evenly among the languages: the most frequent of each.
MAX_GRAMS = 400_000
#: Words whose scores are worked on at once.
BATCH_WORDS = 1 << 17
#: New words that are scored at once.
BATCH_NEW = 1 << 14
SWITCH = 12.0
CACHE_WORDS = 300_000
#: A language uses a script if at least this share of its words are in it.
SCRIPT_SHARE = 0.01

# First code point of each block of letters and the script it begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
]
STARTS = [a for a, _ in SCRIPTS]


#: UTF-8 of texts in which letters are those of ASCII and from U+00C0 to U+00FF, but for two signs; all but letters becomes a space.
PLAIN = bytes([*range(128), *range(0x80, 0xC0), 0xC3])
TO_SPACE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters in lower case, in UTF-8."""
    lower = text.lower()
    raw = lower.encode("utf-8", "surrogatepass")
    if raw.translate(None, PLAIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
        return [w.encode("utf-8", "surrogatepass") for w in LETTERS.findall(lower)]
    return raw.translate(TO_SPACE).split()


def script(word: str) -> str:
    return SCRIPTS[bisect.bisect_right(STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Scores of words by language; ``counts``: (language, trigram) -> n, ``scripts``: language -> scripts it uses."""

    def __init__(self, langs: list[str], counts: dict[tuple[str, str], int], scripts: dict[str, set[str]]):
        self.langs, self.scripts = langs, scripts
        vocabulary = {g for _, g in counts}
        size = len(vocabulary) + 1
        sums = Counter()
        for (lang, _), n in counts.items():
            sums[lang] += n
        self.rare = np.array([-np.log((sums[x] + size)) for x in langs])
        self.gram_at = {g: i for i, g in enumerate(sorted(vocabulary), 1)}
        # Row 0 is for trigrams that no language has: they tell nothing about any.
        self.logs = np.zeros((size, len(langs)))
        for g, i in self.gram_at.items():
            self.logs[i] = np.log([counts.get((x, g), 0) + 1.0 for x in langs]) + self.rare
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def _learn(self, words: list[bytes]) -> None:
        """Scores of new words, all at once."""
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(t) for t in texts])
        # Short words first, so that those with a trigram at a place are the last ones.
        order = np.argsort(lengths, kind="stable")
        texts, lengths = [texts[i] for i in order], lengths[order]
        known = self.gram_at.get
        at = np.array([known(g, 0) for t in texts for g in grams(t)], np.int64)
        ends = np.cumsum(lengths)
        rows = np.zeros((len(texts), len(self.langs)))
        for j in range(int(lengths[-1])):
            from_ = np.searchsorted(lengths, j, "right")
            rows[from_:] += self.logs[at[(ends - lengths)[from_:] + j]]
        firsts, own = np.unique([t[0] for t in texts], return_inverse=True)
        allowed = np.array([[script(c) in self.scripts[x] for x in self.langs] for c in firsts.tolist()]).reshape(len(firsts), -1)[own]
        some = allowed.any(axis=1)
        # Scores relative to the best; a language without the script is far behind.
        best = np.where(allowed, rows, -np.inf).max(axis=1, initial=-np.inf)
        rows = np.where(allowed, rows - np.where(some, best, 0.0)[:, None], -50.0)
        rows[~some] = 0.0
        n = len(self.place)
        while n + len(rows) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n + order] = np.maximum(rows, -50.0)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Words x languages."""
        if len(self.place) > CACHE_WORDS:
            self._forget()
        new = list(set(words).difference(self.place))
        for a in range(0, len(new), BATCH_NEW):
            self._learn(new[a : a + BATCH_NEW])
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def path(self, words: list[bytes], switch: float = SWITCH) -> np.ndarray:
        """The language number of each word on the best path; ties go to the language that comes first."""
        return viterbi(self.scores(words), switch)


def single(scores: np.ndarray, lengths: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Per text, of so many words each, the language with the highest sum, and whether to stay with it is surely the best path.

    It is where no run of words gains more than one switch costs, even if each word took the best of all other languages:
    a path that leaves the language does so for some runs of words, and pays a switch for each.
    """
    starts = np.cumsum(lengths) - lengths
    main = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)
    if scores.shape[1] == 1:
        return main, np.ones(len(lengths), bool)
    rows, own = np.arange(len(scores)), np.repeat(main, lengths)
    others = scores.copy()
    others[rows, own] = -np.inf
    gain = np.cumsum(others.max(axis=1) - scores[rows, own])
    # Each text's sums lie below those of all earlier ones, so that running minima begin anew with it.
    fall = np.repeat(np.arange(len(lengths)) * (np.ptp(gain) + 1.0), lengths)
    before = np.concatenate([[0.0], gain[:-1]]) - fall
    best = np.maximum.reduceat(gain - fall - np.minimum.accumulate(before), starts)
    return main, best <= switch - 1e-6


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Labels that maximise the sum of scores less ``switch`` for each change."""
    n, k = scores.shape
    main, sure = single(scores, np.array([n]), switch)
    if sure[0]:
        return np.full(n, main[0])
    best, back = scores[0].copy(), np.zeros((n, k), np.int32)
    stay = np.arange(k)
    for t in range(1, n):
        top = int(best.argmax())
        jump = best[top] - switch
        back[t] = np.where(best >= jump, stay, top)
        best = np.maximum(best, jump) + scores[t]
    out = np.empty(n, np.int64)
    out[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def train(docs: DataFrame, limit: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most about ``limit`` rows with text and language whose crc32(id as text) mod 4 is not 2."""
    rows = docs.select(column(docs, key).alias("id"), column(docs, text).alias("text"), column(docs, lang).cast("string").alias("lang"))
    rows = rows.where((fold("id", 4) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    # Every language gives as many rows as the limit allows; small ones give all.
    held = sorted((r["count"], r["lang"]) for r in rows.groupBy("lang").count().collect())
    quota, left = 0.0, float(limit)
    for i, (n, _) in enumerate(held):
        quota = left / (len(held) - i)
        left -= min(n, quota)
    size = rows.groupBy("lang").agg(F.count("*").alias("size"))
    spot = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(SCALE)) * F.col("size")
    sample = rows.join(size, "lang").where(spot < F.lit(SCALE * quota))

    def count(batches):
        n: dict[str, Counter] = {}
        for batch in batches:
            for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                c = n.setdefault(x, Counter())
                for w, k in Counter(LETTERS.findall(t.lower())).items():
                    for g in grams(w):
                        c[g] += k
                    c[f"script {script(w)}"] += k
        for x, c in n.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"]
            )

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("gram").startswith("script ").desc(), F.col("n").desc(), "gram")
    found = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_GRAMS // max(1, len(held))).collect()
    langs = sorted({r.lang for r in found})
    used: dict[str, Counter] = {x: Counter() for x in langs}
    for r in found:
        if r.gram.startswith("script "):
            used[r.lang][r.gram[7:]] += r.n
    scripts = {x: {s for s, n in c.items() if n >= SCRIPT_SHARE * sum(c.values())} for x, c in used.items()}
    return Model(langs, {(r.lang, r.gram): r.n for r in found if not r.gram.startswith("script ")}, scripts)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Of each text the language with most letters on the best path and its share of them; ``und`` and 0 without letters."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    held, n = [], 0
    for i, text in enumerate(texts):
        words = words_of(text) if text else []
        if words and model.langs:
            held.append((i, words))
            n += len(words)
        if n >= BATCH_WORDS or held and i + 1 == len(texts):
            scores = model.scores(list(chain.from_iterable(w for _, w in held)))
            lengths = np.array([len(w) for _, w in held])
            a = 0
            for (at, own), main, sure in zip(held, *single(scores, lengths, SWITCH), strict=True):
                b = a + len(own)
                out[at] = (model.langs[main], 1.0) if sure else _share(model, own, viterbi(scores[a:b], SWITCH))
                a = b
            held, n = [], 0
    return out


def _share(model: Model, words: list[bytes], path: np.ndarray) -> tuple[str, float]:
    letters = np.bincount(path, [len(w.decode("utf-8", "surrogatepass")) for w in words], len(model.langs))
    top = int(letters.argmax())
    return model.langs[top], float(letters[top] / letters.sum())


def languages(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row; null texts and texts without a letter are ``und`` with score 0."""
    model = model or train(docs, key=key, text=text, lang=lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        out = predict(shared.value, texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["lang", "score"]
        )

    rows = docs.select(column(docs, key).alias(key), (fold(key, 4) == 2).alias("held_out"), run(column(docs, text)).alias("p"))
    return rows.select(key, "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def language_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, lang): spans of one language in characters, from the first to the last letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(column(docs, key).alias(key), column(docs, text).alias("text"))
    schema = T.StructType([
        rows.schema[0], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())
    ])

    def run(batches):
        own = shared.value
        for batch in batches:
            at, first, last, what = [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                found = list(LETTERS.finditer(t or ""))
                if not found or not own.langs:
                    continue
                path = own.path([m.group().lower().encode("utf-8", "surrogatepass") for m in found])
                cuts = np.flatnonzero(np.diff(path)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)], strict=True):
                    at.append(i)
                    first.append(found[a].start())
                    last.append(found[b - 1].end())
                    what.append(own.langs[path[a]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                 pa.array(what, pa.string())], names=schema.names,
            )

    return rows.mapInArrow(run, schema)
