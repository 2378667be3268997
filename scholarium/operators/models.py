"""Places where a model plugs in: embedders and labellers, with offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.text import count_tokens, words
from scholarium.operators.ordering import fixed_batches
from scholarium.operators.prompts import batch_prompts, parse_batch_answers, parse_cluster_answers
from scholarium.operators.tables import fill_column, pending
from scholarium.operators.usage import pack_by_budget
from scholarium.session import cut_lineage

Embedder = Callable[[Sequence[str]], np.ndarray]
Labeler = Callable[[Sequence[str]], Sequence[str]]


def embed(df: DataFrame, embedder: Embedder, text: str = "text", key: str = "id") -> DataFrame:
    """(key, embedding) from a user function on lists of texts; whole Arrow batches per call."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = np.asarray(embedder(pdf[text].tolist()), dtype="float32")
                yield pd.DataFrame({key: pdf[key], "embedding": list(vectors)})

    return df.select(key, text).mapInPandas(run, f"`{key}` {key_type}, embedding array<float>")


def hashed_tfidf(df: DataFrame, dim: int = 2048, text: str = "text", key: str = "id") -> DataFrame:
    """Offline default embedder: hashed words, weighted by idf, scaled to length one. JVM-side throughout."""
    tokens = df.select(key, words(text).alias("_w"))
    tf = HashingTF(numFeatures=dim, inputCol="_w", outputCol="_tf").transform(tokens)
    weighted = IDF(inputCol="_tf", outputCol="_x").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_x", outputCol="_u").transform(weighted)
    return unit.select(key, vector_to_array("_u", "float32").alias("embedding"))


def embedding_calls(texts: DataFrame, per_call: int = 128, token_limit: int = 120_000) -> DataFrame:
    """(batch, sub_batch, position, id): which call to an embedder takes which of ``texts(id, text)``, in order of id.

    A call has at most ``per_call`` texts and ``token_limit`` tokens; a text above the limit is in no call. Texts
    stay where they are, only ids and token counts move.
    """
    counted = texts.select("id", count_tokens("text").alias("tokens"))
    return pack_by_budget(fixed_batches(counted, ["id"], per_call), token_limit).select("batch", "sub_batch", "position", "id")


def embed_calls(calls: DataFrame, texts: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, embedding) with one call of ``embedder`` per (batch, sub_batch); it must answer every text."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        vectors = np.asarray(embedder(pdf["text"].tolist()), dtype="float32")
        if len(vectors) != len(pdf):
            raise ValueError(f"{len(vectors)} vectors for {len(pdf)} texts")
        return pd.DataFrame({"id": pdf["id"], "embedding": list(vectors)})

    named = calls.join(texts.select("id", "text"), "id").select("batch", "sub_batch", "position", "id", "text")
    return named.groupBy("batch", "sub_batch").applyInPandas(run, f"id {id_type}, embedding array<float>")


def embed_pending(
    papers: DataFrame, texts: DataFrame, embedder: Embedder | None = None, dim: int = 2048, per_call: int = 128, token_limit: int = 120_000
) -> DataFrame:
    """Fill ``embedding`` of the papers that have none; ``texts`` has (id, text), null counts as empty.

    The vectors are written before they are joined, so that nothing asks for them twice. Papers whose
    text is missing or above the limit of a call stay pending. The default embedder has no calls.
    """
    queue = texts.join(pending(papers, "embedding").select("id"), "id", "left_semi").withColumn("text", F.coalesce("text", F.lit("")))
    if embedder is None:
        return fill_column(papers, hashed_tfidf(queue, dim), "id", "embedding")
    vectors = cut_lineage(embed_calls(embedding_calls(queue, per_call, token_limit), queue, embedder))
    return fill_column(papers, vectors, "id", "embedding")


def ask(prompts: DataFrame, labeler: Labeler, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``prompts`` with the answer of a labelling function to each prompt."""
    kept = prompts.select(*keep)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[list(keep)].assign(answer=list(labeler(pdf["prompt"].tolist())))

    return prompts.select(*keep, "prompt").mapInPandas(run, f"{types}answer string")


def label_prompts(prompts: DataFrame, labeler: Labeler, key: str = "cluster_id") -> DataFrame:
    """Answers of a labelling function to prompts (key, prompt), parsed and checked."""
    return parse_cluster_answers(ask(prompts, labeler, key))


def label_papers(papers: DataFrame, labeler: Labeler, instructions: str, size: int = 400, column: str = "llm_category") -> DataFrame:
    """Fill ``column`` of the papers that have none, asking for ``size`` of them in one prompt.

    An answer must be a JSON array with a label for each paper. Where it is not, the prompt's papers are halved and
    asked again, so a paper that spoils its prompt is found in as many rounds as ``size`` has binary digits,
    and stays pending alone. Only papers of spoiled prompts take part in a further round.
    """
    queue = pending(papers, column).select(
        "id", *[F.coalesce(c, F.lit("None")).alias(c) for c in ("title", "abstract")]
    )
    items = cut_lineage(fixed_batches(queue.select("id"), ["id"], size))
    labels: DataFrame | None = None
    while True:
        prompts = batch_prompts(items.join(queue, "id"), instructions)
        answers = cut_lineage(parse_batch_answers(ask(prompts, labeler, "batch", "n_items")))
        good = answers.where("rejected IS NULL").select("batch", F.posexplode("labels").alias("position", column))
        found = items.join(good, ["batch", "position"]).select("id", column)
        labels = found if labels is None else labels.unionByName(found)
        spoiled = answers.where("rejected IS NOT NULL AND n_items > 1").select("batch", F.ceil(F.col("n_items") / 2).alias("half"))
        if spoiled.isEmpty():
            return fill_column(papers, labels, "id", column)
        late = (F.col("position") >= F.col("half")).cast("long")
        items = cut_lineage(items.join(spoiled, "batch").select(
            "id", (F.col("batch") * 2 + late).alias("batch"), (F.col("position") - late * F.col("half")).alias("position")
        ))


def keyword_labels(keyword_lines: DataFrame) -> DataFrame:
    """Offline default labels: the top keywords; relevance stays unknown."""
    return keyword_lines.select(
        "cluster_id", F.initcap("keywords").alias("label"), F.lit(None).cast("double").alias("safety_relevance")
    )
