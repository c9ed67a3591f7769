"""Toxicity from document labels: multiple-instance learning over sentences with a noisy-or."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import map_rows, text_of

#: Labelled documents the model is fitted on, about, at most; chosen by a hash of their id.
FIT_DOCUMENTS = 8_000
#: Hashed character n-grams of words, with marked ends, and whole words.
BUCKETS, GRAMS = 1 << 20, (4, 5, 6, 7)
#: Features take part if their share among toxic documents stands out by so many deviations, in so many documents.
LEAST_Z, LEAST_DOCUMENTS = 3.0, 3
STEPS, RATE, DECAY, BIAS = 200, 0.1, 0.01, -5.0
#: A document is predicted toxic from this score on, a sentence is listed from this chance on.
DOCUMENT_LIMIT, SENTENCE_LIMIT = 0.7, 0.5
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")


def sentence_words(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, words) of the sentences that hold a word."""
    out = []
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m[0].lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def features(word: str) -> list[int]:
    marked = f"^{word}$"
    grams = {marked, *(marked[i:i + k] for k in GRAMS for i in range(len(marked) - k + 1))}
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})


def held_out(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit_noisy_or(labels: np.ndarray, documents: list[list[np.ndarray]], of_word: list[list[int]]):
    """Feature weights and bias of the sentence scores, from document labels.

    ``documents`` hold sentences of word numbers, ``of_word`` the features of each word. A sentence is
    toxic with chance s = sigmoid(bias + weights of its words' features), a document with
    1 - prod(1 - s). Full-batch Adam on the documents' log-likelihood, with decay.
    """
    n_docs, n_words = len(labels), len(of_word)
    every, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for label, sentences in zip(labels, documents, strict=True):
        seen = np.unique([f for w in {int(w) for s in sentences for w in s} for f in of_word[w]]).astype(np.int64)
        every[seen] += 1
        toxic[seen] += label
    share = labels.mean() if n_docs else 0.0
    z = (toxic - every * share) / np.sqrt(np.maximum(every * share * (1 - share), 1e-9))
    chosen = np.flatnonzero((z > LEAST_Z) & (toxic >= LEAST_DOCUMENTS))
    number = np.full(BUCKETS, -1)
    number[chosen] = np.arange(len(chosen))
    word_of = np.repeat(np.arange(n_words), [len(f) for f in of_word])
    feature = number[np.array([f for fs in of_word for f in fs], np.int64)]
    word_of, feature = word_of[feature >= 0], feature[feature >= 0]
    live = np.zeros(n_words, bool)
    live[word_of] = True
    sentences = [s[live[s]] for ss in documents for s in ss]
    doc_of = np.repeat(np.arange(n_docs), [len(ss) for ss in documents])
    sentence_of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    words = np.concatenate([*sentences, np.zeros(0, np.int64)])
    w, first, second = (np.zeros(len(chosen) + 1) for _ in range(3))
    w[-1] = BIAS
    for step in range(1, STEPS + 1):
        by_word = np.bincount(word_of, w[feature], n_words)
        z = np.bincount(sentence_of, by_word[words], len(sentences)) + w[-1]
        total = np.bincount(doc_of, np.logaddexp(0, z), n_docs)
        slope = np.where(labels > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0)
        by_sentence = slope[doc_of] / (1 + np.exp(-z))
        back = np.bincount(words, by_sentence[sentence_of], n_words)
        grad = np.append(np.bincount(feature, back[word_of], len(chosen)), by_sentence.sum())
        grad[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad ** 2
        w -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
        np.maximum(w[:-1], 0, out=w[:-1])  # chosen features speak for toxicity only
    return chosen, w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> tuple[dict[int, float], float]:
    """Fit on labelled documents outside the held-out third: all of them, or, beyond ``fit_documents``,
    those whose hashed id is small enough. Sentences are split in parallel; one task, bounded by
    ``fit_documents`` texts, fits. Only the weights of the chosen features reach the driver."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id")).dropDuplicates(["id"])
    share = min(1.0, fit_documents / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    # Bounded by fit_documents, a few hundred kB.
    sample = text_of(docs, id_col, text_col).join(F.broadcast(chosen), "id")

    def start():
        def step(texts, labels):
            lines = ["\n".join(" ".join(sorted(ws)) for _, _, ws in sentence_words(t)) for t in texts]
            return labels, lines

        return step

    split = map_rows(sample.select("text", F.col("label").cast("double")), start, "label double, words string",
                     {"label": pa.float64(), "words": pa.string()})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        labels, documents = [], []
        for batch in batches:
            for label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                labels.append(label)
                documents.append([np.array([known.setdefault(w, len(known)) for w in line.split(" ")], np.int64)
                                  for line in text.split("\n") if line])
        chosen, weights, bias = fit_noisy_or(np.array(labels), documents, [features(w) for w in known])
        yield pa.RecordBatch.from_pylist([{"chosen": chosen.tolist(), "weights": weights.tolist(), "bias": bias}])

    row = split.repartition(1).mapInArrow(fit, "chosen array<long>, weights array<double>, bias double").first()
    if row is None:
        return {}, BIAS
    return dict(zip(row["chosen"], row["weights"], strict=True)), row["bias"]


def scored(docs: DataFrame, weights: dict[int, float], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text, and ``sentences``: (start, end, score) of the offending ones."""

    def start():
        known: dict[str, float] = {}

        def weight(word):
            value = known.get(word)
            if value is None:
                if len(known) > 1 << 19:
                    known.clear()
                value = known[word] = sum(weights.get(f, 0.0) for f in features(word))
            return value

        def step(ids, texts):
            scores, listed = [], []
            for text in texts:
                total, bad = 0.0, []
                for begin, end, words in sentence_words(text):
                    z = bias + sum(map(weight, sorted(words)))
                    total += np.logaddexp(0, z)
                    if z >= limit:
                        bad.append({"start": begin, "end": end, "score": float(1 / (1 + np.exp(-z)))})
                scores.append(float(-np.expm1(-total)))
                listed.append(bad)
            return ids, scores, listed

        return step

    limit = float(np.log(SENTENCE_LIMIT / (1 - SENTENCE_LIMIT)))
    entry = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    return map_rows(text_of(docs, id_col, text_col), start,
                    "doc_id long, score double, sentences array<struct<start: long, end: long, score: double>>",
                    {"doc_id": pa.int64(), "score": pa.float64(), "sentences": pa.list_(entry)})


def toxicity(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Score every whole text; learn from the labels outside the held-out third.

    Returns doc_id, held_out, score, predicted and the offending sentences (code points). A text without
    words scores 0; null texts are empty; null ids stay null (not held out); unlabelled or null-labelled
    rows only get scores; repeated labels count once; without any label every score is that of the bias.
    """
    weights, bias = train(docs, labels, fit_documents, id_col, text_col)
    return scored(docs, weights, bias, id_col, text_col).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= DOCUMENT_LIMIT).cast("int").alias("predicted"), "sentences")
