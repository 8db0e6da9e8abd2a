"""Language ID by inference of multilingual mixtures.

A model holds, per language, the smoothed frequencies of hashed byte n-grams of words, counted
over all labelled training rows. A document's words are units: the likelihood of a word under a
language is that of its n-grams. Expectation-maximisation estimates the shares of the languages
in a document; the set of languages is grown along the order of their shares as long as the
penalised likelihood (BIC) gets better. The language with the largest share is the prediction,
its share the score.

`fit_score` tells how well the chosen mixture explains the text: the log likelihood per n-gram, 1 at
what the training text of its languages has, 0 at that of n-grams drawn evenly from all buckets.
Text in a language that was not learned, or letters without sense, come near 0 or below; a mixture of
learned languages stays near 1. `expected_fit` is the least value that text of the languages reaches,
given how much the n-grams of a text of that length vary.

Words are runs of letters, in lower case. Null text and text without letters is `und` with score
0, as is every text if no row is labelled. Ties go to the first language in code point order.
Repeated rows are counted and judged each; an empty table learns nothing and gives no rows. Counting
emits one row per task, language and bucket; a language's table is packed on the executors, 0.8 MB
each, and more than `max_languages` of them stop the job, so what reaches the driver and is broadcast
is bounded. Texts are handled in
pieces of about a million characters, a longer text alone and whole. Columns of the input that
share a name with a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitrec.llm.common import replaced

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (2, 3, 4)
PIECE_CHARS = 1_000_000
UNKNOWN = "und"
# Text of a learned language fits at least half way between evenly drawn n-grams and training text.
LEAST_FIT = 0.5


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies `(orders * buckets, languages)` of every n-gram bucket."""

    languages: tuple[str, ...]
    logs: np.ndarray
    buckets: int
    means: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of an n-gram's log frequency in the language
    spreads: np.ndarray = field(default_factory=lambda: np.zeros(0))  # its standard deviation


@dataclass(frozen=True)
class Words:
    """The words of some documents: distinct words and, per document, their numbers and counts."""

    distinct: list[str]
    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    numbers: dict[str, int] = {}
    docs, words, counts = [], [], []
    for place, text in enumerate(texts):
        found = LETTERS.findall(text.lower()) if text else []
        if found:
            codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
            distinct, n = np.unique(codes, return_counts=True)
            docs.append(np.full(len(distinct), place))
            words.append(distinct)
            counts.append(n)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    doc, word, count = join(docs), join(words), join(counts)
    # The pattern also lets signs like a raised two pass; a word needs a letter.
    lettered = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in numbers], bool)
    if not lettered.all():
        kept = lettered[word]
        doc, word, count = doc[kept], word[kept], count[kept]
    return Words(list(numbers), doc, word, count)


def ngram_buckets(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of every word, and the number of the word it belongs to."""
    encoded = [b" " + w.encode() + b" " for w in words]
    data = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes to the word's end
    found, owners = [], []
    for place, order in enumerate(ORDERS):
        at = np.flatnonzero(left >= order)
        code = np.zeros(len(at), np.uint64)
        for k in range(order):
            code = (code ^ data[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        found.append((code % np.uint64(buckets)).astype(np.int64) + place * buckets)
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


def _pieces(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > PIECE_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 16, smoothing: float = 0.5,
    max_languages: int = 200,
) -> LanguageModel:
    """Count n-grams per language over all rows of `labelled` whose language is not null."""
    width = len(ORDERS) * buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for piece in _pieces([len(t) for t in texts]):
                words = words_of(texts[piece])
                if not words.distinct:
                    continue
                found, owner = ngram_buckets(words.distinct, buckets)
                of_doc = np.array(langs[piece], object)[words.doc]
                for name in set(langs[piece]):
                    here = of_doc == name
                    weight = np.bincount(words.word[here], words.count[here], len(words.distinct))
                    total = totals.setdefault(name, np.zeros(width))
                    total += np.bincount(found, weight[owner], width)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))],
                ["lang", "bucket", "n"],
            )

    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).dropna()
    counts = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def table(key: tuple, part: pa.Table) -> pa.Table:
        logs, mean, spread = log_table(part["bucket"].to_numpy(), part["n"].to_numpy(), buckets, smoothing)
        return pa.table({"lang": [key[0].as_py()], "logs": pa.array([logs.tobytes()], pa.binary()), "mean": [mean], "spread": [spread]})

    # One language holds at most orders x buckets rows.
    packed = counts.groupBy("lang").applyInArrow(table, "lang string, logs binary, mean double, spread double")
    found = sorted(packed.limit(max_languages + 1).collect(), key=lambda r: r["lang"].encode())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages in the column {lang}: map them to fewer first, or raise max_languages")
    logs = np.stack([np.frombuffer(r["logs"], np.float32) for r in found], 1) if found else np.zeros((width, 0), np.float32)
    return LanguageModel(
        tuple(r["lang"] for r in found), logs, buckets, np.array([r["mean"] for r in found]), np.array([r["spread"] for r in found])
    )


def log_table(bucket: np.ndarray, n: np.ndarray, buckets: int, smoothing: float) -> tuple[np.ndarray, float, float]:
    """Smoothed log frequencies of one language, each a part of the orders' mean, and how they vary in its text."""
    counts = np.zeros(len(ORDERS) * buckets)
    counts[bucket] = n
    logs, means, squares = np.zeros(len(counts)), [], []
    for place in range(len(ORDERS)):
        own = slice(place * buckets, (place + 1) * buckets)
        share = (counts[own] + smoothing) / (counts[own].sum() + smoothing * buckets)
        logs[own] = np.log(share)
        seen = counts[own] / max(counts[own].sum(), 1)
        means.append((seen * logs[own]).sum())
        squares.append((seen * logs[own] ** 2).sum())
    mean = float(np.mean(means))
    spread = float(np.sqrt(max(np.mean(squares) - np.mean(np.square(means)), 0.0)))
    return (logs / len(ORDERS)).astype(np.float32), mean, spread


def shares(likelihood: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: shares `(docs, languages)` and log likelihoods.

    `likelihood` has the log likelihood of each unit; a document's units lie together from
    `starts` on; languages that are not `allowed` keep share 0. A document stops by itself, so its
    shares do not depend on the others.
    """
    lengths = np.diff(np.append(starts, len(counts)))
    top = likelihood.max(1, keepdims=True)
    scaled = np.exp(likelihood - top)
    totals = np.add.reduceat(counts, starts)[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    moving = np.ones((len(starts), 1), bool)
    for _ in range(50):
        joint = np.repeat(share, lengths, 0) * scaled
        mass = np.maximum(joint.sum(1, keepdims=True), 1e-300)
        new = np.add.reduceat(joint * (counts[:, None] / mass), starts) / totals
        new = np.where(moving, new, share)
        moving &= np.abs(new - share).max(1, keepdims=True) >= 1e-3
        share = new
        if not moving.any():
            break
    mass = np.maximum((np.repeat(share, lengths, 0) * scaled).sum(1), 1e-300)
    return share, np.add.reduceat(counts * (np.log(mass) + top[:, 0]), starts)


def _best_sets(likelihood: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shares of the set of languages with the best penalised likelihood, per document."""
    n_docs, n_langs = len(starts), likelihood.shape[1]
    totals = np.add.reduceat(counts, starts)
    penalty = np.log(totals)
    rank = np.argsort(np.argsort(-shares(likelihood, counts, starts, np.ones((n_docs, n_langs)))[0], 1, "stable"), 1)
    alone = np.add.reduceat(likelihood * counts[:, None], starts)
    best = np.zeros((n_docs, n_langs))
    best[np.arange(n_docs), alone.argmax(1)] = 1.0
    score = -2 * alone.max(1)
    growing = np.arange(n_docs)
    lengths = np.diff(np.append(starts, len(counts)))
    for size in range(2, n_langs + 1):
        units = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in growing])
        own = np.concatenate([[0], np.cumsum(lengths[growing])[:-1]])
        share, fit_ = shares(likelihood[units], counts[units], own, (rank[growing] < size).astype(float))
        value = -2 * fit_ + (size - 1) * penalty[growing]
        better = value < score[growing]
        best[growing[better]], score[growing[better]] = share[better], value[better]
        growing = growing[better]
        if not len(growing):
            break
    return best


def infer(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the languages per text, a row of zeros where there are no letters; fit and expected fit."""
    result = np.zeros((len(texts), len(model.languages)))
    explained, expected = np.zeros(len(texts)), np.zeros(len(texts))
    for piece in _pieces([len(t or "") for t in texts]):
        words = words_of(texts[piece])
        if not len(words.doc):
            continue
        found, owner = ngram_buckets(words.distinct, model.buckets)
        per_word = np.stack(
            [np.bincount(owner, model.logs[found, i], len(words.distinct)) for i in range(len(model.languages))], 1
        )
        docs, starts = np.unique(words.doc, return_index=True)
        counts = words.count.astype(float)
        best = _best_sets(per_word[words.word], counts, starts)
        rows = piece.start + docs
        result[rows] = best
        grams = np.bincount(owner, minlength=len(words.distinct))[words.word] / len(ORDERS)  # a word's, per order
        n = np.add.reduceat(counts * grams, starts)
        lengths = np.diff(np.append(starts, len(counts)))
        joint = np.repeat(np.log(np.maximum(best, 1e-300)), lengths, 0) + per_word[words.word]
        top = joint.max(1)
        likelihood = np.add.reduceat(counts * (top + np.log(np.exp(joint - top[:, None]).sum(1))), starts) / n
        even, usual = -np.log(model.buckets), best @ model.means
        explained[rows] = (likelihood - even) / (usual - even)
        # distinct words, as a word said ten times varies no less than one said once
        distinct = np.add.reduceat(grams, starts)
        expected[rows] = LEAST_FIT - 3 * (best @ model.spreads) / np.sqrt(distinct) / (usual - even)
    return result, explained, expected


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`df` with `lang_pred`, `score`, `languages`, the chosen set by falling share, and how well it fits."""
    names = ("lang_pred", "score", "languages", "fit_score", "expected_fit")
    held = df.sparkSession.sparkContext.broadcast(
        (model.languages, model.logs, model.buckets, model.means, model.spreads)
    )

    def predict(texts: pd.Series) -> pd.DataFrame:
        model = LanguageModel(*held.value)
        nothing = (UNKNOWN, 0.0, [], 0.0, 0.0)
        if not model.languages:
            return pd.DataFrame([nothing] * len(texts), columns=names)
        rows = []
        for share, fits, least in zip(*infer([t if isinstance(t, str) else None for t in texts], model)):
            order = np.argsort(-share, kind="stable")
            chosen = [model.languages[i] for i in order if share[i] > 0]
            rows.append((chosen[0], float(min(share[order[0]], 1.0)), chosen, float(fits), float(least)) if chosen else nothing)
        return pd.DataFrame(rows, columns=names)

    kind = "lang_pred string, score double, languages array<string>, fit_score double, expected_fit double"
    found = df.withColumn("__language", F.pandas_udf(predict, kind)(F.col(f"`{text}`")))
    return replaced(found, **{n: F.col(f"__language.{n}") for n in names}).drop("__language")


def held_out(id: str = "doc_id"):
    """True for the third of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string")) % 3 == 1, F.lit(False))
