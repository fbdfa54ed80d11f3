"""Quality classifier from weak labels: overlapping heuristic labellers, EM for their accuracies, a hashed linear scorer.

Each labeller votes good, bad or abstains on every document. Votes are counted by pattern, of which there are at most
3 ** LABELLERS whatever the corpus, and expectation-maximisation over the patterns estimates the share of good documents and each
labeller's vote probabilities given the class, votes being independent within a class and
labellers being better than chance a priori. The first round takes documents without a bad vote for good.

The posterior of its pattern is a document's soft label. A logistic scorer on hashed features (words, word shapes) is
fitted to the soft labels of a sample of at most SAMPLE documents, those that come first by a hash of doc_id and text, so
that reruns agree; equal rows tie and any of them may be the last of the sample. All documents are scored. The
fitted weights have a fixed size and are all that is broadcast, with the posteriors of the patterns.

Null and empty texts get the score 0 and aren't kept. A null doc_id is a value like others. Repeated rows get equal
results. Only doc_id and text are read. An empty table has no result rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.generate import bounded_batches
from corpusloom.llm.common import SPACE_FREE, mix, text_slices, word_hashes, word_spans

LABELLERS = 8
SAMPLE = 4000
DIM = 1 << 12
THRESHOLD = 0.3
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Prior of a vote (abstain, bad, good) given the class (bad, good), as heavy as PRIOR documents whatever the corpus: it only
#: says which of the two classes is the bad one, and keeps what no document shows above 0.
BELIEF, PRIOR = np.array([[0.5, 0.3, 0.2], [0.59, 0.01, 0.4]]), 10.0

#: Frequent function words of the corpus's languages; fixed values
FUNCTION_WORDS = "the of and to in a is that for it was on be with as by are this de la le et les des en un une que est du el los y las se por con der die und das den von zu ist mit sich im".split()

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=_"]] = 1
_SHOUT = np.zeros(256, np.int64)
_SHOUT[ord("!")] = 1
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_STOP = np.sort(np.array([word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0] for w in FUNCTION_WORDS]))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))


def _repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 for each word that equals the word before it in its document."""
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = 0
    return same


def _longest(repeats: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length of the longest run of ones in each document."""
    at = np.arange(1, len(repeats) + 1)
    runs = at - np.maximum.accumulate(np.where(repeats == 0, at, 0)) if len(at) else at
    out = np.zeros(len(first) - 1, np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.maximum.reduceat(runs, first[:-1][full])
    return out


def votes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One row a document, one column a labeller."""
    n = np.diff(first)
    chars = np.maximum(_sums(SPACE_FREE[data], offsets), 1)
    share = lambda table: _sums(table[data], offsets) / chars
    symbols, shouts, capitals, letters = (share(t) for t in (_SYMBOL, _SHOUT, _CAPITAL, _LETTER))
    stops = _sums(_STOP[np.minimum(np.searchsorted(_STOP, words), len(_STOP) - 1)] == words, first) / np.maximum(n, 1)
    length = _sums(ends - starts, first) / np.maximum(n, 1)
    repeats = _repeats(words, first)
    again, run = _sums(repeats, first) / np.maximum(n, 1), _longest(repeats, first)
    none = np.zeros(len(n), bool)
    return np.stack(
        [
            _vote(symbols > 0.06, none),
            _vote(shouts > 0.03, none),
            _vote(capitals > 0.25, none),
            _vote(letters < 0.8, none),
            _vote(run >= 3, none),
            _vote(again > 0.15, none),
            _vote((n >= 30) & (stops < 0.04), stops > 0.12),
            _vote((length > 12) | (length < 2.5), (length > 3.5) & (length < 8)),
        ],
        axis=1,
    )


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: np.ndarray) -> Iterator[np.ndarray]:
    """A vector of DIM hashed counts, log-scaled, of unit length by halves, for each document: words in one half, in the other the collapsed
    shapes of words, or for words that repeat the one before them a mark of that."""
    half = np.uint64(DIM // 2)
    shape = _SHAPE[data]
    keep = SPACE_FREE[data]
    same = np.zeros(len(shape), bool)
    same[1:] = shape[1:] == shape[:-1]
    same[starts] = False
    keep = keep & ~same
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = word_hashes(shape[keep], place[starts], place[ends]) if len(starts) else words
    slots = np.stack([words % half, np.where(_repeats(words, first) > 0, half, mix(shapes) % half + half)]).astype(np.int64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        vector = np.log1p(np.bincount(slots[:, a:b].ravel(), minlength=DIM))
        for part in (vector[: DIM // 2], vector[DIM // 2 :]):
            part /= max(1e-9, np.sqrt((part * part).sum()))
        yield vector


def _each(batch_texts: pa.Array) -> Iterator[tuple]:
    for i, j, data, offsets in text_slices(batch_texts):
        starts, ends, first = word_spans(data, offsets, SPACE_FREE)
        words = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        yield i, j, data, offsets, starts, ends, first, words


_POWERS3 = 3 ** np.arange(LABELLERS)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets, starts, ends, first, words in _each(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(votes(data, offsets, starts, ends, first, words) @ _POWERS3)], ["doc_id", "pattern"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class) of each labeller (class, labeller, vote), and the share of good."""
    vote = (patterns[:, None] // _POWERS3) % 3
    one_hot = vote[:, :, None] == np.arange(3)
    posterior = np.where((vote == BAD).any(axis=1), 0.1, 0.9)
    prior, table = 0.5, np.zeros((2, LABELLERS, 3))
    for _ in range(rounds):
        for c, weight in enumerate((1 - posterior, posterior)):
            table[c] = np.einsum("p,plv->lv", counts * weight, one_hot) + PRIOR * BELIEF[c]
            table[c] /= table[c].sum(axis=1, keepdims=True)
        prior = float(np.clip((counts * posterior).sum() / max(counts.sum(), 1), 0.01, 0.99))
        logs = np.einsum("plv,clv->pc", one_hot, np.log(table)) + np.log([1 - prior, prior])
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))
        if np.abs(before - posterior).max(initial=0) < 1e-9:
            break
    return posterior, table, prior


def fit(vectors: np.ndarray, soft: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer: full gradients with momentum, rare class weighted up, small ridge."""
    weights, bias = np.zeros(DIM, np.float32), 0.0
    speed, bias_speed = np.zeros(DIM, np.float32), 0.0
    soft = soft.astype(np.float32)
    share = min(max(float(soft.mean()) if len(soft) else 0.5, 0.02), 0.98)
    balance = soft * 0.5 / share + (1 - soft) * 0.5 / (1 - share)
    for _ in range(rounds if len(soft) else 0):
        error = balance * (1 / (1 + np.exp(-(vectors @ weights + bias))) - soft)
        speed = 0.9 * speed - 2.0 * (vectors.T @ error / len(soft) + 1e-5 * weights)
        bias_speed = 0.9 * bias_speed - 0.5 * error.mean()
        weights, bias = weights + speed, bias + bias_speed
    return weights, bias


def quality_scores(documents: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, kept, weak_label (posterior of the votes) of every row of documents (doc_id, text)."""
    bounded_batches(documents.sparkSession)
    documents = documents.select("doc_id", "text")
    counted = documents.mapInArrow(_patterns, "doc_id bigint, pattern bigint").groupBy("pattern").count().toPandas()
    posterior, _, _ = estimate(counted["pattern"].to_numpy(np.int64), counted["count"].to_numpy(np.float64))
    by_pattern = dict(zip(counted["pattern"].tolist(), posterior.tolist(), strict=True))

    total = int(counted["count"].sum())
    part = min(1.0, sample / max(total, 1))
    place = F.xxhash64("doc_id", "text")
    drawn = documents.withColumn("place", place).where(F.pmod("place", F.lit(1_000_003)) <= int(2 * part * 1_000_003))
    drawn = drawn.orderBy("place", F.col("doc_id").asc_nulls_last(), "text").limit(sample).select("doc_id", "text")
    rows = drawn.mapInArrow(_labelled_vectors(by_pattern), "soft double, vector binary").toPandas()
    rows = rows.sort_values(["soft", "vector"], kind="stable")  # one order of sums, whatever the order of arrival
    vectors = np.frombuffer(b"".join(rows["vector"]), np.float32).reshape(-1, DIM)
    weights, bias = fit(vectors, rows["soft"].to_numpy())

    shared = documents.sparkSession.sparkContext.broadcast((weights.astype(np.float32), float(bias), by_pattern))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, known = shared.value
        for batch in batches:
            for i, j, data, offsets, starts, ends, first, words in _each(batch.column(1)):
                raw = np.array([v @ weights + bias for v in hashed(data, starts, ends, first, words)])
                value = np.where(np.diff(first) > 0, 1 / (1 + np.exp(-raw)), 0.0)
                soft = [known[p] for p in (votes(data, offsets, starts, ends, first, words) @ _POWERS3).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(value), pa.array(value >= threshold), pa.array(soft)], ["doc_id", "score", "kept", "weak_label"])

    return documents.mapInArrow(score, "doc_id bigint, score double, kept boolean, weak_label double")


def _labelled_vectors(by_pattern: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets, starts, ends, first, words in _each(batch.column(1)):
                soft = [by_pattern[p] for p in (votes(data, offsets, starts, ends, first, words) @ _POWERS3).tolist()]
                vectors = [v.astype(np.float32).tobytes() for v in hashed(data, starts, ends, first, words)]
                yield pa.RecordBatch.from_arrays([pa.array(soft, pa.float64()), pa.array(vectors, pa.binary())], ["soft", "vector"])

    return run
