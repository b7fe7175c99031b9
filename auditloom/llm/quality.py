"""Text quality from weak labels (operator 4).

Heuristic labellers each vote good, bad or abstain on every text. How often each pattern of votes occurs is
counted over all texts; there are 3 ** (number of labellers) patterns at most, whatever the corpus. From
these counts expectation-maximisation estimates the share of good texts and each labeller's accuracy,
and so a posterior for every pattern. Posteriors of a bounded sample of whole texts
then train a linear scorer on hashed words and word shapes, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, SPACED, Chunk, chunks, mix, gram_hashes

#: Texts that train the scorer at most, and hashed features.
SAMPLE, SLOTS = 3000, 1 << 18

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "a and are as at be by for he in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine er es ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "con del el las los no para por se su y"
).split()

#: A labeller's feature, the value from which it votes bad, and that from which it votes good,
#: if it ever does: the absence of a defect is no sign of quality. Where bad is above good, or there is
#: no good, high values are bad; else low values are.
LABELLERS = [
    ("symbols", 0.08, None),
    ("capitals", 0.6, None),
    ("repeats", 0.3, None),
    ("echoes", 0.45, 0.25),
    ("shouts", 0.25, None),
    ("functions", 0.05, 0.14),
    ("bars", 0.2, None),
    ("oddities", 0.3, None),
    ("marked", 0.25, None),
]
#: Texts of fewer words get no vote on the shares of words.
FEW = 8

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 0x30, 0x41, 0x61, 0x61
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#$%&*@^~<>|{}[]\\=+_"]] = True
_LETTER = (_CLASS == 0x41) | (_CLASS == 0x61)


def _function_hashes() -> np.ndarray:
    (c,) = chunks(pa.array([" ".join(FUNCTION_WORDS)]), SPACED, LOWER)
    return np.unique(c.hashes())


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first])


def measures(c: Chunk, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' features of each text, NaN where a text has too few words."""
    n, few = c.counts, c.counts < FEW
    letters, size = _sums(_LETTER[c.data], c.offsets), _sums(~np.isin(c.data, np.flatnonzero(~SPACED)), c.offsets)
    tail = c.data[c.end - 1] if len(c.end) else np.zeros(0, np.uint8)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1])
    same[c.first[:-1][n > 0]] = False
    echo, text = same.copy(), c.texts()
    for j in (2, 3, 4):
        echo[j:] |= (hashes[j:] == hashes[:-j]) & (text[j:] == text[:-j])
    functions = np.isin(hashes, _function_hashes())
    with np.errstate(divide="ignore", invalid="ignore"):
        by_word = {"repeats": same, "echoes": echo, "shouts": tail == ord("!"), "functions": functions & ~echo, "bars": (tail == ord("|")) & (c.end - c.start == 1), "marked": _SYMBOL[tail] & (c.end - c.start > 1)}
        out = {k: np.where(few, np.nan, _sums(v, c.first) / n) for k, v in by_word.items()}
        out["symbols"] = _sums(_SYMBOL[c.data], c.offsets) / size
        out["capitals"] = _sums(_CLASS[c.data] == 0x41, c.offsets) / letters
        out["oddities"] = 1 - letters / size
    return out


def votes(c: Chunk, hashes: np.ndarray) -> np.ndarray:
    """Text x labeller: 0 abstains, 1 is bad, 2 is good."""
    found, out = measures(c, hashes), np.zeros((len(c.counts), len(LABELLERS)), np.int64)
    for k, (name, bad, good) in enumerate(LABELLERS):
        x = found[name]
        high = good is None or bad > good
        fine = False if good is None else x <= good if high else x >= good
        out[:, k] = np.where(np.isnan(x), 0, np.where(x >= bad if high else x <= bad, 1, np.where(fine, 2, 0)))
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def estimate(counts: dict[int, int], n_labellers: int, rounds: int = 100) -> tuple[float, np.ndarray]:
    """The share of good texts, and each labeller's accuracy: how often it is right when it votes.

    Expectation-maximisation; an abstention says nothing. A few pseudo-votes keep accuracies off 0 and 1,
    and a labeller that seems worse than a coin counts as one.
    """
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in keys.tolist()], np.float64)
    v = keys[:, None] // 3 ** np.arange(n_labellers) % 3
    prior, accuracy = 0.7, np.full(n_labellers, 0.8)
    for _ in range(rounds if len(keys) else 0):
        good = posterior(v, prior, accuracy)
        right = (n * good) @ (v == 2) + (n * (1 - good)) @ (v == 1)
        accuracy = np.maximum((right + 8) / (n @ (v > 0) + 10), 0.5)
        prior = float((n @ good + 1) / (n.sum() + 2))
    return prior, accuracy


def posterior(v: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """The probability that texts with such votes are good."""
    odds = np.log(accuracy) - np.log(1 - accuracy)
    z = ((v == 2).astype(np.float64) - (v == 1)) @ odds + np.log(prior) - np.log(1 - prior)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Scorer(NamedTuple):
    prior: float
    accuracy: np.ndarray
    weights: np.ndarray
    bias: float


def slots(c: Chunk, hashes: np.ndarray) -> np.ndarray:
    """For each word its hashed feature, that of its shape, and that of whether it repeats the word before."""
    kind = _CLASS[c.data]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[c.start] = True
    at = np.concatenate([[0], np.cumsum(turn)])
    shape = gram_hashes(kind[turn].astype(np.uint64) + np.uint64(1), at[c.start], at[c.end])
    same = np.zeros(len(hashes), np.uint64)
    same[1:] = hashes[1:] == hashes[:-1]
    same[c.first[:-1][c.counts > 0]] = 0
    return (np.stack([mix(hashes), mix(shape + np.uint64(1)), mix(same + np.uint64(2))], 1) & np.uint64(SLOTS - 1)).astype(np.int64)


def train(texts: list[str], prior: float, accuracy: np.ndarray, rounds: int = 60, rate: float = 0.5) -> Scorer:
    """Logistic regression on the posteriors, each text's features averaged over its words."""
    found, labels, sizes = [], [], []
    for c in chunks(pa.array(texts, pa.string()), SPACED, LOWER):
        h, full = c.hashes(), c.counts > 0
        found.append(slots(c, h))
        labels.append(posterior(votes(c, h), prior, accuracy)[full])
        sizes.append(c.counts[full])
    weights, bias, seen, seen_b = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-8), 1e-8
    if sum(len(x) for x in labels):
        slot, y, n = np.concatenate(found), np.concatenate(labels), np.concatenate(sizes)
        begin, share = np.cumsum(n) - n, np.repeat(1 / n, n)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(weights[slot].sum(1), begin) / n, -30, 30)))
            error = (p - y) / len(y)
            spread = np.repeat(error, n) * share
            grad = sum(np.bincount(slot[:, k], spread, SLOTS) for k in range(slot.shape[1])) + 1e-6 * weights
            seen += grad**2
            seen_b += error.sum() ** 2
            weights -= rate * grad / np.sqrt(seen)
            bias -= 0.1 * rate * error.sum() / np.sqrt(seen_b)
    return Scorer(prior, accuracy, weights.astype(np.float32), float(bias))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for c in chunks(batch.column(0), SPACED, LOWER):
            full = c.counts > 0
            counts += np.bincount(pattern(votes(c, c.hashes()))[full], minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"pattern": some, "n": counts[some]})


def _scores(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        for c in chunks(column, SPACED, LOWER):
            h, n, full = c.hashes(), c.rows.stop - c.rows.start, c.counts > 0
            total = np.concatenate([[0.0], np.cumsum(scorer.weights[slots(c, h)].sum(1, dtype=np.float64))])
            z = scorer.bias + np.diff(total[c.first]) / np.maximum(c.counts, 1)
            score = np.where(full, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            good = np.where(full, posterior(votes(c, h), scorer.prior, scorer.accuracy), 0.0)
            yield pa.RecordBatch.from_arrays([*(x.slice(c.rows.start, n) for x in batch.columns), pa.array(good), pa.array(score)], names=[*batch.schema.names, "_posterior", "_score"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from all texts' vote patterns and at most ``sample`` whole texts, those with the least hash of doc_id."""
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    counts = {r.pattern: r.n for r in counted.collect()}
    prior, accuracy = estimate(counts, len(LABELLERS))
    h, n = F.xxhash64(F.lit(41), "doc_id"), max(1, sum(counts.values()))
    share = int(min(1.0, (1.5 * sample + 50) / n) * 1_000_000)
    some = texts.filter((F.pmod(h, F.lit(1_000_000)) <= share) & (F.col("text") != "")).orderBy(h, "text").limit(sample)
    return train([r.text for r in some.select("text").collect()], prior, accuracy)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs`` with _posterior (of the text's votes) and _score (of the scorer), both 0 for a text without words."""
    own = docs.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", _posterior double, _score double"
    return own.mapInArrow(lambda it: _scores(it, scorer), schema)


def quality_rows(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, posterior, score, kept (score of at least ``least``).

    A null text, an empty one or one of white space alone has posterior and score 0 and isn't kept.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(own, fit(own, sample)).select("doc_id", F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), (F.col("_score") >= least).alias("kept"))
