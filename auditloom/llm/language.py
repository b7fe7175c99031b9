"""Language identification by a linear-chain conditional random field (operator 7).

Every word of a text gets a label. A word's emission scores come from its affixes, its byte n-grams and
a lexicon of frequent words; learned transitions tie neighbours, so a few foreign words in a sentence
don't change the rest, and code-switched text changes label where the language does. Forward-backward
gives each word's label probabilities; a text's language has the highest mean.

Training takes a bounded sample of labelled texts: ``per_language`` whole texts of each language, those with
the least hash of their doc_id. Their words are cut into stretches that are dealt into sequences of
mixed languages, from which the transitions are learned too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import sheltered
from .known import Known, release
from .words import Chunk, LOWER, chunks, mix, gram_hashes

#: Texts of each language to learn from, and of all languages together; every language keeps one at least.
PER_LANGUAGE, SAMPLE = 150, 30_000
#: Hashed features; words that occur so often in the sample are in the lexicon.
FEATURES, FREQUENT = 1 << 15, 4
UNKNOWN = "und"
#: Words are runs of ASCII letters and non-ASCII bytes.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Known words per worker; words of a block of the forward-backward scan.
CACHE, STEP = 500_000, 64


def words_of(column: pa.Array) -> Iterator[Chunk]:
    """Chunks of words, with Latin-1 capitals folded as well as A-Z."""
    for c in chunks(column, LETTERS, LOWER):
        lead = np.flatnonzero(c.folded[:-1] == 0xC3) + 1
        lead = lead[(c.folded[lead] >= 0x80) & (c.folded[lead] <= 0x9E) & (c.folded[lead] != 0x97)]
        c.folded[lead] += 0x20
        yield c


class Model(NamedTuple):
    name: str
    labels: list[str]
    weights: np.ndarray  # feature x label
    transitions: np.ndarray  # label x label, logarithms
    lexicon: np.ndarray  # sorted hashes of words


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word after the other, and where each begins.

    n-grams of 1 to 3 bytes with the word's edges marked, affixes of 3 to 5 bytes, and the word itself
    if the lexicon has it.
    """
    length = end - start
    size = length + 2
    offset = np.concatenate([[0], np.cumsum(size)])
    edged = np.full(offset[-1], 1, np.uint64)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    edged[np.repeat(offset[:-1] + 1, length) + inside] = data[np.repeat(start, length) + inside].astype(np.uint64) + np.uint64(3)
    edged[offset[1:] - 1] = 2
    word = np.repeat(np.arange(len(start)), size)
    last = np.repeat(offset[1:], size)
    at = np.arange(len(edged))
    found, owner = [], []
    for n in (1, 2, 3):
        own = at[at + n <= last]
        found.append(gram_hashes(edged, own, own + n) + np.uint64(n))
        owner.append(word[own])
    for n in (3, 4, 5):
        own = np.flatnonzero(length >= n)
        found += [gram_hashes(edged, offset[own], offset[own] + n + 1) + np.uint64(10 + n), gram_hashes(edged, offset[own + 1] - n - 1, offset[own + 1]) + np.uint64(20 + n)]
        owner += [own, own]
    place = np.minimum(np.searchsorted(lexicon, hashes), max(len(lexicon) - 1, 0))
    own = np.flatnonzero(lexicon[place] == hashes) if len(lexicon) else np.zeros(0, np.int64)
    found.append(hashes[own] + np.uint64(99))
    owner.append(own)
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    slots = (mix(np.concatenate(found)) & np.uint64(FEATURES - 1)).astype(np.int64)[order]
    return slots, np.searchsorted(owner_all[order], np.arange(len(start) + 1))


def emissions(weights: np.ndarray, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Scores of words: the sum of their features' weights over the root of their number."""
    return np.add.reduceat(weights[slots], begin[:-1], axis=0) / np.sqrt(np.diff(begin))[:, None] if len(begin) > 1 else np.zeros((0, weights.shape[1]))


def pair_counts(p: np.ndarray, forward: np.ndarray, transitions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected number of each pair of labels of the words ``at`` and their successors.

    alpha[i] A psi[i + 1] beta[i + 1], where p[i + 1] is (alpha[i] A) psi[i + 1] beta[i + 1].
    """
    a = np.exp(transitions - transitions.max())
    alpha = forward[at]
    return a * (alpha.T @ (p[at + 1] / (alpha @ a)))


def forward_backward(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray, forward: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of each word; sequence d has words first[d] to first[d + 1].

    ``forward`` gets each word's label probabilities given the words up to it.

    Sequences are cut into blocks of STEP words. The blocks' transfer matrices are made side by side,
    carried along each sequence, and then all blocks run side by side, so the number of numpy
    steps doesn't grow with the longest text but with its number of blocks.
    """
    n_labels = scores.shape[1]
    out = np.zeros_like(scores)
    counts = np.diff(first)
    if not len(scores):
        return out
    a = np.exp(transitions - transitions.max())
    psi_flat = np.exp(scores - scores.max(1, keepdims=True))
    n_blocks = -(-counts // STEP)
    sequence = np.repeat(np.arange(len(counts)), n_blocks)
    head = np.cumsum(n_blocks) - n_blocks
    number = np.arange(len(sequence)) - head[sequence]
    start = first[sequence] + number * STEP
    size = np.minimum(STEP, first[sequence + 1] - start)
    order = np.argsort(-size, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    start, size = start[order], size[order]
    active = [int(np.searchsorted(-size, -j, "left")) for j in range(STEP)]  # blocks with more than j words
    words = start[:, None] + np.arange(STEP)
    psi = psi_flat[np.minimum(words, len(scores) - 1)]

    transfer = np.broadcast_to(np.eye(n_labels), (len(start), n_labels, n_labels)).copy()
    for j in range(STEP):
        m = active[j]
        if m == 0:
            break
        t = (transfer[:m] @ a) * psi[:m, j, None, :]
        transfer[:m] = t / t.max((1, 2), keepdims=True)
    # Along each sequence: what comes into a block from the left and from the right.
    left, right = np.full((len(start), n_labels), 1 / n_labels), np.ones((len(start), n_labels))
    by_length = np.argsort(-n_blocks, kind="stable")
    many = [int(np.searchsorted(-n_blocks[by_length], -k, "left")) for k in range(int(n_blocks.max(initial=0)) + 1)]
    for k in range(1, int(n_blocks.max(initial=0))):
        s = by_length[: many[k]]
        here, before = where[head[s] + k], where[head[s] + k - 1]
        v = (left[before][:, None, :] @ transfer[before])[:, 0]
        left[here] = v / v.sum(1, keepdims=True)
    for k in range(int(n_blocks.max(initial=0)) - 1, 0, -1):
        s = by_length[: many[k]]
        here, before = where[head[s] + k], where[head[s] + k - 1]
        v = (transfer[here] @ right[here][:, :, None])[:, :, 0]
        right[before] = v / v.sum(1, keepdims=True)
    alpha = np.empty_like(psi)
    v = left
    for j in range(STEP):
        m = active[j]
        if m == 0:
            break
        v = (v[:m] @ a) * psi[:m, j]
        v /= v.sum(1, keepdims=True)
        alpha[:m, j] = v
    inside = np.arange(STEP) < size[:, None]
    if forward is not None:
        forward[words[inside]] = alpha[inside]
    v = right.copy()
    for j in range(STEP - 1, -1, -1):
        m = active[j]
        if m == 0:
            continue
        p = alpha[:m, j] * v[:m]
        alpha[:m, j] = p / p.sum(1, keepdims=True)
        w = (psi[:m, j] * v[:m]) @ a.T
        v[:m] = w / w.sum(1, keepdims=True)
    out[words[inside]] = alpha[inside]
    return out


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 5, length: int = 200, batch: int = 32, rate: float = 0.6) -> Model:
    """Fit weights and transitions by AdaGrad on the conditional likelihood of mixed sequences."""
    rng, labels = np.random.default_rng(seed), sorted(set(langs))
    gold_of = np.array([labels.index(x) for x in langs])
    column = pa.array(texts, pa.string())
    hashes, gold = [], []
    for c in words_of(column):
        hashes.append(c.hashes())
        gold.append(np.repeat(gold_of[c.rows], c.counts).astype(np.int32))
    every, truth = np.concatenate(hashes), np.concatenate(gold)
    kinds, known_at, kind_of, count = np.unique(every, return_index=True, return_inverse=True, return_counts=True)
    lexicon = kinds[count >= FREQUENT]
    # Features of each different word once.
    by_place = np.argsort(known_at)
    slots, sizes_of, at, done = [], np.zeros(len(kinds), np.int64), 0, 0
    for c in words_of(column):
        upto = int(np.searchsorted(known_at[by_place], at + len(c.start)))
        own, place = by_place[done:upto], known_at[by_place[done:upto]] - at
        s, b = features(c.folded, c.start[place], c.end[place], every[at + place], lexicon)
        slots.append(s.astype(np.int32))
        sizes_of[own] = np.diff(b)
        at, done = at + len(c.start), upto
    slot = np.concatenate(slots)
    begin_of = np.zeros(len(kinds), np.int64)
    begin_of[by_place] = np.cumsum(sizes_of[by_place]) - sizes_of[by_place]
    # Stretches of 8 to 60 words of one label, in random order, make sequences of mixed languages.
    cuts = np.cumsum(rng.integers(8, 61, len(every) // 8 + 2))
    cuts = np.unique(np.concatenate([[0, len(every)], cuts[cuts < len(every)], np.flatnonzero(np.diff(truth)) + 1]))
    stretches = np.split(np.arange(len(every)), cuts[1:-1])
    dealt = np.concatenate([stretches[i] for i in rng.permutation(len(stretches))])
    n = len(labels)
    weights, transitions = np.zeros((FEATURES, n)), np.zeros((n, n))
    seen_w, seen_t = np.full((FEATURES, n), 1e-6), np.full((n, n), 1e-6)
    sequences = np.split(dealt, np.arange(length, len(dealt), length))
    for _ in range(epochs):
        for group in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // batch)):
            own = [sequences[i] for i in group]
            ids, sizes = np.concatenate(own), np.array([len(x) for x in own])
            span = sizes_of[kind_of[ids]]
            local = np.concatenate([[0], np.cumsum(span)])
            use = slot[np.repeat(begin_of[kind_of[ids]] - local[:-1], span) + np.arange(local[-1])]
            edges = np.concatenate([[0], np.cumsum(sizes)])
            scores = emissions(weights, use, local)
            forward = np.empty_like(scores)
            p = forward_backward(scores, transitions, edges, forward)
            error = p.copy()
            error[np.arange(len(ids)), truth[ids]] -= 1
            spread = np.repeat(error / np.sqrt(span)[:, None], span, axis=0)
            grad = np.stack([np.bincount(use, spread[:, k], FEATURES) for k in range(n)], 1) / len(group) + 1e-6 * weights
            inner = np.ones(len(ids) - 1, bool)
            inner[edges[1:-1] - 1] = False
            i = np.flatnonzero(inner)
            grad_t = pair_counts(p, forward, transitions, i)
            np.subtract.at(grad_t, (truth[ids][i], truth[ids][i + 1]), 1)
            grad_t /= len(group)
            seen_w += grad**2
            seen_t += grad_t**2
            weights -= rate * grad / np.sqrt(seen_w)
            transitions -= 0.1 * grad_t / np.sqrt(seen_t)
    return Model(uuid.uuid4().hex, labels, weights.astype(np.float32), np.clip(transitions - transitions.max(), -8, 0), lexicon)


_caches: dict[str, Known] = {}


def probabilities(c: Chunk, model: Model) -> np.ndarray:
    """Label probabilities of a chunk's words; known words' emissions are kept."""
    if model.name not in _caches:
        _caches.clear()
        _caches[model.name] = Known(("<f4",), min(CACHE, (256 << 20) // (4 * len(model.labels))))
    known, n = _caches[model.name], len(model.labels)
    release(known)
    keys = c.hashes()
    step = max(500, min(50_000, 2_000_000 // n))

    def work(places: np.ndarray, new: list[bytes]) -> Iterator[tuple]:
        for at in range(0, len(new), step):
            some = places[at : at + step]
            slots, begin = features(c.folded, c.start[some], c.end[some], keys[some], model.lexicon)
            flat = emissions(model.weights, slots, begin).astype("<f4").tobytes()
            yield np.arange(at, at + len(some)), [flat[4 * n * k : 4 * n * (k + 1)] for k in range(len(some))]

    rows = known.rows_of(keys, c.folded, c.start, c.end, work)
    scores = known.gather(1, rows)[0].reshape(-1, n).astype(np.float64)
    # With many labels the texts run in several parts, as a block's transfer matrix grows with their square.
    part = np.cumsum(-(-c.counts // STEP)) // max(1, (32 << 20) // (8 * n * n))
    edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(c.counts)]]).tolist()
    parts = [forward_backward(scores[c.first[a] : c.first[b]], model.transitions, c.first[a : b + 1] - c.first[a]) for a, b in zip(edge, edge[1:])]
    return np.concatenate(parts)


def _no_letter(text: str | None) -> bool:
    return not any(map(str.isalpha, text or ""))


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, with_runs: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        for c in words_of(column):
            n = c.rows.stop - c.rows.start
            pred, score, sure = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            runs: list[list[dict]] = [[] for _ in range(n)]
            full = np.flatnonzero(c.counts)
            if model and len(full):
                p = probabilities(c, model)
                mean = np.add.reduceat(p, c.first[full], axis=0) / c.counts[full][:, None]
                pred[full], score[full] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
                sure[full] = np.add.reduceat(p.max(1), c.first[full]) / c.counts[full]
                if with_runs:
                    best, text = p.argmax(1), c.texts()
                    turn = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
                    for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(best)], strict=True):
                        t = int(text[a])
                        runs[t].append({"first": a - int(c.first[t]), "stop": b - int(c.first[t]), "lang": model.labels[best[a]]})
            und = np.ones(n, bool)
            und[full] = False
            texts = column.slice(c.rows.start, n)
            # Only non-ASCII bytes may be no letters after all.
            plain = np.concatenate([[0], np.cumsum((c.folded[c.start] < 0x80) if len(c.start) else np.zeros(0, bool))])
            for t in np.flatnonzero(~und & (plain[c.first[1:]] == plain[c.first[:-1]])).tolist():
                und[t] = _no_letter(texts[t].as_py())
            langs = [UNKNOWN if u or not model else model.labels[k] for u, k in zip(und.tolist(), pred.tolist(), strict=True)]
            columns = [x.slice(c.rows.start, n) for x in batch.columns]
            names = batch.schema.names
            columns += [pa.array(langs, pa.string()), pa.array(np.where(und, 0.0, score)), pa.array(~und), pa.array(np.where(und, 0.0, sure))]
            if with_runs:
                columns.append(pa.array([[] if u else r for u, r in zip(und.tolist(), runs, strict=True)], pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_pred", "_score", "_lettered", "_sure", *(["_runs"] if with_runs else [])])


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the doc_id as text is 2 modulo 4; a null doc_id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """A model from labelled rows of ``docs`` (doc_id, text, lang) that aren't held out, or None without any.

    The driver gets the number of rows of each language and about ``per_language`` whole texts of each, or
    fewer if there are so many languages that these would be more than ``sample`` together.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(~held_out())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    per_language = min(per_language, max(1, sample // len(counts)))
    h = F.xxhash64(F.lit(17), "doc_id")
    # Half as many again as wanted are expected under this share of the hash range; the least of them are taken.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.5 * per_language + 20) / n))])
    some = labelled.filter(F.pmod(h, F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")]).select("lang", "text", h.alias("h"))
    texts: list[str] = []
    langs: list[str] = []
    taken = dict.fromkeys(counts, 0)
    for r in some.orderBy("h", "text").limit(2 * (per_language + 40) * len(counts)).collect():
        if taken[r.lang] < per_language and not _no_letter(r.text):
            taken[r.lang] += 1
            texts.append(r.text)
            langs.append(r.lang)
    return train(texts, langs) if texts else None


def identify(docs: DataFrame, model: Model | None, with_runs: bool = False) -> DataFrame:
    """``docs`` with _pred, _score, _lettered, _sure and, if asked for, _runs (stretches of words with one label).

    A text that is null or has no letter is 'und' with score 0; so is any text without a model. _sure is
    the mean of the words' highest probabilities, whichever labels these are of.
    """
    own = docs.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", _pred string, _score double, _lettered boolean, _sure double" + (", _runs array<struct<first:int,stop:int,lang:string>>" if with_runs else "")
    return own.mapInArrow(lambda it: _predict(it, model, with_runs), schema)


def language_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score; the model learns from rows not held out."""
    model = fit(docs, per_language)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.35, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, all columns, whose words' languages are known.

    Texts without a letter go, and those whose words' highest probabilities have a mean below ``least``.
    A text of several languages stays if its words are sure, however small each one's share is. If there
    are no labelled rows to learn from, all texts with a letter stay.
    """
    own, restored = sheltered(docs, "doc_id", "text", "lang")
    model = fit(own, per_language)
    known = (F.col("_pred") != UNKNOWN) & (F.col("_sure") >= least) if model else F.lit(True)
    return restored(identify(own, model).filter(F.col("_lettered") & known))
