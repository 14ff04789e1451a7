"""Toxicity: a linear-chain conditional random field over tokens, two states (plain, toxic).

Labels come by document, the field is learnt from tokens, so tokens are labelled first: in a
document marked toxic, a token is toxic if one of its features (the token, its prefixes of 3 to
7 bytes) occurs in enough marked documents and nearly never in others. The field's weights
(hashed features, transitions, start) are then fitted by gradient ascent on the likelihood of
those sequences. Forward-backward gives every token of a text its marginal; a document's score
is a logistic function of its largest marginal and of the sum of them, fitted to the labels,
and its spans are the runs of tokens whose marginal is at least 1/2.

Rows are fitted on at most ``rows_per_class`` documents a class, in hash order, and of these on
texts of at most ``most_bytes`` (the documented bounds); every text is scored whole. Language,
source and id are no inputs.

Edge cases: a null or empty text has no tokens and the score of a text without toxic tokens.
Repeated rows are scored each; a document with conflicting labels counts as toxic; of texts
that share an id the smallest is learnt from; labels without a document, null labels and null
ids are ignored. Without labels of both classes the score is the share of marked labels (0
without any). A text of any length is scored in some thousand vectorised steps. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, ShortSpans, Spans, mix, text_groups

PREFIXES = (3, 4, 5, 6, 7)
TAG_BYTES = 6 << 20  # of text whose tokens are held at a time
TOKENS = 1 << 19  # whose features are
MOST = 30.0  # bound of a token's log odds, which keeps the recursions finite

#: Token bytes: ASCII letters and digits, and all bytes of other characters.
IN_TOKEN = np.zeros(256, bool)
IN_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def tokens_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the tokens of texts data[at[i]:at[i+1]]."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def features_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's features; a prefix is one of tokens longer than it."""
    data, size = LOWER[data], end - start
    out, short = [Spans(data).hash(start, end)], ShortSpans(data)
    for n in PREFIXES:
        prefix = mix(short.hash(start, np.minimum(start + n, end)) + np.uint64(GOLDEN * n & (1 << 64) - 1))
        out.append(np.where(size > n, prefix, out[0]))
    return out


def in_steps(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For t = 0, 1, ...: the runs first[i]..first[i]+size[i] longer than t, longest first, and the places of their t-th items."""
    order = np.argsort(-size, kind="stable")
    left = np.sort(size)
    n = len(size) - np.searchsorted(left, np.arange(left[-1] if len(left) else 0), side="right")
    for t, k in enumerate(n):
        yield order[:k], first[order[:k]] + t


def odds_along(odds: np.ndarray, at: np.ndarray, a: np.ndarray, begin: float, stretch: int = 512) -> np.ndarray:
    """f of every item of the sequences odds[at[i]:at[i+1]]: odds * begin for a first one, else
    odds * (a[0, 1] + a[1, 1] * g) / (a[0, 0] + a[1, 0] * g), where g is the f of the item before.

    Each step is a 2 x 2 matrix on (f, 1) up to a factor, so a long sequence is cut into
    stretches whose products are taken side by side: twice ``stretch`` steps and one a stretch.
    """
    size = np.diff(at)
    parts = -(-size // stretch)
    row = np.repeat(np.arange(len(size)), parts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = at[:-1][row] + number * stretch
    length = np.minimum(size[row] - number * stretch, stretch)
    out, g = np.empty(len(odds)), np.empty(len(row))

    def along(who: np.ndarray) -> None:
        last = np.empty(0)
        for t, (k, place) in enumerate(in_steps(first[who], length[who])):
            if t:
                g_now = last[: len(place)]
                now = odds[place] * (a[0, 1] + a[1, 1] * g_now) / (a[0, 0] + a[1, 0] * g_now)
            else:
                k = who[k]
                now = odds[place] * np.where(number[k] == 0, begin, (a[0, 1] + a[1, 1] * g[k]) / (a[0, 0] + a[1, 0] * g[k]))
            out[place] = last = np.minimum(now, 1e30)

    along(np.flatnonzero(number == 0))
    later = np.flatnonzero(number > 0)
    if not len(later):
        return out
    m = np.empty((len(row), 2, 2))
    inner = later[number[later] + 1 < parts[row[later]]]  # the last stretch leads to no other
    product = np.empty((0, 2, 2))
    for t, (k, place) in enumerate(in_steps(first[inner], length[inner])):
        o = odds[place]
        if t:
            p = product[: len(place)]
            top = o[:, None] * (a[1, 1] * p[:, 0] + a[0, 1] * p[:, 1])
            low = a[1, 0] * p[:, 0] + a[0, 0] * p[:, 1]
            product = np.stack([top, low], axis=1)
        else:
            product = np.stack([np.stack([o * a[1, 1], o * a[0, 1]], axis=1), np.broadcast_to([a[1, 0], a[0, 0]], (len(o), 2))], axis=1)
        product /= product.max(axis=(1, 2))[:, None, None]
        m[inner[k]] = product
    second = later[number[later] == 1]
    g[second] = out[first[second] - 1]
    for k in range(2, int(parts.max())):
        now = later[number[later] == k]
        f, x = g[now - 1], m[now - 1]
        g[now] = np.minimum((x[:, 0, 0] * f + x[:, 0, 1]) / (x[:, 1, 0] * f + x[:, 1, 1]), 1e30)
    along(later)
    return out


@dataclass
class Chain:
    """Log-potentials: emission by hashed feature (toxic against plain), transition [from, to], start."""

    weights: np.ndarray
    transition: np.ndarray
    start: float
    bias: float

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        mask = np.uint64(len(self.weights) - 1)
        total = np.full(len(features[0]), self.bias)
        for f in features:
            total += self.weights[(f & mask).astype(np.int64)]
        return np.clip(total, -MOST, MOST)

    def marginals(self, emission: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of toxic, forward odds, backward odds) of each item of sequences emission[at[i]:at[i+1]]."""
        a = np.exp(self.transition)
        odds = np.exp(emission)
        forward = odds_along(odds, at, a, float(np.exp(self.start)))
        back = odds_along(odds[::-1], len(odds) - at[::-1], a.T, 1.0)[::-1]
        backward = back / odds
        joint = np.minimum(forward * backward, 1e30)
        return joint / (1 + joint), forward, backward


def token_labels(features: list[np.ndarray], row: np.ndarray, toxic: np.ndarray, least: int, purity: float) -> np.ndarray:
    """Tokens of marked documents that have one of the telling features.

    A feature may tell if, classes being weighted alike, at least ``purity`` of its documents
    are marked. Of these, the one that explains the most documents not yet explained is taken
    again and again, while it explains ``least``: words that only accompany a telling one, as
    in copies of a document, explain nothing that is left. A document counts half as much each
    time that it is explained, so that among few documents each telling word is still found.
    """
    pairs = []
    for f in features:
        keys, back = np.unique(f, return_inverse=True)
        pair = np.unique(back.astype(np.int64) * len(toxic) + row)
        at, doc = pair // len(toxic), pair % len(toxic)
        marked = np.bincount(at, toxic[doc], minlength=len(keys))
        other = np.bincount(at, minlength=len(keys)) - marked
        good = (marked >= least) & (marked / max(toxic.sum(), 1) > purity / (1 - purity) * (other + 0.5) / max((~toxic).sum(), 1))
        pick = good[at] & toxic[doc]
        pairs.append((keys[at[pick]], doc[pick]))
    key, doc = (np.concatenate(x) for x in zip(*pairs))
    names, key = np.unique(key, return_inverse=True)
    weight, taken, enough = np.ones(len(toxic)), [], max(least / 2, toxic.sum() / 100)
    left = np.ones(len(names), bool)
    while left.any():
        new = np.bincount(key, weight[doc] == 1, minlength=len(names)) * left
        counted = np.bincount(key, weight[doc], minlength=len(names)) * left
        best = int(counted.argmax())
        if counted[best] < enough:
            best = int(new.argmax())
            if new[best] < least:
                break
        left[best] = False
        taken.append(names[best])
        weight[doc[key == best]] /= 2
    found = np.zeros(len(row), bool)
    for f in features:
        found |= np.isin(f, np.array(taken, np.uint64))
    return found & toxic[row]


@dataclass(frozen=True)
class Settings:
    rows_per_class: int = 1200
    most_bytes: int = 32_768
    bits: int = 18
    rounds: int = 40
    rate: float = 0.5
    ridge: float = 1e-4
    least_documents: int = 3
    purity: float = 0.97
    segment: int = 256


def train_chain(texts: pa.Array, toxic: np.ndarray, s: Settings) -> Chain:
    parts, labels, rows = [], [], []
    for first, after, data, at in text_groups(texts):
        start, end, row = tokens_of(data, at)
        parts.append(features_of(data, start, end))
        rows.append(row + first)
    row = np.concatenate(rows)
    features = [np.concatenate(x) for x in zip(*parts)]
    gold = token_labels(features, row, toxic, s.least_documents, s.purity).astype(float)
    mask = np.uint64((1 << s.bits) - 1)
    places = [(f & mask).astype(np.int32) for f in features]
    del features, parts
    # texts are cut into segments here, each a sequence of its own, so that a step works on many
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    inside = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
    at = np.r_[np.flatnonzero(inside % s.segment == 0), len(row)]
    follows = np.ones(len(row), bool)
    follows[at[:-1]] = False
    second = np.flatnonzero(follows)
    chain = Chain(np.zeros(1 << s.bits), np.zeros((2, 2)), 0.0, np.log((gold.sum() + 1) / (len(gold) - gold.sum() + 1)))
    sums = [np.full(1 << s.bits, 1e-8), np.full((2, 2), 1e-8), 1e-8, 1e-8]
    n = max(gold.sum(), 1.0)
    real = np.bincount((2 * gold[second - 1] + gold[second]).astype(np.int8), minlength=4).astype(float)
    for _ in range(s.rounds):
        emission = np.full(len(row), chain.bias)
        for p in places:
            emission += chain.weights[p]
        emission = np.clip(emission, -MOST, MOST)
        marginal, forward, backward = chain.marginals(emission, at)
        error = gold - marginal
        step = np.zeros(1 << s.bits)
        for p in places:
            step += np.bincount(p, error, minlength=1 << s.bits)
        a, o = np.exp(chain.transition), np.exp(emission[second]) * backward[second]
        f = forward[second - 1]
        whole = a[0, 0] + a[0, 1] * o + (a[1, 0] + a[1, 1] * o) * f
        joint = np.array([(a[0, 0] / whole).sum(), (a[0, 1] * o / whole).sum(), (a[1, 0] * f / whole).sum(), (a[1, 1] * f * o / whole).sum()])
        del o, f, whole, emission, forward, backward, marginal
        updates = [step / n - s.ridge * chain.weights, (real - joint).reshape(2, 2) / n, error[at[:-1]].sum() / n, error.sum() / n]
        for k, u in enumerate(updates):
            sums[k] = sums[k] + u * u
        moves = [s.rate * u / np.sqrt(x) for u, x in zip(updates, sums)]
        chain = Chain(chain.weights + moves[0], np.clip(chain.transition + moves[1], -8, 8), float(np.clip(chain.start + moves[2], -8, 8)), float(chain.bias + moves[3]))
    chain.weights = chain.weights.astype(np.float32)
    return chain


@dataclass
class Model:
    """chain is None where the labels hold one class only; then every score is constant."""

    chain: Chain | None
    logistic: np.ndarray
    constant: float

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, marginal) of every token, in bytes of its text, and the items' offsets by row."""
        parts = []
        for first, _, data, at in text_groups(texts):
            start, end, row = tokens_of(data, at)
            emission = np.empty(len(start))
            for k in range(0, len(start), TOKENS):
                a, b = start[k : k + TOKENS], end[k : k + TOKENS]
                emission[k : k + TOKENS] = self.chain.emissions(features_of(data[a[0] : b[-1]], a - a[0], b - a[0]))
            parts.append(((row + first).astype(np.int32), (start - at[row]).astype(np.int32), (end - at[row]).astype(np.int32), emission))
        row, start, end, emission = (np.concatenate([p[k] for p in parts]) for k in range(4)) if parts else (np.empty(0, np.int64),) * 4
        at = np.searchsorted(row, np.arange(len(texts) + 1))
        return row, start, end, self.chain.marginals(emission, at)[0], at

    @staticmethod
    def summary(row: np.ndarray, marginal: np.ndarray, n: int) -> np.ndarray:
        """One line a text: 1, the log odds of its largest marginal, log(1 + the sum of them)."""
        top = np.zeros(n)
        np.maximum.at(top, row, marginal)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(np.bincount(row, marginal, minlength=n))], axis=1)

    def scores(self, lines: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(lines @ self.logistic, -MOST, MOST)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -MOST, MOST)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """may_learn: a condition on the column ``id`` of the rows that labels may be learnt from."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").where(may_learn).groupBy("id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy((F.col("y") == 1).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(None, np.zeros(3), totals.get(1, 0) / max(sum(totals.values()), 1))
    parts = [known.where(F.col("y") == 1 if y else F.col("y") != 1).orderBy(F.xxhash64("id"), "id").limit(settings.rows_per_class) for y in (1, 0)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= settings.most_bytes)
    rows = texts.join(sample, "id").groupBy("id").agg(F.min("text").alias("text"), F.first(F.col("y") == 1).alias("y")).toArrow().sort_by("id")
    toxic = rows.column("y").to_numpy()
    if not toxic.any() or toxic.all():
        return Model(None, np.zeros(3), totals[1] / sum(totals.values()))
    model = Model(train_chain(rows.column("text").combine_chunks(), toxic, settings), np.zeros(3), 0.0)
    row, _, _, marginal, _ = model.tag(rows.column("text").combine_chunks())
    weight = np.where(toxic, totals[1] / toxic.sum(), totals[0] / (~toxic).sum())
    model.logistic = logistic(model.summary(row, marginal, len(toxic)), toxic.astype(float), weight / weight.mean())
    return model


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray, marginal: np.ndarray, n: int) -> pa.Array:
    """Runs of tokens whose marginal is at least 1/2, as (start, end) in bytes of the UTF-8 text."""
    hit = np.flatnonzero(marginal >= 0.5)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
    first = hit[new]
    last = hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]] if len(hit) else hit
    at = np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array(end[last].astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at), pairs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and spans (array of start, end in bytes) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                values, spans = judge(model, batch.column(1), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), spans], [id_col, "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, score double, spans array<struct<start:int,end:int>>")


def judge(model: Model, texts: pa.Array, n: int) -> tuple[np.ndarray, pa.Array]:
    """Scores and spans of n texts, tagged some megabytes at a time."""
    if model.chain is None:
        return np.full(n, model.constant), _spans(*(np.empty(0, np.int64),) * 4, n)
    scores, spans = [], []
    for first, after, _, _ in text_groups(texts, TAG_BYTES):
        row, start, end, marginal, _ = model.tag(texts.slice(first, after - first))
        scores.append(model.scores(model.summary(row, marginal, after - first)))
        spans.append(_spans(row, start, end, marginal, after - first))
    return np.concatenate(scores), pa.concat_arrays(spans)


def keep(docs: DataFrame, model: Model, below: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score less than ``below``, with all their columns."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                yield batch.filter(pa.array(judge(model, batch.column(batch.schema.get_field_index(text_col)), n)[0] < below))

    return docs.mapInArrow(only, docs.schema)
