"""Mixing to target weights with soft memberships.

A softmax classifier learns domains from a labelled table and gives every document a probability
for each domain.  A document's tokens count towards all domains by these probabilities.  Every
document gets a rate of at least 0, and projected-gradient least squares finds the rates whose
expected tokens in each domain match the targets, nearest to rate 1 for all.

The gradient of a document needs only its own probabilities and the few domain totals.  So a
step is one pass over a narrow table that adds up as many numbers as there are domains; a
document's rate follows from the totals of the steps so far and is never stored or
joined.  (The gradient is taken per token, and steps gain momentum as in accelerated
gradients.)  In the end a rate of 1.3 means one copy, and a second with a chance of 0.3, drawn by hash.

Steps end when each domain is near its own target; domains that ``STEPS`` steps leave away from it are
named by a warning and by ``Mixture.missed``.

The classifier is fitted on at most ``LABELLED`` labelled documents of the table, chosen by hash of their ids; all
else covers all rows.  Features are the distinct lower-cased words and runs of other signs that stand in
``LEAST_DOCS`` labelled documents or more.

* null, empty and blank texts have no tokens: even probabilities, rate 1
* labels with a null id or domain, or for unknown documents, teach nothing; a document with several labels counts for each
* no labels at all: even probabilities; a domain nobody is labelled with keeps a small probability
* rows with equal ``doc_id`` are judged one by one; equal rows get equal copies; other columns go along
* an empty table: an empty result
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.scratch import short_batches, written
from tallymark.llm.textscan import LOWER, NON_SPACE, WORD_BYTES, Words, buffer_of, chunks

LABELLED = 5_000
LEAST_DOCS = 5
BITS = 18
FIT_STEPS = 200
RIDGE = 1e-4
STEPS = 60
#: What the total of a domain may be off, as a share of all tokens and of its own target.
TOLERANCE = 1e-3
OWN_TOLERANCE = 1e-2
#: Share of the tokens that each domain of ``labels`` shall have.
TARGETS = {"good": 0.9, "junk": 0.09, "toxic": 0.01}
#: The mixture is so large that no wanted domain has to shrink; a little more, so that soft doubt drops nobody.
SLACK = 1.1
#: Targets under this are unwanted: they do not set the size of the mixture.
WANTED = 0.05


def label_domain() -> Column:
    """The domain that a row of ``labels`` stands for."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "junk")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature buckets of all texts, where each text's begin, and tokens (words between white space) of each."""
    data, offsets = buffer_of(column)
    low = LOWER[data]
    tokens = Words(data, offsets, NON_SPACE).counts()
    keys = []
    for member, salt in ((WORD_BYTES, 0), (NON_SPACE & ~WORD_BYTES, 1 << (BITS - 1))):
        words = Words(low, offsets, member)
        bucket = (words.hashes() >> np.uint64(64 - BITS + 1)).astype(np.int64) + salt
        keys.append((words.texts().astype(np.int64) << BITS) | bucket)
    keys = np.unique(np.concatenate(keys))
    first = np.searchsorted(keys, np.arange(len(offsets), dtype=np.int64) << BITS)
    return (keys & ((1 << BITS) - 1)).astype(np.int32), first, tokens


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between the places ``first``."""
    total = np.zeros((len(first) - 1, values.shape[1]))
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        total[filled] = np.add.reduceat(values, first[filled], axis=0)
    return total


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weight: np.ndarray  # buckets x domains
    bias: np.ndarray

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each domain, and tokens, of each text."""
        bucket, first, tokens = features(column)
        p = _softmax(_row_sums(self.weight[bucket], first) + self.bias)
        p[tokens == 0] = 1 / len(self.domains)
        return p, tokens


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        bucket, first, _ = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(bucket))], ["domain", "buckets"])


def fit(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], most: int = LABELLED) -> Classifier:
    """Learn from the documents of ``labelled (doc_id, domain)``, at most ``most`` of them."""
    short_batches(docs.sparkSession)
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).select("doc_id", "domain").distinct()
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most)
    # at most ``most`` rows of an id and a name are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("domain", "text").orderBy(F.xxhash64("text"), "text", "domain").limit(2 * most)
    rows = texts.mapInArrow(_features_of, "domain string, buckets array<int>").toArrow()
    k = len(domains)
    weight, bias = np.zeros((1 << BITS, k)), np.zeros(k)
    if not rows.num_rows:
        return Classifier(domains, weight, bias)
    lists = rows.column("buckets").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    bucket, at = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    often = np.bincount(bucket, minlength=1 << BITS) >= LEAST_DOCS
    kept = often[bucket]
    first = np.r_[0, np.cumsum(kept)][at]
    bucket = bucket[kept]
    used, code = np.unique(bucket, return_inverse=True)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    truth = np.array([[d == x for x in domains] for d in rows.column("domain").to_pylist()], dtype=float)
    n, w, b = len(truth), np.zeros((len(used), k)), np.log((truth.sum(axis=0) + 1) / (len(truth) + k))
    m, v = np.zeros((len(used) + 1, k)), np.zeros((len(used) + 1, k))
    for step in range(1, FIT_STEPS + 1):
        error = (_softmax(_row_sums(w[code], first) + b) - truth) / n
        slope = np.stack([np.bincount(code, error[owner, i], minlength=len(used)) for i in range(k)], axis=1) if len(used) else w
        slope = np.vstack([slope + RIDGE * w, error.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weight[used] = w
    return Classifier(domains, weight, b)


def _judge(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            p, tokens = share.value.posteriors(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(tokens.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "key", "n_tokens", "p"])

    return run


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def judged(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, key, n_tokens, p`` of every row, written to the shared folder: what the steps read."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    return written(docs.select("doc_id", "text", _key().alias("key")).mapInArrow(_judge(share), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n_tokens long, p array<double>"), "judged")


@dataclass(frozen=True)
class Fit:
    """Steps taken: the domain errors at each, scaled by the step size, and its momentum."""

    moves: tuple[tuple[float, ...], ...] = ()
    momenta: tuple[float, ...] = ()

    def rates(self, p: np.ndarray, tokens: np.ndarray, ahead: float = 0.0) -> np.ndarray:
        """The rates after all steps; with ``ahead``, the point the next step starts from."""
        old = now = np.ones(len(p))
        for move, momentum in zip(self.moves, self.momenta, strict=True):
            start = now + momentum * (now - old)
            old, now = now, np.maximum(0.0, start - p @ np.array(move))
        return np.where(tokens > 0, np.maximum(0.0, now + ahead * (now - old)) if ahead else now, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("p")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _totals(steps: Fit, ahead: float, square: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                p, tokens = _matrix(batch), batch.column("n_tokens").to_numpy()
                mass = p * tokens[:, None]
                own = (mass.T @ p).ravel() if square else mass.T @ steps.rates(p, tokens, ahead)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "x"])

    return run


def _summed(table: DataFrame, size: int, steps: Fit, ahead: float = 0.0, square: bool = False) -> np.ndarray:
    out = np.zeros(size)
    for r in table.select("n_tokens", "p").mapInArrow(_totals(steps, ahead, square), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


@dataclass(frozen=True)
class Mixture:
    model: Classifier
    steps: Fit
    wanted: np.ndarray  # tokens of each domain
    reached: np.ndarray

    @property
    def missed(self) -> tuple[str, ...]:
        """Domains whose total is not near its target."""
        off = np.abs(self.reached - self.wanted) > _allowed(self.wanted)
        return tuple(d for d, x in zip(self.model.domains, off, strict=True) if x)


def _allowed(goal: np.ndarray) -> np.ndarray:
    """What each total may be off; a target of 0 has no share of its own."""
    every = TOLERANCE * goal.sum()
    return np.where(goal > 0, np.minimum(every, OWN_TOLERANCE * goal), every)


def solve(table: DataFrame, model: Classifier, targets: Mapping[str, float]) -> Mixture:
    """Rates for the rows of :func:`judged`, as steps to replay."""
    k = len(model.domains)
    share = np.array([targets[d] for d in model.domains], dtype=float)
    share /= share.sum()
    square = _summed(table, k * k, Fit(), square=True).reshape(k, k)
    mass = square.sum(axis=1)
    if not mass.sum():
        return Mixture(model, Fit(), mass, mass)
    big = share >= WANTED
    size = SLACK * max((mass[big] / share[big]).max(initial=0.0), mass.sum())
    goal, top = share * size, float(np.linalg.eigvalsh(square)[-1])
    steps, speed = Fit(), 1.0
    for _ in range(STEPS):
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = (speed - 1) / faster
        error = _summed(table, k, steps, ahead) - goal
        if steps.moves and (np.abs(error) <= _allowed(goal)).all() and (np.abs(_summed(table, k, steps) - goal) <= _allowed(goal)).all():
            break
        steps = Fit((*steps.moves, tuple(error / top)), (*steps.momenta, ahead))
        speed = faster
    mixture = Mixture(model, steps, goal, _summed(table, k, steps))
    if mixture.missed:
        own = {d: (round(float(r)), round(float(w))) for d, r, w in zip(model.domains, mixture.reached, goal, strict=True) if d in mixture.missed}
        warnings.warn(f"after {len(steps.moves)} steps these domains are off their targets (tokens reached, wanted): {own}", stacklevel=2)
    return mixture


def domains_of(targets: Mapping[str, float]) -> tuple[str, ...]:
    if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets are shares of at least 0, not all of them 0")
    return tuple(sorted(targets))


def plan(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, most: int = LABELLED) -> tuple[DataFrame, Mixture]:
    model = fit(docs, labelled, domains_of(targets), most)
    table = judged(docs, model)
    return table, solve(table, model, targets)


def _copies(rates: np.ndarray, keys: np.ndarray) -> np.ndarray:
    draw = ((keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) / 2.0**32
    return np.floor(rates + draw).astype(np.int64)


def rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, most: int = LABELLED) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate, copies`` of every row of ``docs (doc_id, text)``."""
    table, mixture = plan(docs, labelled, targets, most)
    steps, names = mixture.steps, [f"p_{d}" for d in mixture.model.domains]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, tokens = _matrix(batch), batch.column("n_tokens").to_numpy()
                rate = steps.rates(p, tokens)
                copies = _copies(rate, batch.column("key").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *(pa.array(x) for x in p.T), pa.array(rate), pa.array(copies)], ["doc_id", "n_tokens", *names, "rate", "copies"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, n_tokens long, {', '.join(f'`{n}` double' for n in names)}, rate double, copies long")


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, most: int = LABELLED) -> DataFrame:
    """``docs`` with every row as often as its rate says; all columns; the texts are not shuffled."""
    mixture = plan(docs, labelled, targets, most)[1]
    share = docs.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            p, tokens = share.value.model.posteriors(batch.column("text"))
            copies = _copies(share.value.steps.rates(p, tokens), batch.column("__key").to_numpy())
            yield batch.drop_columns(["__key"]).take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))

    return docs.select("*", _key().alias("__key")).mapInArrow(run, docs.schema)
