"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Staging
from .text import over_texts, slices, split_words, strings

GRAM = 5
LONG = 64
_FLAT = 24  # classes of token scores on either side of 0, half a unit wide
_SEGMENTS = "array<struct<begin:int,end:int,score:double>>"


@dataclass(frozen=True)
class ToxicityConfig:
    """train_rows bounds the labelled rows that are learnt from; the model is what these rows make significant.

    prior is the weight of the Dirichlet prior, as a share of the counts of the labelled texts; least_odds how far a
    token's log-odds must be from 0, on either side, and least_z in how many standard errors: small odds of common
    tokens add up over long texts of one topic without meaning; rest what a word without such a token scores; one in
    `calibrating` labelled rows calibrates instead of teaching log-odds, if there are `enough` of each kind.
    """

    train_rows: int = 200_000
    prior: float = 0.1
    least_z: float = 4.0
    least_odds: float = 2.0
    rest: float = -0.1
    segment_score: float = 2.0
    calibrating: int = 5
    enough: int = 20


def tokens(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The tokens of each distinct word: all runs of GRAM characters of the word between ^ and $, in lower case.

    A word of fewer is one token. Gives (word, token) pairs; a word of more than
    LONG characters gives each of its tokens once.
    """
    padded = pc.binary_join_element_wise("^", pc.utf8_trim(pc.utf8_lower(words.cast(pa.string())), ".,;:!?\"'()[]"), "$", "")
    length = np.asarray(pc.utf8_length(padded), dtype=np.int64)
    owners, parts = [np.flatnonzero(length < GRAM)], [padded.filter(pa.array(length < GRAM))]
    for i in np.flatnonzero(length > LONG).tolist():
        word = padded[i].as_py()
        found = list(dict.fromkeys(word[k : k + GRAM] for k in range(len(word) - GRAM + 1)))
        owners.append(np.full(len(found), i))
        parts.append(pa.array(found, padded.type))
    for k in range(min(LONG, int(length.max(initial=0))) - GRAM + 1):
        held = np.flatnonzero((length >= k + GRAM) & (length <= LONG))
        owners.append(held)
        parts.append(pc.utf8_slice_codeunits(padded.take(pa.array(held)), k, k + GRAM))
    return np.concatenate(owners), pa.concat_arrays(parts)


def _distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


def training_labels(labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(doc_id, toxic, calibrates) of the rows to learn from: at most train_rows, those first by a hash of their id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.train_rows)
    return chosen.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(config.calibrating)) == 0)


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean, others): how often each token stands in the distinct words of texts of each kind. `rows` is (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, bounds = split_words(strings(batch.column("text")))
                if not len(words):
                    continue
                kind = np.asarray(pc.fill_null(batch.column("toxic"), 2), dtype=np.int64)
                distinct, codes = _distinct(words)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                once = np.unique(doc * len(distinct) + codes)  # a word that a text repeats counts once
                counts = np.bincount(once % len(distinct) * 3 + kind[once // len(distinct)], minlength=3 * len(distinct)).reshape(-1, 3)
                owner, found = tokens(distinct)
                names, at = _distinct(found)
                sums = [np.bincount(at, weights=counts[owner, k], minlength=len(names)).astype(np.int64) for k in (1, 0, 2)]
                yield pa.RecordBatch.from_arrays([names, *map(pa.array, sums)], names=["token", "toxic", "clean", "others"])

    found = over_texts(rows, run, "token string, toxic long, clean long, others long")
    return found.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "others")])


def log_odds(counts: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(token, odds): the tokens that toxic texts have more or less often than clean ones, by log-odds with a Dirichlet prior.

    The prior of a token is its share of all texts, labelled or not, times
    config.prior of what the labelled ones hold. Tokens whose log-odds are
    least_odds and least_z standard errors or more from 0 are kept, those of
    clean texts with their negative odds; nothing else bounds their number.
    """
    total = counts.agg(*[F.sum(c).cast("double").alias(f"all_{c}") for c in ("toxic", "clean", "others")]).withColumn("all_n", F.expr("all_toxic + all_clean + all_others"))
    rows = counts.where("toxic + clean > 0").join(F.broadcast(total))  # one row
    weight = F.lit(config.prior) * F.expr("all_toxic + all_clean")
    prior = F.expr("toxic + clean + others") / F.col("all_n") * weight
    part = lambda y, n: (F.col(y) + prior) / (F.col(n) + weight - F.col(y) - prior)
    odds = F.log(part("toxic", "all_toxic")) - F.log(part("clean", "all_clean"))
    z = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    return rows.select("token", odds.alias("odds"), z.alias("z")).where((F.abs("z") >= config.least_z) & (F.abs("odds") >= config.least_odds)).select("token", "odds")


class Scorer:
    """Scores words by the token whose log-odds are farthest from 0; words without a known token score `rest`."""

    def __init__(self, model: dict[str, float], rest: float) -> None:
        self.names, self.odds, self.rest = pa.array(sorted(model), pa.string()), np.array([model[t] for t in sorted(model)]), rest

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether a token is known) of each word."""
        high, low = np.zeros(len(distinct)), np.zeros(len(distinct))
        if len(self.names) and len(distinct):
            owner, found = tokens(distinct)
            at = pc.index_in(found, value_set=self.names)
            known = np.asarray(pc.is_valid(at))
            owner, odds = owner[known], self.odds[np.asarray(at.drop_null(), dtype=np.int64)]
            np.maximum.at(high, owner, odds)
            np.minimum.at(low, owner, odds)
        score = np.where(high >= -low, high, low)
        return np.where(score == 0, self.rest, score), score != 0


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence, in linear time.

    Words of negative score between positive ones count as one gap. Segments
    are kept with the sums before and after them; a new one joins back to the
    last whose sum before is lower, as long as that raises the total. Each
    kept segment links to the last before it of a lower sum, so the search
    passes over no segment twice.
    """
    positive = np.flatnonzero(scores > 0)
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[int, int, float, float, int]] = []
    for i in positive.tolist():
        begin, low, high = i, float(sums[i]), float(sums[i + 1])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                break
            begin, low, link = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = link
        kept.append((begin, i + 1, low, high, j))
    return [(b, e, h - l) for b, e, l, h, _ in kept]


def scan(rows: DataFrame, model: dict[str, float], config: ToxicityConfig, spread: bool = False) -> DataFrame:
    """(doc_id, th, n_words, segments) of `rows` (doc_id, th, text): every maximal segment of segment_score or more.

    With `spread` also how the scores of known words are spread: counts of classes half a unit wide.
    """
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, config.rest)
        for whole in batches:
            for batch in slices(whole, "text"):
                words, bounds = split_words(strings(batch.column("text")))
                distinct, codes = _distinct(words)
                of, known = (x[codes] for x in scorer.words(distinct))
                docs = np.searchsorted(bounds, np.flatnonzero(of > 0), side="right") - 1
                found: list[list | None] = [None] * batch.num_rows
                for d in np.unique(docs).tolist():
                    found[d] = [{"begin": b, "end": e, "score": s} for b, e, s in segments(of[bounds[d] : bounds[d + 1]]) if s >= config.segment_score] or None
                columns = [batch.column("doc_id"), batch.column("th"), pa.array(np.diff(bounds), pa.int64()), pa.array(found, kind)]
                if spread:
                    classes = np.clip(np.floor(2 * of).astype(np.int64) + _FLAT, 0, 2 * _FLAT - 1)
                    counts = [np.bincount(classes[a:b][known[a:b]], minlength=2 * _FLAT).tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    columns.append(pa.array(counts, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_words", "segments", "counts"][: len(columns)])

    return over_texts(rows, run, f"doc_id long, th long, n_words long, segments {_SEGMENTS}" + (", counts array<bigint>" if spread else ""))


@dataclass(frozen=True)
class Calibration:
    """Extreme-value parameters of clean texts, and a logistic curve from evidence to probability."""

    decay: float
    k: float
    slope: float
    bias: float


def decay_of(words: float, counts: np.ndarray, rest: float, below: np.ndarray | None = None) -> float:
    """The positive solution of E[exp(decay * score)] = 1 over the words of clean texts.

    counts[i] words score from i/2 to (i+1)/2, below[i] as much under 0, the others `rest`.
    """
    middle = (np.arange(_FLAT) + 0.5) / 2
    if below is not None:
        counts, middle = np.concatenate((counts, below)), np.concatenate((middle, -middle))
    held = counts.sum()
    if not counts[:_FLAT].sum() or words < held:
        return 1.0

    def excess(x: float) -> float:
        return float(((words - held) * math.exp(x * rest) + (counts * np.exp(x * middle)).sum()) / words - 1)

    low, high = 1e-6, 4.0
    if excess(high) <= 0:
        return 2.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if excess(x) <= 0 else (low, x)
    return min(2.0, max(0.1, high))


def fit_curve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias of a logistic curve, by Newton steps on counts at the points x, lightly held to 0."""
    w = np.array([0.1, -2.0])
    n, design = toxic + clean, np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (toxic - n * p) - np.array([1e-2, 1e-4]) * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-4]), grad)
        w = w + np.clip(step, -2, 2)
    return max(0.0, float(w[0])), float(w[1])


def evidence(k: float, decay: float) -> Column:
    """ln(1 + e) of the largest r-segment evidence e of a text: decay * (sum of the r best) - r * ln(K n) + ln r!, r from 0."""
    scores = F.reverse(F.array_sort(F.transform("segments", lambda s: s["score"])))
    place = F.log(F.lit(k) * F.greatest(F.col("n_words"), F.lit(1)) + 1)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("r"), F.lit(0.0).alias("best"))

    def add(a: Column, s: Column) -> Column:
        total = a["sum"] + s * decay - place + F.log(a["r"] + 1)
        return F.struct(total.alias("sum"), (a["r"] + 1).alias("r"), F.greatest(a["best"], total).alias("best"))

    return F.log1p(F.coalesce(F.aggregate(scores, start, add, lambda a: a["best"]), F.lit(0.0)))


def calibrate(known: DataFrame, config: ToxicityConfig) -> Calibration:
    """From the scan of labelled rows, with `toxic` and spread: sums over the clean ones, then counts of evidence by label."""
    clean = known.where("toxic = 0")
    words, many = clean.agg(F.sum("n_words"), F.sum(F.coalesce(F.size("segments"), F.lit(0)))).first()
    spread = {r.i: r.n for r in clean.select(F.posexplode("counts").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()}  # 2 * _FLAT rows
    counts = np.array([float(spread.get(i, 0)) for i in range(2 * _FLAT)])
    decay = decay_of(float(words or 0), counts[_FLAT:], config.rest, counts[:_FLAT][::-1])
    k = max(1e-6, (max(0, many or 0) + 0.5) / max(1.0, float(words or 0)) * math.exp(decay * config.segment_score))
    near = known.select("toxic", F.round(evidence(k, decay), 2).alias("x"))  # at most some 5,000 values, as a double's logarithm is below 50
    points = near.groupBy("x").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("x").collect()
    if not points:
        return Calibration(decay, k, 1.0, -2.0)
    x, t, n = (np.array([float(p[i]) for p in points]) for i in range(3))
    return Calibration(decay, k, *fit_curve(x, t, n - t))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def score(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, staging: Staging | None = None) -> DataFrame:
    """(doc_id, th, n_words, score, passages) for every row: learnt from `labels` (doc_id, toxic), applied to all texts.

    Words score the signed log-odds, toxic against clean texts with a Dirichlet
    prior from all texts, of the token that says most. One scan finds every
    maximal segment; those of segment_score or more are passages (begin, end,
    score: word numbers). Segment scores of clean texts follow an extreme-value
    law whose parameters turn a text's segments into evidence, and a logistic
    curve turns the logarithm of evidence into a probability, so that no two
    texts tie unless their evidence does. Law and curve come from labelled
    texts that taught no log-odds, or from all where those are too few.

    `labelled` are the texts of the labels if not `docs` (a filtered table can
    be scored by what the whole one teaches). Null and empty texts score as
    texts without evidence; without labels, or with labels of one kind, no
    score means anything but all are below a half; repeated ids share their
    label; null ids have none; very long texts and words take time in
    proportion to their length; an empty table gives no rows; other columns are
    not read, whatever their names. th is a hash of the text.
    """
    config = config or ToxicityConfig()
    staging = staging or Staging(docs.sparkSession, "toxicity")
    train = staging.write(training_labels(labels, config), "train")
    apart = train.where("calibrates").agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    split = min(apart[0] or 0, apart[1] or 0) >= config.enough
    rows = _rows(docs, id_col, text_col)
    texts = rows if labelled is None else _rows(labelled, id_col, text_col)
    teaching = train.where("not calibrates") if split else train
    marked = texts.join(F.broadcast(teaching.select("doc_id", "toxic")), "doc_id", "left").select("toxic", "text")  # train_rows rows at most
    counts = staging.write(token_counts(marked), "counts")
    model = {r.token: r.odds for r in log_odds(counts, config).collect()}  # what train_rows texts make significant
    staging.drop("counts")
    scanned = staging.write(scan(rows, model, config), "scanned")
    curve = F.broadcast((train.where("calibrates") if split else train).select("doc_id", "toxic"))  # train_rows rows at most
    known = staging.write(scan(texts.join(curve, "doc_id", "left_semi"), model, config, spread=True).join(curve, "doc_id"), "known")
    c = calibrate(known, config)
    staging.drop("known")
    probability = 1 / (1 + F.exp(-(F.lit(c.slope) * evidence(c.k, c.decay) + c.bias)))
    return scanned.select("doc_id", "th", "n_words", probability.alias("score"), F.coalesce("segments", F.array().cast(_SEGMENTS)).alias("passages"))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))
