"""Scores for abusive, hateful or sexual content: FTRL-proximal logistic regression on hashed word features.

A document counts if one of its sentences does, so sentences are what is scored. A sentence is described by
hashed word n-grams and skip-grams, with disguised spellings undone before. The reviews are of whole documents:
all sentences of a clean document are negative, and those of an abusive one are positive as far as they answer for
the verdict; a few rounds of fitting settle how far. Per-coordinate learning rates and L1 leave
few weights, which are broadcast to score all documents.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the feature hash; at most 2**BITS weights are broadcast, 8 bytes each.
BITS = 20
#: The bound on the reviewed documents the model is fitted on (a hash-ordered sample if there are more).
MAX_REVIEWED = 20_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 0.1
ROUNDS, FOLDS, EPOCHS = 3, 3, 3
#: The most an example that many documents hold weighs.
MOST_WEIGHT = 20.0
#: Shares of abusive and of clean verdicts taken to be wrong.
WRONG_ABUSIVE, WRONG_CLEAN = 0.2, 0.005
#: Evidence (log odds) from which a sentence counts as abusive beside others of its document.
CERTAIN = 4.0
THRESHOLD = 0.5
#: Documents whose features are held at once.
SLICE_DOCUMENTS = 500
SEED = 20290605

_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]([ .\-_*]))(?:[^\W\d_]\1)+[^\W\d_](?![^\W\d_])")
_GAP = re.compile(r"[ .\-_*]")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+|[@$*]+(?=[^\W_]))*|[@$][^\W_]+(?:[*@$!]+[^\W_]+)*")
_REPEAT = re.compile(r"(.)\1+")
# Signs that stand for letters in disguised words.
_LETTERS = str.maketrans("0134578@$!", "oieastbasi")
_SHIFTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def plain_word(token: str) -> str:
    """A lower-case token without disguise: signs for letters are read, repeated letters are single, stars too;
    a token of digits only is 0."""
    if token.isdigit():
        return "0"
    if not token.isalpha():
        token = token.translate(_LETTERS)
    return _REPEAT.sub(r"\1", token)


class _Hashes(dict):
    """The hash of each word's plain form, remembered."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        found = self[token] = xxhash.xxh64_intdigest(plain_word(token).encode())
        return found


_known = _Hashes()
#: ASCII characters as a for letters, space for the signs that set letters apart, # for all else; and all but letters and
#: digits as spaces.
_KINDS = str.maketrans({chr(k): "a" if chr(k).isalpha() else " " if chr(k) in " .-_*" else "#" for k in range(128)})
_GAPS = str.maketrans({chr(k): " " for k in range(128) if not chr(k).isalnum()})
_SPACES = "\t\r\f\v\x1c\x1d\x1e\x1f"


def _may_be_spaced(text: str) -> bool:
    """Whether an ASCII text may hold letters set apart; only a text that does is looked at closely."""
    kinds = text.translate(_KINDS)
    return " a a " in kinds or " a a#" in kinds or kinds.endswith(" a a")


def _parts(text: str) -> list[str]:
    """A lower-case text cut at the ends of sentences and lines."""
    if text.isascii() and not any(c in text for c in _SPACES):
        for end in ".!?;":
            text = text.replace(f"{end} ", f"{end}\n")
        return text.split("\n")
    return _SENTENCE.split(text)


def _tokens(part: str) -> list[str]:
    if part.isascii() and not ("*" in part or "@" in part or "$" in part or "!" in part[:-1]):
        return part.translate(_GAPS).split()
    return _TOKEN.findall(part)


def sentences(text: str | None) -> list[list[str]]:
    """The tokens of each sentence; single letters set apart are read as one word. Empty sentences are left out."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("​", "")
    text = text.lower()
    if text.isascii() and not _may_be_spaced(text):
        return [t for t in map(_tokens, _parts(text)) if t]
    made = []
    for part in _parts(text):
        joined = _SPACED.sub(lambda m: _GAP.sub("", m[0]), part)
        # a first letter that is a word of its own may not belong to the word set apart
        other = _SPACED.sub(lambda m: m[0][0] + " " + _GAP.sub("", m[0][1:]) if m[0][0] in "ai" else _GAP.sub("", m[0]), part) if joined != part else joined
        for form in {joined: 0, other: 0}:
            tokens = _tokens(form)
            if tokens:
                made.append(tokens)
    return made


def features(docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence, document of each sentence): n-grams of 1 to 3 words and skip-grams over 1 and 2 words."""
    flat = [s for d in docs for s in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    sizes = np.array([len(s) for s in flat], dtype=np.int64)
    h = np.fromiter(map(_known.__getitem__, itertools.chain.from_iterable(flat)), dtype=np.uint64, count=int(sizes.sum()))
    at = np.repeat(np.arange(len(flat)), sizes)
    made, where = [h * _SHIFTS[0]], [at]
    for steps in ((1,), (1, 2), (2,), (3,)):
        far = steps[-1]
        if len(h) <= far:
            continue
        inside = at[:-far] == at[far:]
        mix = h[:-far] * _SHIFTS[1] + np.uint64(sum(s * 31**k for k, s in enumerate(steps)))
        for s in steps:
            mix = (mix ^ (mix >> np.uint64(29))) * _SHIFTS[2] + h[s : len(h) - far + s]
        made.append(mix[inside] * _SHIFTS[0])
        where.append(at[:-far][inside])
    every = np.concatenate(made) >> np.uint64(64 - BITS)
    return every.astype(np.int32), np.concatenate(where).astype(np.int64), owner


class Ftrl:
    """FTRL-proximal logistic regression; weights follow from the sums z and n of each coordinate. The bias is fixed,
    so that a sentence of unknown features is judged by how common abusive sentences are."""

    def __init__(self, bias: float):
        self.z, self.n, self.bias = np.zeros(1 << BITS), np.zeros(1 << BITS), bias

    def weights(self, x: np.ndarray) -> np.ndarray:
        z, n = self.z[x], self.n[x]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(x)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()) + self.bias))))
        g = (p - y) * weight
        n = self.n[x]
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[x] = n + g * g

    def dense(self) -> np.ndarray:
        return self.weights(np.arange(1 << BITS)).astype(np.float32)


#: One fit: the weights of every example for and against, and the seed of the order they are learnt in.
Job = tuple[np.ndarray, np.ndarray, list[int]]


def _learnt(examples: list[np.ndarray], positive: np.ndarray, negative: np.ndarray, seed: list[int]) -> Ftrl:
    rng = np.random.default_rng(seed)
    # half the log odds: the full prior would leave nothing to learn from ordinary sentences
    model = Ftrl(0.5 * math.log((positive.sum() + 1) / (negative.sum() + 2)))
    scale = np.minimum(1.0, MOST_WEIGHT / np.maximum(positive + negative, 1e-9))
    cases = [(i, 1.0, w) for i, w in enumerate(positive * scale) if w > 0.01] + [(i, 0.0, w) for i, w in enumerate(negative * scale) if w > 0.01]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(cases)):
            i, y, weight = cases[k]
            model.learn(examples[i], y, weight)
    return model


def _here(examples: list[np.ndarray], jobs: list[Job]) -> list[tuple[np.ndarray, float]]:
    models = [_learnt(examples, *job) for job in jobs]
    return [(m.dense(), m.bias) for m in models]


def on_cluster(spark: SparkSession):
    """Fits as tasks, one each. What goes out are the examples, bounded by the reviewed documents, and their weights."""

    def fits(examples: list[np.ndarray], jobs: list[Job]) -> list[tuple[np.ndarray, float]]:
        sizes = np.array([len(x) for x in examples], dtype=np.int64)
        sent = spark.sparkContext.broadcast((np.concatenate(examples) if len(examples) else np.zeros(0, np.int32), sizes, jobs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, lengths, wanted = sent.value
            own = np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else []
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    model = _learnt(own, *wanted[k])
                    w = model.dense()
                    kept = np.flatnonzero(w).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([kept], pa.list_(pa.int32())), pa.array([w[kept]], pa.list_(pa.float32())), pa.array([model.bias])], ["id", "kept", "weight", "bias"])

        got = spark.range(len(jobs), numPartitions=len(jobs)).mapInArrow(run, "id bigint, kept array<int>, weight array<float>, bias double").toArrow().sort_by("id").to_pylist()
        made = []
        for row in got:
            dense = np.zeros(1 << BITS, dtype=np.float32)
            dense[np.array(row["kept"], dtype=np.int64)] = row["weight"]
            made.append((dense, row["bias"]))
        sent.destroy()
        return made

    return fits


def fit(docs: list[list[np.ndarray]], labels: np.ndarray, fits=_here) -> tuple[np.ndarray, float]:
    """Weights and bias from documents, each the features of its sentences, and their verdicts.

    Equal sentences are one example. How far each sentence of a document answers for the verdict is estimated
    in turn with the model: each fold of documents by the model of the other folds, with a share of verdicts
    taken to be wrong, so that a sentence found in one misjudged document only convinces nobody. The folds of a round
    don't need each other; fits decides where they are fitted.
    """
    index: dict[bytes, int] = {}
    examples: list[np.ndarray] = []
    held: list[np.ndarray] = []
    for doc in docs:
        own = set()
        for x in doc:
            key = x.tobytes()
            if key not in index:
                index[key] = len(examples)
                examples.append(x)
            own.add(index[key])
        held.append(np.array(sorted(own), dtype=np.int64))
    size = len(examples)
    rng = np.random.default_rng(SEED)
    sentence = np.concatenate(held) if held else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
    y = np.asarray(labels, dtype=bool)
    fold = rng.integers(0, FOLDS, len(held))
    flat = np.concatenate(examples) if examples else np.zeros(0, np.int32)
    at = np.repeat(np.arange(size), [len(x) for x in examples])
    # before any model, a sentence answers for a verdict as its odds among abusive documents stand to those of the others
    abusive, clean = (np.bincount(sentence[k], minlength=size) for k in (y[doc], ~y[doc]))
    odds = np.where(y[doc], ((abusive + 0.5) / (clean + 0.5))[sentence], 0.0)
    blame = odds / np.maximum(np.bincount(doc, weights=odds, minlength=len(held)), 1e-9)[doc]

    def weighed(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # what an abusive document holds beside may be abusive too, so only clean ones are examples against
        return tuple(np.bincount(sentence[keep], weights=w[keep], minlength=size) for w in (blame, np.where(y[doc], 0.0, 1 - blame)))

    for turn in range(ROUNDS):
        evidence = np.zeros(len(sentence))
        models = fits(examples, [(*weighed(fold[doc] != f), [SEED, turn, f]) for f in range(FOLDS)])
        for f, (dense, _) in enumerate(models):
            z = np.bincount(at, weights=dense[flat], minlength=size)
            own = fold[doc] == f
            evidence[own] = z[sentence[own]]
        best = np.full(len(held), -30.0)
        np.maximum.at(best, doc, evidence)
        # evidence against a clean verdict counts half: a sentence may seem abusive for the words it shares with one
        held_against = np.where(y, best, best / 2)
        odds = np.exp(np.clip(held_against, -30, 30)) * np.where(y, (1 - WRONG_ABUSIVE) / WRONG_ABUSIVE, WRONG_CLEAN / (1 - WRONG_CLEAN))
        real = (odds / (1 + odds))[doc]
        share = np.exp(evidence - best[doc])
        share /= np.bincount(doc, weights=share, minlength=len(held))[doc]
        # of two abusive sentences both answer in full
        blame = np.where(y[doc] & (evidence > CERTAIN), real, share * real)
    return fits(examples, [(*weighed(np.ones(len(sentence), dtype=bool)), [SEED, ROUNDS, 0])])[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_DOCUMENTS):
            yield batch.slice(start, SLICE_DOCUMENTS)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        docs = [sentences(t.as_py()) for t in batch.column("text")]
        x, at, owner = features(docs)
        order = np.argsort(at, kind="stable")
        x, sizes = x[order], np.bincount(at, minlength=len(owner))
        parts = np.split(x, np.cumsum(sizes)[:-1]) if len(owner) else []
        own: list[list[np.ndarray]] = [[] for _ in docs]
        for i, part in zip(owner, parts):
            own[i].append(part)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(own, pa.list_(pa.list_(pa.int32())))], ["doc_id", "y", "x"])


def reviewed(labels: DataFrame, most: int = MAX_REVIEWED) -> DataFrame:
    """(doc_id, y): the majority verdict of each reviewed document; ties and null verdicts are left out. More than
    ``most`` documents are cut to the first by a hash of their id."""
    verdict = labels.where("abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share"))
    votes = verdict.where("share != 0.5").select("doc_id", (F.col("share") > 0.5).alias("y"))
    return votes.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def train(documents: DataFrame, labels: DataFrame, most: int = MAX_REVIEWED) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature, weight, bias) of the weights that aren't 0. Without both kinds of verdict no weight is fitted
    and the bias alone says which kind there was."""
    votes = F.broadcast(reviewed(labels, most))  # at most ``most`` rows
    known = documents.select("doc_id", "text").join(votes, "doc_id").mapInArrow(_featurise, "doc_id bigint, y boolean, x array<array<int>>")
    got = known.toArrow().sort_by("doc_id")
    y = np.array(got["y"].to_pylist(), dtype=bool)
    if y.all() or not y.any():
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 5.0 if len(y) and y.all() else -5.0
    docs = [[np.unique(np.asarray(s.as_py() if hasattr(s, "as_py") else s, dtype=np.int32)) for s in d.values] if d.is_valid else [] for d in got["x"]]
    w, bias = fit(docs, y, on_cluster(documents.sparkSession))
    kept = np.flatnonzero(w).astype(np.int32)
    return kept, w[kept], bias


def save_model(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float], path: str) -> None:
    """(feature, weight) rows and, under feature -1, the bias, as Parquet; refuses to overwrite."""
    kept, values, bias = model
    rows = pa.table({"feature": pa.array(np.r_[kept, -1], pa.int32()), "weight": pa.array(np.r_[values.astype(float), bias])})
    spark.createDataFrame(rows).coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, float]:
    """What save_model wrote; at most 2**BITS rows."""
    rows = spark.read.parquet(path).toArrow().sort_by("feature")
    feature, weight = rows["feature"].to_numpy(), rows["weight"].to_numpy()
    return feature[1:], weight[1:].astype(np.float32), float(weight[0])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, values, bias = model.value
        dense = np.zeros(1 << BITS, dtype=np.float64)
        dense[kept] = values
        for batch in _slices(batches):
            docs = [sentences(t.as_py()) for t in batch.column("text")]
            x, at, owner = features(docs)
            # each feature once per sentence, as in fitting
            once = pd.unique((at << np.int64(BITS)) | x)
            at, x = once >> np.int64(BITS), once & np.int64((1 << BITS) - 1)
            z = np.bincount(at, weights=dense[x], minlength=len(owner)) + bias
            most = np.full(len(docs), bias if len(kept) == 0 else -30.0)
            np.maximum.at(most, owner, z)
            score = 1 / (1 + np.exp(-np.clip(most, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(score)], ["doc_id", "source", "score"])

    return run


def scored(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, source, score) by a fitted model."""
    known = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select("doc_id", "source", "text").mapInArrow(_score(known), "doc_id bigint, source string, score double")


def scores(documents: DataFrame, labels: DataFrame, most: int = MAX_REVIEWED) -> DataFrame:
    """(doc_id, source, score): the probability of a document's most abusive sentence. Null and empty texts score
    0, or the bias alone where nothing could be fitted. Copies score alike."""
    return scored(documents, train(documents, labels, most))


def abusive_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id) of the documents that score at least the threshold."""
    return scores(documents, labels).where(F.col("score") >= threshold).select("doc_id")


def source_rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_documents, n_abusive, rate, mean_score) of each source, null among them."""
    hit = (F.col("score") >= threshold).cast("int")
    return scores(documents, labels).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(hit).alias("n_abusive"),
        F.round(F.avg(hit), 6).alias("rate"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )
