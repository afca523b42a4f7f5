"""Operator 3: toxicity by weak supervision.

Voters fire or abstain on a text: a short public word list, groups of terms
mined from labelled rows, and patterns (shouting, runs of marks, repetition).
A generative label model (a two-class mixture fitted by expectation
maximisation to the counts of vote patterns) estimates how often each voter
fires on either class, and from what is left over how voters correlate; a
voter that repeats others counts for less. Its posteriors are the labels on
which a logistic regression over the terms and patterns is trained.

A term is a word without the marks around it, or its first four or five
letters: invented words that share a stem are then one term. A term is mined if
so many of the rows that hold it are toxic that chance would give less than one
such term (a binomial bound over all terms tested). Toxic rows count once for each
pair of neighbours that the term has in them, so copies and near copies add nothing.

``MAX_TRAIN`` bounds the labelled rows that are fitted (those with the smallest
hashes of their ids); every text is scored. All mined terms vote and count; the
``OWN_TERMS`` strongest have a weight of their own beside it. Labels are learned only from rows
outside the held-out fold, crc32(doc_id as text) mod 3 = 1. Label, language,
source and id are no input of a score.

Defined results: a null or empty text gets the score of a text without terms; a
null id is not held out and has no label; several labels of a document count as
toxic if one is; without labels nothing is fitted and the word list alone
decides; columns of any name pass through; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 20_000
OWN_TERMS = 1_000
THRESHOLD = 0.7
#: Least share of toxic rows among those that hold a mined term.
LEAST_SHARE = 0.8
GROUPS = 6
MARKS = ".,;:!?\"'`()[]{}<>*#%&$-_=+~|/\\"
#: A short public list of insults; the mined terms add what the labelled rows show.
WORD_LIST = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown", "dumb", "imbecile", "cretin", "bastard", "bitch", "slut", "whore", "vermin", "retard", "asshole", "dummkopf", "arschloch", "abschaum", "connard", "salope", "ordure", "gilipollas", "cabrón", "escoria")
_ASCII = re.compile(r"[\x00-\x7f]+")
PATTERNS = ("shouting", "marks", "repetition")
_KEPT_WORDS = 300_000
#: Counts that a task holds before it passes them on.
FLUSH = 150_000


def terms_of(word: str) -> list[str]:
    """The terms of a lower-case word: itself without marks, and its beginnings."""
    w = word.strip(MARKS)
    if not w:
        return []
    return [w, *(f"{w[:n]}-" for n in (4, 5) if len(w) > n)]


def hash_of(*words: str) -> int:
    return xxhash.xxh64_intdigest("\n".join(words)) >> 1


_NOT_LETTERS = bytes(k for k in range(256) if not chr(k).isalpha() or k > 127)
_NOT_CAPITALS = bytes(k for k in range(256) if not 65 <= k <= 90)


def letters_of(text: str) -> tuple[int, int]:
    """How many letters and how many capitals a text has."""
    data = text.encode("utf-8", "surrogatepass")
    letters, capitals = len(data.translate(None, _NOT_LETTERS)), len(data.translate(None, _NOT_CAPITALS))
    if len(data) == len(text):
        return letters, capitals
    others = Counter(_ASCII.sub("", text))
    return letters + sum(n for c, n in others.items() if c.isalpha()), capitals + sum(n for c, n in others.items() if c.isupper())


def patterns_of(text: str, words: list[str]) -> list[bool]:
    letters, capitals = letters_of(text)
    return [letters > 20 and capitals > 0.6 * letters, text.count("!!") + text.count("??") > 2, len(words) > 20 and len(set(words)) < 0.3 * len(words)]


class Features:
    """Features of a text: terms by number, then patterns, then whether and how many terms it holds."""

    def __init__(self, terms: list[str]):
        self.number = {t: k for k, t in enumerate(terms)}
        self.size = len(terms) + len(PATTERNS) + 2
        self.first_pattern = len(terms)
        self._kept: dict[str, tuple[int, ...]] = {}

    def _hits(self, word: str) -> tuple[int, ...]:
        hits = tuple({self.number[t] for t in terms_of(word) if t in self.number})
        if len(self._kept) >= _KEPT_WORDS:
            self._kept.clear()
        self._kept[word] = hits
        return hits

    def of(self, text: str) -> tuple[set[int], list[bool]]:
        words = text.lower().split()
        kept, found = self._kept, set()
        for word in set(words):
            hits = kept.get(word)
            if hits is None:
                hits = self._hits(word)
            if hits:
                found.update(hits)
        return found, patterns_of(text, words)

    def score(self, text: str, weights: np.ndarray) -> float:
        found, patterns = self.of(text)
        at = self.first_pattern
        z = weights[-1] + sum(weights[k] for k in found) + sum(weights[at + k] for k, on in enumerate(patterns) if on)
        if found:
            z += weights[at + len(PATTERNS)] + weights[at + len(PATTERNS) + 1] * math.log(len(found))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and toxic (null: unknown) of the rows to fit, each text once; a broadcast of at most ``max_train`` ids."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(common.written(chosen, "toxicity-chosen")), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first(common.text_or_empty()).alias("text"), F.max("toxic").alias("toxic"))
    return common.written(rows.select("text", "toxic"), "toxicity-sample")


def mine(rows: DataFrame) -> list[str]:
    """The terms of toxic rows that chance does not explain, by strength of evidence."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, contexts = Counter(), set()

        def flushed() -> Iterator[pa.RecordBatch]:
            for names, at, n in (([t for t, _ in contexts], [h for _, h in contexts], [0] * len(contexts)), ([*clean], [None] * len(clean), [*clean.values()])):
                yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "at": pa.array(at, pa.int64()), "c": pa.array(n, pa.int64())})
            clean.clear()
            contexts.clear()

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = ["", *text.as_py().lower().split(), ""]
                if label:
                    first: dict[str, int] = {}
                    for w, k in dict(zip(reversed(words[1:-1]), range(len(words) - 2, 0, -1))).items():
                        for t in terms_of(w):
                            first.setdefault(t, k)
                    contexts.update((t, hash_of(words[k - 1], words[k + 1])) for t, k in first.items())
                else:
                    clean.update({t for w in set(words) for t in terms_of(w)})
                if len(contexts) + len(clean) > FLUSH:
                    yield from flushed()
        yield from flushed()

    size, bad = (int(x or 0) for x in rows.agg(F.count("toxic"), F.sum("toxic")).first())
    if not bad or bad == size:
        return []
    base = bad / size
    counts = rows.where("toxic is not null").transform(common.in_arrow, count, "term string, at long, c long").groupBy("term", "at").agg(F.sum("c").alias("c"))
    counts = counts.groupBy("term").agg(F.count("at").alias("t"), F.sum("c").alias("c"))
    counts = common.written(counts.where("t >= 3"), "toxicity-terms")
    tested = max(2, counts.count())
    # binomial large deviations: n * KL(share || base) against the logarithm of the number of terms
    share = F.col("t") / (F.col("t") + F.col("c"))
    gain = F.col("t") * F.log(share / base) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    strong = counts.where((share > max(LEAST_SHARE, base)) & (gain > math.log(tested))).orderBy(gain.desc(), "term")  # bounded by the rows that are fitted
    return [r["term"] for r in strong.collect()]


class LabelModel:
    """Two-class mixture over voters that fire or abstain: accuracies by EM, then correlations."""

    def fit(self, patterns: np.ndarray, counts: np.ndarray, prior: float, trusted: np.ndarray, rounds: int = 100) -> LabelModel:
        # a lexicon voter is taken to fire on half the toxic texts and hardly any other until counts say more
        expected = np.where(trusted, 2.0, 0.5)
        votes, n = patterns.astype(float), counts.astype(float)
        q = np.where(votes[:, trusted].any(axis=1), 0.9, 0.02)
        self.weights = np.ones(votes.shape[1])
        self.prior = prior
        for step in range(2):
            for _ in range(rounds):
                on, off = n * q, n * (1 - q)
                self.fires = np.stack([(votes.T @ off + 0.02) / (off.sum() + 2 * expected), (votes.T @ on + expected) / (on.sum() + 2 * expected)])
                new = self.posterior(votes)
                done, q = np.abs(new - q).max() < 1e-6, new
                if done:
                    break
            if step == 0:
                self.correlations = self._correlations(votes, n, q)
                self.weights = 1 / (1 + np.maximum(self.correlations, 0).sum(axis=0))
        return self

    def _correlations(self, votes: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Correlation of the voters within the classes: what class and accuracy leave unexplained."""
        out = np.zeros((votes.shape[1],) * 2)
        for k, w in ((0, n * (1 - q)), (1, n * q)):
            rest = votes - self.fires[k]
            cov = (rest * w[:, None]).T @ rest / max(w.sum(), 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            out += cov / np.outer(sd, sd) * w.sum() / n.sum()
        np.fill_diagonal(out, 0)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        clean, toxic = self.fires
        odds = votes * np.log(toxic / clean) + (1 - votes) * np.log((1 - toxic) / (1 - clean))
        z = math.log(self.prior / (1 - self.prior)) + odds @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.02, steps: int = 60) -> np.ndarray:
    """Weights and intercept for soft labels ``y`` with row weights ``n``, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-4
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def voter_groups(terms: list[str]) -> np.ndarray:
    """The lexicon voter of each term: 0 for the word list, 1 to GROUPS for mined terms by hash."""
    return np.array([0 if t in WORD_LIST else 1 + hashlib.md5(t.encode()).digest()[0] % GROUPS for t in terms], dtype=int)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """The terms and the weights of the linear classifier."""
    rows = sample(docs, labels, max_train)
    mined = mine(rows)
    terms = [*WORD_LIST, *(t for t in mined if t not in WORD_LIST)]
    groups = voter_groups(terms)

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(terms)
        for batch in batches:
            out = [features.of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"found": pa.array([sorted(a) for a, _ in out], pa.list_(pa.int32())), "patterns": pa.array([b for _, b in out], pa.list_(pa.bool_())), "toxic": batch.column(1)})

    # equal rows are counted, so what comes here is small; max_train bounds it in any case
    got = rows.transform(common.in_arrow, featured, "found array<int>, patterns array<boolean>, toxic int").groupBy("found", "patterns", "toxic").count().collect()
    got = sorted(got, key=lambda r: (r["found"], r["patterns"], -1 if r["toxic"] is None else r["toxic"]))
    if not got:  # one word of the list is enough
        return terms, np.append(np.zeros(len(terms) + len(PATTERNS)), [6.0, 1.0, -4.0])
    own = min(len(terms), len(WORD_LIST) + OWN_TERMS)
    counts = np.array([r["count"] for r in got], dtype=float)
    known = [r for r in got if r["toxic"] is not None]
    prior = min(0.5, max(0.01, sum(r["count"] for r in known if r["toxic"]) / max(1, sum(r["count"] for r in known)))) if known else 0.1
    votes = np.zeros((len(got), 1 + GROUPS + len(PATTERNS)), dtype=bool)
    x = np.zeros((len(got), own + len(PATTERNS) + 2))
    for k, r in enumerate(got):
        votes[k, groups[r["found"]]] = True
        votes[k, 1 + GROUPS :] = r["patterns"]
        x[k, [t for t in r["found"] if t < own]] = 1
        x[k, own : own + len(PATTERNS)] = r["patterns"]
        if r["found"]:
            x[k, -2:] = 1, math.log(len(r["found"]))
    fired = votes.any(axis=0) | (np.arange(votes.shape[1]) == 0)  # a voter that never fires has nothing to say
    votes, lexicons = votes[:, fired], (np.arange(votes.shape[1]) <= GROUPS)[fired]
    model = LabelModel().fit(votes, counts, prior, lexicons)
    used = np.append(np.flatnonzero(x.any(axis=0)), x.shape[1])
    weights = np.zeros(x.shape[1] + 1)
    weights[used] = logistic(x[:, used[:-1]], model.posterior(votes.astype(float)), counts)
    return terms, np.concatenate([weights[:own], np.zeros(len(terms) - own), weights[own:]])


def scored(docs: DataFrame, terms: list[str], weights: np.ndarray, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id alone unless given) and the score of every row, in a column of that name."""
    keep = keep or ["doc_id"]
    (text,) = common.fresh(keep, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(terms)
        for batch in batches:
            scores = [features.score(t.as_py() or "", weights) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*keep, name])

    schema = docs.select(*keep).withColumn(name, F.lit(0.0)).schema
    return docs.select(common.text_or_empty().alias(text), *keep).transform(common.in_arrow, run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = scored(docs, *train(docs, common.table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
