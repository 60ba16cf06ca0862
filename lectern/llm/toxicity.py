"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.lineage import spread

#: At most so many labelled documents of each label are learned from, chosen by a hash of their id.
LEARNED = 3000
LANDMARKS = 240
#: The machine's clean examples: the worst strings of so many sentences of clean documents, and so many strings of theirs drawn at random.
CLEAN_SENTENCES, CLEAN_STRINGS = 20_000, 8_000
#: Subsequences of 3 characters within 5 and of 4 within 6; each character of the span weighs DECAY.
SHAPES = [(0, *inner, span - 1) for size, most in ((3, 5), (4, 6)) for span in range(size, most + 1) for inner in combinations(range(1, span - 1), size - 2)]
DECAY = 0.65
#: A longer word gives windows of WINDOW characters, so any 20 characters of it lie in one whole.
WINDOW, STEP = 28, 8
#: What is learned from a document: so many of its sentences, those whose checksum is lowest, in stretches of so many words.
SENTENCES, SENTENCE_WORDS = 200, 100
#: A phrase is two or three words in order among so many words of a sentence that follow each other.
REACH = 4
#: A phrase is learned if so many toxic documents, and so large a share of them, have it, if each of its words is harmless (its log odds at most HARMLESS), and if it surely says that much more than they do.
PHRASE_DOCUMENTS, PHRASE_SHARE, PHRASE_GAIN, HARMLESS = 8, 0.02, 2.0, 1.0
#: Clean phrases of the same words that are examples, and how like one of these words another must be to make a phrase with it.
NEAR_MISSES, ALIKE = 20_000, 0.5
KEPT_WORDS = 300_000
TABLE_BITS = 20

_TOKEN = re.compile(r"[^\W_](?:\S*[^\W_])?")
_SPELLED = re.compile(r"(?<!\w)[^\W\d_](?:[\W_]{1,3}[^\W\d_](?!\w)){2,}")
_BETWEEN = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def strings(text: str) -> set[str]:
    """The strings of a sentence or text that the kernel compares: lower-case words with what is inside them, and words spelled out letter by letter with up to three other characters between.  A very long word gives overlapping windows."""
    text = text.lower()
    found = set(_TOKEN.findall(text))
    found.update(_BETWEEN.sub("", m) for m in _SPELLED.findall(text))
    long = [w for w in found if len(w) > WINDOW]
    for w in long:
        found.discard(w)
        found.update(w[i : i + WINDOW] for i in range(0, len(w), STEP))
    return found


def spoken(text: str) -> list[list[str]]:
    """The words of each sentence in order; those that are too long for one window are in no phrase."""
    return [words for s in _SENTENCE.split(text.lower()) if (words := [w for w in _TOKEN.findall(s) if len(w) <= WINDOW])]


def phrases(words: list[str], fits: Callable[[str], bool]) -> set[str]:
    """The phrases of a sentence whose words all fit."""
    at = [i for i, w in enumerate(words) if fits(w)]
    found = set()
    for n, i in enumerate(at):
        near = [j for j in at[n + 1 : n + REACH] if j - i < REACH]
        found.update(f"{words[i]} {words[j]}" for j in near)
        found.update(f"{words[i]} {words[j]} {words[k]}" for j, k in combinations(near, 2))
    return found


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word index, subsequence code, weight) of each subsequence, and each word's norm.

    Words are marked at both ends.  The norm is that of the weights place by place, so it depends on
    the word's length alone; dividing by it keeps the kernel positive definite.
    """
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))  # characters from here to the word's end
    index, codes, weights = [], [], []
    norm = np.zeros(len(words))
    with np.errstate(over="ignore"):
        for shape in SHAPES:
            span = shape[-1] + 1
            at = np.flatnonzero(left >= span)
            code = np.full(len(at), len(shape), dtype=np.uint64)
            for step in shape:
                code = (code + letters[at + step]) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            index.append(owner[at])
            codes.append(code)
            weights.append(np.full(len(at), DECAY**span))
            norm += np.maximum(sizes - span + 1, 0) * DECAY ** (2 * span)
    return np.concatenate(index), np.concatenate(codes), np.concatenate(weights), np.sqrt(np.maximum(norm, 1e-12))


class Weights:
    """A function of subsequences, summed over a word's and divided by its norm."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values
        self.there = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.there[(codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def __call__(self, words: list[str], at_once: int = 20_000) -> np.ndarray:
        out = []
        for i in range(0, len(words), at_once):
            part = words[i : i + at_once]
            index, codes, weights, norm = features(part)
            hit = np.flatnonzero(self.there[(codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.codes, codes[hit]), len(self.codes) - 1)
            value = np.where(self.codes[at] == codes[hit], self.values[at], 0.0)
            out.append(np.bincount(index[hit], weights=value * weights[hit], minlength=len(part)) / norm)
        return np.concatenate(out) if out else np.zeros(0)


def kernel(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the landmarks' subsequences, landmark by code weights over norm, kernel of words and landmarks)."""
    index, codes, weights, norm = features(landmarks)
    known, column = np.unique(codes, return_inverse=True)
    basis = np.zeros((len(landmarks), len(known)))
    np.add.at(basis, (index, column), weights / norm[index])
    gram = np.zeros((len(words), len(landmarks)))
    for i in range(0, len(words), 2000):
        part = words[i : i + 2000]
        index, codes, weights, norm = features(part)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[at] == codes
        rows = np.zeros((len(part), len(known)))
        np.add.at(rows, (index[hit], at[hit]), weights[hit] / norm[index[hit]])
        gram[i : i + len(part)] = rows @ basis.T
    return known, basis, gram


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights, with the bias last, of a linear machine with squared hinge loss, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        margin = 1 - y * (x @ theta)
        on = margin > 0
        a = x[on] * weight[on, None]
        grad = theta - 2 * c * a.T @ (y[on] * margin[on])
        step = np.linalg.solve(np.eye(len(theta)) + 2 * c * a.T @ x[on], grad)
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    return theta


class Gate:
    """Which words are like a word of a learned phrase; only these make phrases.  It bounds the kernel with each of them from above, so no phrase that is alike is missed."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.weigh = Weights(codes, values) if len(codes) else None
        self.memo: dict[str, bool] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.memo) > KEPT_WORDS:
            self.memo.clear()
        fresh = [w for w in words if w not in self.memo]
        self.memo.update(zip(fresh, (self.weigh(fresh) >= ALIKE).tolist(), strict=True))

    def phrases(self, said: list[list[str]]) -> set[str]:
        """The phrases of sentences, given their words in order."""
        if self.weigh is None:
            return set()
        self.learn(list({w for words in said for w in words}))
        return set().union(*(phrases(words, self.memo.__getitem__) for words in said))


def _learned_phrases(toxic: list[list[list[str]]], clean: list[list[list[str]]], evidence: dict[str, float]) -> tuple[Counter, Counter]:
    """(toxic documents, clean documents) of each phrase that says more than its words, which are harmless: its log odds pass theirs even if either count is two standard deviations worse."""
    least = max(PHRASE_DOCUMENTS, int(np.ceil(PHRASE_SHARE * len(toxic))))
    often = Counter(w for said in toxic for w in {w for words in said for w in words})
    often = {w for w, n in often.items() if n >= least and evidence.get(w, 0.0) <= HARMLESS}  # a phrase is no more frequent than its words
    all_of = lambda said: set().union(*(phrases(words, often.__contains__) for words in said))
    table = np.zeros(1 << 22, dtype=np.int32)  # counts by checksum first, so only what may be frequent is kept
    for said in toxic:
        np.add.at(table, np.unique(np.fromiter((zlib.crc32(p.encode()) & (len(table) - 1) for p in all_of(said)), dtype=np.int64)), 1)
    bad = Counter(p for said in toxic for p in all_of(said) if table[zlib.crc32(p.encode()) & (len(table) - 1)] >= least)
    bad = Counter({p: n for p, n in bad.items() if n >= least})
    words = {w for p in bad for w in p.split(" ")}
    good = Counter(p for said in clean for p in set().union(*(phrases(s, words.__contains__) for s in said)) if p in bad)
    odds = lambda p: np.log((max(0.0, bad[p] - 2 * bad[p] ** 0.5) + 0.5) / (len(toxic) + 1)) - np.log((good[p] + 2 * good[p] ** 0.5 + 0.5) / (len(clean) + 1))
    kept = {p for p in bad if odds(p) > max(0.0, *(evidence.get(w, 0.0) for w in p.split(" "))) + PHRASE_GAIN}
    return Counter({p: bad[p] for p in kept}), Counter({p: good[p] for p in kept})


def fit(documents: list[tuple[int, list[set[str]], list[list[str]]]], landmarks: int = LANDMARKS, rounds: int = 4, seed: int = 4) -> dict:
    """A model from (label, the strings of each sentence, the words of each sentence in order) of documents.

    The examples are sentences; a sentence's score is that of its highest scoring string or phrase.
    Phrases, which are words of a sentence near each other, in order, are learned where harmless words
    make an insult together; clean sentences with other phrases of the same words are examples too.
    A document's label says of a toxic one only that some sentence is toxic, so of each toxic
    document the highest scoring sentence is taken as toxic, and of clean ones all sentences are
    clean.  The first scores are log odds of subsequences and of the strings themselves; then the
    choice of sentences and strings and the machine are fitted in turn.  A string that is no more
    frequent in toxic documents than in clean ones is never evidence; one that a few clean
    documents hold too can be.  Of clean documents at most CLEAN_SENTENCES sentences and
    CLEAN_STRINGS strings, drawn at random, are examples.  A fifth of the documents is kept from
    the machine and fixes the slope from its margin to a probability.
    """
    rng = np.random.default_rng(seed)
    labels = np.array([y for y, _, _ in documents])
    bags = [set().union(*s) if s else set() for _, s, _ in documents]
    prior = (labels.sum() + 1) / (len(labels) + 2)
    constant = {"codes": [], "values": [], "bias": 0.0, "slope": 0.0, "shift": float(np.log(prior / (1 - prior))), "gate_codes": [], "gate_values": []}
    kept = np.array([i % 5 == 4 for i in range(len(documents))]) if len(documents) >= 100 else np.zeros(len(documents), dtype=bool)
    toxic, clean = np.flatnonzero((labels == 1) & ~kept), np.flatnonzero((labels == 0) & ~kept)
    words = sorted({w for i in (*toxic, *clean) for w in bags[i]})
    if not len(toxic) or not len(clean) or not words:
        return constant
    log_odds = lambda bad, good: np.log((bad + 0.5) / (len(toxic) + 1)) - np.log((good + 0.5) / (len(clean) + 1))
    counts = [Counter(w for i in side for w in bags[i]) for side in (toxic, clean)]
    said_by = lambda side: [documents[i][2] for i in side]
    learned, also = _learned_phrases(said_by(toxic), said_by(clean), {w: log_odds(n, counts[1][w]) for w, n in counts[0].items()})
    parts = {w for p in learned for w in p.split(" ")}
    made = {i: [phrases(s, parts.__contains__) for s in documents[i][2]] for i in (*toxic, *clean)} if parts else {}
    misses = sorted({p for i in clean for found in made.get(i, ()) for p in found if p not in learned}, key=lambda p: (zlib.crc32(p.encode()), p))[:NEAR_MISSES]
    known_phrases = {*learned, *misses}
    for i, found in made.items():
        bags[i] = bags[i].union(*found) & {*bags[i], *known_phrases}
    words += sorted(known_phrases.difference(words))
    place = {w: i for i, w in enumerate(words)}
    members = {i: np.array([place[w] for w in bags[i]], dtype=np.int64) for i in (*toxic, *clean)}
    bad, good = np.zeros(len(words)), np.zeros(len(words))
    for i in toxic:
        bad[members[i]] += 1
    for i in clean:
        good[members[i]] += 1
    size = 1 << TABLE_BITS
    of = lambda codes: (codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    t, c = np.full(size, 1.0), np.full(size, 1.0 * len(clean) / len(toxic))
    for i in range(0, len(words), 20_000):
        index, codes, _, _ = features(words[i : i + 20_000])
        np.add.at(t, of(codes), bad[i + index])
        np.add.at(c, of(codes), good[i + index])
    odds = np.log(t / len(toxic)) - np.log(c / len(clean))
    scores = np.zeros(len(words))
    for i in range(0, len(words), 20_000):
        index, codes, weights, norm = features(words[i : i + 20_000])
        scores[i : i + len(norm)] = np.bincount(index, weights=odds[of(codes)] * weights, minlength=len(norm)) / norm
    evidence = log_odds(bad, good)
    scores += evidence
    sentences = [np.array([place[w] for w in said], dtype=np.int64) for i in clean for said in (*documents[i][1], *(f & known_phrases for f in made.get(i, ()))) if said]
    sentences = [sentences[i] for i in np.sort(rng.choice(len(sentences), min(CLEAN_SENTENCES, len(sentences)), replace=False))]
    ordinary = np.flatnonzero(good > 0)
    drawn = rng.choice(ordinary, min(CLEAN_STRINGS, len(ordinary)), replace=False)
    threshold, model = -np.inf, None
    for turn in range(rounds):
        chosen = [m[np.argmax(scores[m])] for m in (members[i] for i in toxic) if len(m)]
        chosen = [w for w in chosen if evidence[w] > 0 and scores[w] > threshold]
        if not chosen:
            break
        positive, times = np.unique(chosen, return_counts=True)
        hard = np.setdiff1d([m[np.argmax(scores[m])] for m in sentences], positive)
        negative = np.setdiff1d(np.union1d(hard, drawn), positive)
        if not len(negative):
            break
        marks = [words[i] for i in positive[np.argsort(-times, kind="stable")[: landmarks // 2]]]
        among = hard if len(hard) else negative
        marks += [words[i] for i in rng.choice(among, min(len(among), landmarks - len(marks)), replace=False)]
        known, basis, among = kernel(marks, marks)
        values, vectors = np.linalg.eigh(among)
        solid = values > 1e-8 * values[-1]
        root = vectors[:, solid] / np.sqrt(values[solid])
        rows = np.r_[positive, negative]
        _, _, gram = kernel([words[i] for i in rows], marks)
        y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        weight = np.r_[times / times.sum(), np.full(len(negative), 1 / len(negative))] * len(positive)
        theta = fit_svm(gram @ root, y, weight)
        model = Weights(known, (root @ theta[:-1]) @ basis)
        bias = theta[-1]
        scores = model(words) + bias
        threshold = -0.5
    if model is None:
        return constant
    gate_codes, gate_values = np.zeros(0, dtype=np.uint64), np.zeros(0)
    if any(scores[place[p]] > threshold for p in learned):
        gate_codes, basis, _ = kernel(sorted(parts), sorted(parts))
        gate_values = basis.max(axis=0)
    gate = Gate(gate_codes, gate_values)
    ruled = np.flatnonzero(kept) if labels[kept].sum() >= 10 else np.arange(len(labels))
    memo: dict[str, float] = {}
    for i in ruled:
        bags[i] = set().union(*documents[i][1], gate.phrases(documents[i][2]))
        fresh = [w for w in bags[i] if w not in memo]
        memo.update(zip(fresh, (model(fresh) + bias).tolist(), strict=True))
    margin = np.array([max((memo[w] for w in bags[i]), default=-2.0) for i in ruled])
    line = _logistic(np.clip(margin, -3, 3), labels[ruled])
    return {"codes": model.codes.view(np.int64).tolist(), "values": model.values.tolist(), "bias": float(bias), "slope": line[0], "shift": line[1], "gate_codes": gate_codes.view(np.int64).tolist(), "gate_values": gate_values.tolist()}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression with a slight penalty on the slope."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6]), a.T @ (p - y) + np.array([1e-2 * w[0], 0]))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def learn(df: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", learned: int = LEARNED) -> dict:
    """A model from a table of texts and one of labels by the same key (0 or 1; others and null teach nothing).

    At most ``learned`` ids of each label are used: those that hash lowest; of the texts of one id
    that which hashes lowest.  Only ids are sorted, and the chosen ones, so bounded, are sent to where
    the texts are.  Of each text at most SENTENCES sentences of SENTENCE_WORDS words go on, so one
    task, whose input is bounded in rows and words, fits.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    order = F.xxhash64(F.col(key).cast("string"))
    ids = [rows.where(F.col(label) == y).select(F.col(key).alias("_id"), order.alias("_order"), F.col(label).cast("int").alias("_y")).distinct().orderBy("_order", "_id").limit(learned) for y in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))
    body = F.coalesce(F.col(text), F.lit(""))
    sample = df.select(F.col(key), F.col(text)).join(chosen, F.col(key) == F.col("_id")).groupBy("_order", "_id", "_y").agg(F.min_by(body, F.xxhash64(body)).alias("_text"))
    sample = sample.select("_order", "_y", "_text")

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [learned_part(t) for t in b.pop("_text")]
            b["_strings"] = [[sorted(x) for s in _SENTENCE.split(t) if (x := strings(s))] for t in texts]
            b["_words"] = [spoken(t) for t in texts]
            yield b

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "_y"])
        model = fit([(y, [set(s) for s in said], [list(s) for s in words]) for y, said, words in zip(rows["_y"], rows["_strings"], rows["_words"], strict=True)])
        return pd.DataFrame({k: [v] for k, v in model.items()})

    fitted = (
        sample.mapInPandas(sentences, "_order bigint, _y int, _strings array<array<string>>, _words array<array<string>>").withColumn("_all", F.lit(1)).groupBy("_all")
        .applyInPandas(lambda g: train(g), "codes array<bigint>, values array<double>, bias double, slope double, shift double, gate_codes array<bigint>, gate_values array<double>")
    ).collect()  # one row, as large as the landmarks
    return fitted[0].asDict() if fitted else {"codes": [], "values": [], "bias": 0.0, "slope": 0.0, "shift": 0.0, "gate_codes": [], "gate_values": []}


def learned_part(text: str) -> str:
    """The sentences of a text that are learned from, one a line."""
    parts = []
    for s in _SENTENCE.split(text):
        words = s.split()
        parts += [" ".join(words[i : i + SENTENCE_WORDS]) for i in range(0, len(words), SENTENCE_WORDS)]
    chosen = sorted(range(len(parts)), key=lambda i: (zlib.crc32(parts[i].encode("utf-8", "surrogatepass")), i))[:SENTENCES]
    return "\n".join(parts[i] for i in sorted(chosen))


def score(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row: the probability from the highest scoring string or phrase of its sentences.

    Null and empty texts score as clean as a text can; where nothing could be learned every text has
    the share of toxic labels.  Repeated rows stay; an empty table gives none.
    """
    codes, values = np.array(model["codes"], dtype=np.int64).view(np.uint64), np.array(model["values"], dtype=np.float64)
    bias, slope, shift = model["bias"], model["slope"], model["shift"]
    gate_codes, gate_values = np.array(model["gate_codes"], dtype=np.int64).view(np.uint64), np.array(model["gate_values"], dtype=np.float64)
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = Gate(gate_codes, gate_values)
        weigh = Weights(codes, values) if len(codes) else None
        memo: dict[str, float] = {}
        for batch in batches:
            best = np.full(len(batch), -3.0)
            texts = batch["_text"].tolist()
            for lo in range(0, len(texts) if weigh else 0, 64):
                found = [strings(t) for t in texts[lo : lo + 64]]
                if gate.weigh is not None:
                    found = [f | gate.phrases(spoken(t)) for f, t in zip(found, texts[lo : lo + 64], strict=True)]
                if len(memo) > KEPT_WORDS:
                    memo.clear()
                fresh = [w for w in set().union(*found) if w not in memo]
                memo.update(zip(fresh, weigh(fresh).tolist(), strict=True))
                for i, words in enumerate(found, lo):
                    if words:
                        best[i] = max(map(memo.__getitem__, words)) + bias
            p = 1 / (1 + np.exp(-(np.clip(best, -3, 3) * slope + shift)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p})

    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(run, f"doc_id {kind}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that aren't held out; null and empty texts score as clean as a text can, repeated rows are scored alike, no rows of an empty table."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    held = lambda c: F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held("doc_id")).select("doc_id", "toxic")
    model = learn(docs, labels)
    return score(docs, model).select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
