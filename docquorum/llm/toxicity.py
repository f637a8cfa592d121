"""Toxic documents by a subsequence string kernel and a support vector machine on Nyström landmarks.

*Kernel.* A string is a word without the marks inside it (``i-d.i_o.t`` is ``idiot``), a run of single characters put
together (``i d i o t``), or up to ``PIECES`` adjoining words of one or two characters put together (``id i ot``). No
string crosses longer words, so sentences are not compared as such. Its features are subsequences of three characters, weighted by ``decay`` to the power of
the length they span (Lodhi et al., 2002), up to ``SPAN`` characters, so inserted characters cost weight, not the
match. Strings are marked at both ends and compared by the cosine of their features.

*Landmarks.* Strings that occur in labelled toxic documents rather than in others are the landmarks z. A string x is
mapped to ``K(x, z) K(z, z)^(-1/2)``, where the kernel of all strings becomes a plain scalar product.

*Machine.* A document is as toxic as its worst string. Labels belong to documents, so training alternates: for a toxic
document speak the strings that toxic documents hold far beyond chance, counted after copies are folded and over all
labelled clean documents, or, without any, the one most like other insults; from every clean document come its highest
strings, and all near the boundary. A linear machine with squared hinge loss learns to part them. A quarter of the sample
only sets the boundary, where a logistic slope turns the highest score of a document into a probability of a half.

*Scoring.* The decision is linear in the features, so landmarks and weights fold into one table of weights per
subsequence, whose size is fixed. Every string of every whole text is scored with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 6
SLOTS = 1 << 16
LONGEST = 40
PIECES = 6
MOST = 1_500
#: Clean documents counted for each toxic one of the sample; toxic documents that hold a string worth counting.
ZEROS, LEAST_HELD = 4, 3
_CACHE = 300_000
_MARKS = {c: None for c in range(128) if not chr(c).isalnum()} | {ord(c): None for c in "…–—«»“”‘’¡¿·•­​"}


def strings(text: str | None) -> set[str]:
    """The distinct strings of a whole text, marked at both ends."""
    found, letters, short = set(), [], []

    def put_together() -> None:
        if len(letters) > 2:
            found.add("^" + "".join(letters) + "$")
        for i in range(len(short) - 1):
            window = short[i]
            for piece in short[i + 1:i + PIECES]:
                window += piece
                if len(window) > 2:
                    found.add("^" + window + "$")

    for word in (text or "").lower().split():
        plain = word.translate(_MARKS)
        if len(plain) == 1:
            letters.append(plain)
        elif plain:
            if len(letters) > 2:
                found.add("^" + "".join(letters) + "$")
            letters = []
        if 0 < len(plain) < 3:
            short.append(plain)
        elif plain:
            put_together()
            short = []
            found.add("^" + plain + "$")
    put_together()
    return found


def _offsets(decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (second, third) distances of a subsequence within the span, with its weight."""
    pairs = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
    j, k = np.array(pairs).T
    return j, k, (decay ** (k + 1 - 3.0)).astype(np.float32)


class Features:
    """Slots and weights of the subsequences of many strings at once."""

    def __init__(self, decay: float):
        self.j, self.k, self.weight = _offsets(decay)

    def __call__(self, many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string number, slot, weight) of every occurrence; weights of a string are scaled to length one.

        A very long string is cut into overlapping pieces, which become strings of the same number: its features are
        those of all its pieces.
        """
        pieces, owner = [], []
        for n, s in enumerate(many):
            for begin in range(0, max(1, len(s) - SPAN + 1), LONGEST - SPAN + 1):
                pieces.append(s[begin:begin + LONGEST])
                owner.append(n)
        if not pieces:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.float32),)
        width = max(map(len, pieces)) + SPAN
        flat = "".join(p.ljust(width, "\0") for p in pieces)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(pieces), width)
        at = np.arange(width - SPAN)
        first = codes[:, at]
        second = np.stack([codes[:, at + j] for j in range(1, SPAN)])
        rows, slots, weights = [], [], []
        for j, k, w in zip(self.j, self.k, self.weight):
            third = second[k - 1]
            row, column = np.nonzero((third != 0) & (first != 0))
            a, b, c = first[row, column], second[j - 1][row, column], third[row, column]
            slot = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D)))
            slot = (slot ^ (slot >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            rows.append(row)
            slots.append((slot >> np.uint32(16)).astype(np.int64))
            weights.append(np.full(len(row), w, np.float32))
        row = np.asarray(owner)[np.concatenate(rows)]
        slot, weight = np.concatenate(slots), np.concatenate(weights)
        # Equal subsequences of a string add up before its length is taken.
        key, where = np.unique(row * SLOTS + slot, return_inverse=True)
        weight = np.bincount(where, weights=weight).astype(np.float32)
        row, slot = (key // SLOTS).astype(np.int32), (key % SLOTS).astype(np.int32)
        length = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(many)))
        return row, slot, weight / length[row].astype(np.float32)


@dataclass
class Model:
    """Folded weights per subsequence, bias, and the logistic scale of a document's highest score."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    decay: float

    def string_scores(self, many: list[str]) -> np.ndarray:
        row, slot, weight = Features(self.decay)(many)
        return np.bincount(row, weights=weight * self.weights[slot], minlength=len(many)) + self.bias

    def highest(self, bag: set[str]) -> float:
        """A document's score: that of its worst string."""
        return float(self.string_scores(sorted(bag)).max()) if bag else self.bias

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -30, 30)))


def sample(labelled: DataFrame, most: int, label: str = "toxic", text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of either label, chosen by a hash of id and text: the same rows in every run."""
    order = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    known = labelled.filter(F.col(label).isin(0, 1)).select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label"), order.alias("draw"))
    halves = [known.filter(F.col("label") == v).orderBy("draw", "text").limit(most) for v in (0, 1)]
    return halves[0].union(halves[1])


def drawn(rows: list, most_chars: int) -> tuple[list[str | None], list[int]]:
    """(texts, labels) of sampled rows: of either label those drawn first, whatever their length, until the next would
    pass ``most_chars``; one at least."""
    texts, labels = [], []
    for value in (0, 1):
        room = most_chars
        for row in sorted((r for r in rows if r["label"] == value), key=lambda r: r["draw"]):
            room -= len(row["text"] or "")
            if room < 0 and value in labels:
                break
            texts.append(row["text"])
            labels.append(value)
    return texts, labels


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST, text: str = "text",
                    doc_id: str = "doc_id", zeros: int = 1) -> DataFrame:
    """``doc_id, text`` and label of at most ``most`` labelled ids with label 1, and ``zeros`` times as many with label 0,
    drawn by a hash of the id.

    The ids are drawn before their texts are looked up. Their number is bounded, so they are broadcast and no text is
    shuffled.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(doc_id, label)
    draw = F.xxhash64(F.col(doc_id).cast("string"))
    halves = [known.filter(F.col(label) == v).orderBy(draw, doc_id).limit(n) for v, n in ((0, zeros * most), (1, most))]
    return docs.select(doc_id, text).join(F.broadcast(halves[0].union(halves[1])), doc_id)


def fit(labelled: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", most: int = MOST,
        landmarks: int = 400, rounds: int = 5, decay: float = 0.5, most_chars: int = 2_000_000) -> Model:
    """Train on a bounded sample of labelled documents: ``most`` of either label, and of these, in the order of their
    draw and whatever their length, as many as fit into ``most_chars`` characters of either label (one at least), each
    text whole. How many clean documents hold what looks like an insult is counted over all labelled rows. With a
    single label, or without rows, the model knows that label's share alone.
    """
    texts, labels = drawn(sample(labelled, most, label, text, doc_id).collect(), most_chars)
    first = first_of_copies([strings(t) for t in texts])
    bags, labels = [bag for bag in first if bag is not None], [v for v, bag in zip(labels, first) if bag is not None]
    held: dict[str, int] = {}
    for bag, value in zip(bags, labels):
        for s in bag if value else ():
            held[s] = held.get(s, 0) + 1
    often = {s for s, n in held.items() if n >= LEAST_HELD}
    return train(bags, np.array(labels, int), landmarks, rounds, decay, clean_counts(labelled, often, label, text))


def first_of_copies(bags: list[set[str]], sketch: int = 16, shared: int = 8) -> list[set[str] | None]:
    """The bags, with None for (near) copies of an earlier one, whose every string would else look like an insult.

    Copies are told by the rarer strings with the least hashes, of which they share half.
    """
    held: dict[str, int] = {}
    for bag in bags:
        for s in bag:
            held[s] = held.get(s, 0) + 1
    common = max(20, len(bags) // 50)
    seen: dict[int, list[int]] = {}
    out: list[set[str] | None] = []
    for n, bag in enumerate(bags):
        least = sorted(zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in bag if held[s] <= common)[:sketch]
        met: dict[int, int] = {}
        for h in least:
            for other in seen.get(h, ()):
                met[other] = met.get(other, 0) + 1
        if least and max(met.values(), default=0) >= min(shared, len(least)):
            out.append(None)
            continue
        for h in least:
            seen.setdefault(h, []).append(n)
        out.append(bag)
    return out


def clean_counts(labelled: DataFrame, often: set[str], label: str, text: str) -> tuple[int, dict[str, int]]:
    """(number of all rows with label 0, how many of them hold each of these strings, which a sample bounds)."""
    clean = labelled.filter(F.col(label) == 0).select(F.col(text).alias("text"))
    shared = labelled.sparkSession.sparkContext.broadcast(often)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, found = 0, {}
        for frame in frames:
            rows += len(frame)
            for t in frame["text"]:
                for s in strings(t) & shared.value:
                    found[s] = found.get(s, 0) + 1
        if rows:
            yield pd.DataFrame([("", rows), *found.items()], columns=["string", "n"])

    sums = clean.mapInPandas(count, "string string, n long").groupBy("string").agg(F.sum("n").alias("n"))
    found = {r["string"]: r["n"] for r in sums.collect()}
    return found.pop("", 0), found


def train(bags: list[set[str]], labels: np.ndarray, landmarks: int, rounds: int, decay: float,
          clean: tuple[int, dict[str, int]] | None = None) -> Model:
    """Train on strings of documents; ``clean`` tells how many clean documents, of how many, hold strings that several
    toxic ones do, by default those given.

    A quarter of either label's documents only sets the boundary, where there are twenty for it at least."""
    turn = np.empty(len(labels), int)
    for value in set(labels.tolist()):
        turn[labels == value] = np.arange((labels == value).sum())
    aside = turn % 4 == 3
    if len(labels) and min((aside & (labels == v)).sum() for v in (0, 1)) < 20:
        aside[:] = False
    learnt = [bag for bag, out in zip(bags, aside) if not out]
    model = _train(learnt, labels[~aside], landmarks, rounds, decay, clean)
    judged = aside if aside.any() else ~aside
    highest = np.array([model.highest(bag) for bag, own in zip(bags, judged) if own])
    if model.slope:
        boundary = _boundary(highest, labels[judged]) if aside.any() else 0.0
        model.slope = max(_logistic(highest, labels[judged])[0], 1.0)
        model.shift = -model.slope * boundary
    return model


def _boundary(highest: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the best stretch of scores to part held-out documents, a false alarm counting as two misses."""
    cuts = np.unique(highest)
    cuts = np.r_[cuts[0] - 1, cuts, cuts[-1] + 1]
    middle = (cuts[1:] + cuts[:-1]) / 2
    caught = 1 - np.searchsorted(np.sort(highest[labels == 1]), middle) / max((labels == 1).sum(), 1)
    alarms = 1 - np.searchsorted(np.sort(highest[labels == 0]), middle) / max((labels == 0).sum(), 1)
    gain = caught - 2 * alarms
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(np.clip((cuts[best[0]] + cuts[best[-1] + 1]) / 2, -0.5, 0.8))


def _train(bags: list[set[str]], labels: np.ndarray, landmarks: int, rounds: int, decay: float,
           clean: tuple[int, dict[str, int]] | None) -> Model:
    share = float((labels.sum() + 0.5) / (len(labels) + 1))
    flat = Model(np.zeros(SLOTS), 0.0, 0.0, float(np.log(share / (1 - share))), decay)
    if len(set(labels.tolist())) < 2:
        return flat
    seen = [dict(), dict()]
    for bag, label in zip(bags, labels):
        for s in bag:
            seen[label][s] = seen[label].get(s, 0) + 1
    kinds = sorted(seen[0].keys() | seen[1].keys())
    number = {s: n for n, s in enumerate(kinds)}
    members = [np.array(sorted(number[s] for s in bag), np.int64) for bag in bags]
    features = Features(decay)
    parts = [features(kinds[i:i + 50_000]) for i in range(0, len(kinds), 50_000)]
    row = np.concatenate([p[0] + np.int32(50_000 * n) for n, p in enumerate(parts)])
    slot, weight = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    del parts
    totals = np.bincount(labels, minlength=2)

    def per_string(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=weight * values[slot], minlength=len(kinds))

    # How far the shares of both labels' documents lie apart that hold a subsequence, or a string, in standard errors.
    def apart(held: np.ndarray) -> np.ndarray:
        both = (held.sum(axis=0) + 1) / (totals.sum() + 2)
        return (held[1] / totals[1] - held[0] / totals[0]) / np.sqrt(both * (1 - both) * (1 / totals).sum())

    held = np.zeros((2, SLOTS))
    begins = np.searchsorted(row, np.arange(len(kinds) + 1))
    for bag, label in zip(members, labels):
        if len(bag):
            held[label, np.unique(np.concatenate([slot[begins[i]:begins[i + 1]] for i in bag]))] += 1
    counts = np.array([[seen[v].get(s, 0) for s in kinds] for v in (0, 1)], float)
    score = per_string(apart(held)) / np.maximum(per_string(np.ones(SLOTS)), 1e-9) + apart(counts)

    # A string that clean documents hold about as often is no insult, however much it looks like one; one that toxic
    # documents hold so often that chance would bring forth no such string among all is one, however rare its language.
    of_all = totals.copy()
    if clean is not None and clean[0] >= totals[0]:
        of_all[0] = clean[0]
        counts[0] = [clean[1].get(s, 0) if c >= LEAST_HELD else n * clean[0] / totals[0]
                     for s, c, n in zip(kinds, counts[1], counts[0])]
    telling = (counts[1] + 0.5) / of_all[1] >= 4 * (counts[0] + 0.5) / of_all[0]
    certain = telling & (counts[1] >= LEAST_HELD) & beyond_chance(counts, of_all)
    toxic = [bag for bag, label in zip(members, labels) if label]
    spotless = [bag for bag, label in zip(members, labels) if not label and len(bag)]
    # Where such strings tell most toxic documents, the others' labels are not pinned on words that chance picks.
    mostly = 2 * sum(certain[bag].any() for bag in toxic) >= len(toxic)
    model, known = flat, np.empty(0, np.int64)
    for turn in range(rounds):
        highest = [score[bag].max() for bag in spotless]
        limit = np.quantile(highest, 0.99) if highest else -np.inf
        if turn:  # scores now are margins; half of one is clear enough
            limit = max(min(limit, 0.5), 0.3)
        speaking = []
        for bag in toxic:
            own = bag[certain[bag]]
            if not len(own) and len(bag):  # what is like the others' insults, or just the highest string, speaks for it
                own = bag[telling[bag]]
                own = own[np.argsort(-score[own], kind="stable")[:1 if mostly else 3]]
                own = own[score[own] > limit] if mostly or (score[own] > limit).any() else own[:1]
            speaking.append(own)
        positive = np.concatenate(speaking) if speaking else np.empty(0, np.int64)
        if not len(positive):
            positive = np.array([bag[np.argmax(score[bag])] for bag in toxic if len(bag)], np.int64)
        negative = np.unique(np.concatenate([
            bag[np.argsort(-score[bag], kind="stable")[:6]] if not turn
            else np.union1d(bag[np.argsort(-score[bag], kind="stable")[:6]], bag[score[bag] > -0.3]) for bag in spotless
        ] or [np.empty(0, np.int64)]))
        negative = known = np.setdiff1d(np.union1d(negative, known), positive)
        if not len(positive) or not len(negative):
            break
        hits, times = np.unique(positive, return_counts=True)
        top = _covering(speaking, hits, landmarks // 2)
        # Half of the clean landmarks are those that look most like insults, half are from anywhere.
        hard = negative[np.argsort(-score[negative], kind="stable")[:landmarks // 4]] if turn else negative[:0]
        others = np.setdiff1d(negative, hard)
        spread = np.linspace(0, len(others) - 1, min(landmarks // 2 - len(hard), len(others))).astype(int)
        marks = np.concatenate([top, hard, others[spread]])
        phi = np.zeros((len(marks), SLOTS), np.float32)
        for n, i in enumerate(marks):
            phi[n, slot[begins[i]:begins[i + 1]]] = weight[begins[i]:begins[i + 1]]
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
        keep = values > 1e-6
        root = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
        used = np.concatenate([hits, negative])

        def mapped(index: np.ndarray) -> np.ndarray:
            out = np.zeros((len(index), len(marks)))
            for n, i in enumerate(index):
                at = slice(begins[i], begins[i + 1])
                out[n] = phi[:, slot[at]] @ weight[at]
            return out @ root

        x, y = mapped(used), np.r_[np.ones(len(hits)), -np.ones(len(negative))]
        # Frequent words weigh more, but do not drown the rest. Both labels have one scale: a clean word that looks like
        # an insult counts as much as the insult.
        often = np.sqrt(np.r_[times, 1 + counts[0][negative]])
        cost = often / often[:len(hits)].sum()
        theta, bias = _squared_hinge(x, y, cost)
        folded = (root @ theta) @ phi
        score = per_string(folded.astype(np.float64)) + bias
        model = Model(folded.astype(np.float64), float(bias), 1.0, 0.0, decay)
    return model


def beyond_chance(counts: np.ndarray, totals: np.ndarray, expected: float = 0.001) -> np.ndarray:
    """Strings held by toxic documents so much more often than by clean ones that fewer than ``expected`` of all strings
    as frequent would be so by chance (likelihood ratio of the split, times the number of such strings)."""
    both = counts.sum(axis=0)
    share = totals / totals.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(counts > 0, counts * np.log(counts / (both * share[:, None])), 0.0).sum(axis=0)
    at_least = len(both) - np.searchsorted(np.sort(both), both)
    return (counts[1] > both * share[1]) & (np.log(at_least) - ratio < np.log(expected))


def _covering(speaking: list[np.ndarray], hits: np.ndarray, most: int) -> np.ndarray:
    """Landmarks from the strings that speak for documents: each next one where fewest have been taken so far, so that
    the insults of a rare language get theirs beside those of a frequent one."""
    if len(hits) <= most:
        return hits
    where = [np.searchsorted(hits, own) for own in speaking]
    held = [[] for _ in hits]
    for n, own in enumerate(where):
        for i in own.tolist():
            held[i].append(n)
    held = [np.array(h, np.int64) for h in held]
    taken = np.zeros(len(speaking))
    gain = np.array([float(len(h)) for h in held])
    chosen = []
    for _ in range(most):
        best = int(np.argmax(gain))
        chosen.append(best)
        for n in held[best].tolist():
            old, taken[n] = (1 + taken[n]) ** -2.0, taken[n] + 1
            gain[where[n]] -= old - (1 + taken[n]) ** -2.0
        gain[best] = -np.inf
    return hits[np.sort(chosen)]


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine by Newton's method on the squared hinge; only margins below one count."""
    design = np.c_[x, np.ones(len(x))]
    theta = np.zeros(design.shape[1])
    penalty = np.full(len(theta), ridge)
    penalty[-1] = 1e-8

    def objective(t: np.ndarray) -> float:
        missing = np.maximum(1 - y * (design @ t), 0)
        return float((cost * missing * missing).sum() + (penalty * t * t).sum())

    now = objective(theta)
    for _ in range(100):
        short = 1 - y * (design @ theta) > 0
        part = design[short]
        goal = np.linalg.solve(
            part.T @ (part * cost[short, None]) + np.diag(penalty), part.T @ (cost[short] * y[short]))
        # A full step may overshoot as examples enter the margin, so it is shortened until it helps.
        length, better = 1.0, now
        while length > 1e-6:
            step = theta + length * (goal - theta)
            better = objective(step)
            if better < now:
                break
            length /= 2
        if not better < now * (1 - 1e-10):
            break
        theta, now = step, better
    return theta[:-1], float(theta[-1])


def _logistic(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with smoothed targets (Platt, 1999)."""
    ones = labels.sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    design, theta = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        spread = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(design.T @ (design * spread[:, None]) + 1e-6 * np.eye(2), design.T @ (goal - p))
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def scorer(spark, model: Model):
    """A function of a text column: the probability of label 1, between 0 and 1."""
    shared = spark.sparkContext.broadcast(model)  # SLOTS weights, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        m = shared.value
        for texts in batches:
            out = []
            for begin in range(0, len(texts), 500):
                bags = [strings(t) for t in texts.iloc[begin:begin + 500]]
                new = list(set().union(*bags) - known.keys())
                if len(known) + len(new) > _CACHE:
                    known = {}
                    new = list(set().union(*bags))
                for i in range(0, len(new), 50_000):
                    known.update(zip(new[i:i + 50_000], m.string_scores(new[i:i + 50_000]).tolist()))
                out += [max(map(known.__getitem__, bag), default=m.bias) for bag in bags]
            yield pd.Series(m.probability(np.array(out, float)))

    return score


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns, and ``toxic_score``.

    A null or empty text, or one whose words are all marks or make no string of three characters even put together, gets
    the score of no evidence. Repeated rows are
    scored alike; an empty table gives an empty result; a column of the input named ``toxic_score`` is replaced.
    """
    return docs.withColumn("toxic_score", scorer(docs.sparkSession, model)(F.col(text)))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document belongs to the part of the labels that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
