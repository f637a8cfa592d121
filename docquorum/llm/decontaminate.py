"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequences and answers.

1. *Slots.* Words are hashed to a fixed number of slots; every text becomes a row of slot numbers, written once.
2. *Statistics.* Document frequencies of the slots, over all documents.
3. *Randomised SVD.* The matrix of TF-IDF passages is met twice. Every task multiplies its passages with a random
   matrix and back, and returns one table of slots by columns; the sum of the tables spans the leading right singular
   vectors. In the second pass every task returns the small Gram matrix of its passages in that basis.
4. *Search.* Passages of about the length of an item, overlapping by half, are projected and scaled by the inverse
   singular values; all items with a cosine above ``min_cosine`` are candidates. All passages of all documents meet
   all items in blocks.
   Beside them, every run of ``RUN`` words of every item (a shorter item whole) is looked up at every word of every
   document. A passage that shares one is a candidate whatever its cosine, so no item that stands in a text word for
   word is lost.
5. *Check.* The words around a candidate are compared with the item. A document leaks an item if their longest common
   subsequence holds ``strong`` of the item's words, or ``weak`` of them and ``answer`` of the item's last sentence,
   which is where its answer stands.

Only fixed-size tables are sent around: slots by columns, and blocks of items. Texts are never shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

from .words import byte_words

SLOTS = 2048
RANK = 48
SPARE = 8
PASSAGE = 256
STEP = 8
WIDTHS = (16, 32, 64)
MAX_ITEMS = 50_000
RUN = 4
HIGH_BITS = 22


def hashes_of(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))


def slots_of(tokens: list[bytes]) -> np.ndarray:
    return (hashes_of(tokens) % SLOTS).astype(np.int16)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A number for every run of ``n`` words."""
    total = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n if len(total) else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(total)].astype(np.uint64) + np.uint64(1)
    return total


def _slot_rows(texts: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([slots_of(byte_words(t)).tobytes() for t in batch])

    return texts.select(encode(F.col("text")).alias("slots"))


def _summed(rows: DataFrame, per_task, width: int) -> np.ndarray:
    """Sum over all tasks of a table of fixed size that each makes of its rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = per_task(batches)
        yield pd.DataFrame({"row": range(len(total)), "values": list(total.astype(np.float64))})

    parts = rows.mapInPandas(run, "row int, values array<double>")
    cells = parts.select("row", F.posexplode("values").alias("column", "value"))
    sums = cells.groupBy("row", "column").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((max(int(sums["row"].max()) + 1, 1) if len(sums) else 1, width))
    out[sums["row"], sums["column"]] = sums["value"]
    return out


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches):
        total = np.zeros((1, SLOTS + 1))
        for frame in batches:
            for raw in frame["slots"]:
                total[0, np.unique(np.frombuffer(raw, np.int16))] += 1
            total[0, SLOTS] += len(frame)
        return total

    sums = _summed(rows, count, SLOTS + 1)[0]
    return sums[:SLOTS], int(sums[SLOTS])


def _passages(frames: Iterator[pd.DataFrame], idf: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of TF-IDF rows of length one; every text is cut into passages, the last may be shorter."""
    def block(parts: list[np.ndarray]) -> np.ndarray:
        at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        counts = np.bincount(at * SLOTS + np.concatenate(parts), minlength=len(parts) * SLOTS)
        dense = counts.reshape(len(parts), SLOTS).astype(np.float32)
        dense *= idf
        dense /= np.maximum(np.sqrt(np.einsum("ij,ij->i", dense, dense)), 1e-12)[:, None]
        return dense

    held: list[np.ndarray] = []
    for frame in frames:
        for raw in frame["slots"]:
            slots = np.frombuffer(raw, np.int16)
            for begin in range(0, len(slots), PASSAGE):
                held.append(slots[begin:begin + PASSAGE])
                if len(held) == 256:
                    yield block(held)
                    held = []
    if held:
        yield block(held)


def latent_space(rows: DataFrame, seed: int = 7) -> np.ndarray:
    """Slots by ``RANK``: idf, right singular vector and inverse singular value in one."""
    held_by, n = _frequencies(rows)
    idf = np.log((n + 1) / (held_by + 1)).astype(np.float32) + np.float32(0.05)
    omega = np.random.default_rng(seed).standard_normal((SLOTS, RANK + SPARE)).astype(np.float32)

    def there_and_back(frames):
        total = np.zeros((SLOTS, RANK + SPARE))
        for a in _passages(frames, idf):
            total += a.T @ (a @ omega)
        return total

    basis = np.linalg.qr(_summed(rows, there_and_back, RANK + SPARE))[0].astype(np.float32)
    if basis.shape[0] != SLOTS:  # no passage at all
        return np.zeros((SLOTS, RANK), np.float32)

    def gram(frames):
        total = np.zeros((RANK + SPARE, RANK + SPARE))
        for a in _passages(frames, idf):
            b = a @ basis
            total += b.T @ b
        return total

    values, vectors = np.linalg.eigh(_summed(rows, gram, RANK + SPARE))
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    scale = np.where(values > 1e-9 * max(values[0], 1e-12), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)
    return (idf[:, None] * (basis @ vectors) * scale).astype(np.float32)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of words, with one bit for each word of ``a``."""
    where: dict[bytes, int] = {}
    for i, word in enumerate(a):
        where[word] = where.get(word, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for word in b:
        match = row & where.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def last_sentence(tokens: list[bytes]) -> list[bytes]:
    """The words after the last sentence end but the final one."""
    ends = [i for i, w in enumerate(tokens[:-1]) if w[-1:] in b".!?"]
    return tokens[ends[-1] + 1:] if ends else tokens


def _width(n: int) -> int:
    return min(WIDTHS, key=lambda w: (abs(w - n), w))


class _Items:
    """A block of items: words, answer, runs, and unit vectors by passage width (long items as several pieces)."""

    def __init__(self, rows: list[tuple[int, str]], space: np.ndarray):
        self.ids = [r[0] for r in rows]
        self.words = [byte_words(r[1]) for r in rows]
        self.counts = [Counter(w) for w in self.words]
        self.answers = [last_sentence(w) for w in self.words]
        # Which slots an item has words in; the last column stands for the blank behind a text.
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.holds = np.zeros((len(rows), SLOTS + 1), bool)
        for n, tokens in enumerate(self.words):
            self.holds[n, slots_of(tokens)] = True
        # By length of the run: sorted runs, their items, their places in them, and a table of their high bits.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        chosen: dict[int, list] = {}
        for n, tokens in enumerate(self.words):
            if tokens:
                long = min(RUN, len(tokens))
                keys = _runs(hashes_of(tokens), long)
                chosen.setdefault(long, []).append((keys, np.full(len(keys), n), np.arange(len(keys))))
        for long, parts in chosen.items():
            keys, numbers, places = (np.concatenate(x) for x in zip(*parts))
            order, high = np.argsort(keys, kind="stable"), np.zeros(1 << HIGH_BITS, bool)
            high[keys >> np.uint64(64 - HIGH_BITS)] = True
            self.runs[long] = keys[order], numbers[order], places[order], high
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        made: dict[int, list] = {w: [] for w in WIDTHS}
        for n, tokens in enumerate(self.words):
            width = _width(len(tokens))
            for begin in range(0, max(1, len(tokens) - width // 2), width):
                piece = slots_of(tokens[begin:begin + width])
                if len(piece):
                    made[width].append((n, space[piece].sum(axis=0)))
        for width, parts in made.items():
            if parts:
                self.by_width[width] = np.array([p[0] for p in parts]), _unit(np.stack([p[1] for p in parts])).T


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _sharing(tokens: list[list[bytes]], hashes: list[np.ndarray], items: _Items) -> set[tuple[int, int, int]]:
    """(document, item, first word the item would have) of all places where some documents share a run with an item."""
    begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    flat, found = np.concatenate(hashes), set()
    for long, (keys, numbers, places, high) in items.runs.items():
        runs = _runs(flat, long)
        hits = np.flatnonzero(high[runs >> np.uint64(64 - HIGH_BITS)])
        low, up = (np.searchsorted(keys, runs[hits], side) for side in ("left", "right"))
        many = up - low
        hit = np.repeat(hits, many)
        which = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        owner = np.searchsorted(begin, hit, "right") - 1
        inside = hit + long <= begin[owner + 1]
        at = hit - begin[owner] - places[which]
        found.update(zip(owner[inside].tolist(), numbers[which[inside]].tolist(), at[inside].tolist()))
    return found


def _candidates(tokens: list[list[bytes]], hashes: list[np.ndarray], space: np.ndarray, items: _Items,
                min_cosine: float, weak: float):
    """(document, item, first word, width, cosine) of all passages of some documents that are near an item.

    A near passage only counts if so many words around it fall on slots of the item as a leak must share with it.
    """
    blank = len(space) - 1  # a row of zeros behind the slots fills up the last step of a text
    steps = [-(-len(t) // STEP) for t in tokens]
    flat = np.full(sum(steps) * STEP, blank, np.int32)
    begin = np.concatenate([[0], np.cumsum(steps)]) * STEP
    for t, at in zip(hashes, begin):
        flat[at:at + len(t)] = t % SLOTS
    owner = np.repeat(np.arange(len(tokens)), steps)
    first = np.repeat(begin[:-1] // STEP, steps)
    sums = space[flat].reshape(-1, STEP, space.shape[1]).sum(axis=1)
    last = first + np.repeat(steps, steps) - 1
    totals = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
    # The same slots with so many blanks around each document that no window reaches another one.
    spare = int(items.sizes.max(initial=0)) + max(WIDTHS)
    wide = np.full(len(flat) + 2 * spare * len(tokens), blank, np.int16)
    shift = (2 * np.arange(len(tokens)) + 1) * spare
    for d in range(len(tokens)):
        wide[begin[d] + shift[d]:begin[d + 1] + shift[d]] = flat[begin[d]:begin[d + 1]]
    holds = items.holds.ravel()
    for width, (numbers, vectors) in items.by_width.items():
        many = width // STEP
        at = np.arange(len(sums))
        starts = at[((at - first) % (many // 2) == 0) & ((at == first) | (at + many // 2 <= last))]
        if not len(starts):
            continue
        reach = np.minimum(starts + many, last[starts] + 1)
        near = _unit((totals[reach] - totals[starts]).astype(np.float32)) @ vectors
        p, c = np.divmod(np.flatnonzero(near >= min_cosine), near.shape[1])
        s, n = starts[p], numbers[c]
        for part in range(0, len(p), 20_000):
            at_once = slice(part, part + 20_000)
            reach_out = int(items.sizes[n[at_once]].max())
            windows = np.lib.stride_tricks.sliding_window_view(wide, width + 2 * reach_out)
            slots = windows[s[at_once] * STEP + shift[owner[s[at_once]]] - reach_out]
            shared = holds.take(slots + n[at_once, None] * (SLOTS + 1)).sum(axis=1)
            for i in np.flatnonzero(shared >= weak * items.sizes[n[at_once]]) + part:
                yield int(owner[s[i]]), int(n[i]), int((s[i] - first[s[i]]) * STEP), width, float(near[p[i], c[i]])


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_cosine: float = 0.4, strong: float = 0.7,
               weak: float = 0.5, answer: float = 0.8, text: str = "text", doc_id: str = "doc_id",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it leaks: ``doc_id, text_hash, item_id, overlap, answer_found, cosine, at``.

    ``overlap`` is the best share of the item's words in a common subsequence, ``at`` the first word of the passage
    where it was found, counted from 0. An item that stands in a document word for word is always reported. Null and empty texts or items match nothing. Rows with the same id and text
    give equal rows. Empty tables give an empty result; columns of the same names in both tables do not clash, and
    other columns are not looked at. Items are handled in blocks of ``MAX_ITEMS``, one pass over the texts for each.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    space = latent_space(cut_lineage(_slot_rows(texts)))
    space = np.vstack([space, np.zeros((1, space.shape[1]), np.float32)])
    items = cut_lineage(benchmark.filter(F.col(item_text).isNotNull()).select(
        F.col(item_id).alias("item_id"), F.col(item_text).alias("text")))
    blocks = -(-items.count() // MAX_ITEMS)
    kind = dict(items.dtypes)["item_id"]
    schema = (f"doc_id {dict(texts.dtypes)['doc_id']}, text_hash long, item_id {kind}, overlap double, "
              "answer_found boolean, cosine double, at int")
    found = None
    for block in range(max(1, blocks)):
        mine = items if blocks <= 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast((_Items([tuple(r) for r in mine.collect()], space), space))

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ready, vectors = shared.value
            for frame in frames:
                out = []
                for begin in range(0, len(frame), 200):
                    part = frame.iloc[begin:begin + 200]
                    tokens = [byte_words(t) for t in part["text"]]
                    hashes = [hashes_of(t) for t in tokens]
                    best: dict[tuple[int, int], tuple] = {}
                    shared_runs = ((d, n, at, len(ready.words[n]), None) for d, n, at in sorted(
                        _sharing(tokens, hashes, ready)))
                    near = _candidates(tokens, hashes, vectors, ready, min_cosine, weak)
                    for d, n, at, width, cosine in chain(shared_runs, near):
                        wanted, known = ready.words[n], best.get((d, n))
                        if known and known[:2] == (1.0, True):
                            continue
                        if cosine is None:
                            at, width = max(0, at), width + min(0, at)
                        around = tokens[d][max(0, at - len(wanted)):at + width + len(wanted)]
                        counts = ready.counts[n]
                        held = list(filter(counts.__contains__, around))
                        if len(held) < weak * len(wanted):
                            continue
                        common = sum(min(k, counts[w]) for w, k in Counter(held).items())  # no subsequence is longer
                        if common < weak * len(wanted):
                            continue
                        overlap = lcs(wanted, around) / len(wanted)
                        if overlap < weak:
                            continue
                        told = lcs(ready.answers[n], around) >= answer * len(ready.answers[n])
                        if overlap >= strong or told:
                            if cosine is None:
                                here = vectors[hashes[d][at:at + width] % SLOTS].sum(axis=0)
                                item = vectors[slots_of(wanted)].sum(axis=0)
                                cosine = float((_unit(here[None]) * _unit(item[None])).sum())
                            row = (overlap, told, cosine, at)
                            best[d, n] = max(best.get((d, n), row), row)
                    ids, marks = part["doc_id"].tolist(), part["text_hash"].tolist()
                    out += [(ids[d], marks[d], ready.ids[n], *row) for (d, n), row in best.items()]
                yield pd.DataFrame(out, columns=[
                    "doc_id", "text_hash", "item_id", "overlap", "answer_found", "cosine", "at"])

        part = texts.mapInPandas(search, schema)
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  **options) -> DataFrame:
    """The documents that leak no item; all their columns stay."""
    leaks = find_leaks(docs, benchmark, text=text, doc_id=doc_id, **options).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(leaks, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left_anti")
