"""N-gram Jaccard join: documents whose sets of word n-grams agree to a threshold, linked without any loss.

1. *Sets.* A document's n-grams become 64-bit hashes. Equal sets are one node, named by a hash of the set.
2. *Tiles.* Sizes are cut into bands. Sets in one band that reach the threshold differ in at most D elements, D known
   from the band's largest size. Hashes are dealt out into at least D + 2 parts. A set that fills D + 1 of them agrees
   with every such set in one that it fills. A tile is a band, a part and the content of the part; a node lies in one
   tile for each part it fills, and near the upper end of its band also in tiles of the next band. The few sets that
   fill no more than D parts agree among themselves in at least two parts, empty ones counted: these lie in a further
   tile for every pair of empty parts.
3. *Bitmaps.* A node's bitmap holds the parity of the number of its hashes that fall on each bit. Two bitmaps differ
   in at most as many bits as the sets differ in elements, so counting bits bounds the overlap from above.
4. *Verification.* In every tile nodes stand in an order drawn for that tile, and neighbours are candidates. What
   passes the bound is checked by intersecting the sorted arrays. Candidates inside one component need no check.
5. *Remainder.* A tile that still holds several components is compared in full, in blocks of a fixed number of nodes:
   first by bitmaps, and only nodes with a passing partner in another component by their arrays. A block returns the
   links that join components, never its pairs.

A group of near copies of any size so costs a sort and its own links. Equal sets are folded before their tiles are
shuffled; a node's tiles travel packed by range, six bytes each. Texts are shuffled once, for the nodes that have a
candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docquorum.session import cut_lineage

from .components import components
from .words import byte_words

BITS = 256
BLOCK = 1500
#: Tiles that a task is meant to look through; a range of them is one task's. At least so many ranges.
RANGE_KEYS = 2_000_000
LEAST_RANGES = 64
#: Texts described at a time.
AT_ONCE = 256
CHARS_PER_KEY = 20
LOW_BITS = 48
_CACHE = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, n: int, cache: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, no words give no shingle."""
    tokens = byte_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    if len(cache) > _CACHE:
        cache.clear()
    ids = np.array([cache[w] for w in tokens], np.uint64)
    if len(ids) < n:
        return mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64))
    total = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(total)


def band_of(size: int) -> tuple[int, int]:
    """(lowest size, lowest size of the next band); a band is a quarter wide."""
    low = 1
    while True:
        high = max(low + 1, (5 * low + 3) // 4)
        if size < high:
            return low, high
        low = high


def parts_of(low: int, high: int, percent: int) -> tuple[int, int]:
    """(D, number of parts) for sets of a band that are compared in it, which may be as small as the threshold allows.

    So many parts that all but about one in a thousand of the smallest sets fill D + 1 of them.
    """
    differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
    least = max(1, percent * low // 100)
    parts = differ + 2
    while parts < 2 * differ + 16:
        empty = (1 - 1 / parts) ** least
        spread = math.sqrt(max(parts * (empty - empty**2 * (1 + least / parts)), 0.0))
        if parts * (1 - empty) - 3 * spread >= differ + 1:
            break
        parts += 1
    return differ, parts


def tile_keys(grams: np.ndarray, percent: int, bands: dict) -> np.ndarray:
    """The tiles of a set, as 64-bit hashes."""
    size = len(grams)
    if not size:
        return np.empty(0, np.int64)
    if size not in bands:
        low, high = band_of(size)
        above = max(high + 1, (5 * high + 3) // 4)
        homes = [(low, *parts_of(low, high, percent))]
        if 100 * size >= percent * high:
            homes.append((high, *parts_of(high, above, percent)))
        bands[size] = homes
    keys = []
    spread = mixed(grams) >> np.uint64(16)
    content = mixed(grams + np.uint64(0xA5A5A5A5))
    for lowest, differ, parts in bands[size]:
        if differ == 0:  # only equal sets reach the threshold
            continue
        part = spread % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        dealt = part[order]
        begins = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]])
        with np.errstate(over="ignore"):
            tag = np.uint64(lowest) * np.uint64(0x9E3779B97F4A7C15)
            keys.append(mixed(np.add.reduceat(content[order], begins) + mixed(dealt[begins] + tag)))
            if len(begins) <= differ:  # too few parts hold anything: two such sets may agree in empty parts alone
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), dealt[begins])
                first, second = np.triu_indices(len(empty), 1)
                keys.append(mixed(mixed(empty[first] * np.uint64(1 << 24) + empty[second]) + ~tag))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes on each bit, as 64-bit numbers; as many bits as elements, rounded up to a power
    of two, since a narrow bitmap cannot tell large sets apart."""
    width = max(BITS, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(bits: np.ndarray, length: int) -> np.ndarray:
    """The bitmaps of the same sets with fewer bits: halves of a parity bitmap add up."""
    while bits.shape[-1] > length:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def packed(keys: np.ndarray, ranges: int) -> list[tuple[int, bytes]]:
    """(range, keys) of a set's tiles. A range is told by the upper bits; of the lower ones six bytes are kept."""
    dealt = ((keys.view(np.uint64) >> np.uint64(LOW_BITS)) % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(dealt, kind="stable")
    dealt = dealt[order]
    low = keys[order].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    begins = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]]) if len(dealt) else np.empty(0, np.int64)
    ends = np.r_[begins[1:], len(dealt)]
    return [(int(r), low[6 * i:6 * j]) for r, i, j in zip(dealt[begins], begins.tolist(), ends.tolist())]


def unpacked(ranges: np.ndarray, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the row each is from); keys of different ranges are different numbers."""
    wide = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)
    wide = np.concatenate([wide, np.zeros((len(wide), 2), np.uint8)], axis=1).view(np.int64)[:, 0]
    row = np.repeat(np.arange(len(keys)), [len(k) // 6 for k in keys])
    return wide | (ranges.astype(np.int64)[row] << LOW_BITS), row


def _described(n: int, percent: int, ranges: int):
    @F.pandas_udf("size int, node long, tiles array<struct<range:int,keys:binary>>, bits array<long>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache, bands = _Hashes(), {}
        for texts in (batch.iloc[i:i + AT_ONCE] for batch in batches for i in range(0, len(batch), AT_ONCE)):
            rows = []
            for text in texts:
                grams = gram_set(text, n, cache)
                node = xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)
                tiles = [{"range": r, "keys": k} for r, k in packed(tile_keys(grams, percent, bands), ranges)]
                rows.append((len(grams), node, tiles, bitmap(grams)))
            yield pd.DataFrame(rows, columns=["size", "node", "tiles", "bits"])

    return describe


def _shared_tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tiles with several nodes, each node with the one before it in the order drawn for the tile (or itself)."""
    keys, nodes = [], []
    for frame in frames:
        if len(frame):
            own, row = unpacked(frame["range"].to_numpy(), frame["keys"].tolist())
            keys.append(own)
            nodes.append(frame["node"].to_numpy(np.int64)[row])
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    # Those alone in their tile, nearly all, go before the sort by drawn order.
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    several = np.r_[False, same] | np.r_[same, False]
    key, node = key[several], node[several]
    drawn = mixed(key.view(np.uint64) ^ mixed(node.view(np.uint64)))
    order = np.lexsort((node, drawn, key))
    key, node = key[order], node[order]
    if len(key):  # copies of a node that were not folded yet
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        same = key[1:] == key[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        key, node = key[several], node[several]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
    before = np.where(first, node, np.roll(node, 1))
    for at in range(0, len(key), 100_000):
        part = slice(at, at + 100_000)
        yield pd.DataFrame({"key": key[part], "node": node[part], "before": before[part]})


def _grams(n: int):
    @F.pandas_udf("array<long>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _Hashes()
        for texts in batches:
            yield pd.Series([np.sort(gram_set(t, n, cache).view(np.int64)) for t in texts], dtype=object)

    return grams


@F.pandas_udf(IntegerType())
def overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    """Number of common elements of two sorted arrays."""
    def one(a: np.ndarray, b: np.ndarray) -> int:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not len(short):
            return 0
        at = np.searchsorted(long, short)
        return int((long[np.minimum(at, len(long) - 1)] == short).sum())

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int32")


def reaches(common: Column | np.ndarray, total, percent: int):
    """Whether so many common elements of so many in both sets reach the threshold."""
    return 100 * common >= percent * (total - common)


def _folded(bits: str, other: str) -> Column:
    """Column form of ``folded``; sizes of candidates lie so close that one fold is enough."""
    half = (F.size(bits) / 2).cast("int")
    halves = F.zip_with(
        F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > F.size(other), halves).otherwise(F.col(bits))


def _bound(percent: int) -> Column:
    """Whether the bitmaps leave the threshold within reach."""
    differ = F.aggregate(
        F.zip_with(_folded("a_bits", "b_bits"), _folded("b_bits", "a_bits"),
                   lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("a_size") + F.col("b_size")
    return reaches((total - differ) / 2, total, percent)


def _with_ends(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(
            F.col("node").alias(end), F.col("size").alias(f"{end}_size"), F.col(value).alias(f"{end}_{value}")), end)
    return pairs


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    if labels is None:
        return pairs
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end, "left")
    apart = F.coalesce("in_a", "a") != F.coalesce("in_b", "b")
    return pairs.filter(apart).drop("in_a", "in_b")


def link_nodes(docs: DataFrame, n: int, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(one row per input row: ``doc_id, text_hash, node, size``; ``node, component`` of all linked nodes)."""
    length = docs.agg(F.sum(F.length(text).cast("long")).alias("n")).first()["n"] or 0
    ranges = max(LEAST_RANGES, length // (CHARS_PER_KEY * RANGE_KEYS) + 1)
    described = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        _described(n, percent, ranges)(F.col(text)).alias("d"), F.monotonically_increasing_id().alias("row_no"),
    ).select("doc_id", "text_hash", "row_no", "d.*"))
    members = described.select("doc_id", "text_hash", "node", "size")

    tiles = _once(described).select("node", F.inline("tiles")).repartitionById(ranges, "range").mapInPandas(
        _shared_tiles, "key long, node long, before long")
    tiles = cut_lineage(tiles)
    candidates = tiles.filter("before <> node").select(
        F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).distinct()

    # One described row per node that has a candidate, and from it one text.
    wanted = tiles.select("node").distinct()
    nodes = cut_lineage(described.join(wanted, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("text_hash", "doc_id")).alias("row"), F.first("size").alias("size"),
        F.first("bits").alias("bits")))
    passing = cut_lineage(_with_ends(candidates, nodes, "bits").filter(_bound(percent)).select("a", "b"))

    chosen = nodes.join(
        passing.select(F.col("a").alias("node")).union(passing.select("b")).distinct(), "node", "left_semi")
    # The nodes chosen here grow with the corpus, so their texts are joined by a shuffle at every size.
    sets = cut_lineage(_sets(docs, chosen, n, text, doc_id, "merge"))

    def verified(pairs: DataFrame) -> DataFrame:
        ends = _with_ends(pairs, sets, "grams")
        common = overlap(F.col("a_grams"), F.col("b_grams"))
        return ends.filter(reaches(common, F.col("a_size") + F.col("b_size"), percent)).select("a", "b")

    # First one candidate per node, then those that still join components.
    first = passing.groupBy("b").agg(F.min_by("a", F.xxhash64("a", "b")).alias("a")).select("a", "b")
    links = cut_lineage(verified(first))
    labels = cut_lineage(components(links))
    rest = _across(passing.join(first, ["a", "b"], "left_anti"), labels)
    links = cut_lineage(links.union(verified(rest)))
    labels = cut_lineage(components(links))

    more = _remaining(docs, tiles, nodes, labels, n, percent, text, doc_id)
    if not more.isEmpty():
        labels = cut_lineage(components(links.union(more)))
    return members, labels


def _once(described: DataFrame) -> DataFrame:
    """One row of each node; the rows left out are known by their numbers, so no set is shuffled to find them."""
    first = described.groupBy("node").agg(F.min("row_no").alias("first"))
    surplus = cut_lineage(
        described.select("node", "row_no").join(first, "node").filter("row_no > first").select("row_no"))
    return described if surplus.isEmpty() else described.join(surplus, "row_no", "left_anti")


def _sets(docs: DataFrame, chosen: DataFrame, n: int, text: str, doc_id: str, *hints: str) -> DataFrame:
    """``node, size, grams`` of chosen nodes, made anew from one text of each."""
    # Written, so that Spark knows its size: a small selection is broadcast and no text is shuffled.
    picked = cut_lineage(
        chosen.select("node", "size", F.col("row.text_hash").alias("h"), F.col("row.doc_id").alias("i")))
    for hint in hints:
        picked = picked.hint(hint)
    texts = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    return texts.join(
        picked, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i"))
    ).select("node", "size", _grams(n)(F.col("text")).alias("grams")).dropDuplicates(["node"])


def _remaining(docs, tiles, nodes, labels, n, percent, text, doc_id) -> DataFrame:
    """Links between components that share a tile, found by comparing such tiles in full."""
    placed = tiles.select("key", "node").distinct().join(labels, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.expr("bit_xor(xxhash64(node))").alias("all"),
    ).filter("n > 2 and low <> high").groupBy("n", "all").agg(F.min("key").alias("key"))  # equal tiles once
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = placed.join(several.select("key", "n"), "key").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "block", "node", "component")
    rows = cut_lineage(rows.join(nodes.select("node", "size", "bits"), "node"))
    if rows.isEmpty():
        return rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    grouped = ["key", "left", "right"]
    flagged = cut_lineage(_by_tile(rows, grouped).mapInPandas(
        _near_by_bits(percent), "key long, left int, right int, node long, component long"))
    chosen = nodes.join(flagged.select("node").distinct(), "node", "left_semi")
    sets = _sets(docs, chosen, n, text, doc_id).select("node", "grams")
    return cut_lineage(_by_tile(flagged.join(sets, "node"), grouped).mapInPandas(
        _links_by_grams(percent), "a long, b long"))


def _by_tile(rows: DataFrame, grouped: list[str]) -> DataFrame:
    """Rows so that a block of a tile, which is bounded, lies together in one task."""
    return rows.repartition(*grouped).sortWithinPartitions(*grouped)


def _whole_tiles(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in frames of whole blocks, with the position each block begins at."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        begins = _begins(frame)
        if len(begins) > 1:
            ready = frame.iloc[:begins[-1]]
            yield ready, begins[:-1]
        held = frame.iloc[begins[-1]:] if len(frame) else None
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _begins(frame: pd.DataFrame) -> np.ndarray:
    by = frame[["key", "left", "right"]].to_numpy()
    return np.flatnonzero(np.r_[True, (by[1:] != by[:-1]).any(axis=1)][:len(by)])


def _near_by_bits(percent: int):
    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, begins in _whole_tiles(frames):
            marked = near_rows(frame["bits"].to_numpy(), frame["size"].to_numpy(), frame["component"].to_numpy(),
                               begins, percent)
            yield frame.loc[marked, ["key", "left", "right", "node", "component"]]

    return near


def near_rows(bits: np.ndarray, size: np.ndarray, inside: np.ndarray, begins: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a partner of another component in their tile whose bitmap leaves the threshold within reach.

    Rows at the same distance are compared at once, across all tiles whose narrowest bitmap is as wide.
    """
    count = len(bits)
    tile = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, count]))
    width = np.fromiter(map(len, bits), np.int64, count)
    narrow = np.minimum.reduceat(width, begins)[tile]
    marked = np.zeros(count, bool)
    for w in np.unique(narrow):
        rows = np.flatnonzero(narrow == w)
        matrix = np.empty((len(rows), w), np.uint64)
        for own in np.unique(width[rows]):
            here = np.flatnonzero(width[rows] == own)
            matrix[here] = folded(np.stack([bits[i] for i in rows[here]]).view(np.uint64), w)
        t, s, c = tile[rows], size[rows], inside[rows]
        left, apart = np.arange(len(rows)), 0
        while True:
            apart += 1
            left = left[left + apart < len(rows)]
            left = left[t[left] == t[left + apart]]
            if not len(left):
                break
            a = left[c[left] != c[left + apart]]
            for i in range(0, len(a), 20_000):
                x = a[i:i + 20_000]
                y = x + apart
                differ = np.bitwise_count(matrix[x] ^ matrix[y]).sum(axis=1, dtype=np.int64)
                total = s[x] + s[y]
                hit = reaches((total - differ) / 2, total, percent)
                marked[rows[x[hit]]] = marked[rows[y[hit]]] = True
    return marked


def _links_by_grams(percent: int):
    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, begins in _whole_tiles(frames):
            node, inside, grams = frame["node"].tolist(), frame["component"].tolist(), frame["grams"].tolist()
            out = []
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(frame)]):
                out += _links_of_tile(node[begin:end], inside[begin:end], grams[begin:end], percent)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return links


def _links_of_tile(node: list[int], inside: list[int], grams: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of one tile between components; once two are linked, their members are not compared again."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, a in enumerate(node):
        for k in range(i + 1, len(node)):
            low, high = root(inside[i]), root(inside[k])
            small, large = sorted((len(grams[i]), len(grams[k])))
            if low == high or 100 * small < percent * large:
                continue
            common = len(np.intersect1d(grams[i], grams[k], assume_unique=True))
            if reaches(common, small + large, percent):
                parent[max(low, high)] = min(low, high)
                out.append((min(a, node[k]), max(a, node[k])))
    return out


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text_hash, node, n_shingles, component, component_id`` for every row.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct n-word shingles, words
    lower-cased A-Z. ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included, null if
    no row of the component has an id. A text with fewer than ``n`` words is one shingle; without words, or null, the
    set is empty, ``component_id`` is the row's own id, and nothing links to it. Repeated rows share a node. An empty
    table gives an empty result. Other columns are not looked at.
    """
    members, labels = link_nodes(docs, n, percent, text, doc_id)
    joined = members.join(labels, "node", "left").select(
        "doc_id", "text_hash", "node", F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("component", "node").alias("component"))
    joined = cut_lineage(joined)
    smallest = joined.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return joined.join(smallest, "component", "left").select(
        "doc_id", "text_hash", "node", "n_shingles", "component",
        F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text",
                     doc_id: str = "doc_id") -> DataFrame:
    """The documents without near copies: of each component one row stays, that of the smallest id, then text hash.

    Rows with an empty set all stay. Of repeated rows one stays. Columns are those of the input.
    """
    groups = near_groups(docs, n, percent, text, doc_id)
    stay = groups.filter("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("row")
    ).select(F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash"))
    keyed = docs.withColumn("__text_hash", F.xxhash64(text))
    empty = F.coalesce(F.col(text), F.lit("")).rlike(r"^[ \t\n\x0B\f\r]*$")
    first = keyed.filter(~empty).join(
        stay, (F.col("__text_hash") == F.col("__hash")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left_semi",
    ).dropDuplicates([doc_id, "__text_hash"])
    return first.union(keyed.filter(empty)).drop("__text_hash")
