"""Manifest of a dataset as a content-addressed tree of digests, and proofs that single rows belong to it.

*Leaves* are digests of rows. Within a group (a source) they are ordered and every ``FANOUT`` consecutive ones make a
node, whose digest is that of its children's digests, until one node is left: the group's root. The groups' roots make
a tree of the same kind, whose root names the whole dataset.

*Records.* All that is stored of inner nodes are records from a digest to the digests of its children, by height. A
node is found by its digest alone; equal parts of a tree are stored once.

*Proofs.* Requests for leaves descend from the root. The rank of a group, then of a leaf, written to the base of
``FANOUT``, says which child to follow at every level; the children not followed are the siblings of the proof. Requests
go down together as long as their digits agree, so that a node near the root is looked up once and not once for every
leaf below it; only the last step is taken by each request. The segments then are read in reverse, from leaf to root.

A row's rank comes from a range partitioning by group and order, so that a group of any size spans many tasks, and only
counts per partition are added up. All of it is hashing and joining within Spark's own functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquorum.session import cut_lineage, scratch_dir

FANOUT = 16
GROUPS, TOP = "group", "top"
STEP = "struct<left:string,right:string>"
RECORD_DDL = "digest string, children array<string>"


def framed(value: Column) -> Column:
    """A value that cannot run into its neighbour: its length in bytes, a colon and itself, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def group_key(group: Column) -> Column:
    """A key without nulls that sorts as the groups do: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Add ``rank``, from 0 within each key in order.

    Equal rows are told apart by where they are stored, so that however many there are, they need not share a task.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    spread = tied.repartitionByRange(key, *order, "__tie").sortWithinPartitions(key, *order)
    # Written: counts and rows must come from one partitioning.
    placed = cut_lineage(
        spread.drop("__tie").withColumn("__slot", F.spark_partition_id())
        .withColumn("__serial", F.monotonically_increasing_id()))
    counts = placed.groupBy(key, "__slot").agg(F.count("*").alias("n"), F.min("__serial").alias("first"))
    before = Window.partitionBy(key).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "__slot", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(offsets, [key, "__slot"]).withColumn("rank", F.col("__serial") + F.col("shift")).drop(
        "__slot", "__serial", "shift")


@dataclass
class Manifest:
    """A dataset's tree.

    ``leaves`` is ``key, rank, digest`` and the columns given along; ``groups`` is ``key, number, depth, subroot``;
    ``folder`` holds the records by tree and height.
    """

    leaves: DataFrame
    groups: DataFrame
    folder: str
    root: str | None
    top_depth: int

    def records(self, tree: str, height: int) -> DataFrame:
        return self.leaves.sparkSession.read.schema(RECORD_DDL).parquet(f"{self.folder}/{tree}-{height}")


def _raise_tree(nodes: DataFrame, most: int, folder: str, tree: str) -> tuple[DataFrame, int]:
    """``key, subroot, depth`` of the trees over ``key, idx, n, digest``, n being the nodes of the key; their height.

    The records of each height are written. ``most`` is the largest n.
    """
    done, height = nodes.filter("n = 1").select("key", F.col("digest").alias("subroot"), F.lit(0).alias("depth")), 0
    while most > 1:
        height += 1
        runs = nodes.filter("n > 1").groupBy("key", F.floor(F.col("idx") / FANOUT).alias("idx"), "n").agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # at most FANOUT each
        children = F.transform("run", lambda c: c["digest"])
        raised = cut_lineage(runs.select(
            "key", "idx", F.ceil(F.col("n") / FANOUT).alias("n"), children.alias("children"),
            F.sha2(F.array_join(children, ""), 256).alias("digest")))
        raised.select("digest", "children").dropDuplicates(["digest"]).write.parquet(f"{folder}/{tree}-{height}")
        nodes = raised.select("key", "idx", "n", "digest")
        done = done.union(nodes.filter("n = 1").select("key", "digest", F.lit(height)))
        most = -(-most // FANOUT)
    return cut_lineage(done), height


def build(leaves: DataFrame, folder: str | None = None) -> Manifest:
    """The tree over rows ``key, order, digest``; further columns go along to the manifest's leaves.

    Leaves of a key stand by ``order`` (null first), then by digest. Without rows the root is None.
    """
    folder = folder or scratch_dir(leaves.sparkSession, "manifest")
    placed = cut_lineage(ranked(cut_lineage(leaves), "key", "order", "digest"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"))
    sizes = cut_lineage(ranked(cut_lineage(sizes.withColumn("all", F.lit(0))), "all", "key"))
    most = sizes.agg(F.max("n").alias("n"), F.count("*").alias("groups")).first()
    if not most["groups"]:
        return Manifest(placed, sizes.select("key", "rank", "n", "key").toDF("key", "number", "depth", "subroot"),
                        folder, None, 0)
    nodes = placed.join(sizes.select("key", "n"), "key").select("key", F.col("rank").alias("idx"), "n", "digest")
    subroots, _ = _raise_tree(nodes, most["n"], folder, GROUPS)
    groups = cut_lineage(subroots.join(sizes.select("key", F.col("rank").alias("number")), "key").select(
        "key", "number", "depth", "subroot"))
    top = groups.select(
        F.lit("").alias("key"), F.col("number").alias("idx"), F.lit(most["groups"]).alias("n"),
        F.col("subroot").alias("digest"))
    root, depth = _raise_tree(top, most["groups"], folder, TOP)
    return Manifest(placed, groups, folder, root.first()["subroot"], depth)


def _others(children: Column, digit: Column) -> Column:
    """The children not followed, joined to the left and to the right of the one that is."""
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice(children, digit + 2, F.size(children)), "").alias("right"))


def _descend(states: DataFrame, records: DataFrame) -> DataFrame:
    """One level down: each state ``at, digest, above`` becomes one for every child."""
    met = states.join(records, "digest").select(
        *(c for c in states.columns if c != "digest"), "children", F.posexplode("children").alias("digit", "digest"))
    return met.withColumns({
        "at": F.col("at") * FANOUT + F.col("digit"),
        "above": F.array_append("above", _others(F.col("children"), F.col("digit"))),
    }).drop("children", "digit")


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The requests ``key, rank`` with all their columns, ``digest``, ``subroot`` and ``path``.

    ``path`` is the proof from leaf to root: per level the siblings' digests left and right of the node. A request for a
    leaf that is not there has no row; columns of the input with the three names are replaced.
    """
    spark = requests.sparkSession
    kept = [F.col(f"request.{c}") for c in requests.columns if c not in ("digest", "subroot", "path")]
    runs = cut_lineage(requests.select("key", F.floor(F.col("rank") / FANOUT).alias("run")).distinct())
    wanted = cut_lineage(
        manifest.groups.join(runs.select("key").distinct(), "key", "left_semi"))
    states = spark.createDataFrame([(0, manifest.root)], "at long, digest string").withColumn(
        "above", F.array().cast(f"array<{STEP}>"))
    for height in range(manifest.top_depth, 0, -1):
        states = _descend(states, manifest.records(TOP, height))
        ahead = wanted.select(F.floor(F.col("number") / FANOUT ** (height - 1)).alias("at")).distinct()
        states = states.join(ahead, "at", "left_semi")
    # At a group's root: the descent goes on with the digits of the leaf's rank.
    states = cut_lineage(wanted.join(
        states.select(F.col("at").alias("number"), "digest", "above"), "number").select(
        "key", "depth", "subroot", F.lit(0).cast("long").alias("at"), "digest", "above"))
    deepest = states.agg(F.max("depth").alias("d")).first()["d"] or 0
    for height in range(deepest, 1, -1):
        lower = _descend(states.filter(F.col("depth") >= height), manifest.records(GROUPS, height))
        ahead = runs.select("key", F.floor(F.col("run") / FANOUT ** (height - 2)).alias("at")).distinct()
        lower = lower.join(ahead, ["key", "at"], "left_semi").select(*states.columns)
        states = lower.union(states.filter(F.col("depth") < height))
    # The last step is each request's own: its digit picks one of the run's children.
    alone = states.filter("depth = 0").withColumn("children", F.array("digest")).drop("digest")
    met = alone if not deepest else alone.unionByName(
        states.filter("depth > 0").join(manifest.records(GROUPS, 1), "digest").drop("digest"))
    asked = requests.select(
        "key", "rank", F.floor(F.col("rank") / FANOUT).alias("at"), F.struct(*requests.columns).alias("request"))
    own = asked.join(met, ["key", "at"])
    digit = F.pmod("rank", F.lit(FANOUT)).cast("int")
    step = F.when(F.col("depth") > 0, F.array(_others(F.col("children"), digit))).otherwise(
        F.array().cast(f"array<{STEP}>"))
    return own.filter(digit < F.size("children")).select(
        *kept, F.get("children", digit).alias("digest"), "subroot",
        F.reverse(F.concat("above", step)).alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def document_leaves(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = (
        "doc_id", "source", "lang", "n_chars", "text"), text: str = "text", group: str = "source",
        order: str = "doc_id") -> DataFrame:
    """Leaves of documents by source: ``key, order, digest, presented``.

    ``presented`` is the digest of the row as someone else shows it, with the text ``tampered``; by default the same.
    Nulls in any column are a value of their own. Rows without an id come first, rows that are alike in all fields are
    interchangeable leaves, a null source is a group of its own, and other columns are not looked at.
    """
    shown = [tampered if f == text and tampered is not None else F.col(f) for f in fields]
    digest = row_digest(*map(F.col, fields))
    # A row shown as it is need not be hashed again.
    presented = digest if tampered is None else F.when(tampered.eqNullSafe(F.col(text)), digest).otherwise(
        row_digest(*shown))
    return docs.select(
        group_key(F.col(group)).alias("key"), F.col(order).alias("order"), digest.alias("digest"),
        presented.alias("presented"))


def verify(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Every document's leaf, subroot, root, proof and the root its presented form leads to.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; an empty table gives an empty result.
    """
    manifest = build(document_leaves(docs, tampered))
    requests = manifest.leaves.select("key", "rank", F.col("order").alias("doc_id"), "presented")
    proven = prove(manifest, requests) if manifest.root else requests.select(
        "*", F.col("presented").alias("digest"), F.col("presented").alias("subroot"),
        F.array().cast(f"array<{STEP}>").alias("path"))
    root = F.lit(manifest.root).cast("string")
    return proven.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("presented"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
