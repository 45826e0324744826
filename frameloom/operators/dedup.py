"""Near-duplicate images by perceptual hash: banded pairs, ordered greedy keeping, overlap with a locked set.

Hashes are longs of 64 bits or arrays of them (lanes, for 256 bits and more); two are near when fewer than `threshold` bits differ. `near.py`
finds the pairs by bands. Only distinct hashes are joined: copies, however many, meet as one. Keeping is by rounds over the pairs, each a
join on keys, until what is undecided is small; no row passes the driver. An index of what was kept lets the next images be
decided without those before.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.commits import CommittedTable
from .near import FIRST, banded, met, near_hashes, plan_bands

THRESHOLD = 5


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without one gets a folder of its own; elsewhere that is an error.

    The subpackage llm has helpers like this and the next, since neither may need the other.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="frameloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor costs only the round at work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_table(table: DataFrame) -> None:
    """Delete a shared_table that nothing reads any more."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table._written)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A side of a join of at most this many rows may be broadcast.
BROADCAST_ROWS = 20_000


def small(table: DataFrame) -> DataFrame:
    """The table marked for broadcast if its counted size allows, else as it is: the join then shuffles, and adaptive execution splits hot keys."""
    return F.broadcast(table) if len(table.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS else table


def numbered_rows(rows: DataFrame, *by) -> DataFrame:
    """rows with n, from 1, in the order of `by`.

    Ranges are sorted in parallel and written, lest two readings of one sort differ; each partition's rows are numbered after those before
    it, so no task sees all rows.
    """
    dealt = shared_table(rows.orderBy(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_o"))  # a row per partition
    return dealt.join(F.broadcast(offsets), "_p").withColumn("n", F.col("_o") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_i", "_o")


def hamming_pairs(hashes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b, distance), a < b, of distinct hashes (column h), which are made once."""
    hashes = shared_table(hashes.select("h").distinct())
    return near_hashes(hashes, hashes, threshold).filter("probe < build").select(F.col("probe").alias("a"), F.col("build").alias("b"), "distance")


#: Undecided pairs that one task may put in order; while there are more, rounds go on.
TASK_PAIRS = 200_000


def _fates(nodes: DataFrame, edges: DataFrame, task_pairs: int) -> DataFrame:
    """(ord, kept) of nodes (ord): kept if no earlier neighbour is. edges: later, earlier.

    Rounds: nodes without an earlier undecided neighbour are kept, then their neighbours go, and so do the pairs of both. Each
    round's tables are written, and those of the round before deleted. Once few pairs are left (counted), one task scans them in order.
    """
    kind = nodes.schema["ord"].dataType.simpleString()
    nodes, edges, decided = shared_table(nodes.select("ord")), shared_table(edges.select("later", "earlier")), []
    while edges.count() > task_pairs:
        bound = edges.select(F.col("later").alias("ord")).distinct()
        free = nodes.join(bound, "ord", "left_anti").withColumn("kept", F.lit(True))
        gone = edges.join(free.select(F.col("ord").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("ord")).distinct()
        fixed = shared_table(free.union(gone.withColumn("kept", F.lit(False))))
        decided.append(fixed)
        old, nodes = nodes, shared_table(nodes.join(fixed, "ord", "left_anti"))
        drop_table(old)
        rest = edges.join(fixed.select(F.col("ord").alias("later")), "later", "left_anti").join(fixed.select(F.col("ord").alias("earlier")), "earlier", "left_anti")
        old, edges = edges, shared_table(rest)
        drop_table(old)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for frame in frames:
            for later, earlier in frame[["later", "earlier"]].itertuples(index=False, name=None):
                kept[later] = kept.get(later, True) and not kept.get(earlier, True)
        yield pd.DataFrame({"ord": list(kept), "kept": list(kept.values())})

    last = edges.repartition(1).sortWithinPartitions("later", "earlier").mapInPandas(scan, f"ord {kind}, kept boolean")
    out = nodes.join(last, "ord", "left").select("ord", F.coalesce("kept", F.lit(True)).alias("kept"))
    for fixed in decided:
        out = out.unionByName(fixed)
    return shared_table(out)


def keep_in_order(images: DataFrame, threshold: int = THRESHOLD, known: DataFrame | None = None, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Images (ord, h, flip, sha) one after another are kept unless near a kept one; returns ord, kept, duplicate_of (an ord).

    An image is compared by its hash and its mirror image's hash (flip, may be null) with the hashes of those kept before it, and
    an equal hash is a duplicate whatever the threshold. duplicate_of is the first kept with an equal hash, else the first
    kept that is near. Images without a hash are duplicates of the first with the same sha; without either they stay.
    ord must be unique. known: images kept before all of these (ord, h, sha, and near, the hashes here that are near them: KeptIndex).

    Of equal hashes only the first can be kept, so pairs are those of distinct hashes; a copy of a first that was dropped is
    itself compared only by its own flip, and takes part as a hash of its own where that differs.
    """
    hashed = images.filter("h is not null").select("ord", "h", "flip")
    #: A node is a distinct (h, flip): rows alike in both have the same fate after their first.
    nodes = shared_table(hashed.groupBy("h", "flip").agg(F.min("ord").alias("ord")))
    probe = _probes(nodes)
    near = near_hashes(probe, nodes.select("h"), threshold)
    later = nodes.select(F.col("ord").alias("later"), F.explode(F.array_compact(F.array_distinct(F.array("h", "flip")))).alias("probe"), F.col("h").alias("own"))
    linked = lambda pairs, firsts: later.join(pairs.select("probe", "build"), "probe").join(firsts, "build")
    edges = linked(near, nodes.select(F.col("ord").alias("earlier"), F.col("h").alias("build"))).filter("earlier < later").withColumn("before", F.lit(False))
    if known is not None:
        edges = edges.unionByName(linked(known.near, known.hashes.select(F.col("ord").alias("earlier"), F.col("h").alias("build"))).withColumn("before", F.lit(True)))
    edges = shared_table(edges.groupBy("later", "earlier", "before").agg(F.max(F.col("own") == F.col("build")).alias("equal")))
    gone = edges.filter("before").select(F.col("later").alias("ord")).distinct()
    open_nodes = nodes.select("ord").join(gone, "ord", "left_anti")
    among = edges.filter("not before").join(gone.select(F.col("ord").alias("later")), "later", "left_anti").join(gone.select(F.col("ord").alias("earlier")), "earlier", "left_anti")
    state = _fates(open_nodes, among, task_pairs).unionByName(gone.withColumn("kept", F.lit(False)))
    first = F.min(F.struct((~F.col("equal")).alias("unequal"), "earlier"))
    standing = edges.filter("before").unionByName(edges.filter("not before").join(state.filter("kept").select(F.col("ord").alias("earlier")), "earlier", "left_semi").select(edges.columns))
    of = standing.groupBy("later").agg(first.alias("of"))
    decided = state.join(of, state["ord"] == of["later"], "left").select(F.col("ord").alias("node"), F.col("kept").alias("node_kept"), F.col("of.earlier").alias("node_of"))
    #: Images are joined once, and last, so that adaptive execution can split what many copies share.
    decided = nodes.withColumnsRenamed({"ord": "node", "h": "nh", "flip": "nf"}).join(decided, "node")
    rows = hashed.join(decided, F.col("h").eqNullSafe(F.col("nh")) & F.col("flip").eqNullSafe(F.col("nf"))).select(
        "ord", ((F.col("ord") == F.col("node")) & F.col("node_kept")).alias("kept"),
        F.when(F.col("ord") == F.col("node"), F.col("node_of")).when(F.col("node_kept"), F.col("node")).otherwise(F.col("node_of")).alias("duplicate_of"),
    )
    bare = images.filter("h is null").select("ord", "sha")
    shas = bare.filter("sha is not null")
    if known is not None:
        shas = shas.unionByName(known.bare.select("ord", "sha").join(shas.select("sha").distinct(), "sha", "left_semi").select("ord", "sha"))
    firsts = shas.groupBy("sha").agg(F.min("ord").alias("first"))
    bare = bare.join(firsts, "sha", "left").select("ord", (F.coalesce("first", "ord") == F.col("ord")).alias("kept"), F.when(F.col("first") < F.col("ord"), F.col("first")).alias("duplicate_of"))
    return rows.union(bare)


def _probes(nodes: DataFrame) -> DataFrame:
    """The hashes that nodes are compared by."""
    return nodes.select("h").union(nodes.filter("flip is not null").select(F.col("flip").alias("h")))


@dataclass(frozen=True)
class Known:
    """Images kept before: their hashes (ord, h), those without one (ord, sha), and pairs (probe, build) of a hash now and one of theirs that is near it."""

    hashes: DataFrame
    bare: DataFrame
    near: DataFrame


class KeptIndex:
    """What merges have kept, at a path, so that the next images are decided against it without a look at those before.

    A committed table whose every version is one merge: a row per kept image (ord, h, sha), and a row per band of its hash (band, value, h),
    in order of band and value, so that what a few probes look for is found by the files' statistics. Hashes are lanes of one width. The cut into bands is
    planned for a number of hashes to come (capacity); an index of another cut is refused. Where the lookups of the next images outnumber the kept hashes
    (both counted), these are read and cut anew, for as many as there are; the pairs are the same.
    """

    SCHEMA = "band int, value long, ord long, h array<long>, sha string"
    #: Kept hashes that are read at the cost of a lookup.
    PER_LOOKUP = 1

    def __init__(self, spark: SparkSession, path: str, bits: int, threshold: int = THRESHOLD, capacity: int = 1_000_000_000):
        self.table, self.threshold, self.plan = CommittedTable(spark, path, self.SCHEMA), threshold, plan_bands(bits, threshold, capacity)

    def _known(self, rows: DataFrame, images: DataFrame) -> Known:
        kept = rows.filter("band is null")
        probes = shared_table(_probes(images.filter("h is not null").select("h", "flip")).distinct())
        lookups, hashes = probes.count() * self.plan.lookups, kept.filter("h is not null").select("h")
        if lookups > BROADCAST_ROWS and lookups * self.PER_LOOKUP > hashes.count():
            near = near_hashes(probes, hashes, self.threshold)
        else:
            near = met(small(banded(probes, self.plan, probe=True)), rows.filter("band is not null").select("band", "value", "h"), self.threshold, width=self.plan.bits // 64)
        near = shared_table(near)
        hashes = kept.filter("h is not null").join(small(near.select(F.col("build").alias("h")).distinct()), "h", "left_semi").select("ord", "h")
        return Known(hashes, kept.filter("h is null").select("ord", "sha"), near)

    def extend(self, images: DataFrame) -> DataFrame:
        """keep_in_order of images (ord, h as lanes, flip, sha) that come after all before them; what is kept joins the index, as one version.

        The result is that of one run over all images. If another merge commits first, these are decided anew.
        """
        width, decided = self.plan.bits // 64, []
        if not images.filter(F.size("h") != width).isEmpty() or not images.filter(F.size("flip") != width).isEmpty():
            raise ValueError(f"hashes of another width than {self.plan.bits} bits")

        def build(rows: DataFrame) -> DataFrame:
            last, *cut = rows.agg(F.max("ord"), F.min("band"), F.max("band")).first()
            first = images.agg(F.min("ord")).first()[0]
            if cut[0] is not None and cut != [FIRST, FIRST + self.plan.count - 1]:
                raise ValueError("the index was cut into other bands; make it anew")
            if last is not None and first is not None and first <= last:
                raise ValueError(f"images from ord {first} on, but {last} is in the index")
            decided[:] = [shared_table(keep_in_order(images, self.threshold, self._known(rows, images)))]
            kept = images.join(decided[0].filter("kept").select("ord"), "ord", "left_semi").select("ord", "h", "sha")
            none = [F.lit(None).cast(t).alias(c) for c, t in (("ord", "long"), ("sha", "string"))]
            bands = banded(kept.filter("h is not null").select("h"), self.plan).select("band", "value", none[0], "h", none[1])
            rest = kept.select(F.lit(None).cast("int").alias("band"), F.lit(None).cast("long").alias("value"), "ord", "h", "sha")
            return rest.unionByName(bands).repartitionByRange("band", "value").sortWithinPartitions("band", "value")

        self.table.append(build)
        return decided[0]


def eval_overlap(locked: DataFrame, train: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Locked images that are in the training set: image, kind (exact, near), match.

    Both sides: image, sha, h, and flip on the training side. By content first; of the others the first training image (by name) whose hash or
    mirror hash is near. Both sides are written first, for they are read several times.
    """
    locked, train = shared_table(locked.select("image", "sha", "h")), shared_table(train.select("image", "sha", "h", "flip"))
    shas = train.groupBy("sha").agg(F.min("image").alias("match"))
    exact = locked.join(shas, "sha").select("image", F.lit("exact").alias("kind"), "match")
    rest = locked.join(shas, "sha", "left_anti").select("image", "h")
    known = shared_table(train.select("h", F.col("image").alias("match")).union(train.filter("flip is not null").select("flip", "image")).groupBy("h").agg(F.min("match").alias("match")))
    pairs = near_hashes(rest.select("h"), known.select("h"), threshold)
    firsts = known.withColumnRenamed("h", "build")
    near = rest.join(pairs.join(firsts, "build").groupBy(F.col("probe").alias("h")).agg(F.min("match").alias("match")), "h")
    return exact.union(near.select("image", F.lit("near").alias("kind"), "match"))


def copies(files: DataFrame, key: str, name: str) -> DataFrame:
    """Files that repeat the content of an earlier one (by name): key, name, first. Windows are by content; a group's minimum is all that is kept of it."""
    firsts = files.groupBy(key).agg(F.min(name).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return files.join(firsts, key).filter(F.col(name) != F.col("first")).select(key, name, "first")


def split_leakage(files: DataFrame, key: str = "sha", pairs: tuple[tuple[str, str], ...] = (("train", "val"), ("train", "test"), ("val", "test"))) -> DataFrame:
    """(key, split_a, split_b) of contents that are in both splits of a pair. One aggregation; no pairs of rows are made."""
    held = files.groupBy(key).agg(F.collect_set("split").alias("splits"))
    both = F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b")) for a, b in pairs])
    found = F.filter(both, lambda p: F.array_contains("splits", p["split_a"]) & F.array_contains("splits", p["split_b"]))
    return held.select(key, F.explode(found).alias("p")).select(key, "p.split_a", "p.split_b")
