"""Merkle dataset manifest: content-addressed records, descent by rank digits, proofs and their folding.

Every row of a table is a leaf; the leaves of one ``tree`` (a source) ascend by id and every 16 consecutive nodes
become their parent until one node, the subroot, is left.  The subroots, in order of their trees, form one more tree
with the dataset's root.  H is the lower-case hex SHA-256 of its concatenated inputs, digests as hex text.

``build`` writes below one folder: ``leaves`` (tree, rank in the tree, number of leaves, digest), ``records`` (height,
digest -> children: the content-addressed DAG), ``tops`` (tree, subroot, height) and ``sources``, the same records of
the tree over the subroots.  ``prove`` answers leaf requests: it descends from the root, one join on the digest per
height, takes the child that the rank's base-16 digit names and keeps the unselected children as a path segment; the
segments, reversed, are the proof from leaf to root.  Requests that share a node descend as one row, so a join has one
row per node whatever the number of requests, and only the last step deals with single leaves.  ``fold`` recomputes a
root from a claimed leaf and the siblings.

Scale: ranks come from a range sort with counts per partition (a hot source is spread over many tasks); a group
has at most 16 rows; the driver sees the root and the largest leaf count.  All tables are written below the shared
folder, so a lost executor costs a re-run of its tasks only.

Cases: a null field is ``-`` and an empty text ``0:``; a null tree is a tree of its own and comes first; null ids come
first; rows with one id are ordered by digest, and rows alike in everything are leaves of their own with equal digests.
A text of any length is hashed whole.  A tree of one leaf has that leaf as its subroot, a table of one tree that
subroot as its root; an empty table has no root and no proofs.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstar.llm.common import cut
from shopstar.operators.ranking import number_rows

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALL_TREES = "*"
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: dict[str, Column]) -> Column:
    """H over the fields: ``-`` for a null, else UTF-8 byte count, a colon, the value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.sha2(F.concat(*[part(c) for c in fields.values()]), 256)


def tree_key(c: Column) -> Column:
    """A key that is never null and sorts as the values do, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Manifest:
    """A written manifest; ``root`` is None for an empty table, ``height`` and ``source_height`` are the highest trees."""

    spark: SparkSession
    path: str
    root: str | None
    height: int
    source_height: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _grow(spark: SparkSession, nodes: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Write the records of all heights above ``nodes`` (tree, idx, n, digest); the top of every tree, the largest height.

    A node that is alone in its tree is the top; the others meet in runs of 16.
    """
    tops = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    height = 0
    while most > 1:
        height += 1
        run = F.expr(f"idx div {FANOUT}").alias("idx")
        up = nodes.where("n > 1").groupBy("tree", run).agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("members"), F.first("n").alias("below"))
        children = F.col("members.digest")
        up = up.select("tree", "idx", F.ceil(F.col("below") / FANOUT).cast("long").alias("n"),
                       F.sha2(F.concat_ws("", children), 256).alias("digest"), children.alias("children"))
        up.write.parquet(f"{folder}/height={height}")
        nodes = spark.read.parquet(f"{folder}/height={height}")
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest", F.lit(height).alias("height")))
        most = -(-most // FANOUT)
    return tops, height


def build(docs: DataFrame, path: str, tree: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS,
          claim: Column | None = None) -> Manifest:
    """Write the manifest of ``docs`` below ``path``.

    ``claim``: a digest per row that is kept beside its leaf (what a received copy of the row hashes to); default the leaf.
    """
    spark = docs.sparkSession
    digest = leaf_digest({f: F.col(f) for f in fields})
    rows = docs.select(tree_key(F.col(tree)).alias("tree"), F.col(order).alias("id"), digest.alias("digest"),
                       (digest if claim is None else claim).alias("claim"))
    ranked = number_rows(rows, ["id", "digest"], ["tree"], out="idx", total="n")
    ranked.write.parquet(f"{path}/leaves")
    leaves = spark.read.parquet(f"{path}/leaves")
    tops, height = _grow(spark, leaves.select("tree", "idx", "n", "digest"), f"{path}/records")
    number_rows(tops, ["tree"], out="idx", total="n").write.parquet(f"{path}/tops")
    sources = spark.read.parquet(f"{path}/tops").select(F.lit(ALL_TREES).alias("tree"), "idx", "n", "digest")
    over, source_height = _grow(spark, sources, f"{path}/sources")
    top = over.select("digest").first()
    return Manifest(spark, path, top[0] if top else None, height, source_height)


def _segment(children: Column, digit: Column) -> Column:
    """The unselected children, left and right of the selected one."""
    rest = F.slice(children, digit + 2, F.lit(FANOUT))
    return F.struct(F.concat_ws("", F.slice(children, F.lit(1), digit)).alias("before"), F.concat_ws("", rest).alias("after"))


def _digit(place: str) -> Column:
    return F.expr(f"cast({place} % {FANOUT} as int)")


def _descend(m: Manifest, folder: str, height: int, starts: DataFrame, runs: DataFrame) -> DataFrame:
    """The lowest runs asked for: (tree, run, children, path), the path from the root down to the run's own node.

    ``starts``: (tree, digest, height, path) of the trees' tops; ``runs``: (tree, run) that hold the requests' leaves.
    """
    above = None
    for h in range(height, 0, -1):
        here = starts.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("idx"), "digest", "path")
        here = here if above is None else here.unionByName(above)
        asked = runs.select("tree", F.expr(f"run div {FANOUT ** (h - 1)}").alias("idx")).distinct()
        records = m.table(f"{folder}/height={h}").select("digest", "children").dropDuplicates(["digest"])
        opened = here.join(asked, ["tree", "idx"], "left_semi").join(records, "digest")
        if h == 1:
            return opened.select("tree", F.col("idx").alias("run"), "children", "path")
        above = opened.select("tree", "idx", "children", "path", F.posexplode("children").alias("digit", "child")).select(
            "tree", (F.col("idx") * FANOUT + F.col("digit")).alias("idx"), F.col("child").alias("digest"),
            F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"))
    return starts.select("tree", F.lit(0).cast("long").alias("run"), F.array().cast("array<string>").alias("children"), "path").where("false")


def _to_leaves(m: Manifest, folder: str, height: int, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, idx, ...) with ``leaf`` and ``path`` (leaf to root, the segments reversed)."""
    runs = cut(requests.select("tree", F.expr(f"idx div {FANOUT}").alias("run")).distinct())
    lowest = _descend(m, folder, height, starts, runs)
    digit = _digit("idx")
    found = requests.withColumn("run", F.expr(f"idx div {FANOUT}")).join(lowest, ["tree", "run"])
    found = found.withColumn("leaf", F.get("children", digit)).withColumn(
        "path", F.concat("path", F.array(_segment(F.col("children"), digit)))).drop("run", "children").where("leaf is not null")
    alone = requests.where("idx = 0").join(starts.where("height = 0").select("tree", F.col("digest").alias("leaf"), "path"), "tree")
    both = found.unionByName(alone)
    return both.withColumn("path", F.reverse("path"))


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """Inclusion proofs: ``requests`` (tree, idx, further columns) with leaf, subroot, root and path.

    ``path``: a (before, after) pair per height from the leaf up, the concatenated digests left and right of the path's
    node.  A request for a leaf that is not there has no row.
    """
    if m.root is None:
        return requests.select("*", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root")],
                               F.lit(None).cast(PATH).alias("path")).where("false")
    top = m.spark.createDataFrame([(ALL_TREES, m.root, m.source_height)], "tree string, digest string, height int")
    top = top.withColumn("path", F.array().cast(PATH))
    sources = m.table("tops").select(F.lit(ALL_TREES).alias("tree"), "idx", F.col("tree").alias("own"), F.col("height").alias("own_height"))
    subroots = _to_leaves(m, "sources", m.source_height, top, sources)
    starts = cut(subroots.select(F.col("own").alias("tree"), F.col("leaf").alias("digest"), F.col("own_height").alias("height"),
                                 F.reverse("path").alias("path")))
    proofs = _to_leaves(m, "records", m.height, starts, requests)
    return proofs.join(starts.select("tree", F.col("digest").alias("subroot")), "tree").withColumn("root", F.lit(m.root))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
