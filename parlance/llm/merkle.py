"""A Merkle tree over the rows of a table: one tree per group, and one over the groups.

The place of a node in its tree is a number with digits to the base of the arity.
Digit columns are grouped away one after the other, last digit first: each step
nests the structs of the children of a node in the struct of their parent. Blocks
of places bound how much one struct nests, and the roots of blocks are the nodes of
the next round, until one node is left. On the way back the path of a block's root
comes to the block by the same grouping, and its nested structs are unfolded, one
level after the other; each child takes what stands left and right of it along.
Proofs need no join, no group is larger than a block, and a group with a third of
all rows has a third of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from .common import written

#: Children of a node, and levels that are nested in one struct: blocks of 729 nodes.
ARITY, DEPTH = 3, 6
STEP = "struct<left:string,right:string>"


def framed(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (steps with left and right siblings) give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right; without any, of nothing."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _rolled(nodes: DataFrame, payload: Sequence[str], arity: int, depth: int) -> DataFrame:
    """(tree, block, total, hash, top): ``nodes`` (tree, rank, total, hash, payload) nested by blocks.

    ``total`` is the number of nodes of the tree, so every level knows whether
    more than one node is left; only then children become the hash of their parent.
    """
    digits = {f"__d{level}": (F.expr(f"rank div {arity ** level}") % arity).cast("int") for level in range(depth)}
    keys = ["tree", "block", "total"]
    # One shuffle: all groupings below are by more columns than these two.
    out = nodes.withColumn("block", F.expr(f"rank div {arity ** depth}")).withColumns(digits).repartition("tree", "block")
    child = F.struct(F.col("__d0").alias("digit"), "hash", *[name for name in payload if name != "hash"])
    for level in range(depth):
        above = [f"__d{i}" for i in range(level + 1, depth)]
        out = out.groupBy(*keys, *above).agg(F.sort_array(F.collect_list(child)).alias("children"))
        hashes = F.transform("children", lambda c: c["hash"])
        out = out.withColumn("hash", F.when(F.col("total") > arity ** level, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0]))
        if above:
            child = F.struct(F.col(above[0]).alias("digit"), "hash", "children")
    return out.withColumnRenamed("children", "top")


def _unfolded(blocks: DataFrame, payload: Sequence[str], carried: Sequence[str], arity: int, depth: int) -> DataFrame:
    """One row per node of blocks (tree, block, total, top, path, carried): its payload, path and what the tree carries."""
    out, children = blocks.withColumn("rank", F.col("block")), F.col("top")
    for level in reversed(range(depth)):
        def side(child: Column, right: bool) -> Column:
            others = F.filter(F.col("__all"), lambda c: (c["digit"] > child["digit"]) if right else (c["digit"] < child["digit"]))
            return F.array_join(F.transform(others, lambda c: c["hash"]), "")

        out = out.withColumn("__all", children).withColumn("__child", F.explode("__all"))
        step = F.array(F.struct(side(F.col("__child"), False).alias("left"), side(F.col("__child"), True).alias("right")))
        # Where one node is left, there is nothing to hash it with and no step.
        out = out.withColumn("path", F.when(F.col("total") > arity ** level, F.concat(step, "path")).otherwise(F.col("path")))
        out = out.withColumn("rank", F.col("rank") * arity + F.col("__child.digit"))
        out = out.drop("top", "__all").withColumnRenamed("__child", "top")
        children = F.col("top.children")
    return out.select("tree", "rank", *[F.col(f"top.{name}").alias(name) for name in payload], "path", *carried)


def _paths(nodes: DataFrame, payload: Sequence[str], above: Callable[[DataFrame], DataFrame], carried: Sequence[str],
           arity: int, depth: int) -> DataFrame:
    """(tree, rank, payload, path, carried) for every node of trees.

    ``above`` takes the roots (tree, hash) and returns (tree, path, carried) for
    each: how the paths of the whole tree end.
    """
    blocks = written(_rolled(nodes, payload, arity, depth))
    size = arity ** depth
    roots = blocks.select("tree", F.col("block").alias("rank"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), "hash")
    if (roots.agg(F.max("total")).first()[0] or 0) > 1:
        up = _paths(roots, ["hash"], above, carried, arity, depth).drop("hash").withColumnRenamed("rank", "block")
    else:
        up = above(roots.select("tree", "hash")).withColumn("block", F.lit(0).cast("bigint"))
    kept, told = ["total", "top"], ["path", *carried]
    types = {**dict(blocks.dtypes), **dict(up.dtypes)}
    both = blocks.select("tree", "block", *kept, *[F.lit(None).cast(types[c]).alias(c) for c in told]).unionByName(
        up.select("tree", "block", *[F.lit(None).cast(types[c]).alias(c) for c in kept], *told))
    # Exactly one row of each kind per block.
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in [*kept, *told]])
    return _unfolded(met, payload, carried, arity, depth)


def proofs(leaves: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Paths of leaves (tree, place, hash and any payload) to the root over all trees.

    Leaves of a tree ascend by place, those of equal place by hash; trees ascend
    bytewise, null first. While several nodes remain, every ``arity`` consecutive
    ones become the hash of their concatenated hashes, also a last run of one. The
    result has the payload, hash, subroot, root and path: an array of steps with
    the concatenated siblings left and right, from the leaf up to the root.

    Null places come first; leaves equal in place and hash stand side by side in
    any order. An empty table gives an empty result. Memory of a task is that of
    a block of ``arity ** depth`` leaves without their texts.
    """
    payload = [c for c in leaves.columns if c not in ("tree", "place")]
    kind = leaves.schema["tree"].dataType
    # A tree's name that is never null and keeps the order.
    named = leaves.withColumn("tree", F.when(F.col("tree").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("tree").cast("string"))))
    rows = written(named)
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    placed = ordered.running(rows, ["tree"], [F.col("place"), F.col("hash")], F.lit(1).cast("bigint"), "rank", F.sum)
    nodes = placed.withColumn("rank", F.col("rank") - 1).join(sizes, "tree")

    def over_trees(roots: DataFrame) -> DataFrame:
        one = ordered.running(roots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "hash"), ["tree"],
                              [F.col("member")], F.lit(1).cast("bigint"), "rank", F.sum)
        members = written(one.withColumn("rank", F.col("rank") - 1))
        whole = members.withColumn("total", F.lit(members.count()).cast("bigint"))
        top = _paths(whole, ["member", "hash"], lambda r: r.select(
            "tree", F.array().cast(f"array<{STEP}>").alias("path"), F.col("hash").alias("root")), ["root"], arity, depth)
        return top.select(F.col("member").alias("tree"), "path", F.col("hash").alias("subroot"), "root")

    found = _paths(nodes, payload, over_trees, ["subroot", "root"], arity, depth)
    tree = F.when(F.col("tree") != "", F.substring("tree", 2, 2_147_483_647)).cast(kind)
    return found.withColumn("tree", tree)


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id",
             group: str = "source", tampered: Column | None = None, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """One row per document: key, leaf, subroot, root, path, proof_sha256, folded_root and verified.

    A leaf is the hash of ``columns``, each :func:`framed`; empty and very long
    texts are values like any other, and only their hash leaves the scan. The
    tree is by ``group``, in the order of ``key`` (null first). ``tampered`` is
    the text that the check sees instead of the column text: folded_root is made
    from it and the untampered siblings, and verified tells whether that is the
    root. Rows that occur twice are two leaves. Other columns are not read.
    """
    named = {name: F.col(name) for name in columns}
    seen = leaf_of(list({**named, "text": tampered}.values())) if tampered is not None else leaf_of(list(named.values()))
    leaves = docs.select(F.col(group).alias("tree"), F.col(key).alias("place"), F.col(key).alias("key"), leaf_of(list(named.values())).alias("hash"),
                         seen.alias("seen"))
    found = proofs(leaves.withColumn("seen", F.when(F.col("seen") != F.col("hash"), F.col("seen"))), arity, depth)
    root = folded(F.coalesce("seen", "hash"), F.col("path"))
    return found.select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "path", siblings_digest(F.col("path")).alias("proof_sha256"),
        root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
