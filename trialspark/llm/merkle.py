"""A Merkle manifest of a dataset, level by level with lag and lead windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store

ARITY = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Leaves of one window group at most.  A tree grows in blocks of this many
# nodes, so a group holds a bounded number of rows however many share a language.
BLOCK_NODES = 4096
TAMPERED_EVERY = 7
# monotonically_increasing_id: the row's place in its partition, below the partition's number.
PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``grp, doc_id, leaf, changed``: the only pass over the texts.

    ``grp`` is the language with a mark before it, so that null comes first and
    joins need no null-safe keys.  ``changed`` is the leaf of a tampered row.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0
    whole = digest(*[field(F.col(c)) for c in FIELDS])
    altered = digest(*[field(more if c == "n_chars" else F.col(c)) for c in FIELDS])
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("grp"), "doc_id",
        whole.alias("leaf"), F.when(chosen & F.col("n_chars").isNotNull(), altered).alias("changed"),
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored rows with ``pos`` (from 0 in their ``grp``, by ``order``) and ``n`` (rows of the group).

    Rows are dealt to ranges and sorted there; a row's place in its range and
    the counts of the ranges before give its number, so no task ever sorts a
    group.  A stored number breaks ties, hence ranges split rows that are alike.
    """
    known = store(rows.withColumn("tie", F.monotonically_increasing_id()), f"{name}-rows")
    keys = ["grp", *[F.col(c).asc_nulls_first() for c in order], "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    dealt = dealt.select(
        "*", F.shiftright(number, PLACE_BITS).alias("part"),
        number.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"),
    )
    dealt = store(dealt.drop("tie"), f"{name}-dealt")
    # A row per group and range.
    counts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("first"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "grp", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(Window.partitionBy("grp")).alias("n"),
    )
    placed = dealt.join(starts, ["grp", "part"]).withColumn("pos", F.col("place") + F.col("shift"))
    return placed.drop("part", "place", "shift")


def levels_of(most: int, arity: int) -> int:
    """Levels from ``most`` nodes to one."""
    n, size = 0, 1
    while size < most:
        n, size = n + 1, size * arity
    return n


def ladder(nodes: DataFrame, levels: int, arity: int) -> tuple[DataFrame, list[str]]:
    """Adds ``block``, the nodes ``_node0 ..`` and the steps ``_step0 ..`` of ``levels`` levels.

    At level l the rows whose position ``arity ** l`` divides carry the nodes.
    Their siblings stand at fixed offsets: lag columns where the slot in the run
    has that many nodes before it, lead columns where it has as many after and
    the run is that long.  First children hash the parents.  A step is null
    once a group is down to one node.
    """
    size = arity**levels
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(size))).withColumn("_node0", F.col("node"))
    run = Window.partitionBy("grp", "block").orderBy("pos")
    for level in range(levels):
        stride, node = arity**level, F.col(f"_node{level}")
        carries = F.col("pos") % stride == 0
        slot = F.floor(F.col("pos") / F.lit(stride)) % arity
        grows = F.col("n") > stride
        sides = [
            F.concat(*[
                F.when(inside, F.coalesce(shifted, F.lit(""))).otherwise("") for inside, shifted in [
                    (slot >= j, F.lag(node, j * stride).over(run)) if left else (slot + j < arity, F.lead(node, j * stride).over(run))
                    for j in (range(arity - 1, 0, -1) if left else range(1, arity))
                ]
            ])
            for left in (True, False)
        ]
        rows = rows.withColumns({f"_left{level}": sides[0], f"_right{level}": sides[1]})
        step = F.struct(F.col(f"_left{level}").alias("left"), F.col(f"_right{level}").alias("right"))
        parent = F.when(grows, digest(node, F.col(f"_right{level}"))).otherwise(node)
        rows = rows.withColumns({
            f"_step{level}": F.when(carries & grows, step),
            f"_node{level + 1}": F.when(F.col("pos") % (stride * arity) == 0, parent),
        }).drop(f"_left{level}", f"_right{level}")
    return rows, [f"_step{level}" for level in range(levels)]


NO_STEPS = "cast(array() as array<struct<left: string, right: string>>)"


def climb(nodes: DataFrame, most: int, arity: int = ARITY) -> DataFrame:
    """Rows of ``grp, pos, n, node`` with ``path`` and ``top`` added.

    ``path`` holds, from the bottom to the group's last node ``top``, what
    stands left and right in each run; ``most`` is the largest group.  A block's
    first row carries its node on: the blocks above are a table of a thousandth
    of the rows, climbed alike and joined by block.
    """
    if most <= 1:
        return nodes.withColumn("path", F.expr(NO_STEPS)).withColumn("top", F.col("node"))
    levels = min(levels_of(most, arity), max(1, levels_of(BLOCK_NODES + 1, arity) - 1))
    size = arity**levels
    rows, steps = ladder(nodes, levels, arity)
    heads = rows.where(F.col("pos") % size == 0).select(
        "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(size)).alias("n"), F.col(f"_node{levels}").alias("node")
    )
    heads = climb(store(heads, "heads"), -(-most // size), arity)
    heads = store(heads.select("grp", F.col("pos").alias("block"), F.col("path").alias("_above"), "top"), "above")
    # The carrier above a row is the last one at or before it.
    reach = Window.partitionBy("grp", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({s: F.last(s, ignorenulls=True).over(reach) for s in steps})
    rows = rows.withColumn("_path", F.filter(F.array(*steps), lambda s: s.isNotNull()))
    joined = rows.join(heads, ["grp", "block"])
    return joined.select(*nodes.columns, F.concat("_path", "_above").alias("path"), "top")


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, changed`` for every row.

    A language's leaves ascend by doc_id (null first; rows of one id by their
    leaf, so that the tree does not depend on the input's order), and its tree's
    last node is ``subroot``.  Subroots in order of language (null first) make
    ``root``.  ``path`` lists what stands left and right of a row's own node in
    each run from leaf to root.  Null fields enter as ``-``; empty and long
    texts need nothing special; repeated rows are leaves of their own; an empty
    table gives no rows; other columns play no part.
    """
    rows = numbered(leaves(docs).withColumnRenamed("leaf", "node"), ["doc_id", "node"], "leaves")
    rows = store(rows, "leaves")
    most = rows.agg(F.max("n")).first()[0] or 0
    found = climb(rows, most, arity)
    # One row a language from here on.
    tops = store(found.where("pos = 0").select(F.col("grp").alias("lang"), F.col("top").alias("node")), "subroots")
    listed = store(numbered(tops.withColumn("grp", F.lit("all")), ["lang"], "subroots"), "languages")
    many = listed.agg(F.max("n")).first()[0] or 0
    whole = climb(listed, many, arity).select(
        F.col("lang").alias("grp"), F.col("path").alias("_upper"), F.col("node").alias("subroot"), F.col("top").alias("root")
    )
    whole = store(whole, "roots")
    return found.join(_small(whole), "grp").select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "_upper").alias("path"), "changed"
    )


# Bytes of a language's row: a digest for each level of the upper tree and two more.
ROW_BYTES = 4096
BROADCAST_BYTES = 32 << 20


def _small(roots: DataFrame) -> DataFrame:
    """Sent to all executors while few languages exist; beyond that the join shuffles and splits hot keys."""
    return F.broadcast(roots) if roots.count() * ROW_BYTES <= BROADCAST_BYTES else roots


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings, from leaf to root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verify(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """The manifest's digests for every row, and whether the (tampered) rows still lead to the root.

    Rows whose id's crc32 is a multiple of ``TAMPERED_EVERY`` are folded with
    ``n_chars`` one higher; a null ``n_chars`` or id stays as it is and verifies.
    """
    rows = manifest(docs, arity)
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
