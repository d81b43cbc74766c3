"""Sharding by a hierarchical weighted hash tree.

The tree has a root, regions, racks and shards.  A document descends it: at each node it draws one number for each child
from the hash of its id and the child's name and goes where `-ln(draw) / weight` is least, which sends it to a child with
the probability of the child's weight.  The draw of a child does not depend on its siblings, so when a weight changes,
documents move only between that subtree and the others on the same level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import hex_draw, table

#: Slices of a shard that are numbered on their own, so that no task numbers a whole shard.
SLICES = 64


@dataclass
class Node:
    """A subtree; weight is the sum of its leaves' weights, a leaf has a shard number."""

    name: str
    weight: float = 0.0
    shard: int | None = None
    children: list[Node] = field(default_factory=list)


def tree(shards: int, racks: int = 4, regions: int = 12, weights: dict[int, float] | None = None) -> Node:
    """`racks` shards in a rack, `regions` shards in a region, in the order of their numbers.

    A shard that begins a region of its own, as the one after the last full region does, takes documents only into
    itself; one that joins an existing region also lets its region and rack take documents.
    """
    root = Node("root")
    for shard in range(shards):
        weight = (weights or {}).get(shard, 1.0)
        at = root
        at.weight += weight
        for name in (f"region{shard // regions}", f"rack{shard // racks}"):
            if not at.children or at.children[-1].name != name:
                at.children.append(Node(name))
            at = at.children[-1]
            at.weight += weight
        at.children.append(Node(f"shard{shard}", weight, shard))
    return root


def descend(key: Column, node: Node) -> Column:
    """The shard number that key reaches below node."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return descend(key, live[0])
    cost = [-F.log(hex_draw(F.lit(c.name), key)) / c.weight for c in live]
    best = F.array_min(F.array(*[F.struct(x.alias("cost"), F.lit(i).alias("child")) for i, x in enumerate(cost)])).getField("child")
    # the choice is evaluated once for a row; only the branch taken is evaluated further
    return F.element_at(F.transform(F.array(best), lambda b: _branch(key, b, live)), 1)


def _branch(key: Column, choice: Column, nodes: list[Node]) -> Column:
    out = F.when(choice == 0, descend(key, nodes[0]))
    for i, n in enumerate(nodes[1:], 1):
        out = out.when(choice == i, descend(key, n))
    return out


def assign(docs: DataFrame, shards: int = 24, weights: dict[int, float] | None = None) -> DataFrame:
    """docs with shard and grown_shard (with one more shard); the id and the number of shards alone decide."""
    plain = docs.drop("shard", "grown_shard")
    return plain.select("*", descend(F.col("doc_id"), tree(shards, weights=weights)).alias("shard"), descend(F.col("doc_id"), tree(shards + 1, weights=weights)).alias("grown_shard"))


def shard(docs: DataFrame, shards: int = 24, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard, slot for every row of docs.

    size: UTF-8 bytes of the text (null: none) plus 8.  A null id is a key like any other, rows with equal ids share a
    shard.  slot numbers the rows of a shard from 0 without gaps, in the order of (slice, doc_id, crc): slices are counted
    first, then numbered each on its own with the sum of those before.  Empty table: no rows.  Other columns are ignored.
    """
    base = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = assign(base, shards, weights).withColumn("slice", F.floor(hex_draw(F.lit("slice"), F.col("doc_id")) * SLICES).cast("int"))
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("rows"))
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("slice").alias("o_slice"), (F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows")).alias("offset"))
    numbered = placed.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")) - 1)
    # shards x SLICES rows, a fixed number
    out = numbered.join(F.broadcast(offsets), (F.col("shard") == F.col("o_shard")) & (F.col("slice") == F.col("o_slice")))
    return out.select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("offset") + F.col("rn")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
