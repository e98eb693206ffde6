"""Merkle trees over the rows of groups, and versions of them by path copying.

The rows of a group, in the order of their keys, are the leaves of a tree in which every
eight neighbours are hashed into one node; the tops of the groups, in the order of the
groups, are the leaves of one more tree. A changed leaf makes a new version of the tree: it
copies the leaf's ancestors and shares every other node with the version before.

Leaves are dealt into aligned blocks of 512, whose nodes depend on nothing outside, so a
task builds a block's nodes and all versions of its leaves. Tops of blocks are the leaves of
blocks above, and so on; a version goes on there along the path that its block has been given
from above, so no task ever sees the versions of more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import written
from .workers import ship, tidy

FAN = 8
#: Levels of a block, and the nodes below its top.
DEPTH = 3
BLOCK = FAN ** DEPTH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Per level the place in a run and the digests of the run's other nodes.
_PATH = "array<struct<place:int,others:binary>>"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; texts of plain bytes go the short way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def leaf(*fields: Column) -> Column:
    """Digest of the fields, each ``-`` if null, else its UTF-8 byte count, ``:``, itself."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"),
                                         value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


# --- one block ------------------------------------------------------------------------

def digest(nodes: list[bytes]) -> bytes:
    """The node above: the digest of its children's digests as hex text."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


class Block:
    """The nodes of an aligned block by level, leaves first; never changed once built.

    A block alone in its tree ends where one node remains; one among others is reduced to
    its top by all its levels, even if it holds a single leaf.
    """

    def __init__(self, leaves: list[bytes], alone: bool):
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if alone else len(self.levels) <= DEPTH:
            below = self.levels[-1]
            self.levels.append([digest(below[i:i + FAN]) for i in range(0, len(below), FAN)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def path(self, place: int) -> list[tuple[int, bytes]]:
        """Per level the place within its run and the run's other nodes, in a row."""
        steps = []
        for level in self.levels[:-1]:
            begin = place - place % FAN
            others = level[begin:place] + level[place + 1:begin + FAN]
            steps.append((place - begin, b"".join(others)))
            place //= FAN
        return steps


def copied(node: bytes, path: list[tuple[int, bytes]]) -> list[bytes]:
    """The nodes of a version that are its own: a new leaf and its ancestors up the path."""
    copies = [node]
    for place, others in path:
        run = [others[i:i + 32] for i in range(0, len(others), 32)]
        run.insert(place, copies[-1])
        copies.append(digest(run))
    return copies


# --- order and levels -----------------------------------------------------------------

def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``pos`` in the order of their group, and its ``size``.

    Rows are dealt by ranges of the order, so a group of any size is spread; a range then
    numbers its own rows and adds the rows of the group in the ranges before.
    """
    rows = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    ranged = written(rows.repartitionByRange(group, *order, "_tie").withColumn(
        "_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    starts = written(counts.select(
        F.col(group).alias("_group"), F.col("_range").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(whole).alias("size")), "starts")
    own = Window.partitionBy(group, "_range").orderBy(*order, "_tie")
    placed = ranged.withColumn("_nth", F.row_number().over(own) - 1).join(
        starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return placed.withColumn("pos", F.col("_start") + F.col("_nth")).drop(
        "_tie", "_range", "_nth", "_group", "_of", "_start")


_BLOCKS = ("group string, block long, size long, top binary, members array<struct<pos:long,"
           "key:string,node:binary,changed:binary>>")


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes (group, pos, size, key, node, changed) in aligned blocks with their tops."""
    packed = nodes.groupBy("group", "size", (F.col("pos") / BLOCK).cast("long").alias("block")
                           ).agg(F.sort_array(F.collect_list(F.struct(
                               "pos", "key", "node", "changed"))).alias("members"))
    return written(packed.select("group", "block", "size", "members").mapInArrow(
        _with_tops, _BLOCKS), name)


def _with_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidy(batches):
        sizes = batch.column("size").to_pylist()
        lists = batch.column("members")
        ends, flat = lists.offsets.to_pylist(), lists.values.field("node").to_pylist()
        tops = [Block(flat[ends[i]:ends[i + 1]], sizes[i] <= BLOCK).top
                for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("group"), batch.column("block"), batch.column("size"),
             pa.array(tops, pa.binary()), lists],
            names=["group", "block", "size", "top", "members"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, because each is a whole block."""
    for batch in tidy(batches):
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


_DOWN = f"group string, pos long, root binary, path {_PATH}"


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path above them to their members with the path above those."""
    for row in _rows(batches):
        block = Block([m["node"] for m in row["members"]], row["size"] <= BLOCK)
        above = [(s["place"], s["others"]) for s in row["path"] or []]
        paths = [block.path(i) + above for i in range(len(row["members"]))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["group"]] * len(paths), pa.string()),
             pa.array([m["pos"] for m in row["members"]], pa.int64()),
             pa.array([row["root"]] * len(paths), pa.binary()),
             pa.array([[{"place": p, "others": o} for p, o in path] for path in paths],
                      pa.list_(pa.struct([("place", pa.int32()),
                                          ("others", pa.binary())])))],
            names=["group", "pos", "root", "path"])


@dataclass(frozen=True)
class Tree:
    """``blocks`` of leaves, the ``paths`` of block tops up to their group's root, ``roots``."""

    blocks: DataFrame
    paths: DataFrame
    roots: DataFrame


def grow(leaves: DataFrame, order: list[str], name: str) -> Tree:
    """The trees of all groups of ``leaves`` (group, key, node, changed, columns of ``order``).

    Upwards tops of blocks are blocked again until every group has one; then the paths are
    handed down, a level of blocks at a time.
    """
    nodes = _numbered(leaves, "group", order).select(
        "group", "pos", "size", "key", "node", "changed")
    levels = [_blocks(nodes, f"{name}-0")]
    while (levels[-1].agg(F.max("size")).first()[0] or 0) > BLOCK:
        below = levels[-1]
        levels.append(_blocks(below.select(
            "group", F.col("block").alias("pos"),
            F.ceil(F.col("size") / BLOCK).cast("long").alias("size"),
            F.lit(None).cast("string").alias("key"), F.col("top").alias("node"),
            F.lit(None).cast("binary").alias("changed")), f"{name}-{len(levels)}"))
    roots = levels[-1].select("group", F.col("top").alias("root"))
    paths = roots.select("group", F.lit(0).cast("long").alias("pos"), "root",
                         F.array().cast(_PATH).alias("path"))
    for above in reversed(levels[1:]):
        paths = written(_under(above, paths).mapInArrow(_down, _DOWN), f"{name}-paths")
    return Tree(levels[0], paths, roots)


def _under(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with their group's root and the path above their top."""
    above = paths.select(F.col("group").alias("_group"), F.col("pos").alias("_pos"),
                         "root", "path")
    return blocks.join(above, F.col("group").eqNullSafe(F.col("_group"))
                       & (F.col("block") == F.col("_pos"))).drop("_group", "_pos")


# --- the manifest ---------------------------------------------------------------------

_VERSIONS = ("group string, key string, pos long, leaf string, subroot string, root string, "
             "proof_sha256 string, copies array<string>, folded_root string, "
             "verified boolean")


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with subroot, root and the path above their top to rows of their leaves."""
    for row in _rows(batches):
        block = Block([m["node"] for m in row["members"]], row["size"] <= BLOCK)
        above = [(s["place"], s["others"]) for s in row["path"] or []]
        tail = b"".join(others for _, others in above).hex()
        root, subroot = row["root"], row["subroot"].hex()
        columns: list[list] = [[] for _ in range(8)]
        for i, member in enumerate(row["members"]):
            inside = block.path(i)
            proof = "".join([o.hex() for _, o in inside] + [tail])
            # An unchanged leaf's fold is the version that shares everything.
            version = copied(member["changed"] or member["node"], inside + above)
            for column, value in zip(columns, (
                    member["key"], member["pos"], member["node"].hex(),
                    hashlib.sha256(proof.encode()).hexdigest(),
                    [n.hex() for n in version] if member["changed"] else None,
                    version[-1].hex(), version[-1] == root, subroot), strict=True):
                column.append(value)
        key, pos, leaves, proofs, copies, folded, verified, subroots = columns
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["group"]] * len(key), pa.string()), pa.array(key, pa.string()),
             pa.array(pos, pa.int64()), pa.array(leaves, pa.string()),
             pa.array(subroots, pa.string()),
             pa.array([root.hex()] * len(key), pa.string()), pa.array(proofs, pa.string()),
             pa.array(copies, pa.list_(pa.string())), pa.array(folded, pa.string()),
             pa.array(verified, pa.bool_())],
            names=[c.split()[0] for c in _VERSIONS.split(", ")])


def manifest(documents: DataFrame, *, group: str = "lang", key: str = "doc_id",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             changed: Column | None = None, tampered: dict[str, Column] | None = None
             ) -> DataFrame:
    """One row per document: its leaf, its proof, and the version that its change makes.

    A leaf is the digest of ``fields``. Leaves of one ``group`` ascend by ``key``, and
    groups ascend with null first. Rows for which ``changed`` is true make a version in
    which the columns of ``tampered`` have the given values. Columns of the result:
    ``group``, ``key`` (as text), ``pos`` in the group, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of the siblings' hex digests, from the leaf up, left to right),
    ``copies`` (the version's own nodes from the leaf to the root; null where nothing
    changed), ``folded_root`` and ``verified`` (the version's root is the original's).

    Null keys come first in their group; a null field is ``-``, an empty one ``0:``. Equal
    keys are ordered by leaf, and rows that repeat take neighbouring places in any order. A
    text counts whole, however long. An empty table gives an empty result; other columns
    are left out. What is shuffled: three times a leaf's digests and key, then blocks of
    512 with the paths above them. Groups of any size are spread over ranges of keys.
    """
    ship(documents.sparkSession)
    new = tampered or {}
    node = leaf(*(F.col(f) for f in fields))
    other = leaf(*(new.get(f, F.col(f)) for f in fields))
    leaves = documents.select(
        F.col(group).cast("string").alias("group"), F.col(key).alias("sort"),
        F.col(key).cast("string").alias("key"), node.alias("node"),
        F.when(changed if changed is not None else F.lit(False), other).alias("changed"))
    tree = grow(leaves, ["sort", "node"], "tree")
    subroots = tree.roots.select(
        F.lit("").alias("group"), F.col("group").alias("sort"), F.col("group").alias("key"),
        F.col("root").alias("node"), F.lit(None).cast("binary").alias("changed"))
    upper = grow(subroots, ["sort"], "upper")
    tops = written(_under(upper.blocks, upper.paths).select(
        "group", "block", "size", "members", "root", "path").mapInArrow(
        _named, f"name string, subroot binary, root binary, path {_PATH}"), "tops")
    lower = tree.paths.select("group", "pos", F.col("path").alias("lower"))
    paths = lower.join(tops, F.col("group").eqNullSafe(F.col("name"))).select(
        "group", "pos", F.struct("subroot", "root").alias("root"),
        F.concat("lower", "path").alias("path"))
    return _under(tree.blocks, paths).select(
        "group", "size", "members", "root.subroot", "root.root", "path").mapInArrow(
        _versions, _VERSIONS)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of subroots to (name, subroot, root, path) of each."""
    for row in _rows(batches):
        members = row["members"]
        block = Block([m["node"] for m in members], row["size"] <= BLOCK)
        above = [(s["place"], s["others"]) for s in row["path"] or []]
        yield pa.RecordBatch.from_arrays(
            [pa.array([m["key"] for m in members], pa.string()),
             pa.array([m["node"] for m in members], pa.binary()),
             pa.array([row["root"]] * len(members), pa.binary()),
             pa.array([[{"place": p, "others": o} for p, o in block.path(i) + above]
                       for i in range(len(members))],
                      pa.list_(pa.struct([("place", pa.int32()),
                                          ("others", pa.binary())])))],
            names=["name", "subroot", "root", "path"])
