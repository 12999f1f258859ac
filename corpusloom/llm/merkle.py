"""A Merkle manifest of a dataset, by supersteps over an RDD of tree vertices.

Leaves are the rows of a source in id order; runs of ARITY nodes are hashed into their parent until one is left, the source's
root, and the sources' roots likewise, in the order of the sources. A vertex of the supersteps is a block of three levels:
children message their digests to their block, and a block that has all of them hashes its levels and forwards its top to the
block above. In reverse, each block sends every child the siblings on its way up, so a leaf ends with all that it takes to
recompute the root from its own digest. Blocks have 27 children at most, whatever a source's size; no tree is in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.common import materialize

ARITY = 3
#: Levels of the tree that a block has, and the children of a block.
LEVELS = 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each `-` if null, else its UTF-8 length, a colon and the value."""
    parts = (F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields)
    return F.sha2(F.concat(*parts), 256)


def _hash(run: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


def _depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _levels(digests: list[bytes], depth: int) -> list[list[bytes]]:
    """The levels of a block from its children to its top: three, or as many as the tree still has."""
    out = [digests]
    for _ in range(min(depth, LEVELS)):
        out.append([_hash(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def _siblings(levels: list[list[bytes]], at: int) -> bytes:
    """The siblings of child `at`, level by level: a byte with how many are left (upper bits) and right of it, and they."""
    out = []
    for level in levels[:-1]:
        run = level[at // ARITY * ARITY : at // ARITY * ARITY + ARITY]
        own = at % ARITY
        out += [bytes([own << 4 | len(run) - own - 1]), *run[:own], *run[own + 1 :]]
        at //= ARITY
    return b"".join(out)


def fold(leaf: bytes, proof: bytes) -> tuple[bytes, str]:
    """The root that follows from a leaf and its proof, and the hex digests of the proof from left to right, level by level."""
    at, now, said = 0, leaf, []
    while at < len(proof):
        left, right = proof[at] >> 4, proof[at] & 15
        run = [proof[at + 1 + 32 * i : at + 33 + 32 * i] for i in range(left + right)]
        said += run
        now = _hash([*run[:left], now, *run[left:]])
        at += 1 + 32 * (left + right)
    return now, "".join(d.hex() for d in said)


def _climb(nodes: RDD, rounds: int, partitions: int) -> tuple[list[RDD], RDD]:
    """Supersteps upwards from nodes (group, index) -> (depth, digest, extra): the blocks of every round, and (group, (round, top))
    of each group, in the round in which its one last block is complete."""
    blocks, tops = [], None
    for k in range(rounds):
        sent = nodes.map(lambda x: ((x[0][0], x[0][1] // BLOCK), (x[0][1] % BLOCK, *x[1])))
        own = max(1, partitions // ARITY ** (LEVELS * k))
        held = sent.groupByKey(own).mapValues(lambda got: sorted(got, key=lambda c: c[0]))
        hashed = held.mapValues(lambda c: (c[0][1], _levels([d for _, _, d, _ in c], c[0][1])[-1][0]))
        ended = hashed.filter(lambda x: x[1][0] <= LEVELS).map(lambda x, k=k: (x[0][0], (k, x[1][1])))
        nodes = hashed.filter(lambda x: x[1][0] > LEVELS).mapValues(lambda x: (x[0] - LEVELS, x[1], None))
        blocks.append(held)
        tops = ended if tops is None else tops.union(ended)
    return blocks, tops


def _descend(blocks: list[RDD], answers: RDD) -> RDD:
    """Supersteps downwards from answers (group, (round, proof, carried)), one per group: (group, index) -> (digest, extra, proof,
    carried) of the nodes that the climb began with."""

    def told(x):
        (group, index), (children, (proof, carried)) = x
        levels = _levels([d for _, _, d, _ in children], children[0][1])
        for at, (slot, _, digest, extra) in enumerate(children):
            yield (group, index * BLOCK + slot), (digest, extra, _siblings(levels, at) + proof, carried)

    below = None
    for k in range(len(blocks) - 1, -1, -1):
        mail = answers.filter(lambda x, k=k: x[1][0] == k).map(lambda x: ((x[0], 0), x[1][1:]))
        mail = mail if below is None else mail.union(below.mapValues(lambda x: x[2:]))
        below = blocks[k].join(mail, blocks[k].getNumPartitions()).flatMap(told)
    return below


def _numbered(rows: DataFrame, group: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """`rows`, written in order, with _pid and _at (range and place in it), and per group and range (_pid, _first, _before, _n): its
    first place, how many rows of the group earlier ranges have, and how many there are in all."""
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_pid": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)})
    placed = materialize(placed)
    counts = placed.groupBy(*group, "_pid").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # a group has a row per range here, so what meets in a task is bounded by the number of ranges
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, counts.select(*group, "_pid", "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("_n"))


def manifest(leaves: DataFrame, group_col: str = "source", id_col: str = "doc_id", leaf_col: str = "leaf", carry: str | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof binary), with the column `carry` if named, one row per row of `leaves`.

    Leaves of a group are ordered by id, null first, and by digest where ids repeat; groups by their UTF-8 bytes, the null group
    first. A group of one leaf has that leaf as its subroot, and a single group's subroot is the root; an empty table gives
    no rows. `leaf_col`: hex digests. `fold_proofs` recomputes the root.
    """
    spark, kept = leaves.sparkSession, F.col(carry) if carry else F.lit(None).cast("string")
    rows = leaves.select(F.col(group_col).cast("string").alias("_group"), F.col(id_col).alias("_id"), F.unhex(leaf_col).alias("_leaf"), kept.alias("_carry"))
    placed, starts = _numbered(rows, ["_group"], [F.col(c).asc_nulls_first() for c in ("_group", "_id", "_leaf")])
    starts = materialize(starts)
    groups, group_starts = _numbered(starts.groupBy("_group").agg(F.first("_n").alias("_n")), [], [F.col("_group").asc_nulls_first()])
    ranks = groups.join(group_starts.drop("_n"), "_pid").select(F.col("_group").alias("_g"), (F.col("_at") - F.col("_first") + F.col("_before")).alias("_rank"))
    starts = starts.join(ranks, F.col("_group").eqNullSafe(F.col("_g"))).select(F.col("_group").alias("_g"), F.col("_pid").alias("_p"), "_first", "_before", "_n", "_rank")
    leaf_rows = placed.join(starts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p"))).select("_rank", (F.col("_at") - F.col("_first") + F.col("_before")).alias("_index"), "_n", "_leaf", "_id", "_carry")
    out = T.StructType([T.StructField(id_col, leaves.schema[id_col].dataType), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root")), T.StructField("proof", T.BinaryType()), *([T.StructField(carry, leaves.schema[carry].dataType)] if carry else [])])
    size = groups.agg(F.count("*").alias("groups"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    if not size.groups:
        return spark.createDataFrame([], out)
    rounds = lambda n: max(1, -(-_depth(n) // LEVELS))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.rows >> 18)
    trees, subroots = _climb(leaf_rows.rdd.map(lambda r: ((r[0], r[1]), (_depth(r[2]), bytes(r[3]), (r[4], r[5])))), rounds(size.most), partitions)
    depth = _depth(size.groups)
    top, root = _climb(subroots.map(lambda x: ((0, x[0]), (depth, x[1][1], x[1][0]))), rounds(size.groups), max(1, size.groups >> 18))
    ways = _descend(top, root.map(lambda x: (0, (x[1][0], b"", (x[1][1],)))))
    told = _descend(trees, ways.map(lambda x: (x[0][1], (x[1][1], x[1][2], (x[1][0], *x[1][3])))))
    flat = told.map(lambda x: (x[1][1][0], x[1][0].hex(), x[1][3][0].hex(), x[1][3][1].hex(), bytearray(x[1][2]), *x[1][1][1 : 1 + bool(carry)]))
    return spark.createDataFrame(flat, out, verifySchema=False)


def fold_proofs(rows: DataFrame, leaf: str, proof: str = "proof") -> DataFrame:
    """`rows` with folded_root and proof_hex: the root that follows from the hex digest in column `leaf` and the proof, and the
    proof's digests in hex, put together. Columns of these names are replaced. A null leaf or proof gives nulls."""
    rows = rows.drop("folded_root", "proof_hex")
    schema = T.StructType([*rows.schema.fields, T.StructField("folded_root", T.StringType()), T.StructField("proof_hex", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None) if a is None or b is None else fold(bytes.fromhex(a), b) for a, b in zip(batch.column(leaf).to_pylist(), batch.column(proof).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f and f.hex() for f, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=[*batch.schema.names, "folded_root", "proof_hex"])

    return rows.mapInArrow(run, schema)


def document_leaves(docs: DataFrame, fields: Iterable[str] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, tampered): each document's digest, and that of the document as the tampering leaves it. Where the
    CRC-32 of the decimal id is even, line feeds are deleted from the text; null ids and null texts stay as they are. Columns
    other than `fields` are ignored."""
    kept = [F.col(f) for f in fields]
    changes = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(changes, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return docs.select("doc_id", "source", leaf_digest(kept).alias("leaf"), leaf_digest([text if f == "text" else F.col(f) for f in fields]).alias("tampered"))
