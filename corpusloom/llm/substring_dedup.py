"""Substring dedup by prefix-partitioned suffix trees over sampled suffixes.

Suffixes are sampled: of each window, the one that starts at its anchor, the least-hashed 5-word sequence in it, so that
equal windows sample equal suffixes. A suffix belongs to the group of its prefix, the anchor; it brings the words of the
windows around it. Pass 1 counts prefixes: those of one document only can't begin a repeat between documents. Groups that
fit in memory are sorted into two trees, of the suffixes and of the words before them read backwards; their internal nodes
are the runs of neighbours with so many words in common, and a window is a node of the one at one depth with a node of the
other at the rest of it. Where a prefix has more suffixes than a group may, its suffixes are partitioned by longer ones, the
whole windows, which need no tree: all suffixes of such a group are one node, and are reduced before they are sent.
Consecutive windows found give the maximal repeats.

Trees compare words by 16 bits of their hashes. They only narrow down: a window counts as equal to another under one node if
64 further bits, a hash of its 13 words by a second word hash, are equal as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bloom import build_bloom, in_bloom
from corpusloom.llm.common import materialize, text_of
from corpusloom.llm.words import rolling, window_minima, word_hashes

WINDOW, ANCHOR = 13, 5
#: Suffixes of one prefix that one task may gather, some 20 MB: above, the prefix grows. It doesn't depend on the corpus.
MAX_GROUP = 200_000


def _suffixes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, the position of its anchor and, by word position, the hash of the anchor there."""
    anchor = min(ANCHOR, window)
    grams = rolling(words, anchor)
    return window_minima(grams, window - anchor + 1), grams


def _checks(text: str, window: int) -> np.ndarray:
    """Per window, 64 bits from other hashes of its words than those that suffixes are found and sorted by."""
    words = text.encode().split()
    return rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), window)


def shared_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a long, n long): hashes of anchors that more than one document has, and in how many places at least one a
    document. `docs`: _id, _text."""

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, sizes = [], [], []
            for text in batch.column(1):
                at, grams = _suffixes(word_hashes(text.as_py()), window)
                own, times = np.unique(grams[at[np.concatenate([[True], at[1:] != at[:-1]])]] if len(at) else grams[:0], return_counts=True)
                found.append(own)
                counts.append(times)
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes))), pa.array(np.concatenate(counts) if counts else [], pa.int32())], names=["a", "_id", "times"])

    rows = docs.mapInArrow(anchors, f"a long, _id {docs.schema['_id'].dataType.simpleString()}, times int")
    held = rows.groupBy("a").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.sum("times").alias("n"))
    return held.where("least < most").select("a", "n")


def _sampled(docs: DataFrame, shared: np.ndarray, hot: np.ndarray, window: int, of_hot: bool) -> DataFrame:
    """Suffixes whose prefix may be in the filter `shared`. For those not in `hot` a row (a, _id, _row, pos, left, words, checks):
    the hash of the prefix; the first window that sampled it, how many words of it come before the suffix; the words from
    there to the end of the last such window, 16 bits each; and 64 bits a window. For those that may be in `hot` (node, check,
    _id, _row, pos): a row per window, two hashes of the whole. What is in `hot` by chance is treated like the rest: all
    copies alike."""
    spark = docs.sparkSession
    filters = spark.sparkContext.broadcast((shared, hot))  # both of bounded size
    kind = docs.schema["_id"].dataType.simpleString()

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = filters.value
        join = lambda parts: np.concatenate(parts)
        for batch in batches:
            of, pos, anchor, left, nodes, lengths, checks, runs_of = [], [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(2)):
                text = value.as_py()
                words = word_hashes(text)
                at, grams = _suffixes(words, window)
                if not len(at):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                own = grams[at[starts]]
                second = _xxhash64_of_longs(own)
                keep = in_bloom(shared, own, second)
                keep[keep] = in_bloom(hot, own[keep], second[keep]) == of_hot
                if not keep.any():
                    continue
                runs = np.diff(np.concatenate([starts, [len(at)]]))
                if of_hot:
                    chosen = np.flatnonzero(np.repeat(keep, runs))
                    of.append(np.full(len(chosen), i))
                    pos.append(chosen)
                    nodes.append(rolling(words, window)[chosen])
                    checks.append(_checks(text, window)[chosen])
                else:
                    first, run = starts[keep], runs[keep]
                    size = run + window - 1
                    of.append(np.full(len(first), i))
                    pos.append(first)
                    anchor.append(own[keep])
                    left.append(at[first] - first)
                    lengths.append(size)
                    runs_of.append(run)
                    nodes.append((words >> np.uint64(48)).astype(np.uint16)[np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)])
                    checks.append(_checks(text, window)[np.repeat(keep, runs)])
            if not of:
                continue
            rows = pa.array(join(of))
            ids, row = batch.column(0).take(rows), batch.column(1).take(rows)
            if of_hot:
                yield pa.RecordBatch.from_arrays([pa.array(join(nodes).view(np.int64)), pa.array(join(checks).view(np.int64)), ids, row, pa.array(join(pos), pa.int32())], names=["node", "check", "_id", "_row", "pos"])
            else:
                lists = lambda sizes, values, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(join(sizes))]).astype(np.int32)), pa.array(join(values).view(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(join(anchor).view(np.int64)), ids, row, pa.array(join(pos), pa.int32()), pa.array(join(left), pa.int32()), lists(lengths, nodes, np.int16), lists(runs_of, checks, np.int64)], names=["a", "_id", "_row", "pos", "left", "words", "checks"])

    schema = f"node long, check long, _id {kind}, _row long, pos int" if of_hot else f"a long, _id {kind}, _row long, pos int, left int, words array<short>, checks array<long>"
    return docs.select("_id", "_row", "_text").mapInArrow(find, schema)


def _xxhash64_of_longs(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column: XXH64 of its 8 bytes, seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(values), (42 + int(p5) + 8) % 2**64, np.uint64) ^ (turn(values * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _tree(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A tree of word sequences per group, as its nodes: column k numbers the node at depth k that each sequence is under. The
    sequences are sorted; the words that neighbours have in common from the start tell where nodes of each depth end."""
    depth = words.shape[1]
    order = np.lexsort((*words.T[::-1], group))
    group, words = group[order], words[order]
    alike = np.empty((len(order), depth + 1), bool)
    alike[0] = False
    alike[1:, 0] = group[1:] == group[:-1]
    alike[1:, 1:] = words[1:] == words[:-1]
    opens = ~np.logical_and.accumulate(alike, axis=1)
    nodes = np.empty((len(order), depth + 1), np.int64)
    nodes[order] = np.cumsum(opens, axis=0)
    return nodes


def _deep_nodes(rows: pa.Table, window: int) -> pa.RecordBatch:
    """For whole groups: (_id, _row, pos, mask) of the suffixes with a window that a document of a smaller id has too. Bit j of
    mask stands for the window at pos + j.

    A window has `before` words before the suffix and the rest in it: equal windows are under one node at depth `before`
    of the tree of what stands before, and under one at the remaining depth of the tree of suffixes; and they have one
    check. Two that differ in a single word, outside the prefix, are taken for equal with a probability of 2 ** -80."""
    lists = rows["words"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy()
    first = lists.offsets.to_numpy()[:-1]
    held = rows["checks"].combine_chunks()
    checks, first_check = held.values.to_numpy(), held.offsets.to_numpy()[:-1]
    ids, group, left = rows["_id"].to_numpy(), rows["a"].to_numpy(), rows["left"].to_numpy().astype(np.int64)
    prefix = min(ANCHOR, window)
    ahead = np.arange(prefix, window)  # the prefix is the same in a group
    back = np.arange(1, window - prefix + 1)
    right = np.where(left[:, None] + ahead < lengths[:, None], flat[np.minimum(first[:, None] + left[:, None] + ahead, len(flat) - 1)], 0)
    reverse = np.where(back <= left[:, None], flat[np.maximum(first[:, None] + left[:, None] - back, 0)], 0)
    after, before = _tree(group, right), _tree(group, reverse)
    mask = np.zeros(len(lengths), np.int64)
    for n in range(window - prefix + 1):  # words before the suffix
        own = np.flatnonzero((left >= n) & (left - n <= lengths - window))
        node = after[own, window - n - prefix] << np.int64(32) | before[own, n]
        check = checks[first_check[own] + left[own] - n]
        order = np.lexsort((ids[own], check, node))
        k, c, d = node[order], check[order], ids[own][order]
        opens = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
        gone = own[order[d > d[np.flatnonzero(opens)][np.cumsum(opens) - 1]]]
        mask[gone] |= np.int64(1) << (left[gone] - n)
    at = pa.array(np.flatnonzero(mask))
    return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks().take(at) for c in ("_id", "_row", "pos")), pa.array(mask[mask != 0])], names=["_id", "_row", "pos", "mask"])


def _build_trees(suffixes: DataFrame, window: int) -> DataFrame:
    """`suffixes`: rows of _sampled; those of a group come to one task, and whole groups into memory, small ones together."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 50_000:
                continue
            table = pa.Table.from_batches(held)
            key = table["a"].to_numpy()
            whole = int(np.searchsorted(key, key[-1], "left"))
            held, rows = table.slice(whole).to_batches(), len(key) - whole
            if whole:
                yield _deep_nodes(table.slice(0, whole).combine_chunks(), window)
        if held:
            yield _deep_nodes(pa.Table.from_batches(held).combine_chunks(), window)

    kind = suffixes.schema["_id"].dataType.simpleString()
    return suffixes.repartition("a").sortWithinPartitions("a").mapInArrow(build, f"_id {kind}, _row long, pos int, mask long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, max_group: int = MAX_GROUP) -> DataFrame:
    """(_id, _row, pos, mask): where windows start that a document of a smaller id has too; bit j of mask is the window at
    pos + j. `docs`: _id (an integer, no nulls), _row, _text."""
    anchors = materialize(shared_anchors(docs, window))
    hot = anchors.where(F.col("n") > max_group)
    rows, n_hot = anchors.agg(F.count("*"), F.count_if(F.col("n") > max_group)).first()
    shared_filter, hot_filter = build_bloom(anchors, "a", rows), build_bloom(hot, "a", n_hot)
    found = _build_trees(_sampled(docs, shared_filter, hot_filter, window, of_hot=False), window)
    if n_hot:
        windows = materialize(_sampled(docs, shared_filter, hot_filter, window, of_hot=True))
        nodes = windows.groupBy("node", "check").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).where("least < most").drop("most")
        deep = windows.join(materialize(nodes), ["node", "check"]).where("_id > least")
        found = found.unionByName(deep.select("_id", "_row", "pos", F.lit(1).cast("long").alias("mask")))
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, max_group: int = MAX_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_words, n_removed, kept_text, spans) per row of `docs`: the words of the text, unchanged and joined by
    one blank, without those covered by a window whose words also start in a document with a smaller id. spans: the maximal
    runs of removed words, as arrays of (start, stop).

    Windows are judged on the input. A null text has no words; a text shorter than the window loses none. Repeats within
    one id don't count. Rows with a null id lose nothing and take nothing away. Ids are integers. Other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_row", F.xxhash64("_text"))
    known = rows.where("_id IS NOT NULL").select("_id", "_row", "_text")
    found = materialize(repeated_windows(known.select("_id", "_text", "_row"), window, max_group).distinct())
    places = found.groupBy("_id", "_row").agg(F.collect_list(F.struct("pos", "mask")).alias("_places"))
    joined = rows.join(places, ["_id", "_row"], "left").select("_id", "_text", "_places.pos", "_places.mask")
    kind = rows.schema["_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pos, mask in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                words = text.as_py().encode().split()
                if not pos.is_valid:
                    out.append((len(words), 0, b" ".join(words).decode(), []))
                    continue
                starts, bits = pos.values.to_numpy(), mask.values.to_numpy()
                change = np.zeros(len(words) + 1, np.int64)
                for j in range(window):
                    own = starts[(bits >> j) & 1 == 1] + j
                    np.add.at(change, own, 1)
                    np.add.at(change, own + window, -1)
                covered = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).reshape(-1, 2)
                out.append((len(words), int(covered.sum()), b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]).decode(), [{"start": a, "stop": b} for a, b in edges.tolist()]))
            if out:
                n, gone, kept, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["_id", "n_words", "n_removed", "kept_text", "spans"])

    out = joined.mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,stop:int>>")
    return out.withColumnRenamed("_id", id_col)
