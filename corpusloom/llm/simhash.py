"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are computed in Arrow batches. Their bits are put in groups, correlated bits together, and a dynamic program
gives each group its own threshold so that the estimated work is least: with thresholds t_i and sum(t_i + 1) = k + 1, two
fingerprints within k bits agree in some group i but for t_i bits at most. Every distinct fingerprint goes under its keys
(a group's bits without any t_i of them); under a key, candidates are verified bit by bit, and only enough links to hold
a component together come out, never all pairs. Keys are sent in passes of a bounded number each, so that disk doesn't grow
with their number. Near copies by Jaccard similarity are found in the same way, by wider limits,
and then decided on by the shingles of those documents that have a candidate.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import brief_shuffles, free_name, materialize, text_of
from corpusloom.llm.components import connected_components

BITS, SEED = 64, 42
#: Distinct fingerprints that bit statistics are estimated from, at most: those with the smallest hashes.
SAMPLE = 20_000
#: Neighbouring sizes are a factor of this apart: shingle sets with a Jaccard similarity of 0.8 differ by less.
_SIZE_STEP = 1.25
#: For near copies, with a Jaccard similarity of 0.8 or more on 5-word shingles. At 0.8 a bit differs with probability 0.15:
#: 10 of the first 64 bits are expected to, and 29 of the 192 further ones. Within these limits are 97 and 99.9 % of pairs at
#: 0.8, and of the rest most once other 64 bits take the place of the first; the shingles themselves then decide.
NEAR_COPIES = {"shingle_words": 5, "similarity": 0.8, "distance": 15, "more_words": 3, "more_distance": 50}
#: How often candidates are looked for, each time by another 64 bits: as few times as recall needs.
ROUNDS = 3
#: Sets of so few shingles have too rough a fingerprint. They are candidates by their least hashes, of which similar ones
#: must share one, whatever their fingerprints.
SMALL_SET = 25
#: Fingerprints under one key that a task takes at once; a key with more, as estimated from every 64th, is divided.
MAX_UNDER_KEY = 200_000
#: Keys of each fingerprint that are sent at once; a plan for many rows has more, and takes so many passes. What a pass shuffles
#: is deleted before the next one.
KEYS_AT_ONCE = 16
#: Sets of a group of candidates that a task compares at once: larger groups are dealt over pairs of blocks of half as many.
MAX_GROUP = 1_000
#: Bytes of rows that a task holds before it works on the groups that are complete.
_HELD = 64 << 20
#: Pairs of rows under a key that are compared at once, about, and with how many others a row is.
_PAIRS, _COLUMNS = 32_768, 4096
_KEY_COST, _CHECK_COST = 1e-6, 2e-9


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each `width`-word shingle, repeats included, A-Z lower-cased, words joined by one blank; of the
    whole sequence if it is shorter; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(lengths)
    starts = stops - lengths
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), (stops[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - width + 1)


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        bits = np.unpackbits(h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _more_bits(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits of each hash."""
    h = (h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle_words: int = 4, more_words: int = 0, id_col: str = "doc_id", text_col: str = "text", as_set: bool = False, similarity: float = 0.0, with_hashes: bool = False) -> DataFrame:
    """(`id_col`, fp long, more array<long>, size int, least array<long>, hashes binary) per row. A bit of fp is 1 if set in over
    half of the shingle hashes, each counted once with `as_set`; a text without words, or null, has fp zero. `more`: as many
    further 64-bit words of fingerprint as asked for, made of the set of shingles. size: how many different shingles there are.
    least: where there are up to SMALL_SET and a `similarity` is given, so many of the least hashes that two sets of that Jaccard
    similarity share one. hashes: the sorted 64-bit hashes if asked for, else null. Other columns are dropped."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, more, sizes, least, hashes = [], [], [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), shingle_words)
                own = np.unique(h)
                n = len(own)
                fps.append(_majority(own if as_set else h))
                sizes.append(n)
                more.append(np.array([_majority(_more_bits(own, k + 1)) for k in range(more_words)], np.uint64).view(np.int64))
                least.append(own[: n - math.ceil(similarity * n - 1e-9) + 1 if similarity and n <= SMALL_SET else 0].view(np.int64))
                hashes.append(own.tobytes() if with_hashes else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(more, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(least, pa.list_(pa.int64())), pa.array(hashes, pa.binary())], names=["id", "fp", "more", "size", "least", "hashes"])

    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_text")).mapInArrow(compute, f"id {kind}, fp long, more array<long>, size int, least array<long>, hashes binary")
    return named.withColumnRenamed("id", id_col)


def group_bits(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in `groups` groups of nearly equal width, correlated bits together: each group starts with the bit that
    correlates most with any other one left and takes, one by one, the bit that correlates most with its own."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(0)
    norm = np.sqrt((centred**2).sum(0))
    related = np.abs(centred.T @ centred) / np.maximum(norm[:, None] * norm[None, :], 1e-12)
    np.fill_diagonal(related, 0)
    left, out = list(range(BITS)), []
    for g in range(groups):
        width = BITS * (g + 1) // groups - BITS * g // groups
        own = [max(left, key=lambda b: (related[b, left].max(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (related[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def _group_work(sample: np.ndarray, group: list[int], t: int, rows: float) -> float:
    """Estimated seconds for one group at threshold t over `rows` fingerprints: keys to send and pairs to check."""
    one = np.array([((sample >> np.uint64(b)) & np.uint64(1)).mean() for b in group])
    keys = math.comb(len(group), t)
    agree = one**2 + (1 - one) ** 2
    # a key leaves out t bits; on average, the pairs under it agree in the others
    meet = float(np.exp(np.log(agree).sum() * (len(group) - t) / len(group)))
    return rows * keys * _KEY_COST + rows * rows / 2 * keys * meet * _CHECK_COST


def allocate(sample: np.ndarray, distance: int, rows: float) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, for the least estimated work. The dynamic program goes over groups and the
    sum of t_i + 1 spent so far; a group may be left out (t_i = -1), and the sum must come to `distance` + 1."""
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for groups in range(1, min(BITS, distance + 1) + 1):
        parts = group_bits(sample, groups)
        table: dict[int, tuple[float, list[tuple[list[int], int]]]] = {0: (0.0, [])}
        for part in parts:
            grown = dict(table)
            for spent, (work, chosen) in table.items():
                for t in range(min(len(part), distance - spent + 1)):
                    if math.comb(len(part), t) > 2000:
                        break
                    now = work + _group_work(sample, part, t, rows)
                    if now < grown.get(spent + t + 1, (math.inf, []))[0]:
                        grown[spent + t + 1] = (now, [*chosen, (part, t)])
            table = grown
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            best = table[distance + 1]
    return best[1]


def _masks(plan: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """For each key of a fingerprint, a number of its own and the bits that it is made of."""
    return [(1 + g * 4096 + c, sum(1 << b for b in group if b not in out)) for g, (group, t) in enumerate(plan) for c, out in enumerate(itertools.combinations(group, t))]


def _clusters(fp: np.ndarray, more: np.ndarray, size: np.ndarray, distance: int, more_distance: int) -> Iterator[np.ndarray]:
    """Rows under one key that links hold together, two or more. Most rows are near no other one: some at a time are compared
    with all that are left, and those without a neighbour go. From the others links are followed: each row found leaves those
    still to be found, so dense groups cost little more than one look at each row."""

    def agree(x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(more[y] ^ more[x]).sum(1)
        ratio = np.minimum(size[y], size[x]) / np.maximum(size[y], size[x])
        return ~((apart > more_distance) | (ratio < 1 / _SIZE_STEP))

    rest, left = np.arange(len(fp)), fp
    while len(rest) > 1:
        block = left[: max(8, min(64, _PAIRS // len(left))), None]
        linked = np.zeros(len(block), bool)
        for i in range(0, len(left), _COLUMNS):
            near = np.bitwise_count(block ^ left[i : i + _COLUMNS]) <= distance
            if not i:
                np.fill_diagonal(near, False)
            if near.any():
                x, y = np.divmod(np.flatnonzero(near), near.shape[1])
                linked[x[agree(rest[x], rest[i + y])] if more.shape[1] else x] = True
        seeds = rest[: len(block)][linked]
        rest, left = rest[len(block) :], left[len(block) :]
        if len(seeds):
            rest, left = np.concatenate([seeds, rest]), np.concatenate([fp[seeds], left])
        while len(seeds):
            queue = [int(seeds[0])]
            own = list(queue)
            rest, left = rest[1:], left[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(left ^ fp[x]) <= distance
                if more.shape[1] and near.any():
                    at = np.flatnonzero(near)
                    near[at] = agree(x, rest[at])
                if near.any():
                    found = rest[near]
                    own += found.tolist()
                    queue += found.tolist()
                    rest, left = rest[~near], left[~near]
            seeds = seeds[~np.isin(seeds, own)]
            if len(own) > 1:
                yield np.array(own)


def _similar(sets: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    """Rows that Jaccard similarities of at least `similarity` hold together, two or more. `sets`: sorted hashes. How many
    hashes a row shares with each other one is counted by looking its hashes up among all of them, sorted."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], np.repeat(np.arange(len(sets)), size)[order]
    rest = np.ones(len(sets), bool)
    for first in range(len(sets)):
        if not rest[first]:
            continue
        rest[first] = False
        queue, own = [first], [first]
        while queue and rest.any():
            x = queue.pop()
            low, high = np.searchsorted(flat, sets[x]), np.searchsorted(flat, sets[x], "right")
            runs = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum()) if len(runs) else runs
            shared = np.bincount(of[at], minlength=len(sets))
            found = np.flatnonzero(rest & (shared >= similarity * (size + size[x] - shared) - 1e-9))
            rest[found] = False
            own += found.tolist()
            queue += found.tolist()
        if len(own) > 1:
            yield np.array(own)


def _by_key(rows: DataFrame, schema: str, work: Callable[[pa.Table], Callable[[int, int], Iterator[tuple]]], flush: int = 100_000) -> DataFrame:
    """What `work` makes of each group of rows with one `key`: it gets a table, and then each group's first and last place in it."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0

        def close(last: bool) -> pa.RecordBatch:
            nonlocal held, n, size
            table = pa.Table.from_batches(held).combine_chunks()
            key = table["key"].to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)] if last else []]).astype(int)
            of_group = work(table)
            out = [x for i, j in itertools.pairwise(bounds.tolist()) if j - i > 1 for x in of_group(i, j)]
            held = [] if last else table.slice(bounds[-1]).to_batches()
            n = size = 0
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))], names=names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                size += batch.nbytes
                if n >= flush or size >= _HELD:
                    yield close(last=False)
        if held:
            yield close(last=True)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(go, schema)


def _under_keys(prints: DataFrame, masks: list[tuple[int, int]], by_size: bool, first: int = 0) -> DataFrame:
    """(key, at, node, fp, more, size): every row of `prints` under its keys by `masks`, which are number `first` and so on, in `at`;
    with the first of all, small sets also under their least hashes (at -1)."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "at", "node", "fp", "more", "size"]
        for batch in batches:
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            step = np.floor(np.log(np.maximum(1, batch.column(3).to_numpy(zero_copy_only=False))) / math.log(_SIZE_STEP)).astype(np.uint64)
            # with sizes compared, a row also goes under its keys with the next size step, where rows of that step are
            steps = [step, step + np.uint64(1)] if by_size else [np.zeros_like(step)]
            rows = [batch.column(i) for i in range(4)]
            for at, (number, mask) in enumerate(masks, first):
                key = _more_bits(fp & np.uint64(mask), number)
                for s in steps:
                    yield pa.RecordBatch.from_arrays([pa.array(_more_bits(key ^ s, 99).view(np.int64)), pa.array(np.full(len(fp), at, np.int32)), *rows], names=names)
            if first:
                continue
            least = batch.column(4)
            at = pa.array(np.repeat(np.arange(len(fp)), pc.list_value_length(least).fill_null(0).to_numpy(zero_copy_only=False)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pc.list_flatten(least), pa.array(np.full(len(at), -1, np.int32)), *(c.take(at) for c in rows)], names=names)

    return prints.select("node", "fp", "more", "size", "least").mapInArrow(spread, "key long, at int, node long, fp long, more array<long>, size int")


def _hot_keys(prints: DataFrame, masks: list[tuple[int, int]], by_size: bool, most: int) -> DataFrame:
    """(key, at, count) of keys with more than `most` rows, as estimated from every 64th row, with its count there."""
    every = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(64)) == 0
    return materialize(_under_keys(prints.where(every), masks, by_size).where("at >= 0").groupBy("key", "at").count().where(F.col("count") > most / 64))


def _divided(keyed: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """`keyed`, with keys in `hot` replaced by `distance` + 1 keys each: the 64 bits in so many parts, of which two fingerprints
    within `distance` share one. Which keys those are only decides how the work is dealt, so an estimate from a sample of the
    fingerprints will do; what is found is the same."""
    masks = [sum(1 << b for b in range(64 * i // (distance + 1), 64 * (i + 1) // (distance + 1))) for i in range(distance + 1)]

    def divide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array(_more_bits(key ^ _more_bits(fp & np.uint64(mask), 1 + i), 98).view(np.int64)), *batch.columns[1:]], names=batch.schema.names)

    marked = keyed.join(hot.select("key", F.lit(True).alias("hot")), "key", "left")
    return marked.where("hot IS NULL").drop("hot").unionByName(marked.where("hot").drop("hot").mapInArrow(divide, keyed.schema))


def _passes(shares: list[float], most: float) -> Iterator[tuple[int, int]]:
    """First and last place of stretches of `shares` that come to `most` at most, or have one place."""
    first, held = 0, 0.0
    for i, share in enumerate(shares):
        if i > first and held + share > most:
            yield first, i
            first, held = i, 0.0
        held += share
    yield first, len(shares)


def link(prints: DataFrame, plan: list[tuple[list[int], int]], distance: int, more_distance: int = 0, groups: bool = False, most: int = MAX_UNDER_KEY) -> DataFrame:
    """Links (a, b) between rows (node, fp, more, size, least), distinct fingerprints, at most `distance` bits apart in fp and, where
    there are further words, `more_distance` in those, with sizes of a ratio of at least 0.8. Not all links: as many as keep the
    components. With `groups`, rows (key, node) in their place: groups of nodes that such links, or a common least hash, hold
    together, each group once however many keys it was found under. Each pass over the keys is written before the next one begins."""

    def verify(table: pa.Table) -> Callable[[int, int], Iterator[tuple]]:
        at, node, fp, size = (table[c].to_numpy() for c in ("at", "node", "fp", "size"))
        fp = fp.view(np.uint64)
        more = table["more"].combine_chunks()
        flat = more.values.to_numpy(zero_copy_only=False).view(np.uint64)[more.offsets[0].as_py() : more.offsets[-1].as_py()].reshape(len(fp), -1)

        def of_group(i: int, j: int) -> Iterator[tuple]:
            for own in [np.arange(j - i)] if at[i] < 0 else _clusters(fp[i:j], flat[i:j], size[i:j], distance, more_distance):
                if groups:
                    members = np.unique(node[i + own])
                    key = int(np.array([xxhash.xxh64_intdigest(members.tobytes())], np.uint64).view(np.int64)[0])
                    yield from ((key, m) for m in members.tolist())
                else:
                    yield from ((int(node[i + own[0]]), int(y)) for y in node[i + own[1:]])

        return of_group

    masks, by_size = _masks(plan), bool(more_distance)
    hot = _hot_keys(prints, masks, by_size, most)
    shares = [1.0] * len(masks)
    in_hot = {r["at"]: r["n"] for r in hot.groupBy("at").agg(F.sum("count").alias("n")).collect()}
    if in_hot:  # a divided row is sent `distance` more times
        rows = max(1, prints.count()) * (1 + by_size)
        shares = [1 + distance * min(1.0, 64 * in_hot.get(i, 0) / rows) for i in range(len(masks))]
    tables = []
    for i, j in _passes(shares, max(KEYS_AT_ONCE, distance + 1)):
        keyed = _under_keys(prints, masks[i:j], by_size, i)
        tables.append(materialize(_by_key(_divided(keyed, hot, distance) if in_hot else keyed, "key long, node long" if groups else "a long, b long", verify).distinct()))
    return functools.reduce(DataFrame.unionByName, tables).distinct()


def _whole(members: DataFrame, most: int = MAX_GROUP) -> DataFrame:
    """`members` (key, node), a table, with all groups that hang together put into one where those have at most `most` nodes: a
    node is then sent once, not with each of its groups. Any two nodes of a group still meet."""
    first = members.groupBy("key").agg(F.min("node").alias("b"))
    of_node = materialize(connected_components(members.join(first, "key").select(F.col("node").alias("a"), "b")))
    small = materialize(of_node.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select("component"))
    apart = members.join(of_node.join(small, "component", "left_anti").select("node"), "node", "left_semi").select("key", "node")
    return of_node.join(small, "component", "left_semi").select(F.col("component").alias("key"), "node").unionByName(apart)


def _in_blocks(members: DataFrame, most: int) -> DataFrame:
    """`members` (key, node), with groups of more than `most` under keys for pairs of blocks of them, of at most about `most` nodes:
    any two nodes of a group meet under one of its keys."""
    block = max(1, most // 2)
    large = members.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("key", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    joined = members.join(materialize(large), "key", "left")
    dealt = joined.where("_blocks IS NOT NULL").withColumn("_own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where("_own <> _other")
    return joined.where("_blocks IS NULL").select("key", "node").unionByName(dealt.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "node"))


def similar_links(members: DataFrame, sets: DataFrame, similarity: float, most: int = MAX_GROUP) -> DataFrame:
    """Links (a, b) that keep the components of exact Jaccard similarities of at least `similarity` within each group of
    `members` (key, node), a table. `sets`: (node, hashes). What a task holds at once is bounded by `most` sets."""

    def verify(table: pa.Table) -> Callable[[int, int], Iterator[tuple]]:
        node, hashes = table["node"].to_numpy(), table["hashes"].combine_chunks()

        def of_group(i: int, j: int) -> Iterator[tuple]:
            for own in _similar([np.frombuffer(x.as_buffer(), np.uint64) for x in hashes[i:j]], similarity):
                yield from ((int(node[i + own[0]]), int(y)) for y in node[i + own[1:]])

        return of_group

    return _by_key(_in_blocks(members, most).join(sets, "node").select("key", "node", "hashes"), "a long, b long", verify, flush=4_000).distinct()


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 4, distance: int = 4, more_words: int = 0, more_distance: int = 0, similarity: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, fp long, component_id) per row of `docs`: the least id reachable over links, the row's own included.

    Without `similarity`, fingerprints at most `distance` bits apart link. With it, fingerprints only find candidates, and links
    are pairs of a Jaccard similarity of at least `similarity` on the sets of shingles; a row without an id isn't linked then.
    Null and empty texts have fp zero and are linked to each other. Rows with equal fingerprints, further words and sizes
    are linked; they are first reduced to one. Repeated rows give repeated rows; a null id is left out of the minimum. No links
    are capped, and no pairs are sent: a group under a key costs its task its distinct fingerprints, and where shingles decide,
    those of the members that have a candidate.
    """
    with brief_shuffles(docs.sparkSession):
        return _grouped(docs, shingle_words, distance, more_words, more_distance, similarity, id_col, text_col)


def _grouped(docs: DataFrame, shingle_words: int, distance: int, more_words: int, more_distance: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    prepare = lambda rows, sets: fingerprints(rows, shingle_words, more_words, id_col, text_col, as_set=bool(similarity), similarity=similarity, with_hashes=sets).withColumn("node", F.col("fp") if not more_words else F.xxhash64("fp", "more", "size"))
    prints = materialize(prepare(docs, False).drop("hashes"))
    known = prints.where(F.col(id_col).isNotNull()) if similarity else prints
    nodes = materialize(known.groupBy("node").agg(F.first("fp").alias("fp"), F.first("more").alias("more"), F.first("size").alias("size"), F.first("least").alias("least"), F.min(id_col).alias("first_id")))
    rows = nodes.count()
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("node"), "node").select("fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    if rows < 2:
        return prints.join(nodes.select("node", F.col("first_id").alias("component_id")), "node", "left").select(id_col, "fp", "component_id")
    plan = allocate(sample, distance, rows if not more_distance else rows / 4)
    links = link(nodes, plan, distance, more_distance, groups=bool(similarity))
    if similarity:
        # again with another word of fingerprint in the place of the first: hardly a pair is over the limit in all
        for k in range(min(ROUNDS - 1, more_words)):
            others = F.array("fp", *(F.get("more", i) for i in range(more_words) if i != k))
            turned = nodes.withColumns({"fp": F.get("more", k), "more": others, "least": F.array().cast("array<long>")})
            links = links.unionByName(link(turned, plan, distance, more_distance, groups=True))
        links = links.distinct()
    links = materialize(links)
    if similarity:
        links = materialize(_whole(links))
        # the shingles of one document per node that has a candidate, and of no others
        asked = materialize(nodes.join(links.select("node").distinct(), "node").select("node", F.col("first_id").alias("_asked")))
        name = free_name(docs, "_asked")
        chosen = docs.join(asked.select(F.col("_asked").alias(name)).distinct(), F.col(id_col) == F.col(name), "left_semi")
        sets = prepare(chosen, True).select("node", "hashes").join(asked, "node", "left_semi")
        links = materialize(similar_links(links, materialize(sets.dropDuplicates(["node"])), similarity))
    parts = connected_components(links)
    labelled = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).select("node", "first_id", "component")
    labelled = materialize(labelled)
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = materialize(labelled.join(least, "component").select("node", "component_id"))
    if not similarity:
        return prints.join(of_node, "node").select(id_col, "fp", "component_id")
    return known.join(of_node, "node").select(id_col, "fp", "component_id").unionByName(prints.where(F.col(id_col).isNull()).select(id_col, "fp", F.col(id_col).alias("component_id")))
