import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from corpusloom.llm import exact_dedup, line_dedup, repeat_filter, sharding
from corpusloom.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_exact_odd_rows(spark, odd_docs):
    rows = exact_dedup.exact_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    of = {r.doc_id: r for r in rows}
    assert (of[1].keep_id, of[1].group_size, of[1].kept) == (2, 2, False) and of[2].kept and of[None].kept
    assert (of[3].keep_id, of[3].group_size, of[3].kept) == (3, 2, True)
    assert of[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_groups(odd_docs.limit(0)).count() == 0


def test_unique_rows_are_not_shuffled(spark, odd_docs, monkeypatch):
    """Without automatic broadcasts, and with many slices: what passes straight through meets no exchange of rows."""
    docs = spark.range(40000).select(F.col("id").alias("doc_id"), (F.col("id") % 30000).cast("string").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = []

    def written(df, *args, **more):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *args, **more)

    materialize = exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", written)
    monkeypatch.setattr(repeat_filter.may_repeat, "__defaults__", (1000,))
    try:
        rows = exact_dedup.exact_groups(docs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [(i, i % 30000 + 30000 if i % 30000 < 10000 else i, 2 if i % 30000 < 10000 else 1) for i in range(40000)]
    hashed, _, marked, _ = seen
    assert "Exchange" not in hashed and "Exchange" not in marked.replace("BroadcastExchange", "") and marked.count("BroadcastHashJoin") >= 8


def test_line_odd_rows(spark, odd_docs):
    rows = line_dedup.dedup_lines(odd_docs).collect()
    assert sorted(r._kept_text for r in rows) == sorted(r.text or "" for r in odd_docs.collect())
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


def test_lines_over_a_word_of_the_bitmap(spark):
    """Lines at and after position 64, ties of equal ids, keys that differ in case and outer white space only."""
    line = "A line which five documents hold, of over 40 code points"
    docs = [(d, "\n".join([f"own {d} {i}" for i in range(63 + d)] + [f" \t{line.upper() if d % 2 else line} ", line, "end"])) for d in range(5)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")).collect()}
    assert all(got[d]._n_dropped == 2 and got[d]._kept_text == "\n".join(t.split("\n")[:-3] + ["end"]) for d, t in docs[:4])
    assert got[4]._n_dropped == 0 and got[4]._kept_text == docs[4][1]


def test_op7(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    places, load = defaultdict(list), [0] * 8
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes", None)
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(own) == list(range(len(own))) for own in places.values())
    # a slot is the least that moves: no shard has more than a slot over another's bytes
    slots = defaultdict(int)
    for r in rows:
        slots[r.virtual_slot] += r.size
    assert max(load) - min(load) <= max(slots.values())
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert all(len(own) == 1 for own in shards.values())
    assert all(r.next_shard in (r.shard, 8) for r in rows) and any(r.next_shard == 8 for r in rows)


def test_groups_of_equal_texts(spark):
    """Equal texts share a shard; a group too large for one is dealt out; sizes are near equal either way."""
    docs = spark.range(30000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 2000).cast("string")).alias("text"))
    got = sharding.shard_documents(docs)
    rows = got.withColumn("text", F.when(F.col("text_crc32") == zlib.crc32(b"hot"), "hot").otherwise(F.col("text_crc32").cast("string"))).groupBy("text").agg(F.countDistinct("shard").alias("n")).collect()
    assert all((r.n == 8) if r.text == "hot" else (r.n == 1) for r in rows) and len(rows) > 1000
    shards = got.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("places"), F.max("slot").alias("last")).collect()
    assert max(r.bytes for r in shards) < 1.01 * min(r.bytes for r in shards)
    assert all(r.n == r.places == r["last"] + 1 for r in shards) and sum(r.n for r in shards) == 30000


def test_limit_of_a_group(spark):
    """A group of 3.5 %, or of nearly a shard's 12.5 %, of the bytes is in one shard; one of 30 % is in all."""
    for share, shards in ((350, 1), (1200, 1), (3000, 8)):
        docs = spark.range(10000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < share, F.lit("same!")).otherwise(F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
        got = sharding.shard_documents(docs)
        assert got.where("doc_id < 350").select("shard").distinct().count() == shards
        sizes = [r.bytes for r in got.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
        assert max(sizes) < 1.02 * min(sizes)


def test_slot_map_grows_and_is_stored(spark, tmp_path):
    sizes = {s: (s * 7919) % 101 + 1 for s in range(512)}
    first = sharding.fill_map(sizes, 8, 512)
    grown = sharding.grow_map(first, sizes)
    assert grown.version == 2 and all(b in (a, 8) for a, b in zip(first.shard_of, grown.shard_of, strict=True))
    load = [sum(v for s, v in sizes.items() if grown.shard_of[s] == k) for k in range(9)]
    assert max(load) - min(load) <= 2 * max(sizes.values())
    for m in (first, grown):
        m.save(spark, f"{tmp_path}/map")
    assert sharding.load_map(spark, f"{tmp_path}/map") == grown and sharding.load_map(spark, f"{tmp_path}/map", 1) == first


def test_shard_odd_rows(spark, odd_docs):
    assert sharding.shard_documents(odd_docs).count() == odd_docs.count()
    assert sharding.shard_documents(odd_docs.limit(0)).count() == 0


def test_repeated_hashes(spark):
    """No repeated hash is missing, few others are in; with many small segments too, and over several partitions."""
    rows = spark.range(0, 30000, numPartitions=5).select(F.when(F.col("id") < 29000, F.xxhash64(F.col("id") % 20000)).alias("h"))
    for per_segment in (repeat_filter.ROWS_PER_SEGMENT, 100):
        found = repeat_filter.repeated_hashes(rows, "h", 30000, per_segment)
        got = repeat_filter.may_repeat(rows.where("h IS NOT NULL").distinct(), "h", found, repeat_filter.filter_bits(30000)).join(spark.range(20000).select("id", F.xxhash64("id").alias("h")), "h").collect()
        assert len(got) == 20000 and all(r.maybe for r in got if r.id < 9000)
        assert sum(r.maybe for r in got if r.id >= 9000) < 500
    assert repeat_filter.repeated_hashes(rows.limit(0), "h", 0).count() == 0
