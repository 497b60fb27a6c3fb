import random
import zlib

import numpy as np

from foliant.llm.common import scratch_path
from foliant.llm.sharding import assign_shards, range_of, write_shards


def check(rows, docs, n=8):
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((d[0] is not None, d[0] or 0) for d in docs)
    text = {d[0]: d[1] for d in docs}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(n)]
    assert max(sizes) - min(sizes) <= 2 * max([r.size for r in rows], default=0)


def test_sizes_slots_and_hot_group(frame):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choices("abé ", k=rng.randint(0, 60))), "en", "s") for i in range(900)]
    docs += [(1000 + i, "the same text", "en", "s") for i in range(500)] + [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "x" * 20_000, "en", "s")]
    rows = assign_shards(frame(docs)).collect()
    check(rows, docs)
    again = assign_shards(frame(docs[::-1]).repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    same = [r.shard for r in rows if 1000 <= r.doc_id < 1500]
    assert max(same) - min(same) == len(set(same)) - 1  # a group of equal texts lies in neighbouring shards


def test_repeated_rows_null_ids_and_empty(frame, empty):
    docs = [(1, "a b", "en", "s")] * 300 + [(None, "zz", "en", "s"), (None, None, "en", "s")]
    rows = assign_shards(frame(docs)).collect()
    assert len(rows) == 302
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 8
    assert assign_shards(empty).collect() == []


def test_ranges_follow_the_key_order():
    bounds = np.array([[-5, 3], [7, -1], [7, 4], [7, 9], [20, 0]])
    keys = [(-9, 0), (-5, 2), (-5, 3), (7, -2), (7, -1), (7, 5), (7, 9), (8, 0), (30, 1)]
    want = [sum(tuple(b) <= k for b in bounds) for k in keys]
    got = range_of(bounds, np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))
    assert got.tolist() == want


def test_written_shards_hold_every_row_once(spark, frame):
    docs = [(i, f"text {i % 50}", "en", "s") for i in range(300)] + [(5, "again", "en", "s"), (5, "again", "fr", "s")] + [(9, "text 9", "en", "t")] * 40 + [(None, None, "en", "s"), (None, "", "en", "s"), (None, "", "en", "s"), (777, "y" * 200_000, "en", "s")]
    df = frame(docs).repartition(5)
    path = scratch_path(spark, "shards")
    placed = write_shards(df, path)
    rows = spark.read.parquet(path)
    assert sorted((str(r.doc_id), str(r.text), r.lang, r.source) for r in rows.collect()) == sorted((str(d[0]), str(d[1]), d[2], d[3]) for d in docs)
    assert sorted((r.shard, r.slot) for r in rows.collect()) == sorted((r.shard, r.slot) for r in placed.collect())
    key = lambda r, size: (str(r.doc_id), size, r.shard, r.slot)
    assert sorted(key(r, len((r.text or "").encode()) + 1) for r in rows.collect()) == sorted(key(r, r.size) for r in placed.collect())
