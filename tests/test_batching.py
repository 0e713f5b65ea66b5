from pyspark.sql import functions as F

from preftable.operators import batching as B
from preftable.operators.encode import build_vocab, encode
from preftable.operators.indexing import with_group_row_number, with_row_index


def test_row_index_independent_of_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000)))
    ref = None
    for parts in (1, 3, 16):
        got = {r.k: r.row_idx for r in with_row_index(df, ["k"], partitions=parts).collect()}
        assert sorted(got.values()) == list(range(1000))
        assert all(got[k] == k for k in got)
        ref = ref or got
        assert got == ref


def test_group_row_number_with_hot_group(spark):
    rows = [("hot", i) for i in range(300)] + [("a", i) for i in range(5)] + [("b", i) for i in range(2)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = {(r.g, r.k): r.rn for r in with_group_row_number(df, ["g"], ["k"], partitions=6).collect()}
    assert all(got[(g, k)] == k for g, k in got)


def test_split_disjoint_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "key")
    s = B.train_test_split(df, "key", 0.1, seed=7)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 2000 and 120 < counts["test"] < 290
    again = B.train_test_split(df, "key", 0.1, seed=7)
    assert s.exceptAll(again).count() == 0
    exact = B.train_test_split(df, "key", 0.1, seed=7, exact=True)
    assert exact.filter(F.col("split") == "test").count() == 200


def test_batches_buffers_replay(spark):
    df = B.shuffle(spark.range(23).withColumnRenamed("id", "key"), "key", 1, 0)
    b = B.assign_batches(df, ["shuffle_key", "key"], 4)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [3, 4, 4, 4, 4, 4]
    mb = B.make_mini_batches(b, 2)
    assert mb.select("batch_id", "mini_id").distinct().count() == 12
    buf = B.fill_buffer(mb, 4)
    assert buf.select("batch_id").distinct().count() == 4  # batches 4-5 form an incomplete buffer
    rep = B.replay_epochs(buf, 2, seed=3)
    steps = sorted(r.step for r in rep.select("step").distinct().collect())
    assert steps == list(range(1, 17))
    assert rep.count() == 2 * buf.count()


def test_zip_streams_cuts_to_shorter(spark):
    main = B.assign_batches(spark.range(10).withColumnRenamed("id", "m"), ["m"], 4)
    extra = B.assign_batches(spark.range(6).withColumnRenamed("id", "x"), ["x"], 4)
    z = B.zip_streams(main, extra).collect()
    assert {r.batch_id for r in z} == {0, 1}
    assert len(z) == 8 and sum(1 for r in z if r.extra_x is None) == 2


def test_shards(spark):
    s = B.shard_to_ranks(spark.range(10).withColumnRenamed("id", "k"), 3, ["k"])
    assert sorted(r["count"] for r in s.groupBy("rank").count().collect()) == [3, 3, 4]


def test_encode_unknown_empty_and_hot_cold(spark):
    corpus = spark.createDataFrame([("a b a c",), ("a b",)], "text string")
    vocab = build_vocab(corpus)
    ids = {r.token: r.id for r in vocab.collect()}
    assert ids == {"a": 3, "b": 4, "c": 5}
    df = spark.createDataFrame([(1, "a zz  c\nb"), (2, ""), (3, None), (4, " ")], "k long, text string")
    full = {r.k: r.text_ids for r in encode(df, "text", vocab, ["k"]).collect()}
    assert full == {1: [3, 0, 5, 4], 2: [], 3: [], 4: []}
    split = {r.k: r.text_ids for r in encode(df, "text", vocab, ["k"], broadcast_limit=1).collect()}
    assert split == full


def test_encode_matches_brute_force(spark):
    import random
    import re

    rnd = random.Random(11)
    words = ["a", "bb", "ccc", "the", "Über", "x{y}", "é", "zz"]

    def text():
        parts = []
        for _ in range(rnd.randint(0, 12)):
            parts.append(rnd.choice(words))
            parts.append(rnd.choice([" ", "  ", "\n", " \n "]))
        return "".join(parts)

    corpus = spark.createDataFrame([(text(),) for _ in range(40)], "text string")
    vocab = build_vocab(corpus)
    table = {r.token: r.id for r in vocab.collect()}
    # brute-force vocabulary: count desc, token asc, ids from 3
    counts = {}
    for r in corpus.collect():
        for t in re.split("[ \n]+", r.text):
            if t:
                counts[t] = counts.get(t, 0) + 1
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0].encode()))
    assert table == {t: i + 3 for i, (t, _) in enumerate(ranked)}
    rows = [(i, text() + " unknownword") for i in range(30)]
    df = spark.createDataFrame(rows, "k long, text string")
    got = {r.k: r.text_ids for r in encode(df, "text", vocab, ["k"]).collect()}
    for k, t in rows:
        assert got[k] == [table.get(w, 0) for w in re.split("[ \n]+", t) if w]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "key long, text string")
    assert with_row_index(empty, ["key"]).count() == 0
    b = B.assign_batches(empty, ["key"], 4)
    assert b.count() == 0
    assert B.fill_buffer(B.make_mini_batches(b, 2), 3).count() == 0
    assert B.zip_streams(b, b).count() == 0
    vocab = build_vocab(empty)
    assert vocab.count() == 0
    assert encode(spark.createDataFrame([(1, "a b")], "key long, text string"), "text", vocab, ["key"]).first().text_ids == [0, 0]


def test_encode_max_ids_equals_truncation(spark):
    corpus = spark.createDataFrame([("a b c d e",)], "text string")
    vocab = build_vocab(corpus)
    df = spark.createDataFrame([(1, " a b c d e f "), (2, ""), (3, "a"), (4, None)], "k long, text string")
    full = {r.k: r.text_ids for r in encode(df, "text", vocab, ["k"]).collect()}
    cut = {r.k: r.text_ids for r in encode(df, "text", vocab, ["k"], max_ids=3).collect()}
    assert cut == {k: v[:3] for k, v in full.items()}
