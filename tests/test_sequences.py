from pyspark.sql import functions as F

from preftable.config import SpecialIds
from preftable.operators import collate as C
from preftable.operators import sequences as S

IDS = SpecialIds()


def test_g1_sft_and_ppo(spark):
    df = spark.createDataFrame([(0, [11, 12, 13, 14], [21, 22])], "example_id long, prompt_ids array<int>, response_ids array<int>")
    r = S.build_sft_sequences(df, ids=IDS, max_prompt_length=4, max_response_length=4).first()
    assert r.input_ids == [11, 12, 13, 1, 21, 22, 2]
    assert r.label_ids == [-100, -100, -100, 1, 21, 22, 2]
    p = S.build_ppo_prompts(df, ids=IDS, max_prompt_length=4, max_response_length=4).first()
    assert p.input_ids == [11, 12, 13, 1] and p.label_ids == [21, 22, 1]


def test_truncation_edges(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [4]), (1, [1, 2, 3, 4], [])], "example_id long, prompt_ids array<int>, response_ids array<int>")
    rows = {r.example_id: r for r in S.build_sft_sequences(df, max_prompt_length=4, max_response_length=4).collect()}
    assert rows[0].input_ids == [1, 2, 3, 1, 4, 2]
    assert rows[1].input_ids == [1, 2, 3, 1, 2]
    assert all(len(r.input_ids) == len(r.label_ids) for r in rows.values())


def test_g2_pair_flatten_round_trip(spark):
    df = spark.createDataFrame([(0, [11], [21, 22], [31])], "example_id long, prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>")
    p = S.pad_pair(S.build_pair_sequences(df, ids=IDS), IDS)
    r = p.first()
    assert r.accepts_ids == [11, 1, 21, 22, 2] and r.accepts_labels == [-100, 1, 21, 22, 2]
    assert r.rejects_ids == [11, 1, 31, 2, 0] and r.rejects_labels == [-100, 1, 31, 2, -100]
    flat = S.flatten_pairs(p)
    assert len(flat.first().input_ids) == 10
    back = S.unflatten_pairs(flat).first()
    assert back.accepts_ids == r.accepts_ids and back.rejects_labels == r.rejects_labels


def test_g3_packing(spark):
    df = spark.createDataFrame(
        [(0, 0, [1, 5, 6]), (0, 1, [1, 7, 8, 9]), (0, 2, [1, 4]), (1, 0, [1, 5]), (1, 1, [])],
        "g long, k long, input_ids array<int>",
    )
    out = {(r.g, r.block_id): r.input_ids for r in S.pack_blocks(df, ["g"], "k", "input_ids", 4).collect()}
    assert out == {(0, 0): [1, 5, 6, 1], (0, 1): [7, 8, 9, 1], (1, 0): [1, 5]}


def test_packing_property(spark):
    import random

    rnd = random.Random(7)
    rows, flat = [], {}
    for g in range(3):
        for k in range(rnd.randint(1, 30)):
            ids = [rnd.randint(3, 99) for _ in range(rnd.randint(0, 13))]
            rows.append((g, k, ids))
            flat.setdefault(g, []).extend(ids)
    df = spark.createDataFrame(rows, "g long, k long, input_ids array<int>")
    b = 8
    got = {}
    for r in S.pack_blocks(df, ["g"], "k", "input_ids", b).collect():
        got.setdefault(r.g, {})[r.block_id] = r.input_ids
    for g, ids in flat.items():
        keep = len(ids) if len(ids) < b else (len(ids) // b) * b
        blocks = got.get(g, {})
        joined = [x for i in sorted(blocks) for x in blocks[i]]
        assert joined == ids[:keep]
        if len(ids) >= b:
            assert all(len(x) == b for x in blocks.values())


def test_left_pad_collate(spark):
    df = spark.createDataFrame([(0, 0, [5, 6, 1]), (0, 1, [7, 1])], "batch_id long, k long, input_ids array<int>")
    out = {r.k: r for r in C.collate_prompts_left(df, "batch_id").collect()}
    assert out[0].input_ids == [5, 6, 1] and out[1].input_ids == [0, 7, 1]
    assert out[0].attention_mask == [1, 1, 1] and out[1].attention_mask == [0, 1, 1]


def test_collate_sft_masks(spark):
    df = spark.createDataFrame([(0, 0, [5, 0, 1], [5, 0, 1]), (0, 1, [7], [7])], "batch_id long, k long, input_ids array<int>, label_ids array<int>")
    out = {r.k: r for r in C.collate_sft(df).collect()}
    assert out[1].input_ids == [7, 0, 0] and out[1].labels == [7, -100, -100]
    assert out[0].attention_mask == [1, 0, 1]  # pad = unknown = 0 masks the unknown token (parity)
    by_len = {r.k: r for r in C.collate_sft(df, mask_mode="by_length").collect()}
    assert by_len[0].attention_mask == [1, 1, 1] and by_len[1].attention_mask == [1, 0, 0]


def test_pad_across_shards(spark):
    df = spark.createDataFrame([(0, [1, 2], [1, 1]), (0, [3], [1])], "step long, input_ids array<int>, attention_mask array<int>")
    rows = sorted(C.pad_across_shards(df, side="left").collect(), key=lambda r: len([x for x in r.input_ids if x]))
    assert rows[0].input_ids == [0, 3] and rows[0].attention_mask == [0, 1]
    assert F is not None


def test_long_form_packing_equals_array_form(spark):
    import random

    from preftable.operators.encode import build_vocab, encode_long, encode_with_specials

    rnd = random.Random(5)
    words = ["a", "b", "c", "dd", "zz"]
    rows = []
    for k in range(60):
        body = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 15)))
        rows.append((k, k // 20, rnd.choice(["", " ", "\n "]) + body + rnd.choice(["", " ", "\n"])))
    df = spark.createDataFrame(rows, "doc_id long, g long, text string")
    vocab = build_vocab(df.filter("doc_id % 3 <> 0"))
    arr = encode_with_specials(df, "text", vocab, ["doc_id"], passthrough=["g"], out="input_ids")
    a = {(r.g, r.block_id): r.input_ids for r in S.pack_blocks(arr, ["g"], "doc_id", "input_ids", 7).collect()}
    toks = encode_long(df, "text", vocab, ["doc_id", "g"], with_bos=True)
    flat = {r.doc_id: r.input_ids for r in arr.collect()}
    got = {}
    for r in toks.collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.id
    assert {d: [got[d][i] for i in range(len(got[d]))] for d in got} == flat
    b = {(r.g, r.block_id): r.input_ids for r in S.pack_blocks_long(toks, ["g"], "doc_id", "pos", "id", 7).collect()}
    assert a == b
