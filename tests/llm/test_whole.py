"""What a cut would leave out: the mixture's effect, short lines, many sources."""

import heapq
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from preftable.llm import linedup, mixing, neardup

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="fixture tables not present")


def test_mixture_decides_sequences(spark):
    rows = [(i, f"doc {i} " + "w " * (i % 50), "big" if i % 46 else "small") for i in range(9200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, BASE)
    got = stages["packing"](spark, mixed, BASE).collect()
    window = {r.doc_id: r[mixing.WINDOW] for r in mixed.collect()}
    assert set(window.values()) == {0, 1}
    slot = {r.doc_id: (r.slot, r.period) for r in mixing.mix(docs).crossJoin(mixing.schedule(mixing.target_units(docs)).select("period").distinct()).collect()}
    assert window == {i: s // w for i, (s, w) in slot.items()}
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) and {r.doc_id for r in got} == set(window)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, window[r.doc_id]))
    assert sorted(by) == list(range(len(by)))
    order = []
    for s in sorted(by):
        end = 0
        for offset, length, _ in sorted(by[s]):
            assert offset == end
            end += length
        assert end <= 1024 and len({w for *_, w in by[s]}) == 1
        order.append(by[s][0][2])
    assert order == sorted(order)
    # The first window nears the target: the small source has sqrt(200) of sqrt(9000) + sqrt(200).
    first = [r for r in got if window[r.doc_id] == 0]
    share = sum(r.doc_id % 46 == 0 for r in first) / len(first)
    assert share > 200 / 9200
    empty = stages["packing"](spark, stages["mixing"](spark, docs.filter(F.lit(False)), BASE), BASE)
    assert empty.count() == 0


def edf(units):
    """Slots of ``(source, block)`` by the definition: in each slot the earliest deadline of the released blocks."""
    w, heap, out, release = sum(units.values()), [], {}, {}
    for k, u in units.items():
        for j in range(u):
            release.setdefault(j * w // u, []).append((((j + 1) * w + u - 1) // u, k, j))
    for t in range(w):
        for x in release.get(t, []):
            heapq.heappush(heap, x)
        d, k, j = heapq.heappop(heap)
        assert t < d
        out[k, j] = t
    return out


@pytest.mark.parametrize("part", [1, 7, 64])
def test_schedule_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(mixing, "PART", part)
    rng = random.Random(part)
    units = {f"s:{i:03d}": rng.choice([1, 2, 3, 11, 40]) for i in range(30)}
    plan = mixing.schedule(spark.createDataFrame(list(units.items()), "__k string, units long")).collect()
    assert {(r["__k"], r["__j"]): r["__slot"] for r in plan} == edf(units)
    assert all(r.release <= r["__slot"] < r.deadline for r in plan)


def test_many_sources_keep_their_shares(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id < 6000 THEN concat('s', id div 4) ELSE 'big' END AS source")
    units = {r["__k"]: r.units for r in mixing.target_units(docs).collect()}
    total, weight = sum(units.values()), 1500 * 4**0.5 + 54_000**0.5
    for k, u in units.items():
        share = (54_000 if k == "s:big" else 4) ** 0.5 / weight
        assert abs(u / total / share - 1) <= 1 / (mixing.LEAST_UNITS - 1)
    got = mixing.mix(docs).agg(F.count(F.lit(1)), F.countDistinct("slot", "place"), F.sum(F.expr("int(release <= slot AND slot < deadline)"))).first()
    assert tuple(got) == (60_000,) * 3


def test_short_lines(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choices(["w%d" % i for i in range(9)], k=rng.randint(0, 8))) for _ in range(400)]
    lines[:6] = ["All rights reserved.", "All rights reserved.", "a b c d", "b a d c e", "Ietzte.", "Ietzte."]
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, 400, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, want = [], {}
    for i, text in enumerate(texts):
        for k, line in enumerate(text.split("\n")):
            if w := frozenset(line.split()):
                match = [x for x in seen if 100 * len(x & w) >= linedup.PERCENT * len(x | w)]
                if match:
                    want[i, k] = w in match
                seen.append(w)
    got = {(r.doc_id, r.line_no): r.exact for r in linedup.repeated_lines(docs).collect()}
    assert got == want and {(0, 1): True, (0, 3): False, (1, 0): True}.items() <= got.items()
    assert any(not e and len(set(texts[d].split("\n")[k].split())) == 4 for (d, k), e in got.items())
    left = [x for r in linedup.dedup_lines(docs).collect() for x in r.text.split("\n")]
    assert left.count("All rights reserved.") == left.count("Ietzte.") == 1
    # Cut off below five words, the others are found as before.
    five = {(r.doc_id, r.line_no) for r in linedup.repeated_lines(docs, min_tokens=5).collect()}
    assert five and five < set(want) and all(len(set(texts[d].split("\n")[k].split())) >= 5 for d, k in five)


def test_rows_that_share_an_id(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(30))
    rows = [(1, text("a"), "x")] * 3 + [(2, text("b"), "x"), (5, text("b"), "x"), (5, text("c"), "x"), (6, text("c"), "y"), (7, text("d"), "x"), (7, "", "x"), (8, text("d") + " end", "x")]
    rows += [(9, "", "x"), (9, "", "x"), (None, "", "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    parts = {}
    for r in neardup.near_duplicates(docs).collect():
        parts.setdefault(r.doc_id, set()).add(r.component_id)
    assert parts == {1: {1}, 2: {2}, 5: {2}, 6: {2}, 7: {7}, 8: {7}, 9: {9}, None: {None}}
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 7, 9, None, None]
