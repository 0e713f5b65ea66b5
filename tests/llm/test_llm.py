"""Pipeline operators against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from preftable.llm import components as CC
from preftable.llm import covertree, linedup, mixing, neardup, packing, queries, quotes, rules, secretscan, simple8b, tokencount, tokens

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="fixture tables not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node string, slot int, kept string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    vocab = ["w%03d" % i for i in range(400)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    base = "\n".join(line(30) for _ in range(5))
    texts = [None, "", " \n\t ", "one two", "One TWO", base, base, base.replace(" ", "  ", 3), base + " tail words here", base.upper(),
             "é漢字 " * 40, line(20_000), "a b\r\nc d e f g", "x" * 5000, "the same line here again\n" * 9]
    texts += [line(25) + "\n" + base.split("\n")[1] for _ in range(20)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, "n", 2, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{BASE}/{t}.parquet')")
    df = queries.QUERIES[name](spark, BASE)
    rel = con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = sorted(rel.project(", ".join(cols)).fetchall(), key=repr)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == want


def test_ids_equal_the_library(library):
    enc = tokens.encoder(tokens.default_vocabulary())
    for t in ["", "a  b", " a", "a ", "a\n\nb", "it's 12ab\tx", "<|endoftext|> x", "é漢字 ü", "a b   c", "x\r\ny", "a.b, c!? 's"]:
        assert list(np.frombuffer(enc.ids(t), "<u4")) + [2] == library(t)


@pytest.mark.parametrize("top", [1, 3, 50_256, 2**40, 2**64 - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        v = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        v[n // 4 : n // 2] = 0
        assert (simple8b.unpack_ids(*simple8b.pack_ids(v), n) == v).all()


def test_files_and_packing(odd, empty, library):
    got = {r.doc_id: r for r in simple8b.write_and_read(odd, tokens.default_vocabulary()).collect()}
    at = 0
    for r in sorted(odd.collect(), key=lambda r: r.doc_id):
        ids = np.array(library(r.text), "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces = packing.pack_documents(odd, tokens.default_vocabulary()).collect()
    assert sum(p.length for p in pieces) == at and len({p.sequence_id for p in pieces}) <= -(-at // 1024) + 2
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 1024
    assert packing.pack_documents(empty, tokens.default_vocabulary()).count() == 0
    assert simple8b.write_and_read(empty, tokens.default_vocabulary()).count() == 0


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_every_capacity_holds(rule):
    rng = random.Random(5)
    cap = packing.Capacity(max_docs=4, max_cost=1024 * 1024, weights=(1.0, 0.3, 0.2), rule=rule)
    counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 1025), 200)}
    bins, placed = {}, dict.fromkeys(counts, 0)
    for length, rank, n, first, offset in packing.place(counts, cap):
        placed[length] += n
        for b in range(first, first + n):
            bins.setdefault(b, []).append((offset, length))
    assert placed == counts
    for own in bins.values():
        assert sum(n for _, n in own) <= 1024 and len(own) <= 4 and sum(n * n for _, n in own) <= 1024 * 1024


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), (1.0, 0.1, 0.1), (0.2, 0.5, 1.0)])
@pytest.mark.parametrize("docs, cost", [(None, None), (5, 500_000)])
def test_placements_are_one_by_one_best_fit(rule, weights, docs, cost):
    rng = random.Random(7)
    cap = packing.Capacity(max_docs=docs, max_cost=cost, weights=weights, rule=rule)
    top = 1024 if cost is None else 700
    for lengths in ([rng.randint(1, top) for _ in range(400)], [rng.choice((5, 90, 100, 300)) for _ in range(300)], []):
        bins = []
        for n in sorted(lengths, reverse=True):
            need = (n, 1, n * n)
            best = None
            for i, room in enumerate(bins):
                if all(a >= d for a, d in zip(room, need)):
                    if rule == "dot_product":
                        s = -sum(w * (a / c) * (d / c) for w, a, d, c in zip(weights, room, need, cap.limits))
                    else:
                        s = sum(w * ((a - d) / c) ** 2 for w, a, d, c in zip(weights, room, need, cap.limits))
                    best = min(best or (s, room, i), (s, room, i))
            if best is None:
                bins.append(cap.limits)
            i = len(bins) - 1 if best is None else best[2]
            bins[i] = tuple(a - d for a, d in zip(bins[i], need))
        own = {}
        for length, _, n, first, offset in packing.place(dict(Counter(lengths)), cap):
            for b in range(first, first + n):
                own.setdefault(b, []).append((offset, length))
        left = []
        for placed in own.values():
            placed.sort()
            assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
            used = (sum(n for _, n in placed), len(placed), sum(n * n for _, n in placed))
            left.append(tuple(c - u for c, u in zip(cap.limits, used)))
        assert sorted(left) == sorted(bins) and sorted(own) == list(range(len(own)))


def test_token_counts(odd, empty):
    scores, byte = tokencount.read_pieces(tokencount.default_pieces())

    def viterbi(w):
        w = tokencount.MARK + w
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            size = len(w[i - 1].encode())
            options = [(best[i - 1][0] + byte * size, -best[i - 1][1] - size)]
            options += [(best[j][0] + scores[w[j:i]], -best[j][1] - 1) for j in range(max(0, i - 20), i) if w[j:i] in scores]
            s, c = max(options)
            best.append((s, -c))
        return best[-1][1]

    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(odd, tokencount.default_pieces()).collect()}
    for r in odd.filter("length(text) < 4000 or text is null").collect():
        assert got[r.doc_id] == sum(viterbi(w) for w in (r.text or "").split())
    small = tokencount.TrieCounter(scores, byte, max_nodes=50)
    assert small.tokens("the theory of thermal things the theory") == tokencount.TrieCounter(scores, byte).tokens("the theory of thermal things the theory")
    assert tokencount.token_counts(empty, tokencount.default_pieces()).count() == 0


def test_near_duplicates(odd, empty):
    sets = {}
    for r in odd.collect():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = neardup.near_duplicates(odd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(label.values()))
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (50, 51), (60, 60), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in CC.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, 50: 50, 51: 50}


def test_lines(odd, empty):
    seen, want = [], {}
    for r in sorted(odd.collect(), key=lambda r: r.doc_id):
        for k, line in enumerate((r.text or "").split("\n")):
            w = frozenset(words(line))
            if len(w) >= linedup.MIN_TOKENS:
                match = [x for x in seen if 100 * len(x & w) >= linedup.PERCENT * len(x | w)]
                if match:
                    want[r.doc_id, k] = w in match
                seen.append(w)
    assert {(r.doc_id, r.line_no): r.exact for r in linedup.repeated_lines(odd).collect()} == want
    out = linedup.dedup_lines(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} >= {0, 1, 2, 5}
    assert linedup.dedup_lines(empty).count() == 0


def test_long_runs_equal_short_runs(monkeypatch):
    rng = np.random.default_rng(2)
    m = 40
    sets = [np.unique(np.concatenate([np.arange(20), rng.integers(20, 60, 2)])).astype(np.uint64) for _ in range(m)]
    bits = np.array([np.bitwise_or.reduce(np.uint64(1) << (s & np.uint64(63))) for s in sets]).view(np.int64)
    cols = (np.zeros(m, np.int64), np.arange(m), np.zeros(m, np.int64), np.array([len(s) for s in sets]), np.zeros(m, np.int64), bits, np.zeros(m, np.int64))

    def told(*kinds):
        return sorted((r["a_doc"], r["a_line"], r["b_doc"], r["b_line"]) for batch in linedup._pairs(*cols) for r in batch.to_pylist() if r["kind"] in kinds)

    short, all_ = told(1), told(1, 3)
    assert short and len(all_) > len(short) and len({x[2:] for x in short}) == len(short)
    monkeypatch.setattr(linedup, "RUN", 3)
    monkeypatch.setattr(linedup, "KEPT", m)
    assert [x[2:] for x in told(1)] and {x[2:] for x in told(1)} == {x[2:] for x in short}
    assert told(1, 3) == all_ and not told(2, 4)
    monkeypatch.setattr(linedup, "KEPT", 2)
    many, partners = {x[2:] for x in told(2)}, {x[2:] for x in told(4)}
    assert many and {x for x in all_ if x[2:] not in many} <= set(told(1, 3))
    assert {x[:2] for x in all_ if x[2:] in many} <= partners


def test_lines_of_long_runs(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(24)]
    lines = [" ".join(base[: rng.randint(14, 24)] + rng.sample(["x%d" % i for i in range(90)], rng.randint(1, 6))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(5)
    sets = [frozenset(x.split()) for x in lines]
    want = {j for j, b in enumerate(sets) if any(100 * len(a & b) >= linedup.PERCENT * len(a | b) for a in sets[:j])}
    assert len(lines) > linedup.RUN and len(want) > linedup.KEPT
    assert {r.doc_id for r in linedup.repeated_lines(df).collect()} == want


def test_cover_tree(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(900, 8)) / 3).astype(np.float32)
    x[300:600] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2100, [float("nan")] * 8), (2200, [None] * 8), (2300, []), (2400, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in covertree.search(covertree.whole_vectors(df), F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    assert set(got) == set(range(0, 900, 100))
    for q, own in got.items():
        best = sorted((-int(whole[q] @ whole[j]), j) for j in range(900) if j != q)[:10]
        assert sorted(own) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_mixing(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and len({(r.slot, r.place) for r in got}) == len(got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert mixing.in_mixed_order(odd).columns == odd.columns and mixing.mix(empty).count() == 0


def test_mixing_deviation(spark):
    units = spark.createDataFrame([("s:a", 7), ("s:b", 2), ("s:c", 1), ("s:d", 13)], "__k string, units long")
    plan = sorted(mixing.schedule(units).collect(), key=lambda r: r["__slot"])
    assert [r["__slot"] for r in plan] == list(range(23))
    done = dict.fromkeys("abcd", 0)
    for t, r in enumerate(plan):
        done[r["__k"][2:]] += 1
        for k, u in zip("abcd", (7, 2, 1, 13)):
            assert abs(done[k] - u * (t + 1) / 23) < 1


def test_quality(odd, empty):
    got = {r.doc_id: r for r in rules.quality_report(odd).collect()}
    for r in odd.collect():
        w, g = words(r.text), got[r.doc_id]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {i + k for i, x in enumerate(grams) if grams.count(x) > 1 for k in range(8)} if len(w) < 3000 else set()
        assert (g.n_words, g.word_chars, g.n_repeat_words) == (len(w), sum(map(len, w)), len(twice))
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g.kept}
    assert rules.quality_report(empty).count() == 0
    out = rules.cascade(odd, rules.BASE_RULES).collect()
    assert all((r.rejected_by is None) == (r.rules_run == 2 and not got[r.doc_id].base_failed) for r in out)


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there friend.\nHow are the things today?"), (1, 1, "a", "On Monday, x wrote:\n> Hello there friend.\n\nFine."),
            (1, 2, "u", "Another topic."), (1, 3, "a", "> Fine.\n>> hello THERE, friend\nGood."), (1, 4, "u", "> never said"), (2, 0, "u", None), (None, 0, "u", "x"), (2, 1, "u", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert [(got[1, t].parent_turn, got[1, t].root_turn, got[1, t].position) for t in range(5)] == [(None, 0, 0), (0, 0, 1), (None, 2, 3), (1, 0, 2), (None, 4, 4)]
    assert got[1, 1].body == "\nFine." and got[1, 3].body == "Good." and got[1, 3].max_level == 2 and len(got) == 8
    assert quotes.conversations(df.filter("false")).count() == 0


def test_secrets(spark, empty):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        key = "".join(rng.choices("0123456789abcdef", k=24))
        rows.append((2 * i, f"the plain words stand here password={key} and then more", "s"))
        rows.append((2 * i + 1, f"the plain words stand user{i}.name@mail{i}.example.com and then more", "s"))
    rows += [(9000, None, "s"), (9001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secretscan.find_secrets(df, labels=F.when(F.col("doc_id") < 400, 1 - F.col("doc_id") % 2)).filter("doc_id >= 400").collect()
    right = sum(r.is_secret == (r.doc_id % 2 == 0) for r in got)
    assert len(got) == 200 and right >= 195
    assert secretscan.find_secrets(empty).count() == 0
