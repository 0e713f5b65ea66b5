"""``corpus_pipeline.run`` against the definition of each stage in plain Python, odd tables through all stages, and the packing's numbering."""

import bisect
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from preftable.llm import linedup, mixing, neardup, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, units int, __id long, __gone string, __w int"
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.default_vocabulary()), reason="tokenizer files not present")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def good(text):
    """The quality rules, by their definitions."""
    text = text or ""
    w = words(text)
    n, chars = len(w), sum(map(len, w))
    if n < 20:
        return False
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + k for own in at.values() if len(own) > 1 for i in own for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    copies = len(lines) - len(set(lines))
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    bad = (
        100 * len(again) > 30 * n,
        100 * len(re.findall(r"[#*$%&|<>]", text)) > 10 * n,
        100 * upper > 40 * (upper + lower),
        100 * len(re.findall(r"[!-@\[-`{-~]", text)) > 40 * chars,
        copies >= 3 and 100 * copies > 30 * len(lines),
        100 * sum(a == b for a, b in zip(w, w[1:])) > 20 * n,
        chars < 2 * n or chars > 20 * n,
    )
    return not any(bad)


def without_repeated_lines(docs):
    """``{row: text}`` without lines that an earlier one reaches; rows that share an id are one document."""
    seen, by_word, gone = [], {}, {}
    order = sorted((r[0], k, line) for r in docs if r[0] is not None for k, line in enumerate((r[1] or "").split("\n")))
    for i, k, line in order:
        w = frozenset(words(line))
        if not w:
            continue
        near = {j for x in w for j in by_word.get(x, ())}
        if any(100 * len(seen[j][0] & w) >= linedup.PERCENT * len(seen[j][0] | w) and seen[j][1:] != (i, k) for j in near):
            gone.setdefault(i, set()).add(k)
        for x in w:
            by_word.setdefault(x, []).append(len(seen))
        seen.append((w, i, k))
    out = []
    for r in docs:
        cut = gone.get(r[0], ())
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in cut) if cut else r[1]
        if not cut or words(text):
            out.append((r[0], text, *r[2:]))
    return out


def one_of_each_group(docs):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, by = [], {}
    for n, r in enumerate(docs):
        w = words((r[1] or "").translate(fold))
        own = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        sets.append(own)
        if r[0] is not None:
            for x in own:
                by.setdefault(x, []).append(n)
    root = list(range(len(docs)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    ids = {}
    for n, r in enumerate(docs):
        met = {m for x in sets[n] for m in by.get(x, ())} if r[0] is not None else set()
        linked = [m for m in met if 100 * len(sets[n] & sets[m]) >= neardup.PERCENT * len(sets[n] | sets[m])]
        if r[0] is not None:
            linked.append(ids.setdefault(r[0], n))
        for m in linked:
            a, b = find(n), find(m)
            if a != b:
                root[max(a, b, key=lambda k: docs[k][0])] = min(a, b, key=lambda k: docs[k][0])
    out = {}
    for n, r in enumerate(docs):
        if r[0] is None:
            out[None, n] = r
        elif docs[find(n)][0] == r[0]:
            out[r[0]] = r
    return list(out.values())


def windows(docs):
    """``{doc_id: window}``: blocks of 8 in md5 order of the id; a window has each source's units of blocks."""
    by = {}
    for r in docs:
        by.setdefault("null" if r[3] is None else f"s:{r[3]}", []).append(r[0])
    p = {k: len(v) ** 0.5 for k, v in by.items()}
    whole = max(mixing.PERIOD, math.ceil(mixing.LEAST_UNITS * sum(p.values()) / min(p.values())))
    out = {}
    for k, ids in by.items():
        units = math.floor(whole * p[k] / sum(p.values()))
        ids.sort(key=lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest())
        out |= {i: rank // mixing.BLOCK_ROWS // units for rank, i in enumerate(ids)}
    return out


def sequences_needed(lengths):
    """How many sequences of 1,024 best-fit decreasing takes."""
    room, made = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        if at == len(room):
            made += 1
            left = 1024 - n
        else:
            left = room.pop(at) - n
        if left:
            bisect.insort(room, left)
    return made


def table(n_plain):
    """Plain documents, and all cases that a stage decides on."""
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéç", k=rng.randint(3, 9))) for _ in range(30_000)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    para = lambda k, n=14: "\n".join(line(n) for _ in range(k))
    rows = [(1000 + i, para(1, rng.randint(22, 40)), "big") for i in range(n_plain)]

    base = para(4)
    swap = lambda t, k: " ".join(rng.choice(vocab) if i in k else x for i, x in enumerate(t.split(" ")))
    flat = base.replace("\n", " ")
    special = [None, "", " \n\t ", line(19), "WORDS " * 5 + line(6).upper() * 4, line(30) + " ###" * 9, "1234 5678 " * 3 + line(21) + " 99887766554433221100" * 9]
    special += ["the same short line\n" * 9 + line(40), line(20) + " go" * 30, line(30).replace(" ", "x"), (line(9) + "\n") * 6]
    # Copies in other lines keep their text through line dedup; in the same lines they lose it.
    special += [base, base, base + "\n" + line(14), flat, flat.replace(" ", "  "), flat.title(), swap(flat, {3}), swap(swap(flat, {3}), {50})]
    chain = [line(80)]
    for _ in range(3):
        chain.append(" ".join(chain[-1].split()[6:] + line(6).split()))
    special += [c.replace(" ", "\n" if i % 2 else " ", 39) for i, c in enumerate(chain)]
    # Lines of few words, and lines one word apart.
    tail = "All rights reserved.\nRead it again\na b c d"
    special += [para(2) + "\n" + tail, para(2) + "\n" + tail + " e", "Read it again\r\n" + para(2)]
    special += [para(3000, 8)]  # pieces of 1,024
    rows += [(i, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(special)]
    rows += [(900, para(3), "s1")] * 3 + [(901, para(3), "s1"), (901, para(2), "s1"), (None, para(2), "s2")]
    return [(i, t, "en", s, len(t or ""), 1, 2, "g", 3) for i, t, s in rows]


def test_run_is_what_the_stages_say(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_UNITS", 5)  # a period short enough for two windows of so few rows
    rows = table(9300)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    left = [r for r in rows if good(r[1])]
    kept = without_repeated_lines(left)
    stay = one_of_each_group(kept)
    assert len(rows) > len(left) + 8 and len(left) > len(kept) and len(kept) > len(stay) + 6

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    want = {}
    for r in stay:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], piece] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    shared = {901}  # of rows that share an id any one may stay
    assert {(r.doc_id, r.piece) for r in got} - {(901, 0)} == want.keys() - {(901, 0)}
    assert all((r.start, r.length, r.ids_crc32) == want[r.doc_id, r.piece] for r in got if r.doc_id not in shared)

    window = windows(stay)
    assert set(window.values()) == {0, 1}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, window[r.doc_id]))
    assert sorted(by) == list(range(len(by)))
    lengths, order = {}, []
    for s in sorted(by):
        end = 0
        for offset, n, w in sorted(by[s]):
            assert offset == end
            end += n
            lengths.setdefault(w, []).append(n)
        assert end <= 1024 and len({w for *_, w in by[s]}) == 1
        order.append(by[s][0][2])
    assert order == sorted(order)
    assert len(by) == sum(sequences_needed(x) for x in lengths.values())


def test_odd_tables_through_all_stages(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    odd = {
        "rejected": [(None, None, None, None, None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0, 1, 2, "g", 3)],
        "repeated": [(1, text, "en", "s", 0, 1, 2, "g", 3)] * 5 + [(None, text, None, None, None, 1, 2, "g", 3)],
    }
    found = {}
    for name, rows in odd.items():
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found[name] = sorted((r.doc_id is None, r.piece, r.offset > 0) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
    assert found["rejected"] == []
    assert found["repeated"] == [(False, 0, found["repeated"][0][2]), (True, 0, found["repeated"][1][2])]


def test_splits_follow_from_the_rows(spark):
    from preftable.llm import packing

    rows = [(i, (i * 37) % 200 + 1) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").selectExpr("*", "0 AS piece", "0L AS start", "0L AS ids_crc32")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    places = []
    try:
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            places.append({tuple(r) for r in packing.pack(pieces).select("doc_id", "sequence_id", "offset").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert places[0] == places[1] and len(places[0]) == 3000


def test_many_placements_are_joined_by_span(spark, monkeypatch):
    from preftable.llm import packing

    rows = [(i, 100 if i % 3 else (i * 37) % 200 + 1) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").selectExpr("*", "0 AS piece", "0L AS start", "0L AS ids_crc32")
    few = {tuple(r) for r in packing.pack(pieces).select("doc_id", "sequence_id", "offset").collect()}
    monkeypatch.setattr(packing, "BROADCAST_PLACEMENTS", 0)
    monkeypatch.setattr(packing, "SPLIT_PIECES", 700)
    assert len(few) == 3000
    many = packing.pack(pieces).select("doc_id", "length", "sequence_id", "offset").collect()
    by = {}
    for r in many:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(many) == 3000 and len(by) == len({s for _, s, _ in few})
    for own in by.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 1024
