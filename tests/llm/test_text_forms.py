"""Fill-in-the-middle, fingerprints and spelling variants against brute force on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from preftable.llm import fingerprint, infill, mixing, packing, quotes, secretscan, simple8b, spelling, tokens

SCHEMA = "doc_id long, text string, n long, form string, output string, at long, word string, rest string, key string, head string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeéü", k=rng.randint(3, 9))) for _ in range(120)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    texts = [None, "", " \n\t", "One", "one two", "x", "漢字😀 é", "<P> inside", "a<S>b", "ab <M", "abc" * 9000, line(3), line(5), line(9000)]
    texts += [line(rng.randint(1, 300)).replace(" ", rng.choice([" ", "\n", "  ", ", "])) for _ in range(60)]
    ids = [7 * i % 1009 for i in range(len(texts))]
    pairs = list(zip(ids, texts))
    pairs += [(pairs[20][0], line(40)), (None, line(30)), (None, line(31)), (None, None), (5000, pairs[30][1])]  # shared and null ids, an exact copy
    pairs += [pairs[25]] * 3 + [(None, "twice the same row")] * 2
    return pairs


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "o", 2, "w", "r", "k", "h") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fim(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(q in text for q in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [1, 100, infill.SLICE])
def test_infill(rows, docs, empty, monkeypatch, size):
    for lo, hi in infill._slices(np.array([0, 0, 5, 5, 900, 901, 901])):
        assert lo < hi
    monkeypatch.setattr(infill, "SLICE", size)
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((fim(i, t) for i, t in rows), key=key)
    assert sorted(r.again for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(empty).count() == 0


def test_infill_sentinels(spark, docs):
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, sentinels=("<P>", "<P>>", "<M>"))
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, sentinels=("aba", "<S>", "<M>"))
    one = spark.createDataFrame([("k", "x <P> y é z")], "id string, body string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = infill.fill_in_middle(one, "id", "body", "s", 0, 100, marks).withColumn("again", infill.restored(F.col("output"), F.col("form"), marks)).first()
    assert out.form == "spm" and out.again == "x <P> y é z" and out.id == "k"


def test_exception_index():
    text = "aé漢b😀" * 50 + "z" * 200 + "ü"
    index = infill.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    assert len(index.at_byte) == 151
    chars = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in chars])
    assert (index.to_byte(chars) == places).all() and (index.to_char(places) == chars).all()


def sketch(text):
    """The 4-bit values of the 256 bins by the definition (None: no words)."""
    words = (text or "").lower().strip(fingerprint.BLANKS)
    if not words:
        return None
    words = re.split(r"[\x20\x09-\x0D]+", words)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    order = [*range(128, 256), *range(128)]  # bins as signed 64-bit hashes sort
    least = {}
    for i in range(max(len(words) - 4, 1)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        b = h >> 56
        least[b] = min(least.get(b, h), h)
    present = [least.get(b) for b in order]

    def hashed(bin_, x, width):  # Spark's hash of a long and an int or long
        return xxhash.xxh64_intdigest(x.to_bytes(width, "little"), xxhash.xxh64_intdigest(bin_.to_bytes(width_of_bin, "little"), 42))

    width_of_bin = 4
    out = []
    for place, h in enumerate(present):
        if h is None:
            for t in range(fingerprint.ATTEMPTS):
                h = present[hashed(place, t, 4) & 255]
                if h is not None:
                    break
        if h is None:
            filled = [k for k, x in enumerate(present) if x is not None]
            h = present[min(filled, key=lambda k: signed(hashed(place, k, 8) & ~255 | k))]
        out.append(h & 15)
    return out


def shown(text):
    own = sketch(text)
    return fingerprint.NO_WORDS if own is None else "".join("%x" % v for v in own)


def like(a, b):
    if a is None or b is None:
        return float(a is b)
    same = sum(x == y for x, y in zip(a, b)) / 256
    return min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))


def test_fingerprints(rows, docs, empty):
    got = fingerprint.edited_report(docs).collect()
    assert len(got) == len(rows)
    distinct = {(i, t or "") for i, t in rows}
    at = lambda r: ((r[0] is None, -(r[0] or 0)), hashlib.md5(f"{'null' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest())
    order = sorted(distinct, key=at)
    want = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        near = [like(sketch(t), sketch(x)) for x in (edited, u)]
        want[i, shown(t), len(t), hashlib.sha256(edited.encode()).hexdigest()] = (shown(edited), *near, j)
    for r in got:
        e, near_e, near_n, j = want[r.doc_id, r.fingerprint, r.n_chars, r.edited_sha256]
        assert (r.edited_fingerprint, r.next_id) == (e, j)
        assert abs(r.near_edited - near_e) < 1e-9 and abs(r.near_next - near_n) < 1e-9
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert fingerprint.edited_report(empty).count() == 0
    only = fingerprint.edited_report(docs.filter("doc_id = 5000")).collect()
    assert len(only) == 1 and only[0].near_next == 1.0 and only[0].next_id == 5000
    texts = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs.filter("doc_id >= 5000")).collect()}
    assert texts == {5000: shown(rows[30][1])}
    back = docs.select(fingerprint.sketch(F.coalesce("text", F.lit(""))).alias("s")).select("s", fingerprint.packed_again(fingerprint.rendered(F.col("s"))).alias("t"))
    assert back.filter(~F.col("s").eqNullSafe(F.col("t"))).count() == 0


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(2)
    pairs = []
    for k in range(300):
        a = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([30, 120, 600]))]
        b = a[:]
        for _ in range(rng.randint(0, 12)):
            b[rng.randrange(len(b))] = "changed"
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    got = df.select("a", "b", fingerprint.likeness(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))).alias("x")).collect()
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    off = np.array([r.x - len(sets(r.a) & sets(r.b)) / len(sets(r.a) | sets(r.b)) for r in got])
    assert abs(off.mean()) < 0.01 and np.sqrt((off**2).mean()) < 0.06


def test_spelling(rows, docs, empty):
    modulus, least = 5, 2
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % modulus == 0 else w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    near = defaultdict(set)
    cuts = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    for a in vocab:
        for b in vocab:
            if a != b and (a in cuts(b) or b in cuts(a) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)):
                near[a].add(b)
    form = {}
    for w, own in near.items():
        top = min(own, key=lambda x: (-vocab[x], x))
        if vocab[top] >= 2 * vocab[w]:
            form[w] = top

    def root(w):
        return root(form[w]) if w in form else w

    want = {(w, form.get(w), root(w), n, len(near[w]), vocab.get(form.get(w))) for w, n in vocab.items()}
    assert sum(x[4] > 0 for x in want) > 20 and any(x[1] for x in want)
    table = spelling.vocabulary(spelling.words(docs, modulus=modulus), least)
    assert {tuple(r) for r in spelling.variants(table).collect()} == want
    # Every shared chunk is split down to the shortest rests.
    assert {tuple(r) for r in spelling.variants(table, group_pairs=0).collect()} == want
    assert spelling.variants(spelling.vocabulary(spelling.words(empty, modulus=97))).count() == 0


def test_one_hot_chunk(spark):
    rng = random.Random(4)
    words = {"template" + "".join(rng.choices("abcdef", k=4)) + "ending" for _ in range(400)}
    words |= {w[:3] + "é" + w[3:] for w in sorted(words)[:50]}
    table = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long").repartition(4)
    got = {tuple(sorted(r)) for r in spelling.near_pairs(table, group_pairs=50).collect()}
    cuts = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    want = set()
    for a in words:
        want |= {tuple(sorted((a, c))) for c in cuts(a) & words}
        want |= {tuple(sorted((a, b))) for b in words if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1}
    assert got == want and len(got) > 100


def test_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w30"), ("y", "z")]
    got = dict(spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {f"w{i}": "w37" for i in range(37)} | {"x": "w37", "y": "z"}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: np.asarray(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("generation,piece", [(2000, 300), (32 << 20, 1 << 20)])
def test_encoder_equals_the_library(library, monkeypatch, generation, piece):
    monkeypatch.setattr(tokens, "GENERATION_BYTES", generation)
    monkeypatch.setattr(tokens, "SLICE_BYTES", piece)
    rng = random.Random(piece)
    parts = ["a", "é", "1", " ", " ", "\n", "\n\n", "\t", "'s", "!", "漢", "\xa0", "\x1c", "\x85", "ab ", ".\n", "😀", "\r\n", " x", "<|", "\u3000", "\u2003"]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000))]
    texts += [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 70))) for _ in range(rng.randint(1, 40))) for _ in range(100)]
    end = "<|endoftext|>"
    texts += [end, f"a {end} b", f"{end}a\nb", f"a b{end}", f"a {end[:-1]} b", f"é{end}{end} x"]
    enc = tokens.ChunkEncoder(tokens.default_vocabulary())
    for _ in range(2):  # from the library, then from the store
        assert list(enc.column(pa.array(texts))) == [library(t) for t in texts]
    assert enc.ids("a <|endoftext|> b") == np.array([64, 220, 50256, 275], "<u4").tobytes()
    assert list(enc.column(pa.array([], pa.string()))) == []
    assert list(enc.column(pa.array(texts).slice(5, 40))) == [library(t) for t in texts[5:45]]


def test_files_and_pieces_of_odd_rows(spark, rows, docs, library):
    end = np.array([2], "<u4").tobytes()
    special = [(6000, "a <|endoftext|> b"), (6001, "<|endoftext|>"), (6002, "b<|endoftext|>")]
    more = docs.unionByName(spark.createDataFrame(special, "doc_id long, text string"), allowMissingColumns=True)
    ids = [(i, library(t) + end) for i, t in rows + special]
    got = simple8b.write_and_read(more, tokens.default_vocabulary()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x) // 4, zlib.crc32(x)) for i, x in ids)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # starts leave no gap, whatever ids repeat or are null
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    pieces = Counter()
    for i, x in ids:
        n, a, k = len(x) // 4, 0, 0
        while a < n:
            size = (n - a) % 1024 or 1024 if a == 0 else 1024
            pieces[i, k, a, size, zlib.crc32(x[4 * a : 4 * (a + size)])] += 1
            a, k = a + size, k + 1
    packed = packing.pack_documents(more, tokens.default_vocabulary()).collect()
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == pieces
    full = {}
    for p in packed:
        full.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in full.values():
        end_ = 0
        for o, n in sorted(own):
            assert o == end_
            end_ += n
        assert end_ <= 1024


def test_quotes_of_repeated_rows(spark):
    said = "The first line of what was said.\r\nAnd a second line of it."
    reply = "On Monday they wrote:\n> The first line of what was said.\n> And a second line of it.\n\nI agree with that."
    rows = [("c", 1, said), ("c", 2, "Something else entirely."), ("c", 3, reply), ("c", 4, "> I agree with that.\nMe too."), ("c", 5, None), (None, 1, "> x"), ("d", 1, reply)]
    schema = "conv_id string, turn int, text string"
    digest = lambda out: {(r.conv_id, r.turn): tuple(r[c] for c in quotes.RESULTS if c != "position") for r in out.collect()}
    plain = digest(quotes.conversations(spark.createDataFrame(rows, schema)))
    assert plain["c", 3] == (2, 1, 3, 1, 1, "\nI agree with that.")  # two lines and their passage
    assert plain["c", 4][2:5] == (1, 3, 1) and plain["c", 1] == (0, 0, 0, None, 1, said) and plain["d", 1][2] == 0
    for again in ([rows[0]], [rows[2]], rows, rows * 3):
        out = quotes.conversations(spark.createDataFrame(rows + again, schema).repartition(3))
        assert digest(out) == plain and out.count() == len(rows + again)
    # The earliest of equal originals is linked, and any column name passes through.
    tied = spark.createDataFrame([("c", 0, said, "k", 1), *((*r, "k", 1) for r in rows[:4])], schema + ", __pt_gidx string, level int")
    got = digest(quotes.conversations(tied))
    assert got["c", 3][3] == 0 and quotes.conversations(tied).columns[:5] == tied.columns
    long = spark.createDataFrame([("c", 1, "\n".join(f"line number {i} of many" for i in range(5000))), ("c", 2, "> line number 4999 of many\nyes")], schema)
    assert digest(quotes.conversations(long))["c", 2][2:4] == (1, 1)


def test_mixing_with_any_column_names(spark):
    rows = [(i, f"s{i % 3}", 7, 8, 9, "x") for i in range(200)] + [(5, "s1", 7, 8, 9, "x")] * 3 + [(None, None, 7, 8, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, units int, period int, __r int, `a.b` string")
    plain = mixing.mix(docs.select("doc_id", "source"))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, *mixing.RESULTS]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out.select("doc_id", "source", *mixing.RESULTS).collect())) == sorted(map(key, plain.collect()))
    assert out.filter("units = 7 and period = 8 and __r = 9").count() == len(rows)
    assert out.select("slot", "place").distinct().count() == len(rows)  # repeated rows have places of their own


def test_candidates_of_secrets(spark):
    texts = {
        1: "password=hunter22 and SECRET_KEY=correcthorsebatterystaple here",
        2: 'set api_key="0123456789abcdef0123"### now, or token: "short" maybe',
        3: "see https://example.com/path/12345678 for the key idea of tokens",
        4: "plain words only",
        5: None,
        6: "x" * 50_000 + "1 pwd: a",
    }
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()] + [(1, texts[1], "s")], "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.name, r.value) for r in secretscan.candidates(docs).collect())
    assert got == Counter({
        (1, "password", "hunter22"): 2, (1, "SECRET_KEY", "correcthorsebatterystaple"): 2,
        (2, "api_key", "0123456789abcdef0123"): 1, (2, None, "short"): 1, (3, None, "https://example.com/path/12345678"): 1,
        (6, None, "x" * 50_000 + "1"): 1, (6, None, "a"): 1,
    })
