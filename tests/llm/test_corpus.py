from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftlink.llm import _text, bpe, components, line_dedup, mixing, neardup, prefix_forest, quality, queries, substrings, token_counts, tokenizer_spec, topk, toxicity, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source if isinstance(source, str) else source[i], len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n\n", "one", "a b", "é ü \x0b x\x1fy", "q " * 50, "word " * 3000]


def made(seed, n=40, low=5, high=60):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(low, high))) for _ in range(n)]


# text


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_words_and_hashes(limit):
    texts = [*ODD, "a b a", "tail"]
    body, offsets = _text.utf8(pa.array(texts))
    got = []
    for a, b in _text.chunks(offsets, limit):
        part = body[offsets[a] : offsets[b]]
        s, e, at = _text.word_spans(part, offsets[a : b + 1] - offsets[a])
        h = _text.hash_spans(part, s, e)
        for i in range(b - a):
            got.append([(part[x:y].tobytes().decode(), v) for x, y, v in zip(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]], h[at[i] : at[i + 1]], strict=True)])
    assert [[w for w, _ in x] for x in got] == [words(t) for t in texts]
    of = {w: v for x in got for w, v in x}
    assert all(of[w] == v for x in got for w, v in x)
    assert len(set(of.values())) == len(of)


def test_words_of_like_structure_have_unlike_hashes():
    """Thue-Morse words and their complements, which collide in every polynomial modulo 2**64."""
    found = []
    for first in "ab", "ba":
        t = "".join(first[bin(i).count("1") % 2] for i in range(4096))
        body, offsets = _text.utf8(pa.array([t + " " + t[:1024]]))
        s, e, _ = _text.word_spans(body, offsets)
        found += _text.hash_spans(body, s, e).tolist()
    assert len(set(found)) == 4


def test_window_hashes():
    h = np.array([5, 6, 5, 6, 5], np.uint64)
    w = _text.window_hashes(h, 2)
    assert w[0] == w[2]
    assert w[0] != w[1]
    assert len(_text.window_hashes(h, 9)) == 0


# substrings


def removed(texts, width, ids=None):
    seen, out = {}, {}
    for i, t in sorted(zip(ids or range(len(texts)), texts, strict=True)):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            if key in seen:
                gone[j : j + width] = [True] * width
            seen.setdefault(key, (i, j))
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substrings(spark, monkeypatch, small):
    base = made(1, 12, 30, 90)
    texts = [*ODD, *base, base[0], base[1] + " x " + base[2], "  " + base[3].replace(" ", "\n"), "k " * 70]
    if small:  # many blocks, buckets and rounds
        for name, value in (("BLOCK", 40), ("BUCKET", 3), ("FANOUT", 4)):
            monkeypatch.setattr(substrings, name, value)
        found = list(substrings._blocks(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])]), 7, 4))
        finer = list(substrings._finer(iter(found), 16))
        assert {x for b in finer for x in b.column(0).to_pylist()} <= set(range(16))
        by = collections.defaultdict(list)
        for b in finer:
            by[b.column(0)[0].as_py()].append(b)
        spots = pa.concat_tables([substrings._count(pa.Table.from_batches(x), 1) for x in by.values()])
        cut = {r["key"]: (r["begins"], r["ends"]) for r in substrings._merge(spots, 7).to_pylist()}
        want = removed(texts, 7)
        assert {i: sum(b - a for a, b in zip(*v, strict=True)) for i, v in cut.items()} == {i: v[1] for i, v in want.items() if v[1]}
        return
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(frame(spark, texts).withColumn("key", F.lit(1)), 7).collect()}
    assert got == removed(texts, 7)
    assert substrings.remove_repeats(frame(spark, []), 7).count() == 0


def test_substrings_null_and_repeated_ids(spark):
    t = " ".join(f"a{i}" for i in range(30))
    rows = spark.createDataFrame([(None, t), (3, t), (3, t), (5, "b " + t)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_removed) for r in substrings.remove_repeats(rows).collect())
    assert got == [(-1, 0), (3, 30), (3, 30), (5, 30)]


# near duplicates


def classes(texts):
    sets = [collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := words(t)) else collections.Counter() for t in texts]
    df = collections.Counter(k for s in sets for k in s)
    n = len(texts)
    weight = [{k: c * math.log(1 + n / df[k]) for k, c in s.items()} for s in sets]
    sums = [sum(w.values()) for w in weight]
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = collections.defaultdict(list)
    for a in range(n):
        for b in {b for k in weight[a] for b in having[k]}:
            low = sum(min(v, weight[b].get(k, 0)) for k, v in weight[a].items())
            if low / (sums[a] + sums[b] - low) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        for k in weight[a]:
            having[k].append(a)
    return [root(i) for i in range(n)]


def edited(text, rng, n=1):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def found_classes(docs):
    return [r.class_id for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("cap", [2048, 6])
def test_near_duplicates(spark, monkeypatch, cap):
    monkeypatch.setattr(neardup, "CAP", cap)
    if cap == 6:  # many blocks, buckets and rounds
        for name, value in (("BLOCK", 500), ("BUCKET", 60), ("FANOUT", 8)):
            monkeypatch.setattr(neardup, name, value)
    rng = random.Random(4)
    base = made(2, 15, 120, 200)
    texts = [*ODD, *base, *[edited(b, rng) for b in base[:8]], *[edited(base[0], rng) for _ in range(12)], base[1], base[1], *[edited(b, rng, 60) for b in base[9:12]]]
    docs = frame(spark, texts)
    assert found_classes(docs.withColumns({"key": F.lit(1), "sig": F.lit(2), "tag": F.lit(3), "block": F.lit(4)})) == classes(texts)
    clash = docs.withColumns({"kept_class_id": F.lit(1), "class_id": F.lit(2), "key": F.lit("k"), "row": F.lit(0), "words": F.lit(0)})
    kept = neardup.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(texts)))


def test_document_counts(spark, monkeypatch):
    for name, value in (("BLOCK", 300), ("BUCKET", 40), ("FANOUT", 4)):
        monkeypatch.setattr(neardup, name, value)
    texts = [*ODD, *made(3, 30, 20, 60)] * 2 + made(5, 10)
    blocks = frame(spark, texts).selectExpr("doc_id AS key", "doc_id AS tag", "text").repartition(3).mapInArrow(neardup._blocks, "block long, payload binary, docs long, shingles long").cache()
    want = collections.Counter()
    for t in texts:
        w = words(t)
        want.update({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else ())
    rows, replies = blocks.collect(), collections.defaultdict(list)
    for r in neardup.document_counts(blocks, sum(r.shingles for r in rows)).collect():
        replies[r.block].append(bytes(r.payload))
    got = {}
    for r in rows:
        gaps, count = neardup.unpack(bytes(r.payload))[-2:]
        ids = np.cumsum(gaps, dtype=np.uint64)
        got |= dict(zip(ids.tolist(), neardup._weights(ids, count, replies[r.block], 9)[0].tolist(), strict=True))
    blocks.unpersist()
    assert sorted(got.values()) == sorted(want.values())
    assert sum(r.docs for r in rows) == len(texts)


@pytest.mark.parametrize("cap", [2048, 6])
def test_near_duplicates_about_the_threshold(spark, monkeypatch, cap):
    """Many pairs of a group lie just below or above 0.8; what links a class may be any of them."""
    monkeypatch.setattr(neardup, "CAP", cap)
    rng = random.Random(8)
    texts = [edited(b, rng, rng.choice([2, 3])) for b in made(9, 5, 380, 381) for _ in range(20)]
    assert found_classes(frame(spark, texts)) == classes(texts)


@pytest.mark.parametrize("cap", [2048, 24])
def test_near_duplicates_of_many_families(spark, monkeypatch, cap):
    """1,200 documents in 40 families whose members lie about 0.8: at least 0.99 of them in the class that brute force gives."""
    monkeypatch.setattr(neardup, "CAP", cap)
    rng = random.Random(13)
    texts = []
    for b in made(14, 40, 200, 201):
        for _ in range(30):
            texts.append(edited(b, rng, rng.choice([1, 1, 2, 2, 3])))
    want, got = classes(texts), found_classes(frame(spark, texts))
    assert 50 < len(set(want)) < 1100
    assert np.mean([a == b for a, b in zip(want, got, strict=True)]) >= 0.99


def test_near_duplicates_of_one_hot_text(spark, monkeypatch):
    """A third of all rows are copies, and as many near copies, of one text; long texts are cut by their bytes."""
    monkeypatch.setattr(neardup, "CAP", 64)
    monkeypatch.setattr(neardup, "HEAP", 1 << 14)
    rng = random.Random(15)
    base = made(16, 1, 300, 301)[0]
    texts = [base] * 300 + [edited(base, rng) for _ in range(300)] + made(17, 290) + [x * 40 for x in made(18, 3, 200, 201) for _ in range(3)]
    got = found_classes(frame(spark, texts).repartition(6))
    assert got == classes(texts)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert neardup.keep_one(frame(spark, [])).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c = made(19, 3, 40, 41)
    rows = spark.createDataFrame([(None, a), (2, a), (2, a), (2, b), (None, c), (None, c), (7, b), (None, ""), (3, None), (3, None)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id) for r in neardup.near_duplicates(rows).collect())
    assert got == {(None, 2): 1, (2, 2): 3, (None, None): 3, (7, 2): 1, (3, 3): 2}
    kept = collections.Counter((r.doc_id, r.text) for r in neardup.keep_one(rows).collect())
    assert kept == {(2, a): 1, (2, b): 1, (None, c): 1, (None, ""): 1, (3, None): 2}


def test_sampling_matches_weighted_jaccard():
    sampler = neardup._Sampler()
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**44, 400).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 400), rng.uniform(0.5, 4, 400)
    hits = []
    for _ in range(30):
        ids = rng.integers(0, 2**44, 400).astype(np.uint64)
        hits.append((sampler.sample(ids, a, np.array([0])) == sampler.sample(ids, b, np.array([0]))).mean())
    assert abs(np.mean(hits) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 30)] + [(rng.randrange(40, 60), rng.randrange(40, 60)) for _ in range(15)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# lines


@pytest.mark.parametrize("few", [line_dedup.FEW, 0])
def test_lines(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    texts = ["menu\nown one\n\n menu ", "menu\ntext", "menu", "menu\r\nx", "menu\nlast", None, "", "other", "menu", "menu"]
    sites = ["a"] * 7 + [None, None, "b"]
    docs = frame(spark, texts, sites).withColumns({"line": F.lit(1), "site": F.lit("q"), "gone": F.lit(0), "row": F.lit(0), "own_id": F.lit(2)})
    out = line_dedup.drop_boilerplate(docs, ratio=0.5, least=3)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "own one\n", 1: "text", 2: "", 3: "x", 4: "last", 5: None, 6: "", 7: "other", 8: "menu", 9: "menu"}
    assert line_dedup.drop_boilerplate(frame(spark, [])).count() == 0
    urls = spark.createDataFrame([("https://u@A.example:80/x?y",), ("nothing",)], "u string")
    assert [r.h for r in urls.select(line_dedup.host(F.col("u")).alias("h")).collect()] == ["a.example", ""]


@pytest.mark.parametrize("few", [line_dedup.FEW, 0])
def test_lines_of_odd_rows_agree_with_the_sql(spark, monkeypatch, few):
    """Null and repeated ids, null texts and sites, equal rows, a line that fills a hot site."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(24)
    texts = ["\n".join(rng.choice(["menu", "foot ", " ", "terms", f"own {rng.randrange(400)}"]) for _ in range(rng.randrange(1, 7))) for _ in range(240)] + [None, None, "", "menu"] * 2
    sites = [rng.choice(["hot", "hot", "b", None]) for _ in texts]
    ids = [rng.choice([None, i, i // 3]) for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, sites, strict=True)), "doc_id long, text string, source string")
    docs.createOrReplaceTempView("odd_docs")
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: spark.table("odd_docs"))
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in queries.op4_line_dedup(spark, "").collect()), key=key)
    want = sorted(sql_of("op4_line_dedup", documents=docs.toPandas().astype({"doc_id": "Int64"})), key=key)
    assert got == want
    assert any(r[2] is not None and r[2] < r[1] for r in got)


# token counts


def test_token_counts(spark):
    texts = [*ODD, *made(3, 30)]
    enc = tokenizer_spec.library_encoding(tokenizer_spec.default_spec())
    lengths = [len(enc.encode_ordinary(t or "")) for t in texts]
    totals = token_counts.context_totals(token_counts.length_histogram(token_counts.token_lengths(frame(spark, texts))))
    rows = totals.collect()
    assert sorted(r.length for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.docs == lengths.count(r.length)
        assert r.docs_from == sum(x >= r.length for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    asked = [0, 7, 100, 10**6]
    assert {r.context: r.truncated_tokens for r in token_counts.at_limits(totals, asked).collect()} == {c: sum(min(x, c) for x in lengths) for c in asked}
    assert {r.share: r.length for r in token_counts.quantile_lengths(totals, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[math.ceil(0.5 * len(lengths)) - 1], 1.0: max(lengths)}
    assert token_counts.context_totals(token_counts.length_histogram(token_counts.token_lengths(frame(spark, [])))).count() == 0


# encoding


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(tokenizer_spec.default_spec())


def test_encoding_is_the_librarys(codec, monkeypatch):
    enc = tokenizer_spec.library_encoding(tokenizer_spec.default_spec())
    rng = random.Random(6)
    letters = "etaoinshrdl" * 3 + "ÉÜñß-=!'#1234 \n\t\x1c 　日本😀́ſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)] + [c * n for c in ("a", "=", " ", "\n", "th", "é") for n in (2, 9, 130, 700)] + ["<|endoftext|>"]
    for _ in range(2):
        for t in texts:
            ids = codec.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
            assert codec.decode_bytes(ids) == t.encode()
            assert b"".join(codec.decode_portions(ids, 7)) == t.encode()
            assert "".join(codec.decode_stream(np.frombuffer(ids, "<u4").tolist())) == t
        monkeypatch.setattr(bpe, "STATES", 50)  # tables that are emptied again and again give the same
        monkeypatch.setattr(bpe, "PIECES", 5)
        codec.pieces.clear()
        codec.pieces.old = {}


def test_utf8_stream():
    rng = random.Random(7)
    for _ in range(500):
        data = bytes(rng.choice([*range(256), 0xC3, 0xA9, 0xF0, 0x9F, 0x98, 0x80, 0xE2, 0x82]) for _ in range(rng.randrange(12)))
        s, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            n = rng.randrange(1, 4)
            out += s.feed(data[at : at + n])
            at += n
        assert out + s.end() == data.decode("utf-8", "replace")


def test_decoding_of_any_ids(codec):
    """Ids in any order: the incremental machine gives what a decoder of the whole gives, in whatever portions."""
    rng = random.Random(23)
    broken = [i for i, t in codec.tokens.items() if "\ufffd" in t.decode("utf-8", "replace")]
    for portion in (1, 3, 50):
        for _ in range(150):
            ids = [rng.choice(broken) if rng.random() < 0.5 else rng.randrange(len(codec.tokens)) for _ in range(rng.randrange(30))]
            whole = b"".join(codec.tokens[i] for i in ids).decode("utf-8", "replace")
            assert b"".join(codec.decode_portions(np.array(ids, "<u4").tobytes(), portion)).decode() == whole
            assert "".join(codec.decode_stream(ids)) == whole
    with pytest.raises(KeyError):
        list(codec.decode_portions(np.array([10**6], "<u4").tobytes()))


def test_round_trip_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a é 日", 1), (None, None, 2), (4, "x y", 3), (4, "x y", 4)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256 == hashlib.sha256((r.doc_id and "x y" or "a é 日").encode()).hexdigest()) for r in bpe.round_trip(rows).collect())
    assert [x[::2] for x in got] == [(0, False), (0, True), (4, True), (4, True)]


def test_round_trip(spark):
    texts = [*ODD, *made(8, 5)]
    enc = tokenizer_spec.library_encoding(tokenizer_spec.default_spec())
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, bytes(got[i].ids)) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids)
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(frame(spark, [])).count() == 0


# mixing


def test_mix(spark):
    rng = random.Random(9)
    sources = ["b", None, "a", "", "c"]
    texts = [" ".join(["w"] * rng.choice([0, 1, 3, 10, 40])) for _ in range(1500)]
    texts[:3] = [None, "", " "]
    docs = frame(spark, texts, [sources[rng.randrange(5)] for _ in texts]).withColumn("target", F.lit(1))
    rows = mixing.mix(docs, [3, 1, 2]).collect()
    again = mixing.mix(docs.repartition(7), [3, 1, 2]).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
        assert r.size == len(words(texts[r.doc_id]))
        assert r.taken == r.copies * r.size
        assert 0 <= r.copies <= 2
    order = sorted((s for s in size if s is not None), key=str) + [None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    left, share, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}
        if not full:
            share |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        share |= {s: 2 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert {round(r.target, 6) for r in mine} == {round(share[s], 6)}
        assert {r.source_size for r in mine} == {size[s]}
        assert abs(sum(r.taken for r in mine) - share[s]) <= 20
    assert mixing.mixed_documents(docs, [3, 1, 2]).groupBy("doc_id").count().count() == sum(r.copies > 0 for r in rows)
    assert mixing.mix(frame(spark, []), [3, 1, 2]).count() == 0


def sql_of(name, **tables):
    import duckdb

    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, pa.Table.from_pandas(v))
    return con.sql(queries.ORACLE_SQL[name]).fetchall()


@pytest.mark.parametrize("few", [mixing.FEW, 0])
def test_mix_of_repeated_rows_and_null_ids(spark, monkeypatch, few):
    """Equal rows at the cut are taken one by one, and as many as the SQL takes."""
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(21)
    texts = ["w w w w w w w w"] * 400 + ["x " * rng.choice([1, 7, 90]) for _ in range(300)] + [None, "", "y"] * 30
    sources = ["a"] * 400 + [rng.choice(["b", None, "c"]) for _ in range(300)] + ["b"] * 90
    ids = [5] * 400 + [rng.choice([None, i, i // 4]) for i in range(300)] + [None, 1, 2] * 30
    docs = spark.createDataFrame([(*x, "t") for x in zip(ids, texts, sources, strict=True)], "doc_id long, text string, source string, target string").repartition(5)
    got = mixing.mix(docs, [3, 1, 2]).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    for s in ("a", "b", None, "c"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8
    order = lambda rows: sorted((tuple(-1 if x is None else x for x in r[:5]) for r in rows))
    frame_ = docs.toPandas().astype({"doc_id": "Int64"})
    assert order(got) == order(sql_of("op2_mix_sources", documents=frame_))
    out = mixing.mixed_documents(docs, [3, 1, 2])
    assert out.columns == docs.columns
    size = collections.Counter()
    for r in out.collect():
        size[r.source] += len(words(r.text))
    assert size == collections.Counter({s: sum(r.taken for r in got if r.source == s) for s in ("a", "b", None, "c")})


def test_mix_with_unequal_weights(spark):
    docs = frame(spark, ["w w w w"] * 600, "s").withColumn("good", F.when(F.col("doc_id") < 300, 3.0).otherwise(1.0))
    rows = mixing.mix(docs, [1], share=0.25, weight_col="good").collect()
    good, rest = (sum(r.copies for r in rows if (r.doc_id < 300) == x) for x in (True, False))
    assert abs(sum(r.taken for r in rows) - 600) <= 4
    assert 80 <= good <= 140
    assert good > 1.8 * rest


# classifiers


def test_quality(spark):
    rng = random.Random(10)
    good = [" ".join(rng.choice(["the", "of", "plain", "words", "here", f"x{rng.randrange(500)}"]) for _ in range(60)) + "." for _ in range(160)]
    junk = [" ".join(w.upper() + "!!" for w in g.split()) for g in good[:80]]
    texts = good + junk
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(texts))] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = frame(spark, texts).withColumn("score", F.lit("x"))
    forest = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, forest).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {r.doc_id for r in docs.where(quality.held_out(F.col("doc_id"))).collect()} == set(held)
    assert np.mean([(got[i] >= 0.7) == (i < len(good)) for i in held]) > 0.95
    assert quality.keep_good(docs, forest).columns == docs.columns
    assert quality.keep_good(docs, forest).count() == sum(x >= 0.7 for x in got.values())
    odd = [r.score for r in quality.score(frame(spark, ODD), forest).collect()]
    assert len(odd) == len(ODD)
    assert all(0 <= x <= 1 for x in odd)
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(3), none).collect()} == {0.5}


def test_forest_arrays_are_the_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    f = quality.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float))

    def walk(row):
        total = f.base
        for t in range(len(f.leaf)):
            at = 0
            while at < f.feature.shape[1]:
                at = 2 * at + 1 + int(row[f.feature[t, at]] > f.threshold[t, at])
            total += f.leaf[t, at - f.feature.shape[1]]
        return 1 / (1 + math.exp(-total))

    assert f.predict(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_toxicity(spark):
    rng = random.Random(11)
    clean = made(12, 300)
    bad = [t + " " + " ".join(rng.choice(["vilest", "Foulness,", "foulmouth"]) for _ in range(rng.randrange(1, 6))) for t in clean[:80]]
    texts = clean + bad
    labels = spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(texts)) if i % 3], "doc_id long, toxic int")
    docs = frame(spark, texts).withColumn("grade", F.lit("x"))
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [i for i in range(len(texts)) if i % 3 == 0]
    assert np.mean([(rows[i].grade >= 1) == (i >= len(clean)) for i in unseen]) > 0.95
    assert all(0 <= r.severity <= 3 and r.severity >= r.p_toxic - 1e-9 for r in rows.values())
    assert {r.grade for r in toxicity.score(frame(spark, ODD), model).collect()} == {0}
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.severity for r in toxicity.score(docs.limit(3), none).collect()} == {0.0}


# vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def test_topk(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x[50:60] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [None] * 12, 0), (902, [float("nan")] * 12, 0), (903, [float("inf")] + [0.0] * 11, 0), (1000, [1.0, 2.0], 0), (905, [], 0), (None, [0.1] * 12, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit(0), "vector": F.lit(1), "rank": F.lit("r")})
    got = collections.defaultdict(list)
    for r in topk.top_k(df.where("vec_id % 100 = 0"), df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    z = np.floor(1024 * x.astype(float)).astype(int)
    for q in (0, 100, 200):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:10]
        assert got[q] == [(n, i, int(s[i])) for n, i in enumerate(order, 1)]
    assert set(got) == {0, 100, 200}
    few = df.where("vec_id < 5")
    assert topk.top_k(few, few).count() == 20
    assert topk.top_k(df.limit(0), df).count() == 0


def test_topk_of_large_integers():
    a = np.array([[2.0**40, 3.0]])
    assert topk._dots(a, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 3


def test_topk_of_huge_vectors(spark):
    x = [[1e10, -3.0], [1e10, 2.0], [5e17, 1e300], [0.5, 0.25], [-1e10, 1e10], [1e-9, 0.0], [float(2**21), 7.0]]
    df = spark.createDataFrame([(100 * i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    z = [[math.floor(1024 * v) for v in row] for row in x]
    want = []
    for i, a in enumerate(z):
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b, strict=True)))), 100 * j) for j, b in enumerate(z) if i != j)[:3]
        want += [(100 * i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df, df, k=3).collect()) == want


def test_prefix_forest(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, [0.0] * 16, 0), (2020, None, 0), (2040, [float("nan")] * 16, 0)], VECTORS)
    got = collections.defaultdict(list)
    for r in prefix_forest.nearest(df.where("vec_id % 20 = 0"), df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    recall = []
    for q, found in got.items():
        s = d @ d[q]
        s[q] = -np.inf
        recall.append(len({i for i, _ in found} & set(np.argsort(-s)[:20])) / 20)
        assert [v for _, v in found] == pytest.approx([s[i] for i, _ in found])
        assert len(found) == 20
    assert len(recall) == 75
    assert np.mean(recall) >= 0.9
    few = df.where("vec_id < 5")
    assert prefix_forest.nearest(few, few).count() == 20


def test_longest_prefix_first():
    rng = np.random.default_rng(6)
    f = prefix_forest.PrefixForest(rng.normal(size=(400, 8)), 10.0)
    q = rng.normal(size=(3, 8))
    strings = prefix_forest._strings(np.column_stack([q, np.zeros(3)]), f.directions)
    whole = np.empty_like(f.sorted)
    np.put_along_axis(whole, f.order, f.sorted, axis=1)
    for i, got in enumerate(f.candidates(q, 30)):
        common = np.array([[prefix_forest.BITS - int(int(a) ^ int(s)).bit_length() for a in row] for row, s in zip(whole, strings[i], strict=True)]).max(0)
        depth = common[got].min()
        assert len(got) >= 30
        assert set(got) == set(np.flatnonzero(common >= depth))
        assert (common > depth).sum() < 30


def test_query_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 400)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, vector array<double>")
    parts = list(vectors.query_parts(df))
    assert len(parts) > 2
    assert sorted(i for ids, _ in parts for i in ids) == list(range(100))


# pipeline


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    kept = corpus_pipeline.keep_quality(spark, docs, data)
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.9 * docs.join(labels.where("quality = 1"), "doc_id").count()
    lines = corpus_pipeline.drop_lines(spark, kept, data)
    one = corpus_pipeline.drop_near_duplicates(spark, lines, data)
    mixed = corpus_pipeline.mix_sources(spark, one, data)
    assert one.columns == mixed.columns == docs.columns
    assert one.count() <= lines.count() <= n
    assert one.dropDuplicates(["text"]).count() == one.count()
    out = corpus_pipeline.encode(spark, mixed, data)
    assert out.count() == mixed.count()
    assert [f for _, f in corpus_pipeline.STAGES][-1] is corpus_pipeline.encode
