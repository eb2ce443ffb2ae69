"""Each operator against a plain version, with nulls, empty and repeated rows and clashing names."""

import hashlib
import io
import itertools
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm import (
    decontaminate,
    html_text,
    jaccard,
    languages,
    licenses,
    packing,
    quality,
    queries,
    topk,
    warc,
    wavelet,
)
from keepsake.llm.common import BETWEEN_SPACE, look_up, run_hashes, sum_arrays
from tools.check_oracle import oracle, rows_of

SF = "/root/testdata/sf0.001"
BYTES, WORDS = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, score string, set string, n_words string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n "), (None, "word"), (4, "word"), (4, "word"), (4, "other"),
       (5, "é 日本 <|endoftext|> a\tb"), (6, "x" * 3000), (7, "lorem ipsum " * 4000)]


def whole(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    names, want = oracle(SF, queries.oracle_sql()[name])
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, want)


def test_packing(spark):
    packed = packing.pack(documents(spark, ODD), BYTES, capacity=2048, open_bins=4).collect()
    found = {}
    for r in packed:
        assert len(r.ids) == 4 * r.length and r.length <= 2048
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in found.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    wanted = sorted(((i, tuple([*whole(BYTES, t), 0])) for i, t in ODD), key=repr)
    pieces = sorted(packed, key=lambda r: (repr(r.doc_id), r.piece))
    whole_ids = sorted((struct.unpack(f"<{r.length}I", r.ids) for r in pieces if r.piece == 0 and r.length < 2048), key=repr)
    assert whole_ids == sorted((x[: len(x) % 2048] for _, x in wanted if len(x) % 2048), key=repr)
    long = [r for r in pieces if r.doc_id == 7]
    assert [r.length for r in long][1:] == [2048] * (len(long) - 1)
    assert packing.pack(documents(spark, []), BYTES).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 8, 2, 4)] == [(0, 0), (1, 0), (1, 8), (0, 6)]
    assert [bins.place(n) for n in (5, 7, 9, 4)] == [(2, 0), (3, 0), (4, 0), (2, 5)]


def test_licences(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code"),
            ("a/d.py", "x\n# Licensed under the Apache License, Version 2.0.\ny"), ("z.py", None),
            (None, ""), ("a/b/c.py", "code")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit(1))
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(files).collect()}
    assert got["a/b/c.py"] == (None, "MIT", "a") and got["z.py"] == (None, None, None)
    assert got["a/d.py"] == ("Apache-2.0", "Apache-2.0", None) and got[""] == (None, None, None)
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files.limit(0)).count() == 0


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home
    </a></ul></nav><div class="cookie-notice">We use cookies here and there, as one does</div>
    <article><header><h1>The&nbsp;title</h1></header><p>First &amp; <b>long</b>
    enough<br>line of text.<p>Is.<script>var x = "</p>"</script></article>
    <aside>Side</aside><section id="comments"><p>A reader's long comment on all of this text.</section>
    <footer>&copy; f</footer>"""
    assert html_text.extract(page) == "The title\n\nFirst & long enough line of text.\n\nIs."
    plain = "<div><a href=x>m</a></div>" + "<p>" + "A paragraph of plain text. " * 9 + "</p>"
    assert html_text.extract(plain) == ("A paragraph of plain text. " * 9).strip()
    assert [html_text.extract(x) for x in (None, "", "<p></p>", "<script>1</script>")] == [""] * 4
    assert html_text.extract("<article><p>cut sh") == "cut sh"


def test_html_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (1, "u", "<p>é</p>", "x"), (None, "u", "", "x")],
        "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()), key=repr)
    assert got == sorted([(1, "", 0), (1, "é", 1), (None, "", 0)], key=repr)


def test_languages(spark):
    rows = [(i, "the cat and the dog with the hat " * 3, "en") for i in range(5)]
    rows += [(i, "der hund und die katze mit dem hut " * 3, "de") for i in range(5)]
    rows += [(9, None, "en"), (9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.train(docs, F.lit(True))
    assert model.languages == ("de", "en")
    asked = documents(spark, [(1, "the hat and the cat"), (2, None), (3, "12 !?"), (4, "die katze und der hut"),
                              (5, "a"), (None, "")]).withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict(asked, model).collect()}
    assert got[1][0] == "en" and got[4][0] == "de" and got[5][0] in ("de", "en")
    assert got[2] == got[3] == got[None] == ("und", 0.0)
    both = model.predict(("the cat and the dog with the hat " * 9 + "der hund und die katze " * 4).encode())
    assert both[0] == "en" and 0.5 < both[1] < 0.95  # a mixture
    nothing = languages.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in languages.predict(asked, nothing).collect()} == {"und"}


def test_quality(spark):
    good = [(i, f"some plain words number {i} stand here in a row") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} $$$ ### BUY!!") for i in range(60)]
    docs = documents(spark, good + bad + [(500, None), (501, ""), (None, "x")])
    labels = spark.createDataFrame(
        [(i, int(i < 100), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0)],
        "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in quality.score(docs, net).collect()}
    held = [i for i, _ in good + bad if i % 3 == 1]
    assert sum(got[i].predicted == int(i < 100) for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 123
    empty = quality.train(docs.limit(0), labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


@pytest.mark.parametrize("spread", [1, 40])
def test_top_k(spark, spread):
    random = np.random.default_rng(spread)
    vectors = [random.integers(-spread, spread + 1, 6).tolist() for _ in range(150)]
    vectors[7] = vectors[8] = vectors[50]
    rows = [*enumerate(vectors), (200, [1, 2]), (201, None), (None, [1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = {}
    asked = topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id = 200"), 5, block_rows=40)
    for r in asked.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 50, 100):
        scores = [(-int(np.dot(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q]
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:5]]
    assert set(got) == {0, 50, 100}


def test_top_k_stops_early_and_skips_bad_vectors(spark):
    vectors = np.zeros((4000, 2), np.int64)
    vectors[:, 0] = np.arange(4000)
    best = topk.Block(np.arange(4000), vectors).best(-1, np.array([1, 0]), 5)
    assert best[0].tolist() == [3999, 3998, 3997, 3996, 3995] and best[2] < 100
    df = spark.createDataFrame(
        [([1.0, -0.3],), ([float("nan")],), ([None, 1.0],), (None,), ([float("inf")],)], "e array<float>")
    kept = df.filter(topk.usable(F.col("e"))).select(topk.quantised(F.col("e")).alias("v")).collect()
    assert [r.v for r in kept] == [[256, -77]]


def brute_groups(rows, words, percent):
    def own(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(words, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    sets = [own(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            group[top(j)] = top(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(top(i), d)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(
    "spec", [jaccard.Spec(3, 90), jaccard.Spec(2, 60, ((0.05, 2), (0.3, 3)), 2), jaccard.Spec(5, 80)]
)
def test_jaccard_groups(spark, spec):
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = list(ODD[:7])
    for base in range(6):
        text = random.choice(words, int(random.integers(4, 90))).tolist()
        for copy in range(9):
            changed = list(text)
            for _ in range(int(random.integers(0, 4))):
                changed[int(random.integers(0, len(changed)))] = f"c{int(random.integers(0, 9))}"
            rows.append((100 * base + copy + 10, " ".join(changed)))
    got = jaccard.join_groups(documents(spark, rows), spec).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(rows, spec.words, spec.percent)


def test_jaccard_keeps_one(spark):
    rows = [(5, "a b c"), (3, "a b c"), (3, "a b c"), (3, "z y x"), (9, None), (9, None), (1, "q")]
    kept = jaccard.keep_one(documents(spark, rows), jaccard.Spec(3, 90))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, "a b c"), (3, "z y x"), (9, None), (1, "q")], key=repr)
    assert kept.columns == documents(spark, []).columns
    assert jaccard.join_groups(documents(spark, [])).count() == 0


def test_token_files(spark):
    files = wavelet.write_shards(documents(spark, ODD), WORDS, shard_tokens=100)
    got = wavelet.read_shards(files).orderBy("start").collect()
    assert files.count() > 1 and files.agg(F.sum("tokens")).first()[0] == sum(r.n_tokens for r in got)
    at = 0
    for r in got:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = [(i, zlib.crc32(struct.pack(f"<{len(x) + 1}I", *x, 1))) for i, x in ((i, whole(WORDS, t)) for i, t in ODD)]
    assert sorted(((r.doc_id, zlib.crc32(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    assert wavelet.write_shards(documents(spark, []), WORDS).count() == 0


def test_wavelet_lookups():
    tokens = np.random.default_rng(1).integers(0, 70, 3001).astype(np.uint16)
    shard = wavelet.Shard(wavelet.to_bytes([1, None], [3000, 1], tokens, 7))
    assert (shard.decode() == tokens).all() and shard.documents()[0] == [1, None]
    for at in (0, 1, 511, 512, 2047, 3000):
        assert shard.access(at) == tokens[at]
    for token in (0, 5, 69, 70, 500):
        places = np.flatnonzero(tokens == token).tolist()
        assert shard.occurrences(token) == places and shard.rank(token) == len(places)
        assert shard.rank(token, 1024) == sum(p < 1024 for p in places)
    with pytest.raises(ValueError):
        wavelet.Shard(wavelet.to_bytes([1], [3001], tokens, 7)[:-1])


def test_warc(spark):
    same = "<p>" + "é" * 80
    rows = [(5, "u", same), (3, "u", same), (3, "v", same), (4, None, None), (6, "u\r\nX: y", ""), (7, "u", "short"),
            (8, "u", "short"), (None, "u", same)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    got = warc.read_archives(warc.write_archives(pages, file_bytes=200)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("5", "revisit", "3"), ("3", "response", "None"), ("3", "response", "None"), ("4", "response", "None"),
         ("6", "response", "None"), ("7", "response", "None"), ("8", "response", "None"), ("None", "revisit", "3")])
    for r in got:
        text = same if r.page_id in ("3", "5", None) else dict((str(a), c or "") for a, _, c in rows)[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (
            len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_frames_and_checks():
    payloads = [f"<html><p>page number {i} of many</p></html>".encode() * 9 for i in range(300)]
    out = io.BytesIO()
    pack = warc.write_head(out, payloads)
    records = [warc.render(i, "u", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    for record in records:
        out.write(pack.compress(record))
    data = out.getvalue()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    assert list(warc.read_records(io.BytesIO(data), 100)) == records
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(data[:-3])))
    for broken in (records[0][:-5], records[0].replace(b"page", b"edge"), records[0].replace(b"WARC/1.1", b"WARC/9"),
                   records[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadRecord):
            warc.parse(broken)


def brute_hits(text, items, size):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(size, len(w))
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for at in range(len(own) - n + 1):
                if tuple(own[at : at + n]) == window:
                    hit |= set(range(at, at + n))
                    found.add("" if item is None else item)
    return len(own), len(hit), sorted(found)


def test_decontamination(spark):
    items = [("b", "one two three four five six"), ("a", "Zwölf B"), (None, "three FOUR five-six seven"), ("c", None),
             ("d", "--"), ("b2", "one two three four nine")]
    texts = [(1, "x one, two three four five six y"), (2, "zwölf b zwölf b c"), (3, None), (4, ""), (5, "nothing"),
             (5, "nothing"), (None, "one two three four nine one two three four")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1, 1 << 20):
        got = decontaminate.scan(documents(spark, texts), bench, size=4, block_bytes=block).collect()
        assert sorted(((r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == sorted(
            (brute_hits(t, items, 4) for _, t in texts), key=repr)
    clean = decontaminate.without_spans(documents(spark, texts), bench, size=4)
    assert {r.doc_id: r.text for r in clean.collect()}[1] == "x  y"
    assert decontaminate.without_documents(documents(spark, texts), bench, size=4).count() == 4
    assert decontaminate.without_documents(documents(spark, texts), bench.limit(0)).count() == len(texts)


def test_look_up_and_sums(spark, many_segments):
    rows = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    found = spark.createDataFrame([(0, "hot"), (7, "seven"), (5000, "none")], "k long, v string")
    out = look_up(rows, "k", F.col("id"), found, "left", 8)
    assert out.count() == 1000 and out.where("v = 'hot'").count() == 334
    parts = spark.range(0, 300, 1, 150).select(
        F.col("id").alias("part"), F.lit("k").alias("key"), F.lit(struct.pack("<2q", 1, 2)).alias("values"))
    row = sum_arrays(parts, at_once=4).collect()
    assert len(row) == 1 and struct.unpack("<2q", row[0]["values"]) == (300, 600)


def test_a_run_has_one_hash_wherever_it_stands():
    """Texts of several blocks, and one run longer than a block."""
    words = [b"w%d" % (i % 50) for i in range(60_000)] + [b"x" * 200_000, b"w3"]
    hashes, kinds = run_hashes(b"  " + b" \t".join(words), BETWEEN_SPACE)
    assert len(hashes) == len(words) and set(kinds.tolist()) == {1}
    alone = {w: int(run_hashes(w, BETWEEN_SPACE)[0][0]) for w in set(words)}
    assert hashes.tolist() == [alone[w] for w in words]
    assert len(set(alone.values())) == len(alone)
