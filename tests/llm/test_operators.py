"""The numbered operators against the library they follow, brute force, or exact round trips, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import io
import json
import math
import os
import random
import re
import string
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import bpe, common, components, fingerprints, jaccard, langid, licenses, media, mixing, sharding, text, token_counts, warc

LIB = bpe.default_tokenizer_path()
ODD = ["", None, "a", "Hello, World's we're!", "<|startoftext|>x<|endoftext|>!!", "ΑΣ ΣΑΣ É é", "日本語 🎉 12 3½", "\x1c\x1f a\x1db \x85\xa0", "aaa " * 50, "a" * 20000, "x\ty\nz", "I'll 're'x"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, row string"


def docs(spark, texts, **columns):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(columns.get("ids", range(len(texts)))[i], t, columns.get("langs", ["en"] * len(texts))[i], columns.get("sources", ["s"] * len(texts))[i], None, 1.0, 7, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(LIB)


# -- 1, 5: tokens -------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, tokenizer, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs(spark, texts))).collect()}
    assert back == {i: r.decoded for i, r in got.items()}
    one = {r.doc_id: r for r in bpe.digests(docs(spark, texts)).collect()}
    assert one[3].ids_sha256 == hashlib.sha256(" ".join(map(str, got[3].ids)).encode()).hexdigest() and one[1].n_tokens == 0


def test_token_counts_equal_the_library(spark, tokenizer):
    texts = [*ODD, "word, " * 3000]
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), limit=50).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == count(t or "") and got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 50)
        if got[i].over_limit:
            cut, shown = got[i].cut_chars, token_counts.normalised(t)
            assert count(shown[:cut]) <= 50 and all(count(shown[:k]) > 50 for k in [*range(cut + 1, min(len(shown), cut + 60)), *range(cut + 60, len(shown) + 1, 499)])


def test_cuts_are_the_longest_prefixes(spark, tokenizer):
    """A longer prefix of a word may have fewer tokens than a shorter one."""
    texts = ["internationalization", "uncharacteristically", "counterrevolutionary thing", "antidisestablishmentarianism's", "pneumonoultramicroscopicsilicovolcanoconiosis"]
    for limit in (0, 1, 2, 3, 5):
        for r in token_counts.count_tokens(docs(spark, texts), limit=limit).collect():
            counts = [len(tokenizer.encode(texts[r.doc_id][:k], add_special_tokens=False).ids) for k in range(len(texts[r.doc_id]) + 1)]
            assert r.cut_chars == (max(k for k, n in enumerate(counts) if n <= limit) if counts[-1] > limit else None)


def test_prefix_tables_hold_every_prefix(spark, tokenizer):
    texts = ["we're they'll I've!'s 12,3 aaaa  b", "É é ΑΣ", "", None]
    for r in token_counts.prefix_tables(docs(spark, texts)).collect():
        shown = token_counts.normalised(texts[r.doc_id] or "")
        assert r.prefix_tokens == [len(tokenizer.encode(shown[:k], add_special_tokens=False).ids) for k in range(len(shown) + 1)]


def test_words_share_the_table_of_their_common_letters(tokenizer):
    """Words of a batch go on from the letters that they share, and words of earlier batches aren't looked into again."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    own = token_counts.PrefixCounter(open(LIB, encoding="utf-8").read())
    own.inner = Counted(own.inner)
    first = [f"pneumonoultramicroscopicsilicovolcanoconiosis{x}" for x in string.ascii_lowercase]
    own.learn(first[:1])
    one, own.inner.asked = own.inner.asked, 0
    own.learn(first[1:])
    assert own.inner.asked < 3 * one
    own.inner.asked = 0
    second = [f"{x}." for x in first] + ["it's", "a-b", "éé!?"]
    own.learn(second[:26])
    assert own.inner.asked == 0
    own.learn(second[26:])
    assert [own.totals[x] for x in first + second] == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in first + second]


def test_older_words_are_kept_for_a_while(tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    own = token_counts.PrefixCounter(open(LIB, encoding="utf-8").read())
    for batch in (["alpha", "beta,gamma", "delta"], ["alpha", "epsilon"], ["zeta", "beta"], ["", "alphas", "gamma"], ["delta.delta"]):
        own.learn(batch)
        assert [own.totals[x] for x in batch] == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in batch]
        assert len(own.words) + len(own.older) < 16


# -- 2: language ----------------------------------------------------------------------------------------


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_documents(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    assert set(got.doc_id) == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_of_odd_texts(spark):
    rng = random.Random(1)
    texts = ["the and of " * 20 + words(rng, 5), "der die und ich " * 20, "le la et des " * 20] * 6 + [None, "", "123 !!", "\U00010400\U00010428 x"]
    labels = ["en", "de", "fr"] * 6 + [None, "en", "de", None]
    table = docs(spark, texts, langs=labels)
    got = {r.doc_id: r for r in langid.identify(table, langid.train(table)).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["en", "de", "fr"]
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (18, 19, 20)) and got[21].lang_pred != "und"
    none = langid.identify(table, langid.train(table.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_votes_within_a_family():
    rng = np.random.default_rng(0)
    x = np.eye(4, langid.DIM)[np.repeat(range(4), 10)] + rng.random((40, langid.DIM)) * 1e-3
    model = langid.fit(x.astype(np.float32), [g for g in ("en", "de", "nl", "xx") for _ in range(10)])
    assert model.families == ["germanic", "xx"] and len(model.pairs["germanic"]) == 3
    assert [model.langs[i] for i in model.predict(x)[0]] == [g for g in ("en", "de", "nl", "xx") for _ in range(10)]


def test_language_sample_is_bounded(spark):
    """However often a row repeats, it is learned from once; keys play no part."""
    rng = random.Random(8)
    texts = ["der die und ich nicht auf"] * 500 + ["the and of to in it " + words(rng, 3) for _ in range(300)]
    table = docs(spark, texts, langs=["de"] * 500 + ["en"] * 300, ids=[7] * 800)
    seen = []
    solve = langid.solve_all
    try:
        langid.solve_all = lambda spark, wanted, rows, labels: seen.append(Counter(labels)) or solve(spark, wanted, rows, labels)
        model = langid.train(table, sample=50)
    finally:
        langid.solve_all = solve
    assert seen[0]["de"] == 1 and 20 <= seen[0]["en"] <= 100
    assert {r.lang_pred for r in langid.identify(table.limit(3), model).collect()} <= {"de", "en"}


def test_what_was_never_learned_is_not_known(spark):
    table = docs(spark, ["the and of to in it", "der die und ich für", "привет как дела друзья", "the привет", "\U00010400\U00010428"], langs=["en", "de", None, None, None])
    got = {r.doc_id: r.known for r in langid.identify(table, langid.train(table)).collect()}
    assert got[0] == got[1] == 1.0 and got[2] == got[4] == 0.0 and abs(got[3] - 3 / 9) < 0.2


def test_features_by_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = pa.array([None, "", "12 3", "é" * 10 + " \U00010400x "] + ["".join(rng.choice("abÄ .") for _ in range(rng.randrange(200))) for _ in range(20)])
    whole = langid.features(texts)
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        part = langid.features(texts)
        assert np.allclose(whole[0], part[0]) and (whole[1] == part[1]).all() and whole[2] == part[2]


# -- 3: near copies ---------------------------------------------------------------------------------------


def shingles(text):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(lower))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \t\n", "one two", "One  TWO", "x" * 50000, "Ä b c d e f"]
    passage = words(rng, 60)
    for _ in range(6):
        base = words(rng, 120).split()
        for _ in range(rng.choice([1, 3, 14])):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
            out.append(" ".join(copy[: rng.choice([120, 112, 100])]))
    out += [f"{words(rng, rng.randrange(5, 90))} {passage} {words(rng, 5)}" for _ in range(30)] + [passage] * 3 + [words(rng, 30, 4) for _ in range(30)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # nearly every shingle takes the road of frequent ones
        monkeypatch.setattr(jaccard, "FREQUENT", 1)
    texts = near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs(spark, texts)).collect()}
    assert got == brute_groups(list(enumerate(texts)))


def test_long_lists_leave_their_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    texts = near_texts(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs(spark, texts)).collect()}
    assert got == brute_groups(list(enumerate(texts)))


def test_one_of_each_group_stays(spark):
    texts = near_texts(4)
    ids = [*range(len(texts) - 1), 8]  # a repeated id
    texts[-1] = texts[8]
    kept = jaccard.keep_one(docs(spark, texts, ids=ids))
    want = brute_groups(list(dict(zip(ids, texts, strict=True)).items()))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert kept.columns == docs(spark, texts).columns


def test_hash_by_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = pa.array([None, "", " ", "x" * 1000 + " y z"] + ["".join(rng.choice("ab \n") for _ in range(rng.randrange(900))) for _ in range(30)])
    whole = text.shingle_sets(texts)
    for piece in (1, 3, 64, 1000):
        monkeypatch.setattr(text, "PIECE", piece)
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, text.shingle_sets(texts), strict=True))


def test_rows_that_share_a_doc_id(spark):
    """Another text with the same doc_id is another document; its links aren't the first one's, and it isn't lost."""
    rng = random.Random(6)
    a, b, c = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(5, a), (5, b), (5, a + " more"), (9, b), (None, c), (None, c), (3, ""), (3, ""), (3, None), (7, c)]
    table = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = Counter((r.doc_id, r.component_id, r.n_shingles > 0) for r in jaccard.groups(table).collect())
    assert got == Counter({(5, 5, True): 3, (9, 5, True): 1, (None, 7, True): 2, (7, 7, True): 1, (3, 3, False): 3})
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(table).collect()]
    assert Counter(t for _, t in kept) == Counter({"": 2, None: 1}) + Counter({t: 1 for _, t in kept if t})
    assert (7, c) in kept and len([t for i, t in kept if i == 5]) == 2 and len(kept) == 6
    assert sorted(kept, key=str) == sorted([(r.doc_id, r.text) for r in jaccard.keep_one(table.repartition(5)).collect()], key=str)


def test_joins_of_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "SPLIT", 3)
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 5 + [3, None])], "k long, i long")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (4, "d")], "k long, x string")
    for how in ("inner", "left"):
        want = Counter(map(tuple, big.join(small, ["k"], how).collect()))
        assert Counter(map(tuple, common.salted_join(big, small, "k", how=how).collect())) == want
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    texts = near_texts(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs(spark, texts)).collect()} == brute_groups(list(enumerate(texts)))


def test_too_many_frequent_shingles_for_the_map(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 20)
    texts = near_texts(9)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs(spark, texts)).collect()} == brute_groups(list(enumerate(texts)))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Somewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_dir(Somewhere)


def test_tables_that_are_discarded(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = common.stored(spark.range(5).toDF("v"))
    assert table.count() == 5 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    folder = os.path.dirname(table.inputFiles()[0]).removeprefix("file://")
    common.discard(table)
    assert not os.path.exists(folder)


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- 4: media ---------------------------------------------------------------------------------------------


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive_bytes():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff\x2c\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03a\x12\xff\x00\x34\xff\xd9"


def test_sniffing_corrects_and_carves(spark):
    import gzip

    packed = gzip.compress(b"hello" * 10)
    cells = [(0, png(), "image/jpeg"), (1, GIF, "image/gif"), (2, JPEG, None), (3, media.wav(b"abcd"), "audio/wav"), (4, archive_bytes(), "x"), (5, packed, None), (6, b"..." + png() + b"zz" + GIF, "text/plain"), (7, b"GIF89a but only text BM WAVE %PDF-", "image/gif"), (8, None, None), (9, b"", None), (10, png()[:-3], "image/png")]
    table = spark.createDataFrame(cells, "id long, data binary, kind string")
    got = {r.id: r for r in media.sniff(table, "id", "data", "kind").collect()}
    assert [got[i].media_type for i in range(6)] == ["image/png", "image/gif", "image/jpeg", "audio/wav", "application/zip", "application/gzip"]
    assert [got[i].length for i in range(6)] == [len(c[1]) for c in cells[:6]]
    assert [got[i].corrected for i in (0, 1, 4)] == [True, False, True]
    assert [(x.offset, x.length, x.type) for x in got[6].embedded] == [(3, len(png()), "image/png"), (5 + len(png()), len(GIF), "image/gif")]
    assert all(got[i].media_type is None and not got[i].embedded for i in (7, 8, 9, 10))


def flac_bytes():
    crc8 = lambda d: __import__("functools").reduce(lambda c, x: media._CRC8[c ^ x], d, 0)
    crc16 = lambda d: __import__("functools").reduce(lambda c, x: (c << 8 & 0xFF00) ^ media._CRC16[c >> 8 ^ x], d, 0)
    out = b"fLaC" + b"\x80\x00\x00\x22" + b"\x00\xc0" * 2 + bytes(6) + ((44100 << 44) | (15 << 36) | 576).to_bytes(8, "big") + bytes(16)
    for n, value in enumerate((5, 77, 1000)):
        head = bytes([0xFF, 0xF8, 0x19, 0x08, n])
        body = head + bytes([crc8(head), 0]) + value.to_bytes(2, "big")
        out += body + crc16(body).to_bytes(2, "big")
    return out


def pdf_bytes(n):
    head = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n" + b"x" * n + b"\n"
    return head + b"xref\n0 1\ntrailer<<>>\nstartxref\n%d\n%%%%EOF" % len(head)


def ogg_page(flags, body):
    return b"OggS\0" + bytes([flags]) + bytes(20) + b"\x01" + bytes([len(body)]) + body


def box(name, body):
    return struct.pack(">I4s", 8 + len(body), name) + body


BMP = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 62, 0, 54, 40, 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + bytes(8)
WEBP = struct.pack("<4sI4s4sI", b"RIFF", 4 + 8 + 4, b"WEBP", b"VP8 ", 4) + b"abcd"
MP4 = box(b"ftyp", b"isom") + box(b"moov", b"xy") + box(b"mdat", b"z" * 9)


@pytest.mark.parametrize("kind, one", [("audio/flac", flac_bytes()), ("application/pdf", pdf_bytes(9)), ("application/ogg", ogg_page(2, b"a") + ogg_page(4, b"bc")), ("image/bmp", BMP), ("image/webp", WEBP), ("video/mp4", MP4), ("application/zip", archive_bytes())], ids=["flac", "pdf", "ogg", "bmp", "webp", "mp4", "zip"])
def test_objects_end_where_they_end(kind, one):
    found = media.finder()
    assert media.objects(one, found) == [(0, len(one), kind)]
    after = b"" if kind == "video/mp4" else b"\n"
    assert media.objects(one + after + GIF, found) == [(0, len(one), kind), (len(one + after), len(GIF), "image/gif")]
    if kind != "video/mp4":
        assert kind not in [k for _, _, k in media.objects(one[: len(one) * 2 // 3], found)]
        assert media.objects(b"ab" + one + b"\n" + one, found) == [(2, len(one), kind), (3 + len(one), len(one), kind)]


def test_texts_as_audio(spark):
    texts = ["", None, "é" * 96, "x" * 193, "same", "same", "RIFF WAVE GIF89a PK\x03\x04"]
    got = {r.doc_id: r for r in media.media_features(media.store_texts(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, math.ceil(len(raw) / 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest() and r.media_bytes == len(payload) + 44
    assert got[4].feature == got[5].feature


# -- 6: licenses --------------------------------------------------------------------------------------------


def test_licenses(spark):
    filler = "nothing to see here\n" * 3
    mit = licenses.TEMPLATES["MIT"][2]
    texts = [
        filler + "Released under the MIT License.\n" + filler, "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", filler + mit.capitalize() + filler, mit.replace("free of charge", "at no cost"), "a licensed driver went home with permission", None, "", "licence " * 2000, "All rights reserved.",
    ]
    got = {r.doc_id: r for r in licenses.scan_documents(docs(spark, texts)).collect()}
    assert [got[i].licenses for i in range(8)] == ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "CC-BY-NC-4.0", "CC-BY-4.0", "MIT", "MIT"]
    assert got[6].differing_words == 0 and got[7].differing_words > 0
    assert all(got[i].licenses == "" for i in (8, 9, 10, 11)) and got[12].licenses == "proprietary"


def test_licenses_among_many_notices(spark):
    t = licenses.TEMPLATES
    notices = "\n".join(f"part{i}: licensed under the MIT license" for i in range(300)) + "\nlast: licensed under the Apache License, Version 2.0"
    run = "\n".join([*t["MIT"][:4], *t["Apache-2.0"][:4], *t["BSD-3-Clause"], *t["GPL-3.0"][:3], *t["ISC"]])
    rng = random.Random(3)
    line = f"{words(rng, 3000)} licensed under the mit license {words(rng, 3000)}"
    wrapped = "\n".join(re.findall(r".{1,60}(?: |$)", t["MIT"][2]))
    rows = licenses.scan_documents(docs(spark, [notices, run, line, wrapped])).collect()
    got = {r.doc_id: r.licenses for r in rows}
    assert got == {0: "Apache-2.0,MIT", 1: "Apache-2.0,BSD-3-Clause,GPL-3.0,ISC,MIT", 2: "MIT", 3: "MIT"}
    at = {r.doc_id: json.loads(r.findings) for r in rows}
    assert line[at[2][0]["offset"] :][: at[2][0]["length"]] == "licensed under the mit license"


def test_license_windows_leave_no_passage_out():
    """Words beside the passage, words left out and words added never hide what brute force over all stretches finds."""
    rng = random.Random(5)
    for t in licenses.Scanner().templates:
        for _ in range(3):
            own = list(t.words)
            for _ in range(rng.randrange(4)):
                own.insert(rng.randrange(1, len(own)), rng.choice(["old", "the", "license"]))
            if rng.random() < 0.5:
                del own[rng.randrange(len(own))]
            text = [f"w{rng.randrange(9)}" for _ in range(20)] + own + rng.choices(t.words, k=3) + ["x"] * 9
            brute = any(licenses.wording(t.words, text[i : i + t.reach]) for i in range(len(text)))
            assert bool(t.passages(text, Counter(text))) == brute


def test_every_license_template_is_found_alone(spark):
    alone = [(name, k, text) for name, some in licenses.TEMPLATES.items() for k, text in enumerate(some)]
    got = {r.doc_id: r.licenses for r in licenses.scan_documents(docs(spark, [text.capitalize() for _, _, text in alone])).collect()}
    assert [(name, k) for i, (name, k, _) in enumerate(alone) if got[i] != name] == []
    # a word left out or a line broken leaves a cue
    cue = re.compile(licenses.CUES)
    for _, _, text in alone:
        for sep in (" ", "\n * "):
            part = text.split()
            assert all(cue.search(sep.join(part[:i] + part[i + 1 :])) for i in range(len(part)) if not licenses.tells(licenses.TOKEN.findall(part[i] + " x")[0]))


def test_licenses_that_are_nearly_others(spark):
    gnu = "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    t = licenses.TEMPLATES
    head, (two, bullets, *_), neither = t["BSD"][0], t["BSD-2-Clause"], t["BSD-3-Clause"][0]
    cut = two.index("this software is provided by")
    texts = [gnu.format("Affero "), gnu.format("Lesser "), gnu.format(""), f"{head}\n1. {two}", f"{head}\n* {bullets}", f"{head}\n1. {two[:cut]}\n3. {neither}\n{two[cut:]}", "x\n/* Copyright (c) 2020. All rights\n * reserved. */", "SPDX-License-Identifier: FOO-BAR"]
    got = {r.doc_id: r.licenses for r in licenses.scan_documents(docs(spark, texts)).collect()}
    assert [got[i] for i in range(8)] == ["AGPL-3.0", "LGPL-3.0", "GPL-3.0", "BSD,BSD-2-Clause", "BSD,BSD-2-Clause", "BSD,BSD-3-Clause", "proprietary", ""]


# -- 7: mixing ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_fit_meets_the_budget(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 300, 12))
    counts = rng.integers(1, 6, len(lengths))
    sums = {0}
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    budget = int(rng.integers(0, int((lengths * counts).sum()) + 1))
    small = mixing.knapsack(lengths, counts, budget)
    assert (small <= counts).all() and int((small * lengths).sum()) == max(s for s in sums if s <= budget)
    taken = mixing.fit(lengths, counts, budget)
    assert (taken <= counts).all() and budget - 300 < int((taken * lengths).sum()) <= budget


def test_fit_of_large_budgets():
    lengths, counts = np.arange(1, 2000), np.full(1999, 10**7)
    budget = 7 * 10**12 + 12345
    taken = mixing.fit(lengths, counts, budget)
    assert int((taken.astype(object) * lengths).sum()) == budget and (taken <= counts).all()


def plain_targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """By halving: the level at which the targets sum to the whole."""
    own, total = [float(weights[i % 3]) for i in range(len(sizes))], min(share, most) * sum(sizes)
    low, high = 0.0, 1e18
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * n, level * w) for n, w in zip(sizes, own, strict=True)) < total else (low, level)
    return [min(most * n, high * w) for n, w in zip(sizes, own, strict=True)]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [0, 5], [0, 0], [], [7], [1, 1000, 3, 3, 80, 2, 9], list(range(200))])
def test_targets_of_sources(spark, sizes):
    names = sorted(["é", "Z", "\U0001f389", "￿", "a", "ab", "b", *map(str, range(1000, 1193))][: len(sizes)], key=lambda x: x.encode())
    names = [*names[:-1], None] if len(sizes) > 2 else names
    table = spark.createDataFrame([(s, n, 1) for s, n in zip(names, sizes, strict=True)], "source string, size long, n long").repartition(4)
    got = {r.source: r for r in mixing.source_targets(table).collect()}
    assert len(got) == len(sizes) and np.allclose([got[s].target for s in names], plain_targets(sizes))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BAND_ROWS", 4)
    rng = random.Random(3)
    texts = [words(rng, rng.choice([0, 1, 5, 5, 5, 9])) for _ in range(300)] + [None, ""]
    sources = [rng.choice(["a", "a", "b", "Ä", None]) for _ in range(302)]
    ids = [*range(299), 5, 5, 7]
    table = docs(spark, texts, ids=ids, sources=sources)
    got = mixing.mix(table).toPandas()
    assert len(got) == 302 and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, plain_targets([sizes[s] for s in order]), strict=True))
    for s in order:
        mine = got[np.isclose(got.target, targets[s]) & (got.source_size == sizes[s])]
        assert abs(mine.taken.sum() - targets[s]) <= 9
    again = mixing.mix(table.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    out = mixing.mixed(table)
    assert out.columns == table.columns
    assert out.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)))).first()[0] == got.taken.sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_lengths_are_cut_by_parts_of_the_hash(spark, seed, monkeypatch):
    """Many documents of one length, many equal rows, one null doc_id for a third of them."""
    monkeypatch.setattr(mixing, "BAND_ROWS", 3)
    monkeypatch.setattr(mixing, "ROUND_BITS", 3)
    monkeypatch.setattr(common, "SPLIT", 20)
    rng = random.Random(seed)
    texts = [words(rng, 5, 60) for _ in range(300)] + ["a b c d e"] * 200 + [words(rng, 7, 50) for _ in range(60)]
    ids, sources = [None if i % 3 == 0 else i for i in range(300)] + [4] * 200 + list(range(60)), ["a"] * 500 + ["b"] * 40 + [None] * 20
    table = docs(spark, texts, ids=ids, sources=sources)
    got = mixing.mix(table).toPandas()
    assert len(got) == 560 and (got.taken <= 2 * got["size"]).all()
    for target, group in got.groupby("target"):
        assert abs(group.taken.sum() - target) <= 8
    again = mixing.mix(table.repartition(7)).toPandas()
    count = lambda g: Counter(map(tuple, g[["doc_id", "size", "taken"]].fillna(-1).values.tolist()))
    assert count(got) == count(again)
    out = mixing.mixed(table)
    assert out.select(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] == got.taken.sum()


# -- 8: WARC ------------------------------------------------------------------------------------------------


def test_warc(spark):
    big, other = "<html>" + "x" * 200, "<p>" + "y" * 97
    pages = [(1, "http://a/ü\n", big), (2, None, big), (3, "u", other), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (9, "u", other), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "z" * 99), (13, "u", "z" * 99)]
    table = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(table).collect()}
    for page, _, html in pages:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    refers = {k: (r.record_type, r.refers_to) for k, r in got.items()}
    assert {k for k, v in refers.items() if v[0] == "revisit"} == {2, 9, 11, None}
    assert refers[2] == ("revisit", 1) and refers[9] == ("revisit", 3) and refers[11] == ("revisit", 10) and refers[None] == ("revisit", 1)
    assert all(v == ("response", None) for k, v in refers.items() if k not in {2, 9, 11, None})
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_without_broadcast_and_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_RECORDS", 7)
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    monkeypatch.setattr(common, "SPLIT", 10)
    monkeypatch.setattr(warc, "fits_broadcast", lambda df, rows, few: df)
    rows = [(i, f"http://h{i % 3}/{i}", "same " * 50 if i % 3 else f"own {i} " * (i * 20)) for i in range(120)] + [(4, None, "same " * 50), (500, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages, f"{common.shared_dir(spark)}/warc-test-{random.random()}")
    read = warc.read_archives(archives)
    assert read.rdd.getNumPartitions() >= 120 // 7
    got = read.collect()
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert all((r.record_type, r.refers_to) == (("revisit", 1) if r.page_id not in (1, 500) and r.page_id % 3 else ("response", None)) for r in got)


def test_revisits_name_their_record():
    whole, again = warc.record(3, "http://a/é", b"payload", "d", None), warc.record(9, None, b"payload", "d", 3, "http://a/é")
    first, second = warc.parse_record(whole)["fields"], warc.parse_record(again)["fields"]
    assert second["warc-refers-to"] == first["warc-record-id"] and second["warc-refers-to-target-uri"] == first["warc-target-uri"] and second["warc-refers-to-date"] == first["warc-date"]
    assert warc.surt("http://www.Example.com:8080/A?b=c") == "com,example,www:8080)/a?b=c" and warc.surt(None) == "about:blank"


class Ranges(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_zip64_directories_and_ranges():
    b = Ranges()
    w = warc.Writer(b)
    b.close = lambda: None
    for i in range(3):
        w.add(i, "u", b"payload %d" % i, "d", None)
    w.close()
    archive = warc.Archive(b)
    assert [archive.record(e)["payload"] for e in archive.index()] == [b"payload 0", b"payload 1", b"payload 2"]
    big = Ranges()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_STORED) as z:  # more members than a plain end record can count
        for i in range(66_000):
            z.writestr(f"f{i}", b"")
        z.writestr("archive/x", b"last PK\x05\x06")
        z.comment = b"PK\x05\x06 in a comment"
    found = warc.members(lambda at, n: big.getvalue()[at : at + n], big.size())
    at, n, method = found["archive/x"]
    at = at + 30 + len("archive/x")
    assert len(found) == 66_001 and method == 0 and big.getvalue()[at : at + n] == b"last PK\x05\x06"
    with pytest.raises(ValueError):
        warc.members(lambda at, n: b"no archive"[at : at + n], 10)


class Sparse:
    """A file of zeros with some bytes here and there."""

    def __init__(self, size, parts):
        self.length, self.parts, self.at = size, parts, 0

    def size(self):
        return self.length

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = bytearray(n)
        for start, raw in self.parts.items():
            a, b = max(start, self.at), min(start + len(raw), self.at + n)
            if a < b:
                out[a - self.at : b - self.at] = raw[a - start : b - start]
        return bytes(out)


def test_zip64_offsets_beyond_four_gigabytes():
    import gzip

    name, far, start = b"archive/data.warc.gz", 5 << 30, 6 << 30
    raw = gzip.compress(warc.record(1, "u", b"far away", "d", None))
    length = (1 << 32) + 10  # the member itself is larger than 32 bits can say
    local = struct.pack("<4s5HIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, length, length)
    extra = struct.pack("<HHQQQ", 1, 24, length, length, far)
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = far + len(local) + length
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(entry), 1)
    tail = entry + end64 + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    at = (1 << 32) + 3 - len(raw)
    archive = warc.Archive(Sparse(start + len(tail), {far: local, far + len(local) + at: raw, start: tail}))
    assert archive.record({"filename": "data.warc.gz", "offset": at, "length": len(raw)})["payload"] == b"far away"
    with pytest.raises(ValueError):
        archive.record({"filename": "data.warc.gz", "offset": length - 1, "length": len(raw)})


def test_compressed_indexes_and_members():
    import gzip

    b, record = Ranges(), gzip.compress(warc.record(1, "u", b"hello", "d", None))
    line = lambda at: f'com,a)/ 20240101000000 {{"filename": "x.warc.gz", "offset": "{at}", "length": "{len(record)}"}}\n'.encode()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/x.warc.gz"), record * 2)
        z.writestr("indexes/index.cdx.gz", gzip.compress(b"!meta 0 {}\n" + line(len(record))) + gzip.compress(line(0)), zipfile.ZIP_DEFLATED)
        z.writestr("indexes/index.idx", b"!meta 0 {}\ncom,a)/ 2024 {}")
        z.writestr("archive/packed.warc.gz", record, zipfile.ZIP_DEFLATED)
    archive = warc.Archive(b)
    assert [(e["offset"], archive.record(e)["payload"]) for e in archive.index()] == [(0, b"hello"), (len(record), b"hello")]
    with pytest.raises(ValueError, match="compressed"):
        archive.record({"filename": "packed.warc.gz", "offset": 0, "length": 5})


# -- 9: fingerprints --------------------------------------------------------------------------------------


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(0, 60)) for _ in range(60)] + [None, "", "é🎉x", "é🎉x"]
    ids = rng.sample(range(-500, 500), len(texts))
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs(spark, texts, ids=ids)).collect()}
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    for k, (i, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    alike = defaultdict(set)
    for i, t in order:
        alike[t].add(got[i].fingerprint)
    assert all(len(s) == 1 for s in alike.values())
    assert fingerprints.compare_edited(docs(spark, ["alone words"])).first().near_next == 1.0
    assert fingerprints.compare_edited(docs(spark, texts).limit(0)).count() == 0


def test_likeness_against_brute_force(spark):
    """Exact up to LEAST shingles, within the stated error beyond."""
    rng = random.Random(11)
    texts = [words(rng, rng.choice([3, 20, 50, 900, 3000])) for _ in range(60)]
    for k in range(0, 60, 3):  # neighbours that share much
        texts[k + 1] = texts[k][: len(texts[k]) * 2 // 3] + " " + words(rng, rng.choice([1, 10, 100]))
    got = {r.doc_id: r for r in fingerprints.compare_edited(docs(spark, texts)).collect()}
    off = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        for other, value in ((edited, got[i].near_edited), (after, got[i].near_next)):
            a, b = shingles(t), shingles(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            if max(len(a), len(b)) <= fingerprints.LEAST:
                assert value == exact
            off.append(value - exact)
    assert abs(np.mean(off)) < 0.02 and np.max(np.abs(off)) < 4 * 0.063


def test_hot_keys_are_put_in_order(spark, monkeypatch):
    """A null and a repeated doc_id with many rows: rows of one key follow one another in some order that is the same in every run, and each key goes on to the next."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    rng = random.Random(5)
    ids, texts = [None] * 80 + [7] * 90 + rng.sample(range(8, 500), 60), [words(rng, 12) for _ in range(225)] + ["same"] * 5
    rows = fingerprints.with_next(docs(spark, texts, ids=ids)).collect()
    assert len(rows) == 230
    assert Counter(r.next_text for r in rows) == Counter(texts)  # a ring: every row is once the next one
    own = dict(zip(ids, texts, strict=True))
    order = sorted(i for i in set(ids) - {None, 7})
    next_of = {r.doc_id: r.next_text for r in rows if r.doc_id in order}
    assert all(next_of[a] == own[b] for a, b in zip(order, order[1:], strict=False))
    again = Counter((r.doc_id, r.text, r.next_text) for r in fingerprints.with_next(docs(spark, texts, ids=ids).repartition(7)).collect())
    assert again == Counter((r.doc_id, r.text, r.next_text) for r in rows)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 2**64, 40000, dtype=np.uint64)), np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    text = lambda x: fingerprints.to_text(fingerprints.sketch(x))
    for n, m in ((40000, 2000), (10, 20), (64, 1), (65, 3), (100, 700), (0, 5), (70, 70)):
        x, y = a[:: len(a) // n] if n else a[:0], b[:: len(b) // m]
        assert fingerprints.merge(text(x), text(y)) == text(np.union1d(x, y))
    both = np.union1d(a, b)
    assert fingerprints.from_text(text(a)).kept.tolist() == fingerprints.sketch(a).kept.tolist()
    assert fingerprints.containment(fingerprints.sketch(b), fingerprints.sketch(both)) == 1.0
    assert abs(fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(both)) - len(a) / len(both)) < 0.01
    none = fingerprints.sketch(np.zeros(0, np.uint64))
    assert fingerprints.likeness(none, none) == 1.0 and fingerprints.likeness(none, fingerprints.sketch(b)) == 0.0


# -- 10: shards -------------------------------------------------------------------------------------------


def plain_jump(key, buckets):
    key, b, j = key % 2**64, -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, 2, -1, 2**62, *range(1000, 1300)])
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    a, b = sharding.jump(np.arange(20000), 16), sharding.jump(np.arange(20000), 17)
    assert set(b[a != b]) == {16} and abs((a != b).mean() - 1 / 17) < 0.01


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    texts = ["é", None, "", "same", "same"] + [f"t{i}" for i in range(300)]
    ids = [None, None, 3, 4, 4, *range(5, 305)]
    got = sharding.shards(docs(spark, texts, ids=ids)).toPandas()
    assert len(got) == 305 and set(got.law) == {"key"}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert Counter(got["size"])[3] >= 1 and got[got.doc_id == 3]["size"].iloc[0] == 1 and got[got.doc_id == 3].text_crc32.iloc[0] == 0
    many = sharding.shards(docs(spark, ["same"] * 5000 + ["x"], ids=[1] * 5000 + [2])).toPandas()
    assert len(many) == 5001 and all(sorted(g.slot) == list(range(len(g))) for _, g in many.groupby("shard"))
    known = got[got.doc_id.notna()]
    assert known["shard"].tolist() == [plain_jump(int(i), 16) for i in known.doc_id]
    assert set(known["grown_shard"][known["shard"] != known["grown_shard"]]) <= {16}


# -- all: empty tables and null columns ---------------------------------------------------------------------


EVERY = {
    "bpe": bpe.digests, "langid": langid.predict_documents, "jaccard": jaccard.groups, "keep_one": jaccard.keep_one, "media": lambda d: media.media_features(media.store_texts(d)), "tokens": token_counts.count_tokens,
    "licenses": licenses.scan_documents, "mix": mixing.mix, "mixed": mixing.mixed, "fingerprints": fingerprints.compare_edited, "shards": sharding.shards,
}


@pytest.mark.parametrize("name", EVERY)
def test_empty_tables_and_null_columns(spark, name):
    assert EVERY[name](docs(spark, ["x"]).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,) * 8] * 3 + [(1, None, None, None, None, None, None, None)], SCHEMA)
    rows = EVERY[name](nulls).count()
    assert rows == (0 if name == "mixed" else 4)


ROWS = {k: v for k, v in EVERY.items() if k not in ("keep_one", "mixed")}


@pytest.mark.parametrize("name", ROWS)
def test_repeated_rows_and_very_long_texts(spark, name):
    """Every row gets a row, equal texts equal values, whatever the doc_id; a text of 3 MB is handled whole."""
    rng = random.Random(4)
    long, some = words(rng, 600_000), words(rng, 50)
    texts, ids = [some, some, words(rng, 9), long, some, None, ""], [1, 1, 1, 2, 3, 3, 3]
    rows = [r.asDict() for r in ROWS[name](docs(spark, texts, ids=ids, langs=["en", "en", "de", None, "en", "de", None])).collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    shown = {"bpe": "ids_sha256", "langid": "lang_pred", "jaccard": "n_shingles", "media": "media_sha256", "tokens": "n_tokens", "licenses": "licenses", "mix": "size", "fingerprints": "fingerprint", "shards": "text_crc32"}[name]
    for i, n in ((1, 2), (3, 2)):  # rows 0 and 1; the null and the empty text
        assert max(Counter(r[shown] for r in rows if r["doc_id"] == i).values()) >= n
    if name == "jaccard":
        assert next(r for r in rows if r["doc_id"] == 2)["n_shingles"] == len(shingles(long))
    if name == "tokens":
        assert next(r for r in rows if r["doc_id"] == 2)["over_limit"]


def test_licenses_in_repeated_rows_and_far_inside(spark):
    rng = random.Random(5)
    far = words(rng, 100_000) + ". Released under the MIT License. " + words(rng, 100_000)
    got = licenses.scan_documents(docs(spark, [far, far, "x"], ids=[1, 1, 1])).collect()
    assert Counter(r.licenses for r in got) == Counter({"MIT": 2, "": 1})


def test_each_license_notice_is_a_finding(spark):
    notice = lambda i: f"{'abc'[i]} licensed under the MIT license. "
    rows = licenses.scan_documents(docs(spark, ["".join(map(notice, range(3))), "\n".join(f"part{i}: licensed under the MIT license" for i in range(300))])).collect()
    got = {r.doc_id: r for r in rows}
    assert (got[0].n_findings, got[1].n_findings, got[0].differing_words) == (3, 300, 0)
    assert [f["offset"] for f in json.loads(got[0].findings)] == [2, 36, 70]


def test_license_windows_equal_brute_force_over_every_window():
    """Every stretch of a window's length, at every word, compressed with every template: the sliding windows find the same licenses at the same places."""
    rng, scanner = random.Random(11), licenses.Scanner()
    for round_ in range(25):
        parts = []
        for t in rng.choices(scanner.templates, k=3):
            own = list(t.words)
            if len(own) > 8 and rng.random() < 0.7:
                own[rng.randrange(len(own))] = "changed"
            parts += [rng.choice(["license", "copyright", "word"]), *own, *words(rng, rng.randrange(12)).split()]
        text = " ".join(parts)
        blocks, spans = scanner.blocks(text), [m.span() for m in licenses.TOKEN.finditer(text)]
        flat, places = [text[a:b].lower() for a, b in spans], {}
        for size, templates in scanner.by_window.items():
            for lo in range(len(flat)) if templates else ():
                near = flat[lo : lo + size]
                for _, t in scanner.ranked(near, size):
                    for i, j, diff in t.passages(near, Counter(near)):
                        places[t.name, t.k, lo + i, lo + j] = (t, diff)
        assert blocks and flat
        want = scanner.findings(text, spans, places)
        got = scanner.scan(text)[1]
        assert [(f["license"], f["offset"], f["length"]) for f in got] == [(f["license"], f["offset"], f["length"]) for f in want], round_
