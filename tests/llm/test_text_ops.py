import hashlib
import re
import zlib
from datetime import date, timedelta

import numpy as np
import pytest
from loomgraph.llm import language_id, license_scan, media, pii
from pyspark.sql import functions as F


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def keyed(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(a, b, ma, mb, key, tweak):
    for i in range(pii.ROUNDS):
        m = ma if i % 2 == 0 else mb
        a, b = b, (a + keyed(key, tweak, i, ma, mb, b) % m) % m
    return a, b


def permute(d, key, tweak):
    u = len(d) // 2
    v = len(d) - u
    a, b = feistel(int(d[:u]), int(d[u:]), 10**u, 10**v, key, tweak)
    return str(a).zfill(u) + str(b).zfill(v)


def test_pii_against_plain_python(spark):
    text = "a 4532015112830366 b 4111 1111 1111 1111 bad 4111111111111112 ip 10.0.0.1 not 300.1.1.1 day 2020-02-29 no 2021-02-29 31.12.1999"
    text += " ssn 123-45-6789 no 000-12-3456 tel +1 (663) 555-6869 iban DE89370400440532013000 no DE89370400440532013001 x.y.1@mail3.example.com"
    text += ' token = "11acdfb36bb72224148e6160f674b4be45601bff" v1.2.3.4.5'
    df = spark.createDataFrame([(1, text, "x"), (2, text, "x"), (3, None, "x"), (4, "", "x"), (5, "clean text, nothing here", "x")], "doc_id long, text string, pii_kinds string")
    out = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    new = out[1].text
    assert out[2].text == new and out[3].text is None and out[4].text == "" and out[5].text == "clean text, nothing here" and out[3].pii_kinds == []
    card = permute("453201511283036", "k", "card")
    assert re.search(rf"a {card}\d b", new) and luhn(re.search(r"a (\d{16}) b", new)[1])
    grouped = re.search(r"b (\d{4} \d{4} \d{4} \d{4}) bad", new)[1]
    assert luhn(grouped.replace(" ", "")) and grouped != "4111 1111 1111 1111"
    a, b = feistel(10 * 256, 1, 65536, 65536, "k", "ip")
    assert f"ip {a // 256}.{a % 256}.{b // 256}.{b % 256} not 300.1.1.1 " in new
    x = (date(2020, 2, 29) - date(1900, 1, 1)).days
    while True:
        p, q = feistel(x // 300, x % 300, 300, 300, "k", "date")
        x = p * 300 + q
        if x < pii.DAYS:
            break
    assert f"day {date(1900, 1, 1) + timedelta(x)} no 2021-02-29 " in new and "31.12.1999" not in new
    assert re.search(r"ssn \d{3}-\d{2}-\d{4} no 000-12-3456", new) and "123-45-6789" not in new
    assert f"+1 ({(t := permute('6635556869', 'k', 'phone'))[:3]}) {t[3:6]}-{t[6:]}" in new
    iban = re.search(r"iban (\w+) no DE89370400440532013001", new)[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert "x.y.1" not in new and "11acdfb36bb7" not in new and "v1.2.3.4.5" in new and "bad 4111111111111112" in new
    assert out[1].pii_kinds == ["card", "card", "ip", "date", "date", "ssn", "phone", "iban", "email", "secret"]


def test_pii_is_a_bijection(spark):
    df = spark.range(0, 2000).select((F.col("id") * 37).alias("n"))
    for size, a, b in ((pii.DAYS, 300, 300),):
        out = df.select(pii._walk(F.col("n"), size, a, b, "k", "t").alias("m")).distinct()
        assert out.count() == 2000 and out.agg(F.max("m")).first()[0] < size
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pii.permute_digits(F.col("d"), "k", "t").alias("e")).distinct().count() == 1000


def test_language_id(spark, docs, no_docs, rows):
    labelled = docs.where(~language_id.held_out(F.col("doc_id")))
    got = language_id.identify(docs, labelled).collect()
    assert len(got) == len(rows)
    truth = {i: (t, g) for i, t, g, _ in rows}
    right = total = 0
    for r in got:
        text, lang = truth[r.doc_id]
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 60 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            total += 1
            right += r.lang_pred == lang
    assert right >= 0.9 * total > 0
    kept = language_id.keep_identified(docs, labelled)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t, *_ in rows if any(c.isalpha() for c in t or ""))
    assert language_id.identify(no_docs, labelled).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs, no_docs).collect()} == {"und"}


def test_profiles_against_counting():
    from collections import Counter

    text = "Abc abc, b!é"
    letters, offs = language_id._letters(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    grams, counts = language_id.gram_counts(letters)
    s = " abc abc b é "
    want = Counter(c for c in s if c != " ") + Counter(s[i : i + 2] for i in range(len(s) - 1)) + Counter(s[i : i + 3] for i in range(len(s) - 2))

    def name(g):
        out = ""
        while g:
            out = (" " if g & (2**21 - 1) == 1 else chr(g & (2**21 - 1))) + out
            g >>= 21
        return out

    assert {name(int(g)): int(n) for g, n in zip(grams, counts)} == dict(want)


def test_gram_counts_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    letters = np.where(rng.random(500) < 0.2, 1, rng.integers(97, 101, 500)).astype(np.uint32)
    whole = language_id.gram_counts(letters)
    for block in (1, 2, 3, 64):
        monkeypatch.setattr(language_id, "BLOCK", block)
        got = language_id.gram_counts(letters)
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()


def test_out_of_place_distance_against_plain_python():
    """Prediction and score by ranks in plain lists."""
    rng = np.random.default_rng(2)
    rows, size = [], 12
    for lang in ("aa", "bb", "cc"):
        rows += [(lang, int(g), k) for k, g in enumerate(rng.choice(np.arange(2, 60), size, replace=False))]
    profiles = language_id.Profiles(rows, size)
    for n in (1, 5, 12):
        grams = rng.choice(np.arange(2, 80), n, replace=False).astype(np.uint64)
        total = {}
        for lang in ("aa", "bb", "cc"):
            rank = {g: k for la, g, k in rows if la == lang}
            total[lang] = sum(abs(rank[int(g)] - i) if int(g) in rank else size for i, g in enumerate(grams))
        best = min(total, key=lambda x: (total[x], x))
        lang, score = profiles.predict(grams)
        assert lang == best and abs(score - (1 - total[best] / (size * n))) < 1e-12


def test_broken_bytes_are_no_letters():
    rows = [b"abc", b"\xff\xfe", b"d\xc3"]
    letters, offs = language_id._letters(np.frombuffer(b"".join(rows), np.uint8), np.array([0, 3, 5, 7]))
    assert [letters[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [[97, 98, 99], [1], [100, 1]]


def test_media_round_trips():
    rng = np.random.default_rng(3)
    for shape in ((1, 1, 3), (5, 7, 3), (64, 3, 3)):
        p = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_netpbm(p)) == p).all() and (media.decode(media.encode_bmp(p)) == p).all()
        assert (media.decode(media.encode_netpbm(p[:, :, 0])) == p[:, :, 0]).all()
    assert (media.decode(b"P3 # c\n2 1 255\n1 2 3 4 5 6\n") == [[[1, 2, 3], [4, 5, 6]]]).all()
    assert (media.decode(b"P2\n2 1\n9\n8 9\n") == [[8, 9]]).all()
    assert (media.decode(b"P1\n3 1\n101\n") == [[0, 1, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 1, 0]]).all()


def test_area_resize_is_the_mean_area():
    rng = np.random.default_rng(4)
    for h, w, th, tw in ((9, 7, 4, 3), (3, 2, 5, 7), (64, 64, 8, 9), (1, 1, 2, 2)):
        x = rng.integers(0, 256, (h, w))
        fine = np.repeat(np.repeat(x, th, axis=0), tw, axis=1)
        want = fine.reshape(th, h, tw, w).mean(axis=(1, 3))
        assert np.abs(media.area_resize(x, th, tw) - want).max() <= 0.5


def test_media_features(spark, docs, no_docs, rows):
    import io

    for form in ("netpbm", "bmp"):
        stored = media.texts_to_media(docs, form)
        assert stored.inputFiles() and all(m.media[:2] == (b"P6" if form == "netpbm" else b"BM") for m in stored.collect())
        tiled = media.media_digests(stored, side=32, tile=16)
        got = media.with_feature(tiled).collect()
        want = {}
        for i, text, *_ in rows:
            b = (text or "").encode()
            p = b + b" " * ((-len(b)) % 192 or (192 if not b else 0))
            image = media.gray(np.frombuffer(p, np.uint8).reshape(-1, 64, 3))
            parts = media.tiles(image, 32, 16)
            crc = zlib.crc32(b"".join(np.load(io.BytesIO(npy)).tobytes() for *_, npy, _ in parts))
            feature = "-".join([f"{media.difference_hash(image):016x}", *(f"{h:016x}" for *_, h in parts), f"{crc:08x}"])
            want[(i, len(b))] = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), feature)
        assert len(got) == len(rows) and all(want[(r.doc_id, r.n_bytes)] == (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got)
        first = tiled.where("doc_id = 1").first().tiles
        assert [np.load(io.BytesIO(bytes(t.npy))).shape for t in first] == [(16, 16)] * 4
        by = {}
        for r in got:
            assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        assert media.with_feature(media.media_digests(media.texts_to_media(no_docs, form))).collect() == []
    good = media.encode_bmp(np.full((3, 3, 3), 7, np.uint8))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"P6\n9 9\n255\nxx")), (5, bytearray(b"BM"))], "media_id long, media binary")
    out = {r.media_id: r for r in media.media_tiles(df).collect()}
    assert out[1].error is None and len(out[1].tiles) == 4 and np.load(io.BytesIO(bytes(out[1].tiles[0].npy))).shape == (32, 32)
    assert all(out[i].error and out[i].tiles is None for i in (2, 3, 4, 5))


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_license_base_places(spark, docs, no_docs, rows):
    texts = [
        "Released under the MIT License. mit, license MIT-license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3. The mit license",
        "amit license mit licenses", "SPDX-License-Identifier: GPL-2.0-or-later", None, "", "general public\nlicense\x00license", "MİT license mit license", "Licensed under CC BY-NC 4.0.",
    ]
    every = [(1000 + i, t) for i, t in enumerate(texts)] + [(i, t) for i, t, *_ in rows]
    df = spark.createDataFrame([(i, t, "x") for i, t in every], "doc_id long, text string, labels string")
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan(df).collect()}
    for i, t in every:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = WORD.findall(low)
        places, labels = [], set()
        for label, phrase in license_scan.BASE:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = got[(i, len(w))]
        assert r.n_base == len(places) and (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | (set() if labels else {""})
        assert 0 <= r.score <= 1 and list(r.labels.split(",")) == sorted(set(r.labels.split(",")))
    by = {i: r.labels.split(",") for (i, _), r in got.items() if i and i >= 1000}
    assert "apache-2.0" in by[1001] and "apache-unversioned" not in by[1001] and "gpl-3.0" in by[1002] and "gpl-2.0" in by[1004] and "cc-by-nc-4.0" in by[1009]
    assert license_scan.scan(no_docs).collect() == []


def test_rules_compile():
    made = license_scan.rules()
    assert len(made) > 250
    for _, _, strength, regex, words in made:
        re.compile(regex)
        assert all(w == w.lower() for w in words) and 0 < strength <= 1


@pytest.mark.parametrize("name", ["op1_exact_topk", "op9_mixing"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
