import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomgraph.llm import packing, token_counts
from loomgraph.llm.common import text_buffer
from loomgraph.llm.tokens import WordTokenizer, default_tokenizer
from tokenizers import Tokenizer

TOK = Tokenizer.from_file(default_tokenizer())


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def encode(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    out = []
    for lo, hi, flat, offs in WordTokenizer.at(default_tokenizer()).encode(raw, offsets):
        out += [flat[offs[i] : offs[i + 1]].tolist() for i in range(hi - lo)]
    return out


def test_same_as_the_library():
    texts = [f"a{chr(i)}b {chr(i)}{chr(i)} 1{chr(i)} {chr(i)}É" for i in range(1, 0x180)] + ["it's don't !'s", "<|endoftext|> x", "", " \n ", "日本語 é12ab"]
    assert encode(texts) == [ids(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'stmdrevl !.1aé\u00a0", max_size=12), min_size=1, max_size=6))
def test_apostrophes(texts):
    assert encode(texts) == [ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_same_as_the_library_on_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode(texts) == [ids(t) for t in texts]


def test_broken_bytes_do_not_crash():
    rows = [b"ok caf\xc3\xa9", b"bad \xc3", b"\xa9 lone", b"\xc3(x", b"\xff\xfe", b""]
    raw, offsets = text_buffer(pa.array(rows, pa.binary()))
    out = []
    for lo, hi, flat, offs in WordTokenizer.at(default_tokenizer()).encode(raw, offsets):
        out += [flat[offs[i] : offs[i + 1]].tolist() for i in range(hi - lo)]
    assert out == [ids(r.decode("utf-8", "replace")) for r in rows]


def check_packing(out, rows, cap=4096, documents=None, attention=None):
    by_doc, bins = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, text, *_ in rows:
        whole = [*ids(text), 1]
        parts = sorted((r for r in by_doc[i]), key=lambda r: (r.piece, r.sequence_id))
        times = sum(1 for j, *_ in rows if j == i)
        for k in range(times):
            mine = parts[k::times]
            assert [r.piece for r in mine] == list(range(len(mine)))
            for r in mine:
                part = np.array(whole[r.start : r.start + r.length], "<u4")
                assert r.start == r.piece * cap and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
            assert sum(r.length for r in mine) == len(whole)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
        assert documents is None or len(rs) <= documents
        assert attention is None or sum(r.length**2 for r in rs) <= attention
    return bins


def test_packing(docs, no_docs, rows):
    out = packing.best_fit_pack(docs).collect()
    bins = check_packing(out, rows)
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 4096) + 1
    assert packing.best_fit_pack(no_docs).collect() == []


def test_packing_under_every_capacity(docs, rows):
    for rule in ("norm", "dot"):
        out = packing.best_fit_pack(docs, documents=4, attention=9_000_000.0 + 4096**2, rule=rule).collect()
        check_packing(out, rows, documents=4, attention=9_000_000 + 4096**2)
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([10, 4000]), 4096, 10, 1000.0)


def test_vector_best_fit_against_plain_python():
    """Every choice of bin, by both rules, with capacities that bind."""
    rng = np.random.default_rng(9)
    for rule, weights in itertools.product(("norm", "dot"), ((1.0, 1.0, 1.0), (1.0, 1e-3, 1e-3), (0.2, 2.0, 0.5))):
        lengths = rng.integers(1, 60, 150)
        caps = (100, 4, 4000.0)
        where, offset = packing.vector_best_fit(lengths, *caps, weights=weights, rule=rule)
        bins: list[list[int]] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            best = None
            for k, b in enumerate(bins):
                left = [caps[0] - sum(b), caps[1] - len(b), caps[2] - sum(x * x for x in b)]
                need = [lengths[i], 1, lengths[i] ** 2]
                if all(x >= y for x, y in zip(left, need)):
                    a, w = [x / c for x, c in zip(left, caps)], [y / c for y, c in zip(need, caps)]
                    score = -sum(v * (x - y) ** 2 for v, x, y in zip(weights, a, w)) if rule == "norm" else sum(v * x * y for v, x, y in zip(weights, a, w))
                    if best is None or score > best[0] + 1e-12:
                        best = (score, k)
            k = best[1] if best else len(bins)
            bins += [] if best else [[]]
            assert (where[i], offset[i]) == (k, sum(bins[k]))
            bins[k].append(int(lengths[i]))
        assert any(len(b) == 4 for b in bins) and any(sum(x * x for x in b) > 3000 for b in bins)


def test_token_counts(docs, no_docs, rows):
    want = {}
    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    for i, text, *_ in rows:
        want.setdefault(i, []).append(len(tok.encode(text or "", add_special_tokens=False).ids))
    for block in (7, 64, 1 << 20):
        got = {}
        for r in token_counts.token_counts(docs, block=block).collect():
            got.setdefault(r.doc_id, []).append(r.n_tokens)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_counts.token_counts(no_docs).collect() == []


def test_unended_tail(spark, tmp_path):
    np.array([5, 6, 9, 9, 7, 9, 8, 8, 8], "<u2").tofile(tmp_path / "x.bin")
    files = spark.createDataFrame([("x.bin", 9)], "file string, file_tokens long")
    for block in (1, 2, 3, 100):
        got = sorted(tuple(r) for r in token_counts.scan_token_files(spark, files, f"file://{tmp_path}", 9, block).collect())
        assert got == [("x.bin", 0, 2, True), ("x.bin", 1, 0, True), ("x.bin", 2, 1, True), ("x.bin", 3, 3, False)]
