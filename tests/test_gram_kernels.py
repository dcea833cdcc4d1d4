"""The kernels of the text index, called without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest

from chronofold.operators import gram_kernels as K


def batches(rows, size):
    t = pa.table({"words": pa.array([w for _, _, w in rows]), "block": pa.array([b for b, _, _ in rows], pa.int64()), "place": pa.array([p for _, p, _ in rows], pa.int32())})
    return iter(t.to_batches(max_chunksize=size))


def texts(n):
    rnd = random.Random(n)
    bits = ["ab", "abc", "the ", "é", "漢字", " ", "x_y", "𝔸", "123"]
    words = ["".join(rnd.choice(bits if i % 5 else bits[:3]) for _ in range(rnd.randrange(12))) for i in range(n)]
    return [(i // 37, i % 37, w) for i, w in enumerate(words)]


def held(rows, size):
    out = {}
    for b in K.postings(batches(rows, size)):
        for r in b.to_pylist():
            at = K.unpacked(r["held"]).tolist()
            assert r["n"] == len(at) == len(set(at))
            for a in at:
                assert (r["gram"], r["block"], a) not in out
                out[r["gram"], r["block"], a] = True
    return set(out)


@pytest.mark.parametrize("size,piece,kept", [(1000, 1 << 20, 1 << 18), (10, 1 << 20, 1 << 18), (50, 30, 40)])
def test_postings_hold_every_run(monkeypatch, size, piece, kept):
    monkeypatch.setattr(K, "SLICE_BYTES", piece)
    monkeypatch.setattr(K, "KEPT", kept)
    rows = texts(200)
    assert held(rows, size) == {(w[i:i + 3], b, p) for b, p, w in rows for i in range(len(w) - 2)}


def test_bytes_that_are_no_text():
    words = pa.array([b"abc", b"\xffabd", "é12".encode()]).cast(pa.binary())
    words = pa.Array.from_buffers(pa.string(), 3, words.buffers())
    batch = pa.RecordBatch.from_arrays([words, pa.array([5] * 3, pa.int64()), pa.array([0, 1, 2], pa.int32())], ["words", "block", "place"])
    got = {(r["gram"], a) for b in K.postings(iter([batch])) for r in b.to_pylist() for a in K.unpacked(r["held"]).tolist()}
    assert {("abc", 0), ("abd", 1), ("é12", 2)} <= got


@pytest.mark.parametrize("n", [0, 1, K.AS_BITS - 1, K.AS_BITS, 9000, K.PLACES])
def test_places_are_packed(n):
    rnd = np.random.default_rng(n)
    at = np.sort(rnd.choice(K.PLACES, n, replace=False))
    assert K.unpacked(K.packed(at)).tolist() == at.tolist() and len(K.packed(at)) <= 4096
    for m in (3, 20_000):
        other = np.sort(rnd.choice(K.PLACES, m, replace=False))
        assert K._among(other, K.packed(at)).tolist() == np.intersect1d(other, at).tolist()


@pytest.mark.parametrize("size,tested", [(1000, 1 << 24), (7, 1 << 24), (7, 1)])
def test_found_are_the_texts_that_hold_a_needle(monkeypatch, size, tested):
    monkeypatch.setattr(K, "TESTED_BYTES", tested)
    rows = texts(300)
    asked = [(10 * i, t, sorted({t[j:j + 3] for j in range(len(t) - 2)})[:4]) for i, t in enumerate(["the ab", "abc", "漢字ab", "x_y123", "none such", "𝔸𝔸𝔸", "ababab"])]
    postings = [(r["block"], -1, r["gram"], r["held"], None, None) for b in K.postings(batches(rows, 11)) for r in b.to_pylist()]
    given = sorted(postings + [(b, p, None, None, 1000 * b + p, w) for b, p, w in rows], key=lambda r: r[:2])
    types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    t = pa.table([pa.array([r[i] for r in given], ty) for i, ty in enumerate(types)], names=["block", "place", "gram", "held", "id", "words"])
    got = [(r["id"], no) for b in K.Needles(asked).found(iter(t.to_batches(max_chunksize=size))) for r in b.to_pylist() for no in r["nos"]]
    assert sorted(got) == sorted((1000 * b + p, no) for b, p, w in rows for no, text, _ in asked if text in w)
