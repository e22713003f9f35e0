import hashlib

import numpy as np

from corpuskiln.llm import suffixes

from .fixtures import rows, table


LENGTH_BYTES = 50


def marked_bytes(data):
    """For each document of distinct ids: which bytes a 50-byte string of a smaller document covers."""
    return {i: m for i, _, m in _marked(data)}


def _marked(data):
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            first[g] = min(first.get(g, i), i)
    for i, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k] += 1
                gone[k + 50] -= 1
        yield i, b, np.cumsum(gone)[:-1] > 0


def brute(data):
    out = []
    for i, b, gone in _marked(data):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    data = rows()
    got = suffixes.remove_repeats(table(spark, data)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(data)


def test_texts_and_null_ids(spark):
    passage = "é" * 60
    got = {r.doc_id: r.kept for r in suffixes.remove_repeats(table(spark, [(1, "abc " + passage), (2, passage + " xyz"), (None, passage)]), texts=True).collect()}
    assert got[1] == "abc " + passage
    assert got[2] == " xyz"
    assert got[None] == passage


def test_empty_table(spark):
    assert suffixes.remove_repeats(table(spark, [])).count() == 0


def test_documents_that_share_nothing(spark):
    for data in ([(1, "a" * 70)], [(1, "some text " * 3 + "x" * 40), (2, "quite another one " + "y" * 60)], [(1, "short"), (2, "tiny")]):
        got = suffixes.remove_repeats(table(spark, data).repartition(13)).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(data)


def test_texts_with_equal_polynomials_are_not_equal(spark):
    """Polynomials modulo 2^64 of these two texts agree for any odd base; no byte of them does."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    data = [(1, "".join("ab"[x] for x in bits)), (2, "".join("ba"[x] for x in bits))]
    one, two = (np.frombuffer(t.encode(), dtype=np.uint8) for _, t in data)
    assert (one != two).all()
    keys = suffixes.text_keys(np.concatenate([one, two]), np.array([0, 2048, 4096]))
    assert (keys[0] != keys[1]).any()
    got = suffixes.remove_repeats(table(spark, data)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(data)


def test_refine_tells_equal_strings():
    rng = np.random.default_rng(11)
    text = np.concatenate([rng.integers(97, 99, 300), np.tile([97, 98, 98], 100), rng.integers(97, 99, 300), np.full(200, 97)]).astype(np.uint8)
    text = np.concatenate([text, text[:400]])
    end = np.repeat([900, 1100, 1500], [900, 200, 400])
    at = np.flatnonzero(np.arange(len(text)) + 50 <= end)
    ids = suffixes.refine(text, end, at)
    want = {}
    for i, p in zip(ids.tolist(), at.tolist()):
        assert want.setdefault(text[p : p + 50].tobytes(), i) == i
    assert len(set(want.values())) == len(want)


def test_many_contexts_of_one_gram(spark):
    rng = __import__("random").Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(75))
    data = [(i, "".join(rng.choice("xyzw ") for _ in range(40)) + passage[: rng.randint(55, 75)] + "".join(rng.choice("qrst") for _ in range(30))) for i in range(60)]
    got = suffixes.remove_repeats(table(spark, data)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(data)
