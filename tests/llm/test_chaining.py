"""Passages whose seeds have different least documents, against brute force."""

import random

import numpy as np
import pyarrow as pa

from corpuskiln.llm import chaining
from corpuskiln.llm import textops as T
from corpuskiln.llm.common import bucket_of

from .fixtures import table, words


def covered(got, doc):
    return {w for r in got if r.doc_id == doc for w in range(r.start_word, r.start_word + r.n_words)}


def test_parts_in_smaller_documents(spark):
    rng = random.Random(11)
    p = words(rng, 60).split()
    fill = lambda n: words(rng, n).split()
    texts = {1: fill(40) + p[:30] + fill(40), 2: fill(40) + p[30:] + fill(40), 3: fill(30) + p + fill(20), 4: fill(10) + p + fill(50)}
    got = chaining.passages(table(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.src_doc_id, r.src_start_word, r.n_match) for r in got] == [(4, 10, 60, 3, 30, 60)]


def test_changed_passage_in_parts(spark):
    rng = random.Random(12)
    p = words(rng, 62).split()
    fill = lambda n: words(rng, n).split()
    texts = {1: fill(40) + p[:31] + fill(40), 2: fill(40) + p[31:] + fill(40), 3: fill(30) + p + fill(20), 4: fill(10) + p[:30] + ["changed"] + p[31:] + fill(50)}
    got = chaining.passages(table(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.src_doc_id, r.n_match) for r in got] == [(4, 10, 62, 3, 61)]


def test_unchanged_runs_against_brute_force(spark):
    rng = random.Random(13)
    parts = [words(rng, rng.randint(5, 45)).split() for _ in range(25)]
    texts = {}
    for i in range(120):
        own = []
        for _ in range(rng.randint(2, 9)):
            k = rng.randrange(len(parts))
            own += rng.choice([parts[k], parts[k] + parts[(k + 1) % 25], parts[k] + parts[(k + 1) % 25] + parts[(k + 2) % 25], parts[k][3:], words(rng, 6).split()])
        texts[i] = own
    got = chaining.passages(table(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()
    first, n = {}, chaining.MIN_WORDS
    for i, t in texts.items():
        for k in range(len(t) - n + 1):
            first.setdefault(tuple(t[k : k + n]), i)
    missed, asked = 0, 0
    for i, t in texts.items():
        want = {w for k in range(len(t) - n + 1) if first[tuple(t[k : k + n])] < i for w in range(k, k + n)}
        missed, asked = missed + len(want - covered(got, i)), asked + len(want)
    assert asked > 5000 and missed == 0
    for r in got:
        a, b = texts[r.doc_id][r.start_word :][: r.n_words], texts[r.src_doc_id][r.src_start_word :][: r.src_n_words]
        assert r.src_doc_id < r.doc_id and len(a) == r.n_words >= n and len(b) == r.src_n_words and r.identity >= chaining.IDENTITY


def quadratic(p0, q0, size):
    """Best score of a chain that ends with each segment."""
    score = [0.0] * len(p0)
    for i in sorted(range(len(p0)), key=lambda i: p0[i]):
        score[i] = size[i]
        for j in range(len(p0)):
            a, b = p0[i] - p0[j] - size[j], q0[i] - q0[j] - size[j]
            if 0 <= a <= chaining.MAX_GAP and 0 <= b <= chaining.MAX_GAP:
                score[i] = max(score[i], size[i] + max(0, score[j] - chaining.GAP_COST * (a + b)))
    return score


def test_best_chain_against_quadratic():
    rng = random.Random(14)
    for n in (2, 5, 20, 80):
        for span in (60, 300, 1500):
            for _ in range(20):
                size = [rng.choice((8, 9, 12, 40, 200)) for _ in range(n)]
                p0 = [rng.randrange(span) for _ in range(n)]
                q0 = [max(0, p + rng.randint(-20, 20)) if rng.random() < 0.7 else rng.randrange(span) for p in p0]
                score = quadratic(p0, q0, size)
                chains = chaining.chain(p0, q0, size)
                assert sorted(i for c in chains for i in c) == list(range(n))
                best, at = 0.0, max(chains, key=lambda c: score[c[-1]])
                for j, i in zip([None, *at], at):
                    best = size[i] + (0 if j is None else best - chaining.GAP_COST * (p0[i] - p0[j] - size[j] + q0[i] - q0[j] - size[j]))
                assert abs(best - max(score)) < 1e-6


def test_near_segments_after_a_long_one():
    """A long copy, a replaced paragraph of 100 words, then an edit every 30 words."""
    p0 = [0, *range(10_100, 12_000, 31)]
    got = chaining.chain(p0, list(p0), [10_000, *[30] * (len(p0) - 1)])
    assert sorted(got) == [[0], list(range(1, len(p0)))]


def test_anchors_do_not_grow_with_the_buckets():
    rng = np.random.default_rng(5)
    h, doc, pos = rng.integers(0, 300, 3000).astype(np.uint64), rng.integers(0, 500, 3000), rng.integers(0, 9, 3000).astype(np.uint32)

    def made(n):
        where = bucket_of(T.mix64(h), n)
        seeds = pa.RecordBatch.from_pylist([{"bucket": int(b), "h": h[where == b].tobytes(), "doc": doc[where == b].tobytes(), "pos": pos[where == b].tobytes()} for b in np.unique(where)], schema=chaining._SEEDS)
        keys = seeds.append_column("pos2", seeds.column(3))
        return [sum(b.num_rows for b in join([x], n)) for join, x in ((chaining._join_seeds, seeds), (chaining._join_keys, keys))]

    assert made(4) == made(400)
