"""The random field: decoding against enumeration, and recall on forms that the labelled table does not have."""

import itertools
import random

import numpy as np

from corpuskiln.llm import pii
from corpuskiln.llm import textops as T

from .fixtures import rows, words


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(3)
    for n in range(1, 7):
        u, move = rng.normal(size=(5, n, 3)), rng.normal(size=(3, 3))
        got = pii.viterbi(u, np.full(5, n), move)
        for b in range(5):
            score = lambda y, b=b, n=n: sum(u[b, t, y[t]] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n))
            best = max(itertools.product(range(3), repeat=n), key=score)
            assert tuple(got[b]) == best


def _texts():
    rng = random.Random(2)
    out = [t or "" for _, t in rows()] + [" ".join(pii._labelled(line)[0]) for line in pii.TRAINING]
    for _ in range(40):
        w = words(rng, 40).split()
        for _ in range(5):
            w[rng.randrange(40)] = rng.choice(["token", "=", "Password:", "7f3a9c0e1b2d4f68a9", '"x9y8z7w6v5"', "(2019)", "KEY", "ß9ü", "...", "Zürich"])
        out.append(" ".join(w))
    return out


def test_cut_sequences_decode_as_whole_ones():
    field = pii.Field(pii.train())
    for text in _texts():
        data, off = T.flat(pii.pa.array([text], pii.pa.large_string()))
        w = T.find_words(data, off)
        if len(w.start):
            u = field.emit[pii._features([text.encode()[a:b].decode() for a, b in zip(w.start, w.end, strict=True)])].sum(1)
            assert np.allclose(u, field.unary(data, w))
            whole = pii.viterbi(u[None], np.array([len(u)]), field.move)[0] == 2
            assert (field.secret_words(data, off, w) == whole).all()


def test_word_kinds_tell_all_features():
    data, off = T.flat(pii.pa.array(_texts(), pii.pa.large_string()))
    w = T.find_words(data, off)
    seen = {}
    for k, a, b in zip(pii.word_kinds(data, w).tolist(), w.start, w.end, strict=True):
        f = pii._word_features(data[a:b].tobytes().decode())
        assert seen.setdefault(k, f) == f


def test_recall_on_forms_not_in_the_table():
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(n // 2)) + str(rng.randint(10, 999)) + "".join(rng.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(n // 2)) + str(rng.randint(10, 99))
    forms = [
        "we saw the token {} in a mail", "client_secret {} was pushed", "Bearer {} came back with an error", "password of the host: {} and that was it", "please rotate {} before noon",
        "export SESSION {} now", "TOKEN: {}, they wrote", "his old password {} still works", "the hash {} appears twice", "key -> {} ;",
    ]
    field, found, total, wrong = pii.Field(pii.train()), 0, 0, 0
    for form in forms:
        for _ in range(20):
            secret = rng.choice([hexa(32), hexa(40), mixed(12)]) if "password" in form or "key" in form or "token" in form.lower() else rng.choice([hexa(32), hexa(40)])
            text = words(rng, 12) + " " + form.format(secret) + " " + words(rng, 12)
            (spans,) = pii.secrets([text], field)
            hit = any(text[a:b] == secret for a, b in spans)
            found, total, wrong = found + hit, total + 1, wrong + len(spans) - hit
    assert found >= 0.9 * total and wrong <= 0.02 * total, (found, total, wrong)
    clean = [words(rng, 60) + f" {rng.randint(1, 99999)} items on {rng.randint(1, 12)}/{rng.randint(1, 28)}/2024 at {rng.randint(1, 12)}:30, room {rng.randint(1, 400)}b, v{rng.randint(1, 9)}.{rng.randint(1, 9)}" for _ in range(200)]
    assert sum(bool(x) for x in pii.secrets(clean, field)) <= 2
