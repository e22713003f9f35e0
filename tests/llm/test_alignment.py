import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpuskiln.llm import alignment

from .fixtures import rows, table


def unmap():
    """Byte-level vocabularies write each byte as one character: printable ones as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(data):
    t, of = Tokenizer.from_file(P.path("byte_bpe_50k.json")), unmap()
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def spans(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs = []
    for i, text in data:
        a = [(x, bytes(of[c] for c in t.id_to_token(x))) for x in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(x, bytes([int(p[3:5], 16)]) if m.is_byte(x) else p.replace("▁", " ").encode()) for x in m.encode(text) for p in [m.id_to_piece(x)]] if text else []
        if any(b"".join(r for _, r in side) != (" " + text).encode() for side in (a, b) if text):
            a = b = []
        a, b = spans(a), spans(b)
        links = [(x, y) for x, lo, hi in a for y, s, e in b if lo < e and s < hi]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, _, e in a if last < e <= c) + "|" + ",".join(str(x) for x, _, e in b if last < e <= c))
            last = c
        docs.append((i, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for d in docs for p in set(d[4]))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return Counter((i, n_a, n_b, g, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha) for i, n_a, n_b, g, links, sha in docs)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    odd = ["a <|endoftext|> b <s> c </s>", "  two  blanks ", "tab\tand\nline\n\n ¿qué? naïve — “x” it's 12345 don't", "mark ▁ here", "日本 語 🙂🙂 x", "\x00\x01 z", " ", "\n", "é è à", "a b  c", "aaa" * 300]
    texts = ["".join(rng.choice("ab é.,'1\n\t▂<") for _ in range(60)) for _ in range(60)]
    short = [(i, t) for i, t in rows() if len(t or "") < 6000]
    return [*short, *((1000 + i, t) for i, t in enumerate(odd + texts)), (None, "no id")]


def test_equal_to_brute_force(spark, data):
    assert Counter(tuple(r) for r in alignment.align(table(spark, data)).collect()) == brute(data)


def test_without_broadcast(spark, data):
    assert Counter(tuple(r) for r in alignment.align(table(spark, data), broadcast_pairs=0).collect()) == brute(data)


def test_empty_table(spark):
    assert alignment.align(table(spark, [])).count() == 0
