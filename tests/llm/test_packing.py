import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from corpuskiln.llm import packing

from .fixtures import rows, table


def test_pieces_equal_the_tokenizer_and_sequences_are_gapless(spark):
    data = [*rows(), (900, "a <|endoftext|> b"), (901, "tab\tand  two\n\nlines ¿qué? naïve — “x” it's 12345 don't"), (902, "a b c")]
    t = Tokenizer.from_file(packing.vocabulary_paths()[0])
    want = Counter()
    for i, text in data:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for s in range(0, len(ids), 1024):
            want[(i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids))] += 1
    got = packing.pack(table(spark, data)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 1024
    assert sum(used.values()) / (1024 * len(used)) > 0.9


def test_ids_and_empty_table(spark):
    got = packing.pack(table(spark, [(1, "hello world"), (2, None)]), with_ids=True).collect()
    assert {r.doc_id: r.ids[-1] for r in got} == {1: 0, 2: 0}
    assert packing.pack(table(spark, [])).count() == 0


def test_histogram_packing_keeps_every_length():
    hist = {1: 5000, 3: 7, 600: 40, 500: 10, 1024: 3, 333: 100}
    patterns = packing.spfhp(hist)
    total = Counter()
    for pattern, count in patterns:
        assert sum(n * k for n, k in pattern) <= 1024
        for n, k in pattern:
            total[n] += k * count
    assert total == hist
