import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from corpuskiln.llm import grammar, packing

from .fixtures import rows, table


def brute(data):
    t = Tokenizer.from_file(packing.vocabulary_paths()[0])
    out, start = [], 0
    for i, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


def test_round_trip_and_random_access(spark, tmp_path):
    data = [*rows(), (900, "a <|endoftext|> b"), (901, "tab\tand  two\n\nlines ¿qué? naïve — “x” it's 12345"), (None, "no id"), (902, "la " * 5000)]
    want = brute(data)
    place = str(tmp_path / "shards")
    grammar.write(table(spark, data), place, shard_tokens=2000)
    got = grammar.read(spark, place, with_ids=True).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in got) == [(s, i, n, c, ids) for i, s, n, c, ids in want]
    assert spark.read.parquet(f"{place}/shards").count() > 5
    rng, own = random.Random(1), {i: ids for i, _, _, _, ids in want}
    asked = [(i, lo := rng.randint(0, len(ids)), lo + rng.randint(0, 40)) for i, ids in own.items() if i is not None for _ in range(3)]
    found = grammar.read_ranges(spark, place, spark.createDataFrame([*asked, (10**6, 0, 5)], "doc_id long, lo long, hi long")).collect()
    once = {i for i in own if sum(r[0] == i for r in data) == 1}
    assert sorted((r.doc_id, r.lo, r.hi, r.ids) for r in found if r.doc_id in once) == sorted((i, lo, hi, own[i][lo:hi]) for i, lo, hi in asked if i in once)
    assert 10**6 not in {r.doc_id for r in found}


def test_grammar_of_a_shard():
    rng = np.random.default_rng(2)
    for ids, cuts in ((np.full(5000, 7), [0, 1, 2500, 5000]), (rng.integers(0, 4, 9000), [0, 9000]), (rng.integers(0, 50_000, 3000), [0, 3000]), (np.tile(rng.integers(0, 60, 300), 40), [0, 5000, 12000]), (np.zeros(1), [0, 1])):
        ids, first = ids.astype(np.int64), np.array(cuts)
        body = grammar.pack_shard(ids, first)
        shard = grammar.Shard(body)
        assert shard.ids().tolist() == ids.tolist()
        ends = np.cumsum(np.append(np.ones(shard.base, dtype=np.int64), shard.lengths)[shard.symbols.astype(np.int64)])
        assert [0, *ends[shard.first[1:] - 1].tolist()] == cuts  # no symbol reaches over a document's end
    assert len(grammar.pack_shard(np.full(5000, 7), np.array([0, 5000]))) < 400


def test_cases(spark, tmp_path):
    place = str(tmp_path / "none")
    grammar.write(table(spark, []), place)
    assert grammar.read(spark, place).count() == 0
    place = str(tmp_path / "few")
    grammar.write(table(spark, [(5, None), (3, "")]), place)
    assert [tuple(r) for r in grammar.read(spark, place).orderBy("start").collect()] == [(3, 0, 1, zlib.crc32(bytes(4))), (5, 1, 1, zlib.crc32(bytes(4)))]


def test_wide_and_narrow_pairs_give_the_same_grammar(monkeypatch):
    rng = np.random.default_rng(3)
    ids, first = np.tile(rng.integers(0, 60, 300), 40), np.array([0, 5000, 12000])
    monkeypatch.setattr(grammar, "_SLOTS", 26)  # no two pairs on one slot
    narrow, wide = grammar.compress(ids, first, base=100, max_rules=1000), grammar.compress(ids, first, base=100, max_rules=1 << 17)
    assert all(np.array_equal(x, y) for x, y in zip(narrow, wide, strict=True))
    assert np.array_equal(grammar.expand(narrow[2], narrow[0], narrow[1], 100), ids)


def test_remembered_chunks_are_small():
    enc = packing.Encoder(*packing.vocabulary_paths())
    text = np.frombuffer(b"one two three", dtype=np.uint8)
    enc.slice(text, np.array([0, len(text)]))
    assert all(isinstance(x, bytes) for x in enc.cache.values())
