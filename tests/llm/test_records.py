"""Personal data, quality rules, pieces and passages."""

import hashlib
import re
from collections import Counter

from corpuskiln.llm import chaining, pieces, pii, quality

from .fixtures import rows, table, words

SAMPLE = "mail a.b@c-d.e.fr, ip 1.2.3.4.5 and 300.1.1.1, card 4111 1111 1111 1111 or 4111111111111112, call +1 (974) 555-3436 x@y a@@b.c 0001.2.3.4"


def plain_spans(t):
    found = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 10 <= len(d) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_plain_regexes(spark):
    import random

    rng = random.Random(1)
    texts = [SAMPLE] + ["".join(rng.choice("a1@.+- (Zé9") for _ in range(80)) for _ in range(400)]
    assert all(pii.base_spans(t) == plain_spans(t) for t in texts)
    got = {r.doc_id: r for r in pii.find_personal_data(table(spark, list(enumerate(texts))), redacted=True).collect()}
    for i, t in enumerate(texts):
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    assert got[0].n_email == 1 and got[0].n_ip == 2 and got[0].n_card == 1 and got[0].n_phone == 1
    assert "<card>" in got[0].redacted


def test_random_field_finds_secrets_only():
    text = 'here token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and the rest, "quoted" words: 12 = 4'
    (found,) = pii.secrets([text], pii.Field(pii.train()))
    assert [text[a:b] for a, b in found] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]


def test_pii_cases(spark):
    got = {r.doc_id: r for r in pii.find_personal_data(table(spark, rows())).collect()}
    assert got[200].spans == got[201].spans == "" and got[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(table(spark, [])).count() == 0


def brute_quality(t):
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_measures(spark):
    data = [*rows(), (970, "a b\na b\n\n a b\na b " * 3), (971, ("p q r s t u v w " * 4).strip()), (972, "x ### $$ |<>|\n\n")]
    got = quality.verdicts(quality.ledger(table(spark, data))).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i, *brute_quality(t)) for i, t in data)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.ledger(table(spark, [])).count() == 0


def test_ablation_is_bitwise(spark):
    rows_ = quality.ledger(table(spark, rows()))
    bits = [r.fail_bits & quality.POLICIES["clean-2"] for r in rows_.collect()]
    for r in quality.ablation(rows_).collect():
        b = quality.BIT[r.rule]
        assert (r.n_failed, r.n_only) == (sum(bool(x & b) for x in bits), sum(x == b for x in bits))
    assert sum(r.n_docs for r in quality.compare(rows_, "base-1", "clean-2").collect()) == len(bits)


def test_pieces_round_trip_and_best_score(spark):
    data = [*rows(), (980, "a\n\nb\tc;\r d  e")]
    docs = table(spark, data)
    assert all(r.exact for r in pieces.round_trip(docs).collect())
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t in data)
    m = pieces.Pieces(pieces.vocabulary_path())
    scores = {int(i): s for i, s in zip(m.ids, m.scores, strict=True)}
    keys = {int(k): int(i) for k, i in zip(m.keys, m.ids, strict=True)}

    def best(w):
        top = [0.0] + [-1e30] * len(w)
        for j in range(1, len(w) + 1):
            top[j] = top[j - 1] + pieces.UNKNOWN
            for i in range(max(0, j - m.longest), j):
                k = keys.get(int(m.key(w[i:j])))
                if k is not None:
                    top[j] = max(top[j], top[i] + scores[k])
        return top[-1]

    for w in ("▁the", "▁heitkeit", "▁ñll", "▁rerentionou"):
        assert abs(sum(scores[i] for i in m.segment([w])[0].tolist()) - best(w)) < 1e-9


def test_passages(spark):
    import random

    rng = random.Random(4)
    p = words(rng, 80).split()
    q = list(p)
    q[40] = "changed"
    del q[60]
    data = [(1, words(rng, 50) + " " + " ".join(p) + " " + words(rng, 20)), (2, words(rng, 70) + " " + " ".join(p)), (3, " ".join(q) + " " + words(rng, 90)), (4, words(rng, 300)), (5, None), (6, ""), (7, "short")]
    got = {r.doc_id: r for r in chaining.passages(table(spark, data)).collect()}
    assert sorted(got) == [2, 3]
    assert (got[2].src_doc_id, got[2].start_word, got[2].n_words, got[2].src_start_word, got[2].n_match) == (1, 70, 80, 50, 80)
    assert got[3].src_doc_id == 1 and got[3].n_match == 78 and got[3].start_word == 0 and got[3].n_words == 79
    assert chaining.passages(table(spark, [])).count() == 0
