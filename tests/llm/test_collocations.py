import random
import re
from collections import Counter

import pytest

from corpuskiln.llm import collocations

from .fixtures import rows, table


def brute(data, max_n=4, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in data:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = set()
    for (lang, p), a in found.items():
        for size in range(2, len(p)):
            held |= {(lang, q) for i in range(len(p) - size + 1) if 100 * a >= 80 * found[(lang, (q := p[i : i + size]))]}
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in held:
            score, k = min((2000000 * a // (f[(lang, p[:k])] + f[(lang, p[k:])]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[(lang, p[:k])], f[(lang, p[k:])]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def mixed(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "in", "new", "york", "city", "é", "naïve", "don't", "#1"]
    texts = []
    for _ in range(400):
        w = rng.choices(vocabulary, weights=range(10, 0, -1), k=rng.randint(0, 30))
        texts.append("".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for x in w))
    return [(rng.choice(["aa", "bb", None]), t) for t in texts] + [("aa", None), (None, ""), ("cc", "of of of"), ("aa", "one two three " * 3000)]


@pytest.mark.parametrize("top", [2000, 7])
def test_equal_to_brute_force(spark, top):
    data = mixed(3)
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string, n long, phrase string")
    got = [tuple(r) for r in collocations.collocations(docs, top=top).collect()]
    want = brute(data, top=top)
    assert len(got) == len(want) > 10
    assert set(got) == want


def test_a_table_of_few_bits_changes_nothing(spark):
    data = mixed(5)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(data)], "doc_id long, text string, lang string")
    assert {tuple(r) for r in collocations.collocations(docs, max_n=3, filter_bits=32768).collect()} == brute(data, max_n=3)


def test_cases(spark):
    data = rows()
    docs = table(spark, data)
    assert {tuple(r) for r in collocations.collocations(docs, min_count=3).collect()} == brute([(r.lang, r.text) for r in docs.collect()], least=3)
    assert collocations.collocations(table(spark, [])).count() == 0
