"""Small document tables with the cases that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, bucket int, kind string, stage_id long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows(seed: int = 7):
    """(doc_id, text) with nulls, empty and long texts, copies, near copies, shared passages, ties and short texts."""
    rng = random.Random(seed)
    out = [(i, words(rng, rng.randint(1, 120))) for i in range(0, 40)]
    base = words(rng, 200)
    out += [(100 + i, base) for i in range(6)]
    for i in range(12):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        out.append((120 + i, " ".join(w)))
    passage = words(rng, 60)
    out += [(150 + i, words(rng, 30) + " " + passage + " " + words(rng, 25)) for i in range(8)]
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one two"), (204, "one two"), (205, "One TWO"), (206, words(rng, 6000)), (207, "añb çédille ÀÉ 日本語 🙂"), (208, "x" * 5000), (209, "x" * 4000)]
    out += [(0, out[0][1]), (103, base)]  # repeated rows
    rng.shuffle(out)
    return out


def table(spark, data):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if t is None else ("aa", "bb", None)[(i or 0) % 3], None, None, "x", 3, None, 9) for i, t in data], SCHEMA)
