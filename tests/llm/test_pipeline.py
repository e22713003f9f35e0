import re

import corpus_pipeline as P
from corpuskiln.llm import langid, pii

from .fixtures import rows, table
from .test_jaccard import brute as brute_components
from .test_suffixes import LENGTH_BYTES, marked_bytes


def test_stages_against_brute_force(spark, tmp_path):
    data = [*rows(), (990, 'mail a.b@c-d.org and token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok ' + "z " * 30)]
    docs = table(spark, data).dropDuplicates(["doc_id", "text"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or k < 2
        if name == "language":
            assert set(now) == {i for i, t in kept.items() if t and any(c.isalpha() for c in t)}
        if name == "near_duplicates":
            assert set(now) == {c for _, _, c in brute_components(list(kept.items()))}
        if name == "repeated_passages":
            gone = marked_bytes(list(kept.items()))
            want = {i: bytes(x for x, g in zip(t.encode(), gone[i], strict=True) if not g).decode("utf-8", "ignore") for i, t in kept.items()}
            assert now == {i: t for i, t in want.items() if t == kept[i] or re.search(r"[^\x20\x09-\x0D]", t)}
        if name == "personal_data":
            field = pii.Field(pii.train())
            assert now == {i: pii.redact(t, pii.merge(pii.base_spans(t), pii.secrets([t], field)[0])) for i, t in kept.items()}
            assert "<email>" in now[990] and "<secret>" in now[990]
        kept = now
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(kept)
    assert LENGTH_BYTES == 50 and langid.UND == "und"


def test_run_registers_and_returns_pieces(spark, sf):
    got = P.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 100
