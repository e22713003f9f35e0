"""The queries of this subpackage, by the names under which the driver runs them."""

from __future__ import annotations

from importlib import import_module

#: name -> (module, function); modules load when a query runs.
_WHERE = {
    "op1_string_kernel_langid": ("langid", "op1_string_kernel_langid"),
    "op2_spf_packing": ("packing", "op2_pack"),
    "op3_collinear_chains": ("chaining", "op3_collinear_chains"),
    "op4_projection_passes": ("neighbours", "op4_projection_passes"),
    "op5_divide_skip_jaccard": ("jaccard", "op5_divide_skip_jaccard"),
    "op6_bucket_pointer_dedup": ("suffixes", "op6_bucket_pointer_dedup"),
    "op7_hashed_maxent": ("maxent", "op7_hashed_maxent"),
    "op8_viterbi_pieces": ("pieces", "op8_viterbi_pieces"),
    "op9_crf_pii": ("pii", "op9_crf_pii"),
    "op10_quality_ledger": ("quality", "op10_quality_ledger"),
    "op11_end_alignment": ("alignment", "op11_end_alignment"),
    "op12_collocations": ("collocations", "op12_collocations"),
    "op13_grammar_files": ("grammar", "op13_grammar_files"),
}


def _lazy(module: str, function: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{module}"), function)(spark, sf_dir)

    return run


QUERIES = {name: _lazy(*where) for name, where in _WHERE.items()}

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_KEPT_CHARS = "length(regexp_replace(t, '{other}', '', 'g'))::BIGINT"

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(8) AS o(k) WHERE c > 1 GROUP BY 1),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
{_KEPT_CHARS.format(other="[^#*$%&|<>]")} AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.lines, 0) AS n_lines,
{_KEPT_CHARS.format(other="[\x00-@\x5B-\x60\x7B-\x7F]")} AS n_alpha, {_KEPT_CHARS.format(other="[^A-Z]")} AS n_upper, {_KEPT_CHARS.format(other="[^!?]")} AS n_marks
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 3 * word_chars)::BIGINT + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
+ 16 * (100 * n_alpha < 60 * word_chars)::BIGINT + 32 * (n_upper * 2 > n_alpha)::BIGINT + 64 * (n_marks * 2 > n_words)::BIGINT + 128 * (word_chars > 14 * n_words)::BIGINT)::BIGINT AS fail_bits FROM b)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM f
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOW)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM (SELECT doc_id, count(*) AS n, sha256(string_agg(g, chr(10) ORDER BY g)) AS whole FROM s GROUP BY 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
t AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT c.doc_id, t.b FROM c JOIN t ON t.a = c.o)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(n.class_id, doc_id) AS class_id, component_id FROM (SELECT doc_id, min(o) AS component_id FROM c GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

_SUBSTRINGS = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM q) WHERE least < doc_id),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i,
CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM m)) GROUP BY doc_id, run),
k AS (SELECT doc_id, lo AS end_, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS begin_ FROM (SELECT doc_id, lo, hi FROM r UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d)),
o AS (SELECT doc_id, string_agg(substr(h, (2 * begin_ + 1)::BIGINT, (2 * (end_ - begin_))::BIGINT), '' ORDER BY begin_, end_) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(x.n, 0)::BIGINT AS n_removed, coalesce(x.spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN o USING (doc_id) LEFT JOIN (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans FROM r GROUP BY 1) x USING (doc_id)
"""

_COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, range(1, 5) AS o(k) WHERE i + k - 1 <= len(w)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, 4) AS o(k) WHERE k < words),
x AS (SELECT k.lang, k.words, k.phrase, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = first JOIN f r ON r.lang = k.lang AND r.phrase = rest),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM x),
o AS (SELECT c.lang, c.phrase FROM c JOIN c y ON y.lang = c.lang AND y.words > c.words AND contains(' ' || y.phrase || ' ', ' ' || c.phrase || ' ') AND 100::HUGEINT * y.a >= 80::HUGEINT * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score::BIGINT AS score
FROM b JOIN t ON t.lang = b.lang ANTI JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE nth = 1) WHERE rank <= 2000
"""

#: DuckDB SQL of the queries that SQL can express on whole tables in reasonable time.
ORACLE: dict[str, str] = {"op5_divide_skip_jaccard": _JACCARD, "op6_bucket_pointer_dedup": _SUBSTRINGS, "op10_quality_ledger": _QUALITY, "op12_collocations": _COLLOCATIONS}
