"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can.

SQL has no tokenizer, XXH64, zstandard, linear program, eigenvectors or trained model, so the other queries are tested against
brute-force versions in tests/llm.
"""

from __future__ import annotations

from .decontamination import WINDOW, op11_fm_index
from .embeddings import op5_pivot_permutation
from .empirical_bayes import op2_empirical_bayes
from .licenses import op1_license_scan
from .mixing import CAP, SCHEDULE, WEIGHTS, op3_curriculum_mix
from .packing import op6_packing
from .quality import BOILERPLATE, CLOSING, MARKED, NAVIGATION, op8_quality_rules
from .resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED, op13_importance_resampling
from .secrets import op7_secret_scan
from .simhash import op10_simhash
from .tokens import op4_token_huffman
from .toxicity import op9_compression_toxicity
from .whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_empirical_bayes, op3_curriculum_mix, op4_token_huffman, op5_pivot_permutation,
        op6_packing, op7_secret_scan, op8_quality_rules, op9_compression_toxicity, op10_simhash,
        op11_fm_index, op12_embedding_whitening, op13_importance_resampling,
    )
}



def _positions() -> str:
    """The inverse of each schedule's integral at u."""
    by_place = []
    for i, schedule in enumerate(SCHEDULE):
        total, met, cases = sum(schedule), 0.0, []
        for k, w in enumerate(schedule):
            if w > 0:
                cases.append(f"WHEN u < {met + w / total!r}::DOUBLE THEN ({k}::DOUBLE + (u - {met!r}::DOUBLE) / {w / total!r}::DOUBLE) / {len(schedule)}::DOUBLE")
                met += w / total
        by_place.append(f"WHEN place % {len(SCHEDULE)} = {i} THEN CASE {' '.join(cases)} ELSE 1::DOUBLE END")
    return f"CASE {' '.join(by_place)} END"


MIX = rf"""WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS hash, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM p),
 v AS (SELECT *, CAST(list_extract([{", ".join(map(str, WEIGHTS))}], place % {len(WEIGHTS)} + 1) AS BIGINT) AS weight FROM w),
 r AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight::DOUBLE, place) AS rank FROM v),
 e AS (SELECT *, sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight FROM r),
 f AS (SELECT * FROM e WHERE left_words * weight <= {CAP} * source_size * left_weight ORDER BY rank LIMIT 1),
 t AS (SELECT e.source, e.source_size, e.place, CASE WHEN e.rank < f.rank THEN ({CAP} * e.source_size)::DOUBLE ELSE e.weight::DOUBLE * f.left_words::DOUBLE / f.left_weight::DOUBLE END AS target FROM e, f),
 o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size::DOUBLE) AS BIGINT) ELSE 0 END AS whole,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || d.size || '|' || d.hash), 1, 15), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, least(size, greatest(0, CAST(floor(target - (whole * source_size)::DOUBLE) AS BIGINT) - before)) AS part FROM o),
 m AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS copies,
  least((before::DOUBLE + size::DOUBLE / 2) / greatest(target, 1::DOUBLE), 1::DOUBLE) AS u FROM q)
 SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
  CASE WHEN copies > 0 THEN {_positions()} END AS position FROM m"""

WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_nav, _boiler = (", ".join(map(_quoted, xs)) for xs in (NAVIGATION, BOILERPLATE))
RULES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 b AS (SELECT *, {WORDS.format("t")} AS w, string_split(t, chr(10)) AS l FROM d),
 c AS (SELECT r, doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, l,
  list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(list_slice(w, i, i + 7), ' ')) AS win FROM b),
 x AS (SELECT r, generate_subscripts(win, 1) AS i, unnest(win) AS h FROM c WHERE len(win) > 0),
 y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS k FROM x) WHERE k > 1),
 z AS (SELECT r, sum(least(8, coalesce(n - i, 8))) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM y) GROUP BY r),
 k AS (SELECT r, unnest(l) AS line FROM c),
 j AS (SELECT r, line, {WORDS.format("line")} AS lw, trim(lower(line), ' ') AS low FROM k),
 v AS (SELECT r, line, len(lw) > 0 AS filled, (len(lw) >= 5 AND len(list_filter(lw, lambda a: regexp_matches(a, {_quoted(MARKED)}))) * 10 > len(lw) * 4)
  OR (len(lw) BETWEEN 1 AND 4 AND low IN ({_nav})) OR (len(lw) BETWEEN 1 AND 20 AND len(list_filter([{_boiler}], lambda p: contains(low, p))) > 0)
  OR (len(lw) >= 5 AND NOT regexp_matches(line, {_quoted(CLOSING)})) AS bad FROM j),
 s AS (SELECT r, count(*) FILTER (filled) - count(DISTINCT CASE WHEN filled THEN line END) AS n_dup_lines, count(*) FILTER (bad) AS n_removed_lines,
  coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (bad), 0) AS lost FROM v GROUP BY r),
 u AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_removed_lines, lost FROM c JOIN s USING (r) LEFT JOIN z USING (r)),
 g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM u)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, base_failed, NOT base_failed AND lost::DOUBLE <= 0.5::DOUBLE * word_chars AND n_symbols::DOUBLE <= 0.1::DOUBLE * word_chars AS kept FROM g"""

LETTERS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = rf"""WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {LETTERS} AS w FROM benchmark),
 p AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 q AS (SELECT DISTINCT n FROM p),
 d AS (SELECT row_number() OVER () AS r, doc_id, {LETTERS} AS w FROM documents),
 x AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, q WHERE len(w) >= n),
 h AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM x),
 f AS (SELECT h.r, h.i, h.n, p.item FROM h JOIN p USING (n, phrase)),
 u AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM f)) GROUP BY r),
 t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
 FROM d LEFT JOIN u USING (r) LEFT JOIN t USING (r)"""

DRAW = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LETTERS} AS w FROM documents),
 a AS (SELECT r, unnest(w) AS word FROM d), g AS (SELECT unnest({LETTERS}) AS word FROM benchmark),
 c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda k, j: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, i)) AS t),
 o AS (SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INTEGER), 2))::BIGINT) AS b FROM (SELECT word FROM a UNION SELECT word FROM g)),
 z AS (SELECT word, xor(list_reduce(b, lambda k, v: xor(k >> 8, t[(xor(k, v) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM o, c),
 s AS (SELECT bucket, count(*) AS s FROM a JOIN z USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN z USING (word) GROUP BY bucket),
 m AS (SELECT (SELECT count(*) FROM a)::DOUBLE AS big_s, (SELECT count(*) FROM g)::DOUBLE AS big_t),
 n AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM z) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), m),
 e AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total FROM a JOIN z USING (word) JOIN n USING (bucket) GROUP BY r),
 f AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN len(w) > 0 THEN CAST(total - (total % len(w) + len(w)) % len(w) AS BIGINT) // len(w) ELSE 0 END AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN e USING (r)),
 y AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM f),
 k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () * {PERCENT} // 100 AS wanted FROM y WHERE n_features >= {LEAST_WORDS})
 SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= wanted THEN rank END AS rank FROM y LEFT JOIN k USING (r)"""

ORACLES: dict[str, str] = {"op3_curriculum_mix": MIX, "op8_quality_rules": RULES, "op11_fm_index": LEAKS, "op13_importance_resampling": DRAW}
