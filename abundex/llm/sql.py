"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

_WORD = "[^\\x20\\x09-\\x0D]+"
_SPACE = "[\\x20\\x09-\\x0D]+"

MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source
), weighed AS (
  SELECT source, s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class,
         ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sums
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS i FROM weighed
), levels AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            ::DOUBLE / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), fixed AS (
  SELECT arg_min(level, i) AS level FROM levels WHERE w * level < 3 * s
), targets AS (
  SELECT source, s, class, least((3 * s)::DOUBLE, w * coalesce((SELECT level FROM fixed), 'inf'::DOUBLE)) AS target
  FROM weighed
), placed AS (
  SELECT d.doc_id, d.size, t.s AS source_size, t.target, t.class,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (CASE WHEN size > 0 AND off + size / 2.0 <= target THEN 1 ELSE 0 END
           + CASE WHEN size > 0 AND off + source_size + size / 2.0 <= target THEN 1 ELSE 0 END
           + CASE WHEN size > 0 AND off + 2 * source_size + size / 2.0 <= target THEN 1 ELSE 0 END) AS copies,
         off / target AS x
  FROM placed
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies = 0 THEN NULL
            WHEN class = 1 THEN CASE WHEN x < 0.5 THEN 0.0 + 2 * greatest(x * 1.0 - 0.0, 0.0) / (1.0 + sqrt(1.0 + 2 * 0.0 * greatest(x, 0.0)))
                                     ELSE 0.5 + 2 * greatest(x - 0.5, 0.0) / (1.0 + sqrt(1.0)) END
            WHEN class = 0 THEN CASE WHEN x < 0.375 THEN 2 * x / (0.5 + sqrt(0.25 + 2 * 1.0 * x))
                                     ELSE 0.5 + 2 * greatest(x - 0.375, 0.0) / (1.0 + sqrt(1.0 + 2 * 1.0 * greatest(x - 0.375, 0.0))) END
            ELSE CASE WHEN x < 0.625 THEN 2 * x / (1.5 + sqrt(2.25 + 2 * -1.0 * x))
                      ELSE 0.5 + 2 * greatest(x - 0.625, 0.0) / (1.0 + sqrt(1.0 + 2 * -1.0 * greatest(x - 0.625, 0.0))) END
       END AS first_position
FROM taken
"""

LEDGER = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words
  FROM documents
), windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
), twice AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, sum(least(3, coalesce(next - i, 3)))::BIGINT AS n FROM twice GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY r
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(lines.n, 0)::BIGINT AS n_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) AS lettered,
         length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS capitals
  FROM d LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), bits AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * lettered < 7 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 10 * capitals > 4 * word_chars THEN 128 ELSE 0 END)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures
FROM bits
"""

EXACT = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars,
         regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm
  FROM documents
), first AS (
  SELECT norm, count(*)::BIGINT AS group_size, max(n_chars) AS most FROM d GROUP BY norm
), stays AS (
  SELECT d.norm, min(d.doc_id) AS keep_id FROM d JOIN first USING (norm) WHERE d.n_chars = first.most GROUP BY d.norm
)
SELECT d.doc_id, s.keep_id, f.group_size,
       d.doc_id IS NOT DISTINCT FROM s.keep_id AND d.n_chars = f.most AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN first f USING (norm) JOIN stays s USING (norm)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

SEARCH = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS words
  FROM documents
), totals AS (
  SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs WHERE len(words) > 0
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t
  FROM benchmark
), tfs AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM docs)
  WHERE t IN (SELECT t FROM wanted) GROUP BY r, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM tfs GROUP BY t), totals
), lengths AS (
  SELECT r, doc_id, 100 - 50 + (50 * len(words) * n_docs) // n_terms AS m FROM docs, totals WHERE len(words) > 0
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (r)
  GROUP BY item_id, r, doc_id
), placed AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 50
"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _levels(name: str, leaves: str) -> str:
    """All nodes (tree, level, i, h) over ``leaves`` (tree, i, h): runs of eight until a tree has one node."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, i, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, level, i // 8
), {name}_tops AS (
  SELECT tree, arg_max(h, level) AS root, max(level) AS height FROM {name} GROUP BY tree
), {name}_steps AS (
  SELECT r.tree, r.i, n.level,
         coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < r.i >> (3 * n.level)), '') || '|' ||
         coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > r.i >> (3 * n.level)), '') AS step
  FROM {leaves} r JOIN {name}_tops t ON t.tree IS NOT DISTINCT FROM r.tree
  JOIN {name} n ON n.tree IS NOT DISTINCT FROM r.tree AND n.level < t.height AND n.i >> 3 = r.i >> (3 * n.level + 3)
  GROUP BY r.tree, r.i, n.level
), {name}_paths AS (
  SELECT tree, i, list(step ORDER BY level) AS path FROM {name}_steps GROUP BY tree, i
)"""


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang AS tree, sha256({_FIELDS} || {_field("text")}) AS h,
         sha256({_FIELDS} || {_field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS changed,
         xor({_CRC}, 4294967295) % 3 = 0 AS chosen
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d
), {_levels("nodes", "leaves")}, groups AS (
  SELECT 0 AS tree, tree AS lang, root AS h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i FROM nodes_tops
), {_levels("upper", "groups")}, proofs AS (
  SELECT l.doc_id, l.h AS leaf, g.h AS subroot, u.root, CASE WHEN chosen THEN changed ELSE l.h END AS start,
         list_concat(coalesce(np.path, []), coalesce(up.path, [])) AS path
  FROM leaves l JOIN groups g ON g.lang IS NOT DISTINCT FROM l.tree CROSS JOIN upper_tops u
  LEFT JOIN nodes_paths np ON np.tree IS NOT DISTINCT FROM l.tree AND np.i = l.i
  LEFT JOIN upper_paths up ON up.i = g.i
), folded AS (
  SELECT *, list_reduce(list_prepend(start, path),
                        lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM folded
"""

SQL = {
    "op3_curriculum_mix": MIX,
    "op8_rule_ledger": LEDGER,
    "op9_exact_index": EXACT,
    "op11_bag_search": SEARCH,
    "op12_nested_rollup": MERKLE,
}
