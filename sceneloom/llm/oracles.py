"""DuckDB SQL of the dataset audits: the Merkle manifest and the divergence of sources."""

from __future__ import annotations

#: Levels of a tree that the SQL unrolls: 16 to the power of this many leaves a source.
LEVELS = 6
#: CRC-32 of a text as a reduction over its bytes, each followed by eight shifts (marked by -1).
CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({text}, '')]),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _tree(name: str, leaves: str, docs: str) -> str:
    """CTEs that build the levels over ``leaves(grp, pos, n, h)`` and fold ``docs(grp, pos, h, rest, sibs)`` up to the top."""
    parts = [f"{name}0 AS (SELECT grp, pos, n, h FROM {leaves})", f"{name}_d0 AS (SELECT * FROM {docs})"]
    for k in range(LEVELS):
        parts.append(f"""{name}_r{k} AS (SELECT grp, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name}{k} WHERE n > 1 GROUP BY grp, pos // 16)""")
        parts.append(f"""{name}{k + 1} AS (
  SELECT grp, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM {name}{k} GROUP BY grp, pos // 16)""")
        parts.append(f"""{name}_d{k + 1} AS (
  SELECT rid, d.grp, pos // 16 AS pos, CASE WHEN hs IS NULL THEN h ELSE sha256(lhs || h || rhs) END AS h, CASE WHEN hs IS NULL THEN sibs ELSE sibs || lhs || rhs END AS sibs
  FROM (SELECT d.*, hs, coalesce(array_to_string(hs[1:(pos % 16)::BIGINT], ''), '') AS lhs, coalesce(array_to_string(hs[(pos % 16 + 2)::BIGINT:16], ''), '') AS rhs
        FROM {name}_d{k} d LEFT JOIN {name}_r{k} r ON d.grp = r.grp AND d.pos // 16 = r.run) d)""")
    return ",\n".join(parts)


OP11 = f"""
WITH base AS (SELECT row_number() OVER () AS rid, * FROM documents),
hashed AS (
  SELECT rid, doc_id, source, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {CRC32.format(text="doc_id::VARCHAR")} % 5 = 0 THEN
           sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))}) END AS changed
  FROM base),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM hashed),
leaves AS (SELECT grp, pos, n, leaf AS h FROM placed),
starts AS (SELECT rid, grp, pos, coalesce(changed, leaf) AS h, '' AS sibs FROM placed),
{_tree("s", "leaves", "starts")},
subroots AS (SELECT 0 AS grp, grp AS pos, (SELECT count(DISTINCT grp) FROM placed) AS n, h FROM s{LEVELS}),
folded AS (SELECT rid, 0 AS grp, grp AS pos, h, sibs FROM s_d{LEVELS}),
{_tree("t", "subroots", "folded")}
SELECT doc_id, leaf, s{LEVELS}.h AS subroot, t{LEVELS}.h AS root, sha256(sibs) AS proof_sha256, f.h AS folded_root, f.h = t{LEVELS}.h AS verified
FROM placed JOIN s{LEVELS} ON placed.grp = s{LEVELS}.grp JOIN t_d{LEVELS} f ON f.rid = placed.rid CROSS JOIN t{LEVELS}
"""

#: The 1 + floor(10^9 * (count + 1) / (N + V)) of a term.
SHARE = "1 + ((1000000000::HUGEINT * ({count} + 1)) // ({total} + v))::BIGINT"

OP13 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
lang_counts AS (SELECT lang, term, sum(c)::BIGINT AS c FROM counts GROUP BY lang, term),
groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0)::BIGINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN vocabulary USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source) USING (lang, source)),
langs AS (SELECT lang, sum(c)::BIGINT AS n FROM lang_counts GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, term, coalesce(c, 0) AS c, {SHARE.format(count="coalesce(c, 0)", total="g.n")} AS p
  FROM groups g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
lang_shares AS (SELECT lang, term, {SHARE.format(count="c", total="langs.n")} AS q FROM lang_counts JOIN langs USING (lang) JOIN vocabulary USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares JOIN lang_shares USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 200
"""

ORACLES: dict[str, str] = {"op11_merkle_manifest": OP11, "op13_source_divergence": OP13}
