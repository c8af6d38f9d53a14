"""DuckDB counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

from plumbline.llm.mixing import EPOCHS, FRACTION, LANGUAGE_WEIGHTS, SEED

LANGUAGE_WEIGHT = "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGE_WEIGHTS.items()) + " ELSE 1.0 END"


def _level(name: str, level: str, parents: str, group: str, weight: str, source: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_w AS (
  SELECT *, CAST({weight} AS DOUBLE) AS weight
  FROM (SELECT {group}, CAST(sum(cap) AS DOUBLE) AS room, min(quota) AS quota FROM {source} GROUP BY ALL)
),
{name}_r AS (
  SELECT *, (quota - coalesce(sum(room) OVER ({by} ORDER BY room / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER ({by} ORDER BY room / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM {name}_w
),
{name}_s AS (
  SELECT {group}, CASE WHEN room <= rate * weight THEN room
    ELSE max(CASE WHEN room > rate * weight THEN rate END) OVER ({by}) * weight END AS share
  FROM {name}_r
),
{name} AS (SELECT n.* EXCLUDE (quota), s.share AS quota FROM {source} n JOIN {name}_s s USING ({group}))"""


MIX = f"""
WITH docs AS (
  SELECT doc_id, CASE WHEN substr(md5(coalesce(source, 'unknown')), 1, 1) < '8' THEN 'd0' ELSE 'd1' END AS domain,
    coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, language, origin, sum(n_tokens) AS have, sum(n_tokens) * {EPOCHS} AS cap FROM docs GROUP BY ALL),
start AS (SELECT *, CAST(floor((SELECT sum(have) FROM leaves) * {FRACTION}) AS DOUBLE) AS quota FROM leaves),
{_level("one", "domain", "", "domain", "1.0", "start").strip()},
{_level("two", "language", "domain", "domain, language", LANGUAGE_WEIGHT, "one").strip()},
{_level("three", "origin", "domain, language", "domain, language, origin", "1.0", "two").strip()},
given AS (SELECT domain, language, origin, have, CAST(floor(quota + 1e-6) AS BIGINT) AS quota FROM three),
copies AS (
  SELECT d.*, e.epoch, md5(concat('{SEED}:', e.epoch, ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place
  FROM docs d CROSS JOIN (SELECT unnest(range({EPOCHS})) AS epoch) e
),
summed AS (
  SELECT c.*, greatest(0, least(g.have, g.quota - c.epoch * g.have)) AS part,
    sum(n_tokens) OVER (PARTITION BY domain, language, origin, epoch ORDER BY place) AS upto
  FROM copies c JOIN given g USING (domain, language, origin)
)
SELECT doc_id, domain, language, origin, CAST(epoch AS INT) AS epoch, n_tokens FROM summed WHERE upto <= part AND part > 0
"""

FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, [w FOR w IN regexp_split_to_array(text, '[\\x20\\x09]+') IF w <> ''] AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce({FOLDED}, ''), '[.,;:!?\\x0A-\\x0D]')) AS text FROM documents)
),
totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (SELECT lang, words[i : i + k - 1] AS ws, k, count(*) AS a FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT lang, ws, max(a) AS longer
  FROM (SELECT lang, a, unnest([ws[1 : k - 1], ws[2 : k]]) AS ws FROM grams WHERE k > 2) GROUP BY ALL
),
kept AS (SELECT g.* FROM grams g LEFT JOIN inside i USING (lang, ws) WHERE g.k > 1 AND (i.longer IS NULL OR i.longer < g.a)),
cuts AS (
  SELECT c.lang, c.ws, c.a, c.cut, l.a AS l, r.a AS r, n, 1000 * c.a::HUGEINT * n::HUGEINT // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) c
  JOIN grams l ON l.lang = c.lang AND l.ws = c.ws[1 : c.cut]
  JOIN grams r ON r.lang = c.lang AND r.ws = c.ws[c.cut + 1 : c.k]
  JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY rank <= 2000
"""

SEARCH = f"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce({FOLDED}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf) AS n FROM tfs GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n) AS length FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(coalesce({FOLDED}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * CAST(10 + (90 * n * docs) // length AS BIGINT)))) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole
  GROUP BY ALL HAVING score > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM scored QUALIFY rank <= 10
"""

ORACLE: dict[str, str] = {"op6_mix_sources": MIX, "op11_phrase_collocations": PHRASES, "op13_lexical_search": SEARCH}
