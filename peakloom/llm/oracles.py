"""DuckDB SQL with the same rows as the queries it is given for.

The six others have none: XXH64 (op3), the tokenizer's merges (op4), the dynamic program (op5), the checksum
of planted faults (op12) and the two learned models (op2, op6) are not expressible; ``tests/llm`` holds them against plain versions.
"""

from __future__ import annotations

from peakloom.llm import infill, risk_rules, secret_scan, url_filter

__all__ = ["ORACLES"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- op1: curated rules, then frequent one- and two-token rules counted directly -------------


def _curated(then: int) -> str:
    cases = []
    for rule in sorted(url_filter.CURATED, key=lambda r: -len(r[0])):
        name, _, rest = rule[0].partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        cases.append(f"WHEN {fits} THEN '{rule[then]}'")
    return f"CASE {' '.join(cases)} END"


_MINING = url_filter.MiningConfig()
_ADDRESS = r"://([^/?#]*)([^?#]*)"
_NUMBERS = "regexp_replace(x, '[0-9]+', '0', 'g')"

OP1 = f"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
         {_lower(f"regexp_extract(coalesce(url, ''), '{_ADDRESS}', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '{_ADDRESS}', 2) AS path
  FROM pages
), own AS MATERIALIZED (
  SELECT rid, page_id, host, path, {_curated(0)} AS rule, {_curated(1)} AS given,
         list_sort(list_distinct(
           list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
           || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || {_NUMBERS})
           || list_transform(regexp_extract_all(url, '[?&]([^=&#]+)', 1), lambda x: 'q:' || {_NUMBERS})
           || CASE WHEN contains(url, '#') THEN ['f:'] ELSE [] END)) AS tokens
  FROM parts
), least AS (
  SELECT greatest(ceil({_MINING.support} * count(*)), 1) AS least FROM own WHERE given IS NOT NULL
), single AS (
  SELECT rid, given, unnest(tokens) AS token FROM own
), needs AS (
  SELECT rid, given, [token] AS needs FROM single
  UNION ALL
  SELECT a.rid, a.given, [a.token, b.token] FROM single a JOIN single b ON a.rid = b.rid AND a.token < b.token
), counted AS (
  SELECT needs, verdict, freq, freq::DOUBLE / sum(freq) OVER (PARTITION BY needs) AS confidence
  FROM (SELECT needs, given AS verdict, count(*) AS freq FROM needs WHERE given IS NOT NULL GROUP BY ALL)
), rules AS (
  SELECT counted.* FROM counted, least WHERE freq >= least AND confidence >= {_MINING.confidence}
), best AS (
  SELECT n.rid, r.verdict
  FROM needs n JOIN rules r ON n.needs = r.needs
  WHERE n.given IS NULL
  QUALIFY row_number() OVER (PARTITION BY n.rid ORDER BY r.confidence DESC, r.freq DESC, r.verdict) = 1
)
SELECT own.page_id, own.host, own.path, own.rule, coalesce(own.given, best.verdict, 'allow') AS verdict, best.verdict AS mined
FROM own LEFT JOIN best ON own.rid = best.rid
"""

# --- op7: what the archive must hold, and the order of its merged index ----------------------

OP7 = r"""
WITH own AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '[\r\n]', '%0A', 'g') AS url FROM pages
), named AS (
  SELECT *, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id,
         CASE WHEN regexp_matches(url, '^[^:]*://')
              THEN array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[^:]*://([^/?#]*)([^#]*)', 1)), '.')), ',')
                   || ')' || lower(regexp_extract(url, '^[^:]*://([^/?#]*)([^#]*)', 2))
              ELSE lower(url) END AS url_key,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
  FROM own
), typed AS (
  SELECT *, coalesce(first_id <> coalesce(page_id, first_id - 1), false) AS again FROM named
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, ((j // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to, url_key, warc_date,
       row_number() OVER (ORDER BY url_key, warc_date, page_id NULLS LAST) - 1 AS capture_place
FROM typed
"""

# --- op8: matches and the gaps between them give the places; weak parts by an interval join ---


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token', 'api_?key')))}){_GIVEN}([A-Za-z0-9+/_.=-]+)"
_WEAK_ID = f"({'|'.join(map(_either, ('user', 'username', 'login', 'client_?id', 'account')))}){_GIVEN}[A-Za-z0-9@._+-]{{3,}}"
_ENDPOINT = f"({'|'.join(map(_either, ('https?', 'ftp', 'postgres', 'mysql', 'mongodb', 'redis', 'amqp')))})://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
_RUN = "[A-Za-z0-9+/=]+"
_VALUE = "^[A-Za-z0-9+/]{20,}={0,2}"


def _found(kind: int, pattern: str, keep: str, length: str = "length(m)") -> str:
    """Spans of one kind: a match starts after the gaps up to it and the matches before it."""
    return f"""
  SELECT rid, {kind} AS kind, start, start + {length} AS stop FROM (
    SELECT rid, m, (sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m))::BIGINT AS start
    FROM (SELECT rid, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
      SELECT rid, regexp_extract_all(text, {_quoted(pattern)}) AS ms, string_split_regex(text, {_quoted(pattern)}) AS gaps FROM docs)))
  WHERE {keep}"""


_VALUE_RULE = " AND ".join(f"regexp_matches(regexp_extract(m, '{_VALUE}'), '{c}')" for c in ("[A-Z]", "[a-z]", "[0-9]"))
_KIND = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secret_scan.KINDS)) + " END"
_ROLE = "CASE kind " + " ".join(f"WHEN {i} THEN '{secret_scan.ROLE[k]}'" for i, k in enumerate(secret_scan.KINDS)) + " END"
_LIST = f"coalesce(string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop), '')"

OP8 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), base AS MATERIALIZED (
  {_found(0, _ASSIGN, f"length(regexp_extract(m, {_quoted(_ASSIGN)}, 2)) >= 8")}
  UNION ALL {_found(1, "AKIA[A-Z0-9]+", "length(m) >= 16")}
  UNION ALL {_found(2, "[0-9a-f]+", "length(m) >= 32")}
), points AS MATERIALIZED (
  {_found(5, _ENDPOINT, "true")}
), weak AS MATERIALIZED (
  SELECT * FROM (
    SELECT * FROM points
    UNION ALL {_found(3, _WEAK_ID, "true")}
    UNION ALL {_found(4, _RUN, _VALUE_RULE, f"length(regexp_extract(m, '{_VALUE}'))")}
  ) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.start < w.stop AND w.start < b.stop)
), parts AS (
  SELECT *, {_ROLE} AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)
), linked AS (
  SELECT DISTINCT a.rid, a.kind, a.start, a.stop
  FROM parts a JOIN parts b ON a.rid = b.rid AND (a.role = 'secret') <> (b.role = 'secret')
   AND b.start < a.stop + {secret_scan.SCOPE} AND b.stop > a.start - {secret_scan.SCOPE}
  WHERE a.kind > 2
), all_base AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         {_LIST} AS joined
  FROM base GROUP BY rid
), every AS (
  SELECT rid, {_LIST} AS joined FROM (SELECT * FROM base UNION ALL SELECT rid, kind, start, stop FROM linked) GROUP BY rid
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.joined, '')) AS base_sha256, coalesce(e.joined, '') AS spans
FROM docs d LEFT JOIN all_base b USING (rid) LEFT JOIN every e USING (rid)
"""

# --- op9: every pair, added component by component in double precision -----------------------

OP9 = """
WITH own AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.vec, c.vec), lambda x: x[1] * x[2]), lambda s, x: s + x) AS score
  FROM own q JOIN own c ON q.rid <> c.rid AND len(q.vec) = len(c.vec)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, place::INT AS rank, vec_id, score FROM ranked WHERE place <= 20
"""

# --- op10: counts, then the binomial tests from the log-gamma function ------------------------

_RISK = risk_rules.RiskConfig()
_STEPS = ", ".join(f"('{r.name}', {i}, {c})" for r in _RISK.rules for i, c in enumerate(r.cutoffs))
_PART = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.part}" for r in _RISK.rules) + " END"
_WHOLE = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.whole}" for r in _RISK.rules) + " END"
_SHARE = _RISK.risk / len(_RISK.rules)

OP10 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents
), triples AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS triple
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), repeated AS (
  SELECT rid, i FROM triples QUALIFY count(*) OVER (PARTITION BY rid, triple) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM repeated, range(3) AS t(o) GROUP BY rid
), measured AS MATERIALIZED (
  SELECT rid, doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
  FROM docs LEFT JOIN covered c USING (rid)
), steps(rule, step, cutoff) AS (VALUES {_STEPS}
), good AS (
  SELECT * FROM measured WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), tested AS (
  SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (100 * {_PART} > cutoff * {_WHOLE}) AS k
  FROM good, steps GROUP BY ALL
), judged AS (
  SELECT *, k < n * {_SHARE} AND list_sum(list_transform(range(k + 1), lambda i:
              exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))))
            <= {_RISK.error / len(_RISK.rules)} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) AS ok
  FROM tested
), passed AS (
  SELECT *, min(step) FILTER (NOT ok) OVER (PARTITION BY lang, rule) AS halt FROM judged
), chosen AS (
  SELECT lang, rule, max_by(cutoff, step) AS cutoff FROM passed WHERE halt IS NULL OR step < halt GROUP BY ALL
), rejected AS (
  SELECT DISTINCT rid FROM measured m JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang WHERE 100 * {_PART} > cutoff * {_WHOLE}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
FROM measured
"""

# --- op11: every window of an item looked up among all runs of words of the documents -----------

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WINDOW = 10


def _runs(words: str, lengths: str, keys: str) -> str:
    """Every run of t words with its place, for the lengths t of each text."""
    frame = f"OVER (PARTITION BY {keys}, t ORDER BY place ROWS BETWEEN CURRENT ROW AND t - 1 FOLLOWING)"
    one = f"SELECT {keys}, unnest(range(len(words))) AS place, unnest(words) AS word, len(words) AS n FROM {words}"
    return f"SELECT * FROM (SELECT {keys}, t, place, n, string_agg(word, ' ') {frame} AS run FROM ({one}) JOIN {lengths}) WHERE place + t <= n"


OP11 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ITEM_WORD}') AS words FROM documents
), items AS MATERIALIZED (
  SELECT row_number() OVER () AS iid, CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ITEM_WORD}') AS words FROM benchmark
), lengths AS (
  SELECT iid AS lid, least(len(words), {_WINDOW}) AS t FROM items WHERE len(words) > 0
), spans AS MATERIALIZED (
  SELECT DISTINCT item, t, run FROM ({_runs("items", "lengths ON lid = iid", "iid")}) JOIN items USING (iid)
), found AS MATERIALIZED (
  SELECT * FROM ({_runs("docs", "(SELECT DISTINCT t FROM spans) ON t <= n", "rid")}) WHERE run IN (SELECT run FROM spans)
), hit AS (
  SELECT rid, count(DISTINCT word) AS n FROM (SELECT rid, unnest(range(place, place + t)) AS word FROM found) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, item FROM found JOIN spans USING (t, run)) GROUP BY rid
)
SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""


# --- op13: units by pattern, cut by position ------------------------------------------------------


def _draw(i: int) -> str:
    return f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS BIGINT)"


_FIM = infill.InfillConfig()
_P, _S, _M = (_quoted(x) for x in (_FIM.prefix, _FIM.suffix, _FIM.middle))

OP13 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{_FIM.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, {_draw(0)} % (len(units) + 1) AS one, {_draw(1)} % (len(units) + 1) AS two,
         CASE WHEN text = '' OR contains(text, {_P}) OR contains(text, {_S}) OR contains(text, {_M}) OR {_draw(2)} % 100 >= {_FIM.cut_percent}
              THEN 'plain' WHEN {_draw(3)} % 100 < {_FIM.suffix_first_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM docs
), cut AS (
  SELECT *, array_to_string(units[1:least(one, two)], '') AS prefix, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:n], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {_P} || prefix || {_S} || suffix || {_M} || middle
                        ELSE {_S} || suffix || {_P} || prefix || {_M} || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

ORACLES: dict[str, str] = {
    "op1_url_filters": OP1,
    "op7_warc": OP7,
    "op8_secret_scans": OP8,
    "op9_nearest_neighbours": OP9,
    "op10_quality_rules": OP10,
    "op11_decontamination": OP11,
    "op13_infill": OP13,
}
