"""SQL (DuckDB) that gives the rows of this subpackage's queries, where SQL can."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_ORACLES: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


_ORACLES["op5_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), counted AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN counted c USING (key)
GROUP BY doc_id
"""

_ORACLES["op1_url_filter"] = r"""
WITH seen AS (
    SELECT page_id, url,
           TIMESTAMP '2023-01-01' + to_seconds((('0x' || md5(url)[1:7])::BIGINT % 63072000)::BIGINT) AS fetched_at,
           nullif(rtrim(lower(regexp_replace(regexp_replace(
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)', 1), '^.*@', ''), '(:[0-9]*)?$', '')), '.'), '') AS host,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)', 2)) AS path
    FROM pages
), digests AS (
    SELECT host, md5(host || '#' || i) AS d
    FROM (SELECT DISTINCT host FROM seen WHERE host IS NOT NULL), (SELECT unnest(range(6)) AS i)
), log AS (
    SELECT CASE WHEN d[9] < '8' THEN 'abuse' ELSE 'adult' END AS list,
           CASE WHEN d[10] <= '9' THEN host WHEN d[10] <= 'c' THEN regexp_replace(host, '^[^.]*\.', '') ELSE host || '/en' END AS key,
           CASE WHEN d[8] <= '7' THEN 2 WHEN d[8] <= 'a' THEN 1 ELSE 0 END AS strictness,
           TIMESTAMP '2023-01-01' + to_hours((('0x' || d[1:6])::BIGINT % 17520)::BIGINT) AS listed_at
    FROM digests WHERE d[7] < '8'
), dated AS (
    SELECT list, key, listed_at, max(strictness) AS strictness FROM log GROUP BY ALL
), intervals AS (
    SELECT *, lead(listed_at) OVER (PARTITION BY list, key ORDER BY listed_at) AS valid_to FROM dated
), keys AS (
    SELECT page_id, url, fetched_at, array_to_string(str_split(host, '.')[i:], '.') AS domain,
           list_filter(str_split(path, '/'), lambda x: x <> '') AS segments
    FROM seen, (SELECT unnest(range(1, 20)) AS i) WHERE i <= len(str_split(host, '.'))
), prefixed AS (
    SELECT page_id, url, fetched_at,
           domain || CASE WHEN n = 0 THEN '' ELSE '/' || array_to_string(segments[1:n], '/') END AS key
    FROM keys, (SELECT unnest(range(0, 3)) AS n) WHERE n <= len(segments)
), active AS (
    SELECT p.page_id, p.url, p.fetched_at, i.list, i.key, i.listed_at AS valid_from,
           CASE WHEN strictness = 2 THEN 'block' ELSE 'allow' END AS action
    FROM prefixed p JOIN intervals i ON p.key = i.key AND i.strictness > 0
        AND p.fetched_at >= i.listed_at AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to)
), ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY page_id, url, fetched_at ORDER BY length(key) DESC, action = 'allow', list, key) AS place
    FROM active
)
SELECT s.page_id, s.url, epoch(s.fetched_at)::BIGINT AS fetched_at, s.host,
       coalesce(r.action, 'allow') <> 'block' AS kept, r.list, r.key, r.action,
       epoch(r.valid_from)::BIGINT AS valid_from
FROM seen s LEFT JOIN ranked r
    ON r.place = 1 AND s.page_id = r.page_id AND s.url = r.url AND s.fetched_at = r.fetched_at
"""

_ORACLES["op3_substring_dedup"] = rf"""
WITH words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
    FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
), windows AS (
    SELECT doc_id, pos, md5(string_agg(word, ' ') OVER (
               PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) AS key, n
    FROM words
), later AS (
    SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) < doc_id AS hit FROM windows WHERE pos <= n - 12
), marked AS (
    SELECT w.doc_id, w.word, w.pos,
           coalesce(bool_or(l.hit) OVER (
               PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS removed
    FROM words w LEFT JOIN later l ON w.doc_id = l.doc_id AND w.pos = l.pos
), per_doc AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
           string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed) AS kept
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""

_ORACLES["op10_hamming_search"] = """
WITH codes AS (
    SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = 64
), pairs AS (
    SELECT q.id AS query_id, r.id AS neighbour_id,
           list_sum(list_transform(list_zip(q.code, r.code), lambda p: (p[1] <> p[2])::INT))::INT AS distance
    FROM codes q JOIN codes r ON q.id % 20 = 0 AND q.id <> r.id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank FROM pairs
)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""


def _crc32(text: str) -> str:
    """CRC-32 of an SQL text's UTF-8 bytes; a byte's effect is the xor of its bits' effects."""
    # Fixed values of CRC-32: the effects of the eight bits of a byte.
    bits = (
        0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320,
    )
    step = "(a >> 8)"
    for place, effect in enumerate(bits):
        step = f"xor({step}, ((xor(a, b) >> {place}) & 1) * {effect})"
    digits = f"hex(encode({text}))"
    numbers = f"list_transform(range(0, (length({digits}) // 2)::BIGINT), lambda i: ('0x' || {digits}[2 * i + 1:2 * i + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda a, b: {step}), 4294967295)"


_ORACLES["op11_zip_archives"] = """
WITH digests AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
    FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END::BIGINT AS refers_to, true AS intact
FROM firsts
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ORACLES["op12_target_resampling"] = f"""
WITH texts AS (
    SELECT doc_id AS id, 's' AS side, {_LETTERS} AS w FROM documents
    UNION ALL
    SELECT NULL, 't', {_LETTERS} FROM benchmark
), features AS (
    SELECT id, side, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f
    FROM texts, (SELECT unnest(range(1, 4)) AS n) WHERE len(w) >= n
), counted AS (
    SELECT side, id, f, count(*) AS c FROM features GROUP BY ALL
), numbers AS (
    SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted)
), bucketed AS (
    SELECT side, id, bucket, sum(c)::BIGINT AS c FROM counted JOIN numbers USING (f) GROUP BY ALL
), sums AS (
    SELECT b.bucket, coalesce(sum(c) FILTER (WHERE side = 's'), 0)::DOUBLE AS s,
           coalesce(sum(c) FILTER (WHERE side = 't'), 0)::DOUBLE AS t
    FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN bucketed USING (bucket) GROUP BY b.bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000)
                                   / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain
    FROM sums
), weights AS (
    SELECT id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight
    FROM bucketed JOIN gains USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
    SELECT doc_id, len({_LETTERS}) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN weights ON id = doc_id
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) OVER (PARTITION BY n_words >= 20) AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank
FROM placed
"""

_FAULTY_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"


def _best(*offers: str) -> str:
    """The least of (cost, edits, repaired text) structs; a null cost is no way."""
    return f"list_sort(list_filter([{', '.join(offers)}], lambda o: o.c IS NOT NULL))[1]"


def _move(old: str, cost: str, edit: str, line: str | None = None) -> str:
    text = f"{old}.t" if line is None else f"CASE WHEN {old}.t IS NULL THEN '' ELSE {old}.t || chr(10) END || {line}"
    return f"{{'c': {old}.c + {cost}, 'a': {old}.a || '{edit}', 't': {text}}}"


def _kept(old: str, initial: str) -> str:
    return _move(old, f"CASE WHEN NOT gone AND substr(role, 1, 1) = '{initial}' THEN cut END", "K", "role || ':' || text")


def _reroled(old: str, role: str) -> str:
    return _move(old, "CASE WHEN NOT gone THEN 2 + cut END", "R", f"'{role}:' || text")


_NO_WAY = "{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 't': NULL::VARCHAR}"

_ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE kinds AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_FAULTY_KEY)} % 20 AS kind
    FROM conversations
), hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
    FROM hurt
), faults AS (
    SELECT *, core = '' AS blank, core <> '' AND again AS duplicate,
           core <> '' AND NOT again AND substr(core, -1) NOT IN ('.', '!', '?') AS truncated,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
    FROM placed
), edited AS (
    SELECT conv_id, pos, role, text, blank OR duplicate AS gone, truncated::BIGINT AS cut FROM faults
), steps AS (
    SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}} AS n, {_NO_WAY} AS s,
           {{'c': 2::BIGINT, 'a': 'I', 't': 'user:'}} AS u,
           {{'c': 4::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS a
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, pos, n, s, u, {_best("a", _move("u", "2", "I", "'assistant:'"))}
    FROM (
        SELECT conv_id, pos, n, s,
               {_best("u", _move("n", "2", "I", "'user:'"), _move("s", "2", "I", "'user:'"), _move("a", "2", "I", "'user:'"))} AS u, a
        FROM (
            SELECT e.conv_id, e.pos, {_move("n", "3", "D")} AS n,
                   {_best(_move("s", "3", "D"), _kept("n", "s"), _NO_WAY)} AS s,
                   {_best(_move("u", "3", "D"), *(f(o, x) for o in "nsa" for f, x in ((_kept, "u"), (_reroled, "user"))))} AS u,
                   {_best(_move("a", "3", "D"), _kept("u", "a"), _reroled("u", "assistant"))} AS a
            FROM steps JOIN edited e ON e.conv_id IS NOT DISTINCT FROM steps.conv_id AND e.pos = steps.pos + 1
        )
    )
), last AS (
    SELECT conv_id, {_best("n", "a")} AS best
    FROM (SELECT conv_id, arg_max(n, pos) AS n, arg_max(a, pos) AS a FROM steps GROUP BY conv_id)
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
           count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
    FROM faults GROUP BY conv_id
)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(coalesce(best.t, '')) AS repaired_sha256
FROM last l LEFT JOIN counts c ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
