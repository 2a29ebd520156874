"""The same questions in SQL for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from vecloom.functions import text as X
from vecloom.plans.catalog import TEST_ASPECTS, VECTOR_SIZE
from vecloom.schema import CLUSTER_PALETTE

ITEMS = """items AS (
  SELECT d.doc_id AS item_id, split_part(d.text, chr(10), 1) AS title, d.source AS provider,
         d.text AS review, CASE WHEN l.doc_id IS NOT NULL THEN d.text END AS structured_summary
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

VECTORS = """vecs AS (
  SELECT e.vec_id AS item_id, split_part(d.text, chr(10), 1) AS title, d.source AS provider,
         d.text AS summary, e.label AS cluster, e.embedding::DOUBLE[] AS v
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""

PLAIN = """vecs AS (
  SELECT vec_id AS item_id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings)"""

CELLS = """cells AS (
  SELECT item_id, cluster, unnest(v) AS value, (generate_subscripts(v, 1) - 1)::INTEGER AS dim
  FROM vecs)"""

CENTRES = """centres AS (
  SELECT cluster, list(value ORDER BY dim) AS c
  FROM (SELECT cluster, dim, avg(value) AS value FROM cells GROUP BY 1, 2) GROUP BY cluster)"""

STRIP = r"E' \t\n\r'"
TOKENS = r"'[\p{L}\p{N}_]{2,}'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: Sequence[str]) -> str:
    return ", ".join(_text(v) for v in values)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _content_words(text: str) -> str:
    stop = _list(X.english_stop_words())
    return (
        f"list_filter(regexp_extract_all(lower({text}), {TOKENS}), lambda t: t NOT IN ({stop}))"
    )


def _embedding(table: str, fitted: str = "TRUE", dimensions: int = 256) -> list[str]:
    """CTEs ending in units(item_id, dim, value): hashed words and word pairs by rarity, unit length."""
    return [
        f"""worded AS (SELECT item_id, {fitted} AS fitted, {_content_words('review')} AS w FROM {table}
  WHERE length(trim(review, {STRIP})) > 0)""",
        """terms AS (
  SELECT item_id, fitted, unnest(list_concat(w, list_transform(
    range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM worded)""",
        f"""counted AS (
  SELECT item_id, fitted, (('0x' || substr(md5(term), 1, 8))::BIGINT % {dimensions})::INTEGER AS dim,
         count(*) AS tf FROM terms GROUP BY ALL)""",
        """rarity AS (
  SELECT dim, ln(((SELECT count(*) FROM worded WHERE fitted) + 1) / (count(*) FILTER (WHERE fitted) + 1)) AS idf
  FROM counted GROUP BY dim)""",
        "weighted AS (SELECT item_id, dim, tf * idf AS x FROM counted JOIN rarity USING (dim) WHERE idf <> 0)",
        """units AS (
  SELECT item_id, dim, (x / sqrt(sum(x * x) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE AS value FROM weighted)""",
    ]


def _aspect_ctes(source: str, aspects: Mapping[str, Sequence[str]]) -> list[str]:
    """Sentences with hits per aspect, then one pick per aspect among unused sentences."""
    hits = ", ".join(
        f"len(list_filter(regexp_extract_all(lower(s), {TOKENS}), lambda t: t IN ({_list(words)}))) AS h{k}"
        for k, words in enumerate(aspects.values())
    )
    ctes = [
        f"""raw_sents AS (
  SELECT item_id, list_filter(list_transform(
           regexp_extract_all(review, '[^.!?]+[.!?]*'), lambda s: trim(s, {STRIP})),
           lambda s: length(s) > 0) AS ss FROM {source})""",
        """sents0 AS (
  SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM raw_sents)""",
        f"sents AS MATERIALIZED (SELECT item_id, pos, s, {hits} FROM sents0)",
    ]
    used: list[str] = []
    for k in range(len(aspects)):
        free = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM {u} WHERE {u}.item_id = x.item_id AND {u}.pos = x.pos)"
            for u in used
        )
        ctes.append(
            f"""p{k} AS MATERIALIZED (
  SELECT item_id, pos, s, {k} AS step FROM (
    SELECT x.*, row_number() OVER (PARTITION BY item_id ORDER BY h{k} DESC, pos) AS rn
    FROM sents x WHERE TRUE{free}) WHERE rn = 1)"""
        )
        used.append(f"p{k}")
    union = " UNION ALL ".join(f"SELECT item_id, s, step FROM {u}" for u in used)
    ctes.append(
        f"""joined AS (
  SELECT item_id, string_agg(s, chr(10) ORDER BY step) AS lines FROM ({union}) GROUP BY item_id)"""
    )
    ctes.append(
        f"""summaries AS (
  SELECT i.item_id, CASE WHEN length(trim(i.review, {STRIP})) >= {X.MIN_SUMMARISABLE_CHARS}
                         THEN coalesce(j.lines, '')
                         ELSE i.title || {_text(X.NO_DESCRIPTION)} END AS structured_summary
  FROM {source} i LEFT JOIN joined j USING (item_id))"""
    )
    return ctes


_NOT_BLANK_TITLE = f"length(trim(coalesce(title, ''), {STRIP})) > 0"
_NOT_BLANK_REVIEW = f"length(trim(review, {STRIP})) > 0"
_PENDING = f"pending AS (SELECT * FROM items WHERE structured_summary IS NULL AND {_NOT_BLANK_TITLE})"

_WORD_COUNTS = f"""counts AS (
  SELECT cluster, term, count(*) AS tf FROM (
    SELECT cluster, unnest({_content_words('summary')}) AS term FROM vecs) GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY tf DESC, term)::INTEGER AS rank
  FROM counts)"""

_THEMES = f"""docs AS (
  SELECT item_id, cluster, {_content_words('summary')} AS w
  FROM vecs WHERE length(trim(summary, {STRIP})) > 0),
terms AS (
  SELECT item_id, cluster, unnest(list_concat(w, list_transform(
    range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM docs),
per_doc AS (SELECT item_id, cluster, term, count(*) AS n FROM terms GROUP BY 1, 2, 3),
stats AS (SELECT cluster, term, sum(n)::BIGINT AS tf, count(*) AS df FROM per_doc GROUP BY 1, 2),
sizes AS (SELECT cluster, count(*) AS n FROM docs GROUP BY 1),
themes AS (
  SELECT s.cluster, row_number() OVER (PARTITION BY s.cluster ORDER BY tf DESC, term)::INTEGER AS rank,
         term, tf, df
  FROM stats s JOIN sizes z ON s.cluster = z.cluster WHERE df >= 2 AND df <= 0.9::DOUBLE * z.n
  QUALIFY rank <= 5)"""

_PROVIDERS = """counted AS (
  SELECT cluster, coalesce(provider, '') AS provider, count(*) AS n, min(item_id) AS first_item
  FROM vecs GROUP BY 1, 2),
providers AS (
  SELECT * FROM (
    SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_item)::INTEGER AS rank,
           provider, n AS count,
           round(n::DOUBLE / (sum(n) OVER (PARTITION BY cluster))::DOUBLE * 100, 1) AS percentage
    FROM counted)
  WHERE rank <= 5 AND provider NOT IN ('', 'Unknown'))"""


def _neighbours(same_cluster: bool, focal: str = "") -> str:
    restrict = "AND a.cluster = b.cluster" if same_cluster else ""
    return (
        _with(VECTORS)
        + f"""SELECT item_id, rank, neighbour_id, neighbour_title, round(sim, 6) AS similarity FROM (
  SELECT a.item_id, b.item_id AS neighbour_id, b.title AS neighbour_title, s.sim,
         row_number() OVER (PARTITION BY a.item_id
           ORDER BY round(s.sim, 9) DESC, b.title DESC, b.item_id)::INTEGER AS rank
  FROM vecs a JOIN vecs b ON a.item_id <> b.item_id {restrict},
       LATERAL (SELECT list_cosine_similarity(a.v, b.v) AS sim) s
  {focal}) WHERE rank <= 5"""
    )


_FOCAL = """WHERE a.item_id IN (SELECT item_id FROM (
    SELECT item_id, row_number() OVER (PARTITION BY cluster ORDER BY item_id) AS rn FROM vecs) WHERE rn <= 3)"""


#: CTEs ending in met(item_id, neighbour_id, …): items of a cluster that share a bucket one of them probes.
_HYPERPLANES = """units AS (
  SELECT item_id, cluster, title, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
  FROM vecs WHERE list_dot_product(v, v) > 0 AND cluster IS NOT NULL),
unit_cells AS (
  SELECT item_id, cluster, unnest(u) AS value, generate_subscripts(u, 1) - 1 AS dim FROM units),
centred AS (
  SELECT item_id, cluster, dim, value - avg(value) OVER (PARTITION BY cluster, dim) AS value FROM unit_cells),
planes AS (
  SELECT t, b, dim, CASE WHEN md5('42:' || t || ':' || b || ':' || dim)[1] < '8' THEN 1 ELSE -1 END AS sign
  FROM range(8) x(t), range(4) y(b), (SELECT DISTINCT dim FROM unit_cells)),
projected AS (
  SELECT item_id, cluster, t, b, sum(sign * value) AS p FROM centred JOIN planes USING (dim) GROUP BY ALL),
own AS (
  SELECT item_id, cluster, t, sum(CASE WHEN p > 0 THEN 1 << b ELSE 0 END)::BIGINT AS bucket
  FROM projected GROUP BY item_id, cluster, t),
crossed AS (
  SELECT item_id, t, mask, row_number() OVER (
    PARTITION BY item_id, t ORDER BY sum(CASE WHEN (mask >> b) & 1 = 1 THEN p * p ELSE 0 END), mask) AS place
  FROM projected, range(16) m(mask) GROUP BY item_id, t, mask),
probed AS (
  SELECT item_id, cluster, t, xor(bucket, mask) AS bucket FROM own JOIN crossed USING (item_id, t) WHERE place <= 4),
met AS (
  SELECT DISTINCT a.item_id, b.item_id AS neighbour_id
  FROM probed a JOIN own b ON a.cluster = b.cluster AND a.t = b.t AND a.bucket = b.bucket AND a.item_id <> b.item_id),
near AS (
  SELECT item_id, neighbour_id, neighbour_title, sim, row_number() OVER (
    PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbour_title DESC, neighbour_id)::INTEGER AS rank
  FROM (SELECT m.*, y.title AS neighbour_title, list_cosine_similarity(x.v, y.v) AS sim
        FROM met m JOIN units x ON x.item_id = m.item_id JOIN units y ON y.item_id = m.neighbour_id))"""


def _silhouette(distance: str) -> str:
    return (
        _with(
            PLAIN,
            f"""sums AS (
  SELECT a.item_id, a.cluster AS own, b.cluster AS other, sum({distance}) AS total
  FROM vecs a, vecs b GROUP BY 1, 2, 3)""",
            "sizes AS (SELECT cluster, count(*) AS n FROM vecs GROUP BY 1)",
            """ab AS (
  SELECT item_id, own, max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a,
         min(CASE WHEN own <> other THEN total / n END) AS b,
         max(CASE WHEN own = other THEN n END) AS own_n
  FROM sums JOIN sizes ON other = cluster GROUP BY 1, 2)""",
        )
        + """SELECT item_id, own AS cluster,
  round(CASE WHEN own_n > 1 AND b IS NOT NULL AND greatest(a, b) > 0
             THEN (b - a) / greatest(a, b) ELSE 0.0 END, 6) AS silhouette FROM ab"""
    )


def _palette(cluster: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {_text(c)}" for i, c in enumerate(CLUSTER_PALETTE))
    return f"CASE {cluster} {cases} END"


_DESCRIPTION = """SELECT dim, count(*) AS count, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM cells GROUP BY dim"""

_REQUEST = X.REQUEST_TEMPLATE.split("%s")


# Bandwidths by the same number of halvings, for all items at once: one recursion step
# per halving over the sorted neighbour distances of an item.
_AFFINITIES = """near AS (
  SELECT * FROM (
    SELECT a.item_id, b.item_id AS other, 2 - 2 * s.sim AS d2, row_number() OVER (PARTITION BY a.item_id
      ORDER BY round(s.sim, 9) DESC, b.title DESC, b.item_id) AS rank
    FROM vecs a JOIN vecs b ON a.item_id <> b.item_id,
         LATERAL (SELECT list_cosine_similarity(a.v, b.v) AS sim) s) WHERE rank <= 90),
lists AS (
  SELECT item_id, list(d2 - low ORDER BY rank) AS d, ln(least(30, count(*))) AS target
  FROM (SELECT *, min(d2) OVER (PARTITION BY item_id) AS low FROM near) GROUP BY item_id),
search(item_id, d, target, lo, hi, beta, step) AS (
  SELECT item_id, d, target, 0.0::DOUBLE, 'inf'::DOUBLE, 1.0::DOUBLE, 0 FROM lists
  UNION ALL
  SELECT item_id, d, target, CASE WHEN wide THEN beta ELSE lo END, CASE WHEN wide THEN hi ELSE beta END,
    CASE WHEN wide AND isinf(hi) THEN beta * 2
         WHEN wide THEN (beta + hi) / 2 ELSE (lo + beta) / 2 END, step + 1
  FROM (
    SELECT *, ln(total) + beta * weighted / total > target AS wide FROM (
      SELECT *, list_sum(list_transform(d, lambda x: exp(-x * beta))) AS total,
        list_sum(list_transform(d, lambda x: x * exp(-x * beta))) AS weighted
      FROM search WHERE step < 60))),
betas AS (
  SELECT item_id, beta, list_sum(list_transform(d, lambda x: exp(-x * beta))) AS total
  FROM search WHERE step = 60),
directed AS (
  SELECT n.item_id, n.other, exp(-(n.d2 - low) * beta) / total AS p
  FROM (SELECT *, min(d2) OVER (PARTITION BY item_id) AS low FROM near) n JOIN betas USING (item_id)),
pairs AS (
  SELECT least(item_id, other) AS low, greatest(item_id, other) AS high, sum(p) AS p,
    max(item_id < other) AS up FROM directed GROUP BY 1, 2)"""


def all_oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources and sinks
    sql["csv_roundtrip"] = (
        _with(ITEMS)
        + "SELECT item_id, title, provider, review, coalesce(structured_summary, '') AS structured_summary FROM items"
    )
    sql["tolerant_csv"] = (
        _with(ITEMS)
        + f"SELECT trim(title, {STRIP}) AS title, trim(review, {STRIP}) AS review_text FROM items"
    )
    sql["mixed_header_csv"] = sql["tolerant_csv"]
    sql["append_csv"] = sql["csv_roundtrip"]
    sql["layout_export"] = _with(VECTORS) + f"""
SELECT item_id AS id, round(v[1], 6) AS x, round(v[2], 6) AS y, round(v[3], 6) AS z, cluster,
  {_palette('cluster')} AS color,
  CASE WHEN provider <> 'src3' THEN title ELSE 'Game ' || item_id END AS name, summary AS description
FROM vecs"""
    sql["layout_json_roundtrip"] = _with(VECTORS) + """
SELECT title, provider, cluster, round(v[1], 6) AS "tsneX", round(v[2], 6) AS "tsneY",
  round(v[3], 6) AS "tsneZ", summary FROM vecs"""
    sql["json_array"] = sql["layout_json_roundtrip"]
    sql["cluster_info"] = _with(VECTORS) + f"""
SELECT cluster, n AS count, {_palette('cluster')} AS color, (rn - 1)::INTEGER AS position, title AS sample_game
FROM (SELECT cluster, title, count(*) OVER (PARTITION BY cluster) AS n,
             row_number() OVER (PARTITION BY cluster ORDER BY item_id) AS rn FROM vecs) WHERE rn <= 5"""
    sql["embedding_index"] = _with(VECTORS) + "SELECT item_id, title FROM vecs WHERE v IS NOT NULL"

    # schema and projection
    sql["normalise_columns"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
    sql["resolve_columns"] = (
        _with(ITEMS) + "SELECT item_id, title, review, structured_summary, provider FROM items"
    )
    sql["combined_text"] = (
        _with(ITEMS)
        + "SELECT item_id, title || ' ' || coalesce(structured_summary, '') || ' ' || review AS combined_text FROM items"
    )
    sql["vector_pack"] = (
        _with(PLAIN, CELLS) + "SELECT item_id, dim, round(value, 6) AS value FROM cells"
    )
    wide = ", ".join(f"round(v[{i + 1}], 6) AS e{i}" for i in range(VECTOR_SIZE))
    sql["vector_unpack"] = _with(PLAIN) + f"SELECT item_id, {wide} FROM vecs"
    marked = (
        f"CASE WHEN length(review) > {X.REQUEST_MAX_CHARS} "
        f"THEN substring(review, 1, {X.REQUEST_MAX_CHARS}) || {_text(X.REQUEST_ELLIPSIS)} ELSE review END"
    )
    sql["truncate_text"] = _with(ITEMS) + f"""
SELECT item_id, substring(review, 1, {X.EMBED_MAX_CHARS}) AS for_embedding, {marked} AS for_request FROM items"""
    sql["text_quality_gate"] = _with(ITEMS) + f"""
SELECT item_id, length(s) AS stripped_length, length(s) >= {X.MIN_REVIEW_CHARS} AS passes,
  CASE WHEN length(s) >= {X.MIN_SUMMARISABLE_CHARS} THEN s
       ELSE title || {_text(X.NO_DESCRIPTION)} END AS gated_text
FROM (SELECT item_id, title, trim(review, {STRIP}) AS s FROM items)"""
    sql["summary_request"] = _with(ITEMS) + f"""
SELECT item_id, {_text(_REQUEST[0])} || title || {_text(_REQUEST[1])} || {marked} AS request FROM items"""
    sql["embed_input"] = _with(ITEMS) + f"""
SELECT item_id, {_text(X.EMBED_PREFIX)} || structured_summary AS embed_text FROM items
WHERE {_NOT_BLANK_TITLE} AND length(trim(coalesce(structured_summary, ''), {STRIP})) > 0"""
    sql["cluster_assignments_table"] = (
        _with(VECTORS) + "SELECT item_id, title, cluster, summary, coalesce(provider, '') AS provider FROM vecs"
    )

    # filters
    sql["with_summary"] = _with(ITEMS) + """
SELECT item_id, title, structured_summary FROM items
WHERE structured_summary IS NOT NULL AND structured_summary <> ''"""
    sql["pending_items"] = _with(ITEMS, _PENDING) + """
SELECT item_id, title FROM pending p WHERE NOT EXISTS (
  SELECT 1 FROM items d WHERE d.structured_summary IS NOT NULL AND d.title = p.title)"""
    sql["take_next_n"] = (
        _with(ITEMS, _PENDING)
        + "SELECT item_id, title FROM pending ORDER BY item_id LIMIT 250 OFFSET 100"
    )
    sql["embedding_rejects"] = _with(ITEMS) + """
SELECT item_id, title FROM items LEFT JOIN embeddings ON vec_id = item_id WHERE embedding IS NULL"""
    sql["item_search"] = _with(ITEMS) + """
SELECT item_id, title, provider FROM items
WHERE provider = 'src3' AND contains(lower(title), 'tion')"""

    sql["item_search_index"] = sql["item_search"]

    # joins and sets
    sql["new_items_anti"] = _with(ITEMS, VECTORS) + f"""
SELECT min(item_id) AS item_id, title FROM items i
WHERE structured_summary IS NOT NULL AND structured_summary <> '' AND {_NOT_BLANK_TITLE}
  AND NOT EXISTS (SELECT 1 FROM vecs x WHERE x.title = i.title) GROUP BY title"""
    sql["attach_summary"] = _with(ITEMS, VECTORS) + """
, latest AS (
  SELECT title, structured_summary, provider FROM items
  WHERE structured_summary IS NOT NULL AND structured_summary <> ''
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY item_id DESC) = 1)
SELECT x.item_id, x.title, x.cluster, l.structured_summary AS summary, l.provider AS summary_provider
FROM vecs x LEFT JOIN latest l ON x.title = l.title"""
    sql["upsert_summaries"] = _with(ITEMS, _PENDING, *_aspect_ctes("pending", TEST_ASPECTS)) + """
SELECT i.item_id, coalesce(s.structured_summary, i.structured_summary) AS structured_summary
FROM items i LEFT JOIN summaries s USING (item_id)"""
    sql["merge_summaries"] = _with(ITEMS, VECTORS) + """
, rows AS (
  SELECT 0 AS src, item_id, title, review, structured_summary FROM items
  UNION ALL SELECT 1, item_id, title, NULL, summary FROM vecs),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY src, item_id) AS any_rn,
    CASE WHEN structured_summary IS NOT NULL THEN row_number() OVER (
      PARTITION BY title, structured_summary IS NOT NULL ORDER BY src, item_id) END AS first_rn,
    CASE WHEN structured_summary IS NOT NULL THEN row_number() OVER (
      PARTITION BY title, structured_summary IS NOT NULL ORDER BY src DESC, item_id DESC) END AS last_rn
  FROM rows)
SELECT title, coalesce(max(CASE WHEN any_rn = 1 THEN review END), '') AS review,
  max(CASE WHEN last_rn = 1 THEN structured_summary END) AS structured_summary,
  max(CASE WHEN first_rn = 1 THEN src END)::INTEGER AS first_source,
  max(CASE WHEN first_rn = 1 THEN item_id END) AS first_row
FROM numbered GROUP BY title HAVING count(structured_summary) > 0"""
    sql["vector_item_join"] = _with(VECTORS) + """
SELECT item_id, title, provider, cluster, len(v)::INTEGER AS dimensions, round(v[1], 6) AS first_value FROM vecs"""
    sql["dedup_enrich"] = f"""
SELECT p_partkey AS item_id,
  len(regexp_extract_all(lower(p_name || ' ' || p_brand), {TOKENS}))::INTEGER AS n_words FROM part"""
    sql["memo_rerun"] = _with(ITEMS, *_aspect_ctes("items", TEST_ASPECTS)) + """
SELECT item_id, s.structured_summary, CASE WHEN review IN (SELECT review FROM items WHERE item_id % 2 = 0)
  THEN 1 ELSE 2 END::INTEGER AS asked_run FROM items JOIN summaries s USING (item_id)"""
    sql["combine_embeddings"] = _with(ITEMS, *_embedding("items", "structured_summary IS NOT NULL")) + f"""
, fresh AS (
  SELECT * FROM items WHERE structured_summary IS NULL AND {_NOT_BLANK_TITLE} AND {_NOT_BLANK_REVIEW}
    AND title NOT IN (SELECT title FROM items WHERE structured_summary IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY item_id) = 1),
chosen AS (
  SELECT item_id, title FROM items WHERE structured_summary IS NOT NULL AND {_NOT_BLANK_REVIEW}
  UNION ALL SELECT item_id, title FROM fresh)
SELECT c.item_id, c.title, round(sum(u.value), 4) AS total
FROM chosen c LEFT JOIN units u USING (item_id) GROUP BY ALL"""
    sql["distinct_titles"] = _with(ITEMS) + "SELECT DISTINCT title FROM items"

    # aggregates and reports
    sql["cluster_summary"] = _with(VECTORS) + """
SELECT cluster, count(title) AS count, arg_min(title, item_id) AS first, arg_max(title, item_id) AS last
FROM vecs GROUP BY cluster"""
    sql["cluster_distribution"] = """
SELECT label AS cluster, count(*) AS count,
  round(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100, 2) AS percentage, count(*) OVER () AS clusters
FROM embeddings GROUP BY label"""
    sql["top_providers"] = (
        _with(VECTORS, _PROVIDERS) + "SELECT cluster, rank, provider, count, percentage FROM providers"
    )
    sql["embedding_stats"] = _with(PLAIN, CELLS) + _DESCRIPTION
    sql["consistency_audit"] = _with(ITEMS, VECTORS) + """
, stages AS (
  SELECT 0 AS position, 'summaries' AS stage, count(*) AS n_rows, count(structured_summary) AS n_valid,
         count(DISTINCT item_id) AS distinct_keys, 0 AS keys_lost, 0 AS keys_added FROM items
  UNION ALL SELECT 1, 'embeddings', count(*), count(embedding), count(DISTINCT vec_id),
    (SELECT count(*) FROM items WHERE item_id NOT IN (SELECT vec_id FROM embeddings)),
    (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM items)) FROM embeddings
  UNION ALL SELECT 2, 'layout', count(*), count(v[1]), count(DISTINCT item_id),
    (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM vecs)), 0 FROM vecs
  UNION ALL SELECT 3, 'clusters', count(*), count(cluster), count(DISTINCT item_id), 0, 0 FROM vecs)
SELECT position::INTEGER AS position, stage, n_rows, n_valid, distinct_keys,
  keys_lost::BIGINT AS keys_lost, keys_added::BIGINT AS keys_added,
  coalesce(lag(n_rows) OVER (ORDER BY position) <> n_rows, FALSE) AS mismatch FROM stages"""
    sql["quantile_sketches"] = _with(PLAIN, CELLS) + """
SELECT dim, count(*) AS count, share, TRUE AS close
FROM cells, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(share) GROUP BY dim, share"""
    sql["key_sketches"] = """
WITH runs AS (
  SELECT 'items' AS stage, doc_id AS k, TRUE AS old FROM labels UNION SELECT 'items', doc_id, FALSE FROM documents
  UNION SELECT 'vectors', vec_id, TRUE FROM embeddings WHERE vec_id % 3 <> 0
  UNION SELECT 'vectors', vec_id, FALSE FROM embeddings WHERE vec_id % 3 <> 1),
keys AS (SELECT stage, k, bool_or(old) AS was, bool_or(NOT old) AS now FROM runs GROUP BY stage, k)
SELECT stage, count(*) FILTER (was) AS before, count(*) FILTER (now) AS after,
  count(*) FILTER (was AND NOT now) AS lost, count(*) FILTER (now AND NOT was) AS added, TRUE AS close
FROM keys GROUP BY stage"""
    sql["title_audit"] = _with(VECTORS) + """
SELECT count(*) AS n_rows, count(DISTINCT coalesce(title, '')) AS distinct_titles,
  count(DISTINCT coalesce(cluster, -1)) AS distinct_clusters FROM vecs"""
    sql["top_words"] = _with(VECTORS, _WORD_COUNTS) + """
SELECT c.cluster, coalesce(rank, 1)::INTEGER AS rank, coalesce(term, 'N/A') AS term, coalesce(tf, 0)::BIGINT AS tf
FROM (SELECT DISTINCT cluster FROM vecs) c
LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON c.cluster = r.cluster"""
    sql["key_themes"] = _with(VECTORS, _THEMES) + "SELECT cluster, rank, term, tf, df FROM themes"
    sql["term_weights"] = _with(VECTORS, _WORD_COUNTS) + """
SELECT cluster, rank, term, tf,
  round(tf::DOUBLE / max(tf) OVER (PARTITION BY cluster), 6) AS weight FROM ranked WHERE rank <= 50"""
    sql["cost_ledger"] = """
WITH numbered AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents),
batches AS (SELECT batch, count(*) AS n FROM numbered GROUP BY 1)
SELECT batch::BIGINT AS batch, n AS n_rows, round(n * 0.0001::DOUBLE, 6) AS cost,
  (sum(n) OVER w)::BIGINT AS processed, (sum(n) OVER ())::BIGINT AS total,
  round((sum(n) OVER w)::DOUBLE * 0.0001::DOUBLE, 6) AS cumulative_cost
FROM batches WINDOW w AS (ORDER BY batch)"""
    sql["cost_estimate"] = """
SELECT s AS sample_rows, round(s * 0.0001::DOUBLE, 6) AS sample_cost, n AS total,
  round(round(s * 0.0001::DOUBLE, 6) / s * n, 6) AS estimated_cost
FROM (SELECT least(count(*), 100) AS s, count(*) AS n FROM documents)"""
    sql["enrich_status"] = f"""
SELECT count(*) AS processed, count(*) FILTER (n >= {X.MIN_REVIEW_CHARS}) AS completed,
  count(*) FILTER (n >= {X.MIN_SUMMARISABLE_CHARS} AND n < {X.MIN_REVIEW_CHARS}) AS skipped,
  count(*) FILTER (n < {X.MIN_SUMMARISABLE_CHARS}) AS failed
FROM (SELECT length(trim(text, {STRIP})) AS n FROM documents)"""
    sql["cluster_profile"] = _with(VECTORS, _PROVIDERS, _THEMES) + """
, base AS (
  SELECT cluster, count(*) AS count,
    round(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100, 1) AS percentage FROM vecs GROUP BY 1),
samples AS (
  SELECT cluster, string_agg(title, ', ' ORDER BY rn) AS samples FROM (
    SELECT cluster, title, row_number() OVER (PARTITION BY cluster ORDER BY item_id) AS rn FROM vecs)
  WHERE rn <= 5 GROUP BY 1),
p AS (
  SELECT cluster, string_agg(provider || ': ' || count || ' (' || percentage || '%)', ', ' ORDER BY rank) AS providers
  FROM providers GROUP BY 1),
t AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS themes FROM themes GROUP BY 1)
SELECT b.cluster, b.count, b.percentage, coalesce(p.providers, '') AS providers,
  coalesce(t.themes, '') AS themes, coalesce(s.samples, '') AS samples
FROM base b LEFT JOIN p ON b.cluster = p.cluster LEFT JOIN t ON b.cluster = t.cluster
LEFT JOIN samples s ON b.cluster = s.cluster ORDER BY b.count DESC, b.cluster"""
    sql["row_ids"] = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents"
    sql["cluster_samples"] = _with(VECTORS) + """
SELECT cluster, item_id, title,
  row_number() OVER (PARTITION BY cluster ORDER BY item_id)::INTEGER AS sample_rank
FROM vecs QUALIFY sample_rank <= 5"""
    sql["cluster_random_sample"] = _with(VECTORS) + """
SELECT cluster, item_id, title, row_number() OVER (PARTITION BY cluster ORDER BY
  ((item_id + 42) % 2147483647 * 48271 % 2147483647) * 48271 % 2147483647, item_id)::INTEGER AS sample_rank
FROM vecs QUALIFY sample_rank <= 5"""

    # vectors
    sql["similar_items"] = _neighbours(True)
    sql["similar_items_preview"] = _neighbours(True, _FOCAL)
    sql["recommend_items"] = _neighbours(False)
    sql["similar_items_lsh"] = _with(VECTORS, _HYPERPLANES) + """
SELECT item_id, rank, neighbour_id, neighbour_title, round(sim, 6) AS similarity FROM near WHERE rank <= 5"""
    sql["lsh_recall"] = _with(VECTORS, _HYPERPLANES, f"exact AS ({_neighbours(True)})") + """
SELECT count(*) AS wanted, count(n.item_id) AS found, count(n.item_id) / count(*) AS recall
FROM exact e LEFT JOIN near n ON n.rank <= 5 AND e.item_id = n.item_id AND e.neighbour_id = n.neighbour_id"""
    sql["layout_forces"] = """
WITH points AS (
  SELECT vec_id AS item_id, embedding[1]::DOUBLE * 400 AS x, embedding[2]::DOUBLE * 400 AS y,
         embedding[3]::DOUBLE * 400 AS z FROM embeddings)
SELECT a.item_id, round(sum(q2 * (a.x - b.x)) * 1e6, 1) AS rx, round(sum(q2 * (a.y - b.y)) * 1e6, 1) AS ry,
       round(sum(q2 * (a.z - b.z)) * 1e6, 1) AS rz, true AS "within"
FROM points a, points b,
     LATERAL (SELECT (1 + (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) ** -2 AS q2) s
GROUP BY a.item_id"""
    sql["recommend_items_ivf"] = sql["recommend_items_blocks"] = sql["recommend_items"]
    sql["cosine_pairs"] = _with(PLAIN) + """
SELECT a.item_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
FROM vecs a JOIN vecs b ON b.item_id = a.item_id + 1"""
    sql["semantic_search"] = _with(VECTORS, CELLS, CENTRES) + """
SELECT query_id, rank, item_id, title, round(sim, 6) AS similarity FROM (
  SELECT q.cluster::BIGINT AS query_id, x.item_id, x.title, s.sim, row_number() OVER (PARTITION BY q.cluster
    ORDER BY round(s.sim, 9) DESC, x.title DESC, x.item_id)::INTEGER AS rank
  FROM centres q, vecs x, LATERAL (SELECT list_cosine_similarity(q.c, x.v) AS sim) s) WHERE rank <= 10"""
    sql["search_query_table"] = _with(VECTORS) + """
SELECT query_id, rank, item_id, title, round(sim, 6) AS similarity FROM (
  SELECT q.vec_id AS query_id, x.item_id, x.title, s.sim, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY round(s.sim, 9) DESC, x.title DESC, x.item_id)::INTEGER AS rank
  FROM embeddings q, vecs x,
    LATERAL (SELECT list_cosine_similarity(list_reverse(q.embedding::DOUBLE[]), x.v) AS sim) s) WHERE rank <= 10"""
    sql["standardise"] = _with(PLAIN, CELLS) + """
SELECT item_id, dim, round(CASE WHEN stddev_pop(value) OVER (PARTITION BY dim) > 0
  THEN (value - avg(value) OVER (PARTITION BY dim)) / stddev_pop(value) OVER (PARTITION BY dim)
  ELSE 0.0 END, 6) AS value FROM cells"""
    sql["centroids"] = (
        _with(PLAIN, CELLS) + "SELECT cluster, dim, round(avg(value), 6) AS value FROM cells GROUP BY 1, 2"
    )
    sql["inertia"] = _with(PLAIN, CELLS, CENTRES) + """
SELECT x.cluster, count(*) AS count, round(sum(list_distance(x.v, c.c) ** 2), 6) AS inertia
FROM vecs x JOIN centres c ON x.cluster = c.cluster GROUP BY 1"""
    sql["assign_nearest"] = _with(PLAIN, CELLS, CENTRES) + """
SELECT x.item_id, c.cluster, round(s.d, 6) AS distance
FROM vecs x, centres c, LATERAL (SELECT list_distance(x.v, c.c) ** 2 AS d) s
QUALIFY row_number() OVER (PARTITION BY x.item_id ORDER BY s.d, c.cluster) = 1"""
    sql["cluster_cohesion"] = _with(PLAIN) + """
SELECT s.cluster, s.n AS count, round(p.mean, 6) AS cohesion
FROM (SELECT cluster, count(*) AS n FROM vecs GROUP BY 1) s LEFT JOIN (
  SELECT a.cluster, avg(list_cosine_similarity(a.v, b.v)) AS mean
  FROM vecs a JOIN vecs b ON a.cluster = b.cluster AND a.item_id < b.item_id GROUP BY 1) p
ON s.cluster = p.cluster"""
    sql["silhouette_exact"] = sql["silhouette_bounded"] = _silhouette("list_distance(a.v, b.v)")
    octants = """vecs AS (
  SELECT vec_id AS item_id, embedding[1:3]::DOUBLE[] AS v, (embedding[1] > 0)::INTEGER
         + 2 * (embedding[2] > 0)::INTEGER + 4 * (embedding[3] > 0)::INTEGER AS cluster FROM embeddings)"""
    sql["silhouette_work"] = _with(
        octants,
        f"scores AS ({_silhouette('list_distance(a.v, b.v)').replace('WITH ' + PLAIN, 'WITH ' + octants)})",
        CELLS,
        CENTRES,
        """bounds AS (
  SELECT x.item_id, x.cluster, k.cluster AS target, n, list_distance(x.v, c) AS low, sqrt(list_distance(x.v, c) ** 2 + spread) AS high
  FROM vecs x, (SELECT o.cluster, any_value(o.c) AS c, count(*) AS n, avg(list_distance(y.v, o.c) ** 2) AS spread
                FROM vecs y JOIN centres o ON y.cluster = o.cluster GROUP BY o.cluster) k)""",
        """needed AS (
  SELECT *, min(CASE WHEN cluster <> target THEN high END) OVER (PARTITION BY item_id) AS best FROM bounds)""",
    ) + """
SELECT (SELECT count(*) FROM vecs) AS items, sum(n)::BIGINT AS compared, (SELECT count(*) ** 2 FROM vecs)::BIGINT AS pairs,
       (SELECT round(avg(silhouette), 6) FROM scores) AS silhouette
FROM needed WHERE cluster = target OR low <= best * (1 + 1e-9) + 1e-9"""
    sql["silhouette_fast"] = _silhouette("list_distance(a.v, b.v) ** 2")

    steps = ["s0 AS (SELECT (row_number() OVER (ORDER BY item_id) - 1)::INTEGER AS cluster, v AS c FROM vecs "
             "ORDER BY item_id LIMIT 5)"]
    for i in range(4):
        steps.append(
            f"""a{i} AS (SELECT x.item_id, s.cluster FROM vecs x, s{i} s
  QUALIFY row_number() OVER (PARTITION BY x.item_id ORDER BY list_distance(x.v, s.c), s.cluster) = 1)"""
        )
        steps.append(
            f"""s{i + 1} AS (SELECT cluster, coalesce(list(m ORDER BY dim) FILTER (m IS NOT NULL), any_value(c)) AS c FROM s{i}
  LEFT JOIN (SELECT a.cluster, dim, avg(value) AS m FROM a{i} a JOIN cells USING (item_id) GROUP BY ALL) USING (cluster)
  GROUP BY cluster)"""
        )
    sql["kmeans_steps"] = _with(PLAIN, CELLS, *steps) + """
SELECT cluster, (SELECT count(*) FROM a3 WHERE a3.cluster = s3.cluster) AS count,
  (generate_subscripts(c, 1) - 1)::INTEGER AS dim, round(unnest(c), 6) AS value FROM s3"""

    # enrichment and streaming
    sql["embed_external"] = f"""
WITH t AS (SELECT doc_id AS item_id, text, length(text) % 11 = 0 AS bad FROM documents
           WHERE length(trim(text, {STRIP})) > 0)
SELECT item_id, 'ValueError: text refused' AS error, NULL::INTEGER AS dim, NULL::DOUBLE AS value FROM t WHERE bad
UNION ALL SELECT item_id, NULL, d::INTEGER, CASE d WHEN 0 THEN length(text)
  WHEN 1 THEN length(text) - length(replace(text, ' ', '')) ELSE length(text) - length(replace(text, '.', '')) END::DOUBLE
FROM t, (VALUES (0), (1), (2)) dims(d) WHERE NOT bad"""
    sql["stream_enrichment"] = _with(ITEMS) + """
SELECT item_id, CASE length(review) % 7 WHEN 0 THEN CASE item_id % 3 WHEN 0 THEN 'failed' ELSE 'open' END
    WHEN 1 THEN 'skipped' ELSE 'completed' END AS status,
  CASE WHEN length(review) % 7 > 1 THEN trim(title) END AS structured_summary,
  CASE length(review) % 7 WHEN 0 THEN 3 - item_id % 3 ELSE 1 END::INTEGER AS attempt FROM items"""
    sql["aspect_summary"] = (
        _with(ITEMS, *_aspect_ctes("items", TEST_ASPECTS))
        + "SELECT item_id, structured_summary FROM summaries"
    )
    sql["incremental_rerun"] = _with(ITEMS, _PENDING) + """
SELECT 1 AS pass, count(*) AS n_rows FROM pending UNION ALL SELECT 2, 0"""
    sql["embed_documents"] = _with(ITEMS, *_embedding("items")) + f"""
SELECT i.item_id, u.dim, round(u.value, 4) AS value
FROM items i LEFT JOIN units u USING (item_id)
WHERE {_NOT_BLANK_REVIEW} AND (u.value IS NULL OR round(u.value, 4) <> 0)"""
    sql["stream_assign"] = _with(ITEMS, *_embedding("items", "structured_summary IS NOT NULL")) + f"""
, sized AS (
  SELECT e.label AS cluster, i.item_id FROM items i JOIN embeddings e ON e.vec_id = i.item_id
  WHERE structured_summary IS NOT NULL AND item_id IN (SELECT item_id FROM units)),
means AS (
  SELECT cluster, dim, sum(value) / any_value(n) AS m
  FROM units JOIN (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM sized) USING (item_id)
  GROUP BY cluster, dim),
norms AS (SELECT cluster, sum(m * m) AS norm FROM means GROUP BY cluster),
fresh AS (
  SELECT item_id, title FROM items
  WHERE structured_summary IS NULL AND length(trim(review, {STRIP})) >= {X.MIN_REVIEW_CHARS}
    AND {_NOT_BLANK_TITLE} AND item_id IN (SELECT item_id FROM units)),
dots AS (
  SELECT f.item_id, m.cluster, sum(u.value * m.m) AS dot
  FROM fresh f JOIN units u USING (item_id) JOIN means m USING (dim) GROUP BY ALL)
SELECT f.item_id, f.title, n.cluster
FROM fresh f JOIN norms n ON true LEFT JOIN dots d ON d.item_id = f.item_id AND d.cluster = n.cluster
QUALIFY row_number() OVER (PARTITION BY f.item_id ORDER BY n.norm - 2 * coalesce(d.dot, 0), n.cluster) = 1"""
    sql["stream_restart"] = sql["stream_assign"]
    sql["layout_affinities"] = (
        "WITH RECURSIVE "
        + ",\n".join((VECTORS, _AFFINITIES))
        + """
SELECT CASE WHEN up THEN low ELSE high END AS source, CASE WHEN up THEN high ELSE low END AS target,
  round(p / (SELECT count(*) FROM lists), 9) AS p FROM pairs"""
    )
    return sql
