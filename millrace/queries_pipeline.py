"""Registered queries of the general training-data operators (p4, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import nested, orphans
from millrace.operators.orphans import Link
from millrace.runtime import table


def _links(spark: SparkSession, sf_dir: str) -> list[Link]:
    images, manifest = table(spark, sf_dir, "images"), table(spark, sf_dir, "mask_manifest")
    annotations, refs = table(spark, sf_dir, "annotations"), table(spark, sf_dir, "refs")
    return [
        Link("refs", refs, "ref_id", "ann_id", "annotations", annotations, "id", none=-1),
        Link("refs", refs, "ref_id", "image_id", "images", images, "id", none=-1),
        Link("images", images, "id", "file_name", "mask_manifest", manifest, "image_file"),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.children(table(spark, sf_dir, "annotations"), table(spark, sf_dir, "refs"))


def p4_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.polygons(table(spark, sf_dir, "annotations"))


def p4_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.masks(table(spark, sf_dir, "annotations"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.sentences(table(spark, sf_dir, "refs"))


def p4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.tokens(table(spark, sf_dir, "refs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans(_links(spark, sf_dir)).drop("at")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphans(_links(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (p4_found, p4_polygons, p4_masks, p4_sentences, p4_tokens, p6_found, p6_report)}

_REFS1 = "SELECT ref_id, arg_max(sentences, ingested_at) AS sentences FROM refs WHERE ref_id IS NOT NULL GROUP BY ref_id"

_MASKS = r"""
WITH a AS (SELECT id, any_value(segmentation) AS seg, any_value(counts) AS cnt FROM annotations WHERE id IS NOT NULL GROUP BY id),
u1 AS (SELECT id, cnt, CASE WHEN json_valid(seg) AND json_type(seg) = 'VARCHAR' THEN json_extract_string(seg, '$') ELSE seg END AS seg FROM a),
u2 AS (SELECT id, cnt, CASE WHEN json_valid(seg) AND json_type(seg) = 'VARCHAR' THEN json_extract_string(seg, '$') ELSE seg END AS seg FROM u1),
v AS (SELECT id, cnt, seg, trim(coalesce(seg, '')) <> '' AND NOT json_valid(seg) AS bad,
             CASE WHEN json_valid(seg) THEN seg::JSON END AS j FROM u2),
t AS (SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END AS els FROM v),
r AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT'
                       OR (len(els) > 0 AND len(list_filter(els, lambda x: json_type(x) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = 0)
                       OR (len(els) > 0 AND len(list_filter(els, lambda x: NOT (json_type(x) = 'ARRAY' AND json_array_length(x) = 2 AND json_type(x, '$[0]') IN ('DOUBLE', 'BIGINT', 'UBIGINT')))) = 0)
                     THEN [j] ELSE els END AS items FROM t),
e AS (SELECT id, cnt, unnest(items) AS x, generate_subscripts(items, 1) AS n FROM r WHERE NOT bad),
k AS (SELECT id, n, x, CASE WHEN json_type(x) = 'ARRAY' AND json_array_length(x) > 0 THEN 'polygon'
             WHEN json_type(x, '$.counts') = 'ARRAY' AND json_array_length(x, '$.counts') > 0 THEN 'run_lengths'
             WHEN json_type(x, '$.counts') = 'VARCHAR' AND trim(x->>'$.counts') <> '' THEN 'coded_mask' END AS kind FROM e),
inside AS (SELECT id, kind, (row_number() OVER (PARTITION BY id ORDER BY n) - 1)::INT AS pos FROM k WHERE kind IS NOT NULL),
kids AS (SELECT * FROM inside
         UNION ALL SELECT id, 'unreadable', 0 FROM r WHERE bad
         UNION ALL SELECT id, CASE WHEN json_valid(cnt) AND json_type(cnt) = 'ARRAY' THEN 'run_lengths' ELSE 'coded_mask' END, 0
                   FROM r WHERE NOT bad AND trim(coalesce(cnt, '')) <> '' AND id NOT IN (SELECT id FROM inside))
"""

_ORPHANS = """
WITH r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY ingested_at) AS n FROM refs WHERE ref_id IS NOT NULL) WHERE n = 1),
i1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS n FROM images WHERE id IS NOT NULL) WHERE n = 1),
links AS (
  SELECT DISTINCT 'refs' AS src_table, ref_id AS src_id, 'ann_id' AS field, 'annotations' AS tt, v::VARCHAR AS target, ingested_at AS seen
    FROM (SELECT ref_id, ingested_at, unnest(ann_id) AS v FROM r1) WHERE v IS NOT NULL AND v <> -1
  UNION ALL SELECT 'refs', ref_id, 'image_id', 'images', image_id::VARCHAR, ingested_at FROM r1 WHERE image_id IS NOT NULL AND image_id <> -1
  UNION ALL SELECT 'images', id, 'file_name', 'mask_manifest', file_name, ingested_at FROM i1 WHERE file_name IS NOT NULL),
keys AS (
  SELECT 'annotations' AS tt, id::VARCHAR AS target, ingested_at, coalesce(is_deleted, false) AS gone FROM annotations WHERE id IS NOT NULL
  UNION ALL SELECT 'images', id::VARCHAR, ingested_at, coalesce(is_deleted, false) FROM images WHERE id IS NOT NULL
  UNION ALL SELECT 'mask_manifest', image_file, ingested_at, coalesce(is_deleted, false) FROM mask_manifest WHERE image_file IS NOT NULL),
st AS (SELECT tt, target, arg_max(gone, ingested_at) AS gone, min(ingested_at) AS first_at FROM keys GROUP BY 1, 2),
o AS (SELECT src_table, src_id, field, target, seen,
        CASE WHEN st.target IS NULL THEN 'missing' WHEN st.gone THEN 'deleted' WHEN st.first_at > links.seen THEN 'late' END AS state
      FROM links LEFT JOIN st USING (tt, target))
"""

SQL = {
    "p4_found": _MASKS + f"""
SELECT 'annotations' AS parent_table, id AS parent_id, kind AS child_kind, pos::INT AS child_pos FROM kids
UNION ALL
SELECT 'refs', ref_id, 'sentence', unnest(range(coalesce(len(sentences), 0)))::INT FROM ({_REFS1})""",
    "p4_polygons": _MASKS + """
, p AS (SELECT id, kind, x, (row_number() OVER (PARTITION BY id ORDER BY n) - 1)::INT AS pos FROM k WHERE kind IS NOT NULL),
c AS (SELECT id, pos, CASE WHEN json_type(x, '$[0]') = 'ARRAY' THEN flatten(x::DOUBLE[][]) ELSE x::DOUBLE[] END AS coords FROM p WHERE kind = 'polygon')
SELECT id AS parent_id, pos AS child_pos, coords, (len(coords) // 2)::INT AS n_points FROM c""",
    "p4_masks": _MASKS + """
, p AS (SELECT id, kind, x, (row_number() OVER (PARTITION BY id ORDER BY n) - 1)::INT AS pos FROM k WHERE kind IS NOT NULL),
i AS (SELECT id, pos, kind, (x->'$.size[0]')::INT AS height, (x->'$.size[1]')::INT AS width, CASE WHEN kind = 'run_lengths' THEN (x->'$.counts')::BIGINT[] END AS runs, CASE WHEN kind = 'coded_mask' THEN x->>'$.counts' END AS coded
      FROM p WHERE kind <> 'polygon'),
o AS (SELECT id, 0 AS pos, CASE WHEN json_valid(cnt) AND json_type(cnt) = 'ARRAY' THEN 'run_lengths' ELSE 'coded_mask' END AS kind, CASE WHEN json_type(j) = 'OBJECT' THEN j WHEN len(els) = 1 THEN els[1] END AS w, cnt
      FROM r WHERE NOT bad AND trim(coalesce(cnt, '')) <> '' AND id NOT IN (SELECT id FROM inside))
SELECT id AS parent_id, pos::INT AS child_pos, kind, height, width, runs, coded FROM i
UNION ALL SELECT id, pos::INT, kind, (w->'$.size[0]')::INT, (w->'$.size[1]')::INT, CASE WHEN kind = 'run_lengths' THEN cnt::JSON::BIGINT[] END, CASE WHEN kind = 'coded_mask' THEN cnt END FROM o""",
    "p4_sentences": f"""
SELECT ref_id, (p - 1)::INT AS child_pos, s.sent_id AS sent_id, s.sent AS sent, coalesce(len(s.tokens), 0)::INT AS n_tokens
FROM (SELECT ref_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS p FROM ({_REFS1}))""",
    "p4_tokens": f"""
SELECT ref_id, (p - 1)::INT AS sent_pos, sent_id, (q - 1)::INT AS tok_pos, token
FROM (SELECT ref_id, p, s.sent_id AS sent_id, unnest(s.tokens) AS token, generate_subscripts(s.tokens, 1) AS q
      FROM (SELECT ref_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS p FROM ({_REFS1})))""",
    "p6_found": _ORPHANS + "SELECT src_table, src_id, field, target, state FROM o WHERE state IS NOT NULL",
    "p6_report": _ORPHANS + """
SELECT src_table, field, state, strftime(seen, '%Y-%m') AS period, count(*) AS n_orphans FROM o WHERE state IS NOT NULL GROUP BY ALL""",
}
