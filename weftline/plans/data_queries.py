"""Queries of the general training-data operators (problems 2, 4, 5 and 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import hierarchy, hotkeys, nested, orphans
from weftline.plans.bundle import Bundle
from weftline.plans.network_oracles import array_of, elements, sid
from weftline.plans.network_queries import tidy
from weftline.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _flat(kind: str) -> Query:
    return lambda spark, d: nested.flat_table(Bundle.of(spark, d).tagged, kind)


QUERIES: dict[str, Query] = {
    "p2_found": lambda s, d: hierarchy.institution_roots(table(s, d, "institutions")),
    "p2_hierarchy": lambda s, d: hierarchy.institution_hierarchy(table(s, d, "institutions")),
    "p2_descendants": lambda s, d: hierarchy.institution_descendants(table(s, d, "institutions")),
    "p4_found": lambda s, d: orphans.orphan_references(table(s, d, "works"), table(s, d, "work_tombstones")),
    "p4_counts": lambda s, d: orphans.orphan_counts(table(s, d, "works"), table(s, d, "work_tombstones")),
    "p4_snapshots": lambda s, d: orphans.track_works(table(s, d, "works"), table(s, d, "work_tombstones"), 4, snapshots=True),
    "p5_found": lambda s, d: hotkeys.hot_endpoints(table(s, d, "layer_edges")),
    "p5_profile": lambda s, d: tidy(hotkeys.endpoint_profile(table(s, d, "layer_edges"))),
    "p7_found": lambda s, d: nested.flat_rows(table(s, d, "works")),
    "p7_authorships": _flat("authorship"),
    "p7_authorship_institutions": _flat("authorship_institution"),
    "p7_authorship_affiliations": _flat("authorship_affiliation"),
    "p7_topics": _flat("topic"),
    "p7_locations": _flat("location"),
    "p7_references": _flat("reference"),
}

# The same results in SQL, for the correctness check.
_I = sid("institution_id", "I")


def _flat_rows(kind: str) -> str:
    """(work_id, child_kind, item_index, sub_index, item_key) of one list of works."""
    column, path = {"authorship": ("authorships_json", "$.author.id"), "topic": ("topics_json", "$.id"), "location": ("locations_json", "$.source.id"), "reference": ("referenced_works_json", "$")}[kind]
    key = f"CASE WHEN json_type(json_extract(x, '{path}')) = 'VARCHAR' THEN {sid(f"json_extract_string(x, '{path}')")} END"
    return f"SELECT work_id, '{kind}' AS child_kind, i::INTEGER AS item_index, -1 AS sub_index, coalesce({key}, '') AS item_key FROM ({elements('works', column)}) AS q_{kind}"


_NESTED = f"""SELECT work_id, 'authorship_institution' AS child_kind, i::INTEGER AS item_index, j::INTEGER AS sub_index, coalesce(CASE WHEN json_type(y->'id') = 'VARCHAR' THEN {sid("(y->>'id')")} END, '') AS item_key
    FROM (SELECT work_id, i, j, json_extract(arr, '$[' || j || ']') AS y FROM (SELECT work_id, i, arr, unnest(range(json_array_length(arr)::BIGINT)) AS j FROM (SELECT work_id, i, CASE json_type(x->'institutions') WHEN 'ARRAY' THEN x->'institutions' WHEN 'OBJECT' THEN json_array(x->'institutions') WHEN 'VARCHAR' THEN {array_of("(x->>'institutions')")} END AS arr
    FROM ({elements('works', 'authorships_json')}) AS n0 WHERE json_type(x) = 'OBJECT') AS n1 WHERE arr IS NOT NULL) AS n2) AS n3 WHERE json_type(y) <> 'NULL'"""
_P7 = " UNION ".join([*map(_flat_rows, ("authorship", "topic", "location", "reference")), _NESTED])

_P2 = f"""WITH RECURSIVE rows AS (SELECT DISTINCT {_I} AS id, {sid("canonical_institution_id", "I")} AS canon, parent_ids, child_ids FROM institutions WHERE {_I} IS NOT NULL),
chain AS (SELECT id, coalesce(canon, id) AS here, 0 AS n FROM rows UNION SELECT c.id, r.canon, c.n + 1 FROM chain AS c JOIN rows AS r ON r.id = c.here WHERE r.canon <> c.here AND c.n < 200),
own AS (SELECT id, arg_max(here, n) AS own FROM chain GROUP BY id),
told AS (SELECT id AS child, {sid("p", "I")} AS parent FROM (SELECT id, unnest(parent_ids) AS p FROM rows) AS u UNION SELECT {sid("c", "I")}, id FROM (SELECT id, unnest(child_ids) AS c FROM rows) AS v),
link AS (SELECT a.own AS node, min(b.own) AS parent FROM told JOIN own AS a ON a.id = told.child JOIN own AS b ON b.id = told.parent WHERE a.own <> b.own GROUP BY 1),
climb AS (SELECT node, parent AS here, 1 AS n FROM link UNION ALL SELECT c.node, l.parent, c.n + 1 FROM climb AS c JOIN link AS l ON l.node = c.here WHERE c.n < 3000 AND c.here <> c.node),
ends AS (SELECT c.node, c.here, c.n FROM climb AS c WHERE NOT EXISTS (SELECT 1 FROM link AS l WHERE l.node = c.here))
@SELECT l.node AS institution_id, coalesce(e.here, 'CYCLE') AS root_institution_id, coalesce(e.n, -1)::INTEGER AS depth FROM link AS l LEFT JOIN ends AS e ON e.node = l.node"""
_P2_STEPS, _P2_ROOTS = _P2.split("@")
_ABOVE = "SELECT c.here AS institution_id, c.node AS descendant_id, c.n::INTEGER AS distance FROM climb AS c JOIN ends AS e ON e.node = c.node"

_SEEN = f"SELECT {sid('work_id')} AS id, min(epoch_us(TRY_CAST(source_retrieved_at_utc AS TIMESTAMPTZ))) AS seen FROM works GROUP BY 1"
_P4 = f"""WITH f AS ({_SEEN}), dead AS (SELECT DISTINCT {sid('work_id')} AS id FROM work_tombstones), r AS (SELECT DISTINCT {sid('work_id')} AS work_id, item_key AS ref FROM ({_flat_rows('reference')}) AS z WHERE item_key <> ''),
s AS (SELECT r.work_id, r.ref, a.seen, CASE WHEN dead.id IS NOT NULL THEN 'deleted' WHEN b.id IS NULL THEN 'missing' WHEN b.seen > a.seen THEN 'late' END AS status FROM r JOIN f AS a ON a.id = r.work_id LEFT JOIN f AS b ON b.id = r.ref LEFT JOIN dead ON dead.id = r.ref)
"""
_ENDS = "SELECT 'source_id' AS endpoint, source_id AS institution_id, target_id AS partner_id, layer_weight FROM layer_edges UNION ALL SELECT 'target_id', target_id, source_id, layer_weight FROM layer_edges"

ORACLES: dict[str, str] = {
    "p2_found": _P2_STEPS + _P2_ROOTS,
    "p2_descendants": _P2_STEPS + _ABOVE,
    "p2_hierarchy": _P2_STEPS + f"""SELECT o.own AS institution_id, CASE WHEN l.node IS NULL THEN o.own ELSE coalesce(e.here, 'CYCLE') END AS root_institution_id, CASE WHEN l.node IS NULL THEN 0 ELSE coalesce(e.n, -1) END::INTEGER AS depth,
        CASE WHEN l.node IS NULL THEN [o.own] WHEN e.node IS NOT NULL THEN list_append((SELECT list(c.here ORDER BY c.n DESC) FROM climb AS c WHERE c.node = o.own), o.own) END AS path, CASE WHEN l.node IS NULL OR e.node IS NOT NULL THEN coalesce(d.n, 0) END AS descendant_count
        FROM (SELECT DISTINCT own FROM own) AS o LEFT JOIN link AS l ON l.node = o.own LEFT JOIN ends AS e ON e.node = o.own LEFT JOIN (SELECT institution_id, count(*) AS n FROM ({_ABOVE}) AS a GROUP BY 1) AS d ON d.institution_id = o.own""",
    "p4_found": _P4 + "SELECT work_id, ref AS referenced_work_id, status FROM s WHERE status IS NOT NULL",
    "p4_counts": _P4 + "SELECT strftime(make_timestamp(seen), '%Y-%m') AS arrival_month, status, count(*) AS reference_count, count(DISTINCT work_id) AS citing_work_count, count(DISTINCT ref) AS referenced_work_count FROM s WHERE status IS NOT NULL GROUP BY 1, 2",
    "p5_found": f"SELECT endpoint, institution_id FROM ({_ENDS}) AS e WHERE institution_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM layer_edges)",
    "p5_profile": f"""WITH e AS ({_ENDS}), c AS (SELECT endpoint, institution_id, partner_id, count(*) AS n FROM e WHERE partner_id IS NOT NULL GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY endpoint, institution_id ORDER BY n DESC, partner_id) AS k FROM c)
        SELECT a.*, t.n AS top_partner_edge_count, t.partner_id AS top_partner_id FROM (SELECT endpoint, institution_id, count(*) AS edge_count, count(layer_weight) AS weighted_edge_count, round(sum(layer_weight), 6) AS weight_sum, count(DISTINCT partner_id) AS partner_count, quantile_disc(layer_weight, 0.5) AS weight_p50, round(count(*) / (SELECT count(*) FROM layer_edges), 6) AS share FROM e GROUP BY ALL) AS a
        LEFT JOIN t ON t.endpoint = a.endpoint AND t.institution_id IS NOT DISTINCT FROM a.institution_id AND t.k = 1""",
    "p7_found": _P7,
    "p7_references": f"SELECT DISTINCT work_id, item_index, sub_index, item_key FROM ({_flat_rows('reference')}) AS z",
}
