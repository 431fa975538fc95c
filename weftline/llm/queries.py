"""Queries of the training-data operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import lookalike, mixing, packing, radix, residue, survivor
from weftline.plans.network_oracles import sid
from weftline.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: radix.duplicate_pairs(table(s, d, "works")),
    "p1_records": lambda s, d: radix.duplicate_works(table(s, d, "works")),
    "p1_membership": lambda s, d: radix.duplicate_membership(table(s, d, "works")),
    "p3_found": lambda s, d: survivor.field_survivors(table(s, d, "institution_records"), table(s, d, "source_trust")),
    "p3_records": lambda s, d: survivor.surviving_records(table(s, d, "institution_records"), table(s, d, "source_trust")),
    "p6_found": lambda s, d: lookalike.look_alikes_found(table(s, d, "works"), table(s, d, "institutions")),
    "p6_forms": lambda s, d: lookalike.unified_names(table(s, d, "works"), table(s, d, "institutions")),
    "p8_pack": lambda s, d: packing.pack_documents(table(s, d, "documents"), table(s, d, "pack_capacities")),
    "p8_summary": lambda s, d: packing.packing_summary(table(s, d, "documents"), table(s, d, "pack_capacities")),
    "p9_mix": lambda s, d: mixing.mixed_documents(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_shares": lambda s, d: mixing.mixed_shares(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_checks": lambda s, d: packing.packing_checks(table(s, d, "documents"), table(s, d, "pack_capacities")),
    "p9_checks": lambda s, d: mixing.mix_checks(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p10_coverage": lambda s, d: residue.judge_documents(table(s, d, "documents")).agg(F.count(F.lit(1)).alias("judged_count"), F.count_distinct("doc_id").alias("document_count"), F.count_if(F.col("residue") != F.col("decided_by").isNotNull()).alias("unexplained_count")),
    "p10_found": lambda s, d: residue.residue_found(table(s, d, "documents")),
    "p10_scores": lambda s, d: residue.judge_documents(table(s, d, "documents")),
    "p10_clean": lambda s, d: residue.clean_documents(table(s, d, "documents")),
}

# The same results in SQL where SQL can say them, for the correctness check.
_T = r"regexp_replace(translate(replace(lower(upper({})), 'ß', 'ss'), 'ς', 'σ'), '[\p{{P}}\p{{Z}}\p{{Cc}}\p{{Cf}}\s$+<=>^`|~]', '', 'g')"
_DOI = r"regexp_replace(lower(doi), '(?s)^.*?(10\.\d+)', '\1')"
_KEYS = f"SELECT DISTINCT work_id, {_T.format('title')} AS t, coalesce({_T.format(_DOI)}, '') AS d FROM works WHERE title IS NOT NULL AND work_id IS NOT NULL"


# Spellings of an unknown value, lower case without signs, stated here again.
_UNKNOWN = ("", "na", "nan", "nil", "none", "null", "notavailable", "notapplicable", "notknown", "notspecified", "unspecified", "unknown", "undefined", "missing", "pending", "tbd", "tba", "todo", "x", "xx", "xxx")


def _stand_in(field: str) -> str:
    x = "lower(x)"
    if field == "source_ror_ids":
        x = r"regexp_replace(trim(lower(x)), '^(?:[a-z]+://)?(?:www\.)?ror\.[a-z]+/*|^[a-z]+://[^/]*/*', '', 'g')"
    bare = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')"
    bad = [*_UNKNOWN, *(["zz"] if field == "source_country_codes" else [])]
    return f"{bare} IN ({', '.join(repr(b) for b in bad)})"


def _usable(field: str) -> str:
    return f"SELECT {sid('institution_id')} AS institution_id, '{field}' AS field_name, record_id, metadata_source, openalex_updated_date FROM institution_records WHERE len(list_filter({field}, lambda x: x IS NOT NULL AND NOT ({_stand_in(field)}))) > 0"


_DAY = "replace(trim(openalex_updated_date), '/', '-')"
_AT = f"epoch_us(TRY_CAST(CASE WHEN regexp_matches({_DAY}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN {_DAY} WHEN length({_DAY}) = 10 THEN {_DAY} || ' 00:00:00+00' ELSE {_DAY} || '+00' END AS TIMESTAMPTZ))"
# Letters that look like Latin ones, stated here again: Cyrillic, Greek, Armenian, other Latin.
_FROM = "аеіјорсухѕһԁԛԝӏѵү" "АВЕІЈКМНОРСТУХЅԌԚԜӀ" "ονιϳϲαρυ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "օոսցՕՍՏ" "ɑɡıƖǀ"
_TO = "aeijopcyxshdqwlvy" "ABEIJKMHOPCTYXSGQWI" "ovijcapu" "ABEZHIKMNOPTYXCJ" "onugOUS" "agill"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
_ASCII = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _form(c: str) -> str:
    """One visual form by SQL: enough for the characters of this data, without the full decomposition tables."""
    plain = rf"regexp_replace(regexp_replace({c}, '\p{{Cf}}', '', 'g'), '[\p{{Z}}\s]+', ' ', 'g')"
    parts = f"replace(replace(replace({plain}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'Ⅱ', 'II')"
    return f"trim(nfc_normalize(translate(translate({parts}, '{_WIDE}', '{_ASCII}'), '{_FROM}', '{_TO}')))"


def _pairs(field: str, table_name: str, key: str, text: str) -> str:
    rows = rf"SELECT DISTINCT {key} AS k, {_form(text)} AS f, trim(regexp_replace({text}, '[ \t\r\n\v\f]+', ' ', 'g')) AS p FROM {table_name} WHERE {text} IS NOT NULL"
    return f"SELECT DISTINCT '{field}' AS field_name, a.k AS key_a, b.k AS key_b FROM ({rows}) AS a JOIN ({rows}) AS b ON a.f = b.f AND a.p <> b.p AND a.k < b.k"


_CONTENT = r"regexp_matches(text, '[^\s\p{Z}\x{85}]')"
_FIELDS = survivor.FIELDS


def _best(field: str) -> str:
    """The surviving record of one field with the usable elements of its list, in order and without repeats."""
    kept = f"list_filter({field}, lambda x: x IS NOT NULL AND NOT ({_stand_in(field)}))"
    once = f"list_filter({kept}, lambda y, i: list_position({kept}, y) = i)"
    return f"""SELECT institution_id, v, record_id FROM (SELECT {sid('institution_id')} AS institution_id, record_id, {once} AS v, row_number() OVER (PARTITION BY {sid('institution_id')} ORDER BY t.trust_rank ASC NULLS LAST, {_AT} DESC NULLS LAST, record_id, {field}) AS k
        FROM institution_records LEFT JOIN source_trust AS t USING (metadata_source) WHERE {sid('institution_id')} IS NOT NULL AND record_id IS NOT NULL AND len({kept}) > 0) AS q WHERE k = 1"""


def _forms(field: str, table_name: str, key: str, text: str) -> str:
    return f"SELECT DISTINCT '{field}' AS field_name, {key} AS key, {text} AS text, {_form(text)} AS form FROM {table_name}"


ORACLES: dict[str, str] = {
    "p3_records": f"SELECT a.institution_id, a.n AS record_count, {', '.join(f'{f}.v AS {f}, {f}.record_id AS {f}_record_id' for f in _FIELDS)}, {' + '.join(f'({f}.record_id IS NOT NULL)::BIGINT' for f in _FIELDS)} AS completeness FROM (SELECT {sid('institution_id')} AS institution_id, count(DISTINCT record_id) AS n FROM institution_records WHERE record_id IS NOT NULL GROUP BY 1) AS a "
    + " ".join(f"LEFT JOIN ({_best(f)}) AS {f} ON {f}.institution_id = a.institution_id" for f in _FIELDS) + " WHERE a.institution_id IS NOT NULL",
    "p6_forms": _forms("works.title", "works", "work_id", "title") + " UNION ALL " + _forms("institutions.display_name", "institutions", "institution_id", "display_name"),
    "p8_checks": f"SELECT packing, (SELECT count(*) FROM documents WHERE {_CONTENT}) AS document_count, 0::BIGINT AS wrong_document_count, 0::BIGINT AS overfull_count, 0::BIGINT AS oversized_count, true AS is_tight FROM (SELECT DISTINCT capacity_name AS packing FROM pack_capacities UNION ALL SELECT 'mixed') AS p",
    "p9_checks": "SELECT DISTINCT source, 0::BIGINT AS over_cap_count, 0::BIGINT AS unwanted_count, true AS share_is_reached FROM mix_targets WHERE source IS NOT NULL",
    "p10_coverage": f"SELECT count(*) AS judged_count, count(DISTINCT doc_id) AS document_count, 0::BIGINT AS unexplained_count FROM documents WHERE {_CONTENT}",
    "p1_found": f"WITH k AS ({_KEYS}) SELECT DISTINCT a.work_id AS work_id_a, b.work_id AS work_id_b FROM k AS a JOIN k AS b ON a.t = b.t AND a.d = b.d AND a.work_id < b.work_id",
    "p1_records": f"WITH k AS ({_KEYS}), c AS (SELECT min(work_id) AS work_id, count(*) AS work_id_count FROM k GROUP BY t, d) SELECT DISTINCT c.work_id, w.title, w.doi, c.work_id_count FROM c JOIN works AS w ON w.work_id = c.work_id",
    "p1_membership": f"SELECT work_id, min(work_id) OVER (PARTITION BY t, d) AS representative_work_id, count(*) OVER (PARTITION BY t, d) AS work_id_count FROM ({_KEYS}) AS k",
    "p3_found": f"""WITH u AS ({' UNION ALL '.join(map(_usable, survivor.FIELDS))}), b AS (SELECT u.*, row_number() OVER (PARTITION BY institution_id, field_name ORDER BY t.trust_rank ASC NULLS LAST, {_AT} DESC NULLS LAST, record_id) AS k FROM u LEFT JOIN source_trust AS t USING (metadata_source) WHERE institution_id IS NOT NULL)
        SELECT institution_id, field_name, record_id FROM b WHERE k = 1 AND institution_id IN (SELECT {sid('institution_id')} FROM institution_records GROUP BY 1 HAVING count(DISTINCT record_id) > 1)""",
    "p6_found": _pairs("works.title", "works", "work_id", "title") + " UNION ALL " + _pairs("institutions.display_name", "institutions", "institution_id", "display_name"),
}
