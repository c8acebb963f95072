"""Fragments of SQL that say, from columns alone, what the engines must answer."""

from __future__ import annotations

from attesta.plans.corpus import COMPARATORS


def place(index: str) -> str:
    """The comparator that corpus.by_place takes at an index."""
    return f"list_extract({list(COMPARATORS)}, CAST(({index}) % {len(COMPARATORS)} AS INTEGER) + 1)"


def compared(v: str, said: str, t: str) -> str:
    return f"(CASE {said} WHEN 'lt' THEN {v} < {t} WHEN 'lte' THEN {v} <= {t} WHEN 'gt' THEN {v} > {t} WHEN 'gte' THEN {v} >= {t} ELSE {v} = {t} END)"


def entails_percentage(v: str, seen: str, t: str, said: str) -> str:
    return (
        f"(CASE {seen} WHEN 'exact' THEN {compared(v, said, t)} WHEN 'up_to' THEN {said} <> 'exact' AND {compared(v, said, t)} WHEN 'lt' THEN {said} IN ('lt', 'lte') AND {v} <= {t} "
        f"WHEN 'lte' THEN {said} IN ('lt', 'lte') AND {compared(v, said, t)} WHEN 'gt' THEN {said} IN ('gt', 'gte') AND {v} >= {t} ELSE {said} IN ('gt', 'gte') AND {compared(v, said, t)} END)"
    )


def entails_measurement(v: str, seen: str, t: str, said: str) -> str:
    """Bounds above an observed value ("above", "over") count as the value itself."""
    return (
        f"(CASE WHEN {seen} = 'up_to' THEN CASE WHEN {said} = 'up_to' THEN {v} = {t} ELSE {said} IN ('lt', 'lte') AND {v} <= {t} END "
        f"WHEN {said} IN ('exact', 'up_to') THEN {seen} = 'exact' AND {v} = {t} ELSE {compared(v, said, t)} END)"
    )


def contradicts(v: str, seen: str, t: str, said: str) -> str:
    return (
        f"(CASE {said} WHEN 'lt' THEN {seen} IN ('exact', 'gt', 'gte', 'up_to') AND {v} >= {t} WHEN 'lte' THEN ({seen} IN ('exact', 'gte', 'up_to') AND {v} > {t}) OR ({seen} = 'gt' AND {v} >= {t}) "
        f"WHEN 'gt' THEN {seen} IN ('exact', 'lt', 'lte', 'up_to') AND {v} <= {t} WHEN 'gte' THEN ({seen} = 'exact' AND {v} < {t}) OR ({seen} = 'lt' AND {v} <= {t}) OR ({seen} IN ('lte', 'up_to') AND {v} < {t}) "
        f"ELSE ({seen} = 'exact' AND {v} <> {t}) OR ({seen} = 'lt' AND {v} <= {t}) OR ({seen} IN ('lte', 'up_to') AND {v} < {t}) OR ({seen} = 'gt' AND {v} >= {t}) OR ({seen} = 'gte' AND {v} > {t}) END)"
    )


#: Papers and claims as corpus renders them, without their texts.
PAPERS = f"""papers AS (SELECT p_partkey AS key, p_name AS name, CAST(p_size AS BIGINT) AS life, p_partkey * 7 % 50 + 1 AS first, p_partkey * 11 % 50 + 1 AS second,
 {place('p_partkey')} AS life_cmp, {place('p_partkey // 6')} AS first_cmp, {place('p_partkey // 36')} AS second_cmp FROM part)"""
CLAIMS = f"claims AS (SELECT l_orderkey, l_linenumber, l_partkey AS key, CAST(l_quantity AS BIGINT) AS threshold, {place('l_orderkey')} AS cmp, l_linenumber % 2 = 0 AS strain FROM lineitem)"
#: Which source answers for a paper, and the code if none does.
RESOLVED = """resolved AS (SELECT p.*, CASE WHEN key = 7 OR key % 23 = 0 THEN NULL WHEN key % 4 = 0 THEN 'crossref' WHEN key % 4 = 1 AND key % 5 <> 0 THEN 'openalex' WHEN key % 3 = 0 THEN 'semantic_scholar' WHEN key % 7 = 0 THEN 'pubmed' END AS abstract_source,
 CASE WHEN key = 7 THEN 'ROW_CHECK_ERROR' WHEN key % 23 = 0 THEN 'DOI_MISMATCH' WHEN key % 3 = 1 THEN 'SOURCE_API_ERROR' WHEN key % 4 = 3 THEN 'SOURCE_TIMEOUT' ELSE 'NO_ABSTRACT' END AS lookup_code FROM papers p)"""


def seen_numeric(cmp: str) -> str:
    return f"(CASE WHEN {cmp} = 'gt' THEN 'exact' ELSE {cmp} END)"


LIFE = entails_measurement("life", seen_numeric("life_cmp"), "threshold", "cmp")
FIRST, SECOND = (entails_percentage(v, f"{v}_cmp", "threshold", "cmp") for v in ("first", "second"))
FIRST_AGAINST, SECOND_AGAINST = (contradicts(v, f"{v}_cmp", "threshold", "cmp") for v in ("first", "second"))
ACCEPTED = f"(CASE WHEN strain THEN ({FIRST} AND NOT {SECOND_AGAINST}) OR ({SECOND} AND NOT {FIRST_AGAINST}) ELSE {LIFE} END)"
VERDICTS = f"""WITH {PAPERS}, {CLAIMS}, {RESOLVED}, verdicts AS (SELECT l_orderkey, l_linenumber, key, abstract_source,
 CASE WHEN abstract_source IS NULL THEN 'UNVERIFIABLE' WHEN {ACCEPTED} THEN 'SUPPORTED' ELSE 'PARTIAL' END AS status, CASE WHEN abstract_source IS NOT NULL AND {ACCEPTED} THEN 'ACCEPT' ELSE 'WARN' END AS verdict,
 CASE WHEN abstract_source IS NULL THEN lookup_code WHEN {ACCEPTED} THEN 'CLAIM_SUPPORTED' ELSE 'CLAIM_NOT_EXPLICIT' END AS error_code FROM claims JOIN resolved USING (key))"""
