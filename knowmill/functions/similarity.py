"""Similarity of entities and keywords as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowmill.functions import text as T

#: Families of related entity types and of relation types that mean the same.
TYPE_FAMILIES = (
    ("PERSON", "INDIVIDUAL", "HUMAN", "PEOPLE"),
    ("ORGANIZATION", "COMPANY", "INSTITUTION", "ORG", "BUSINESS"),
    ("LOCATION", "PLACE", "CITY", "COUNTRY", "REGION"),
    ("CONCEPT", "IDEA", "THEORY", "PRINCIPLE", "NOTION"),
    ("TECHNOLOGY", "TECH", "TOOL", "SYSTEM", "PLATFORM"),
)
SYNONYMS = (
    ("WORKS_AT", "EMPLOYED_BY", "WORKS_FOR", "EMPLOYEE_OF"),
    ("LOCATED_IN", "BASED_IN", "SITUATED_IN", "POSITIONED_IN"),
    ("FOUNDED_BY", "ESTABLISHED_BY", "CREATED_BY", "STARTED_BY"),
    ("PART_OF", "COMPONENT_OF", "MEMBER_OF", "BELONGS_TO"),
    ("CAUSES", "LEADS_TO", "RESULTS_IN", "TRIGGERS"),
    ("USES", "UTILIZES", "EMPLOYS", "APPLIES"),
    ("OWNS", "POSSESSES", "HAS", "CONTROLS"),
)
#: Weights of name, type and context.
NAME, TYPE, CONTEXT = 0.6, 0.3, 0.1


def family(kind: Column, families: tuple = TYPE_FAMILIES) -> Column:
    """The first member of the kind's family, or the kind itself, in upper case."""
    up = F.upper(F.trim(kind))
    pick = F
    for some in families:
        pick = pick.when(up.isin(*some), some[0])
    return pick.otherwise(up)


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 where one holds the other, else the larger of token and edit similarity."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(F.greatest(T.jaccard(x, y), T.edit_similarity(x, y)))


def type_similarity(a: Column, b: Column, families: tuple = TYPE_FAMILIES) -> Column:
    """1 for equal types, 0.8 within a family, 0.5 where one is missing, else 0."""
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    same = family(a, families) == family(b, families)
    return F.when(missing, 0.5).when(F.upper(F.trim(a)) == F.upper(F.trim(b)), 1.0).when(same, 0.8).otherwise(0.0)


def entity_similarity(name: tuple[Column, Column], kind: tuple[Column, Column], doc: tuple[Column, Column], families: tuple = TYPE_FAMILIES) -> Column:
    return NAME * name_similarity(*name) + TYPE * type_similarity(*kind, families) + CONTEXT * F.when(doc[0] == doc[1], 1.0).otherwise(0.3)


def keyword_name(name: Column) -> Column:
    return F.replace(F.trim(F.lower(name)), F.lit("_"), F.lit(" "))


def keyword_forms(name: Column) -> list[Column]:
    """Forms of a keyword of which one is equal for spelling variants: without plural, hyphen or the numeral."""
    k = keyword_name(name)
    return [F.rtrim(k, F.lit("s")), F.replace(k, F.lit("-"), F.lit(" ")), F.replace(k, F.lit(" "), F.lit("-")), F.replace(k, F.lit("3"), F.lit("drei"))]


def keyword_similarity(a: Column, b: Column) -> Column:
    """1 for equal keywords, 0.9 for spelling variants, 0.8 where one holds the other, else word overlap (0.6 at least if
    there is any)."""
    x, y = keyword_name(a), keyword_name(b)
    variant = reduce(or_, [p == q for p, q in zip(keyword_forms(a), keyword_forms(b), strict=True)])
    share = T.jaccard(x, y)
    return F.when(x == y, 1.0).when(variant, 0.9).when(x.contains(y) | y.contains(x), 0.8).when(share > 0, F.greatest(share, F.lit(0.6))).otherwise(0.0)


#: The share of the keyword similarity in the blend with the entity similarity.
KEYWORD = 0.6


def keyword_blend(name: tuple[Column, Column], kind: tuple[Column, Column], doc: tuple[Column, Column]) -> Column:
    return (1 - KEYWORD) * entity_similarity(name, kind, doc) + KEYWORD * keyword_similarity(*name)
