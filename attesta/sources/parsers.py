"""Payloads of bibliographic services as paper records; one column in, one struct column out."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import text as tx
from attesta.functions import vocab
from attesta.functions.doi import normalize_doi
from attesta.schemas import PAPER

CROSSREF = (
    "DOI string, title string, author array<struct<family:string,given:string,name:string>>, `container-title` string, abstract string, URL string, "
    + ", ".join(f"`{k}` struct<`date-parts`:array<array<int>>>" for k in ("published-print", "published-online", "published", "issued"))
)
OPENALEX = "doi string, title string, id string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>"
SEMANTIC_SCHOLAR = "title string, abstract string, url string, venue string, year int, authors array<struct<name:string>>, externalIds struct<DOI:string>"


def paper(**fields: Column) -> Column:
    return F.struct(*[fields[n].cast(t).alias(n) for n, t in (f.split(" ", 1) for f in PAPER.split(", "))])


def first_string(value: Column) -> Column:
    """The first element of a JSON list, or a bare string (read as JSON text)."""
    return F.coalesce(tx.strip(F.get(F.from_json(value, "array<string>"), F.lit(0))), F.when(~value.startswith("["), tx.non_blank(value)))


def crossref(payload: Column) -> Column:
    """The record in a CrossRef work message (OP-07 to OP-10). `created` is no publication date."""
    m = F.from_json(payload, CROSSREF)
    authors = F.filter(F.transform(m["author"], lambda a: F.coalesce(tx.non_blank(a["family"]), tx.non_blank(a["name"]))), lambda x: x.isNotNull())
    year = F.coalesce(*[F.get(F.get(m[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "published", "issued")])
    return paper(
        doi=F.coalesce(m["DOI"], F.lit("")), title=F.coalesce(F.nullif(first_string(m["title"]), F.lit("")), F.lit(vocab.TITLE_MISSING)), authors=F.coalesce(authors, F.array()), year=year,
        abstract=tx.clean_markup(m["abstract"]), source=F.lit("CrossRef"), journal=first_string(m["container-title"]), url=F.nullif(m["URL"], F.lit("")),
    )


def inverted_text(index: Column) -> Column:
    """The text that an inverted index (token to positions) describes (OP-13, OP-14); null for an empty one."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: p.isNotNull()), lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    return F.when(F.size(placed) > 0, tx.spaced(F.array_join(F.transform(F.array_sort(placed), lambda x: x["t"]), " ")))


def named(values: Column) -> Column:
    return F.coalesce(F.filter(F.transform(values, tx.non_blank), lambda x: x.isNotNull()), F.array())


def openalex(payload: Column) -> Column:
    """The record in an OpenAlex work (OP-12); null without DOI or abstract."""
    w = F.from_json(payload, OPENALEX)
    text = inverted_text(w["abstract_inverted_index"])
    record = paper(
        doi=normalize_doi(w["doi"]), title=F.coalesce(tx.non_blank(w["title"]), F.lit(vocab.TITLE_MISSING)), authors=named(F.transform(w["authorships"], lambda a: a["author"]["display_name"])),
        year=w["publication_year"], abstract=text, source=F.lit("OpenAlex"), journal=tx.non_blank(w["primary_location"]["source"]["display_name"]), url=tx.non_blank(w["id"]),
    )
    return F.when(tx.non_blank(w["doi"]).isNotNull() & (F.coalesce(text, F.lit("")) != ""), record)


def semantic_scholar(payload: Column) -> Column:
    """The record in a Semantic Scholar paper (OP-16); null without abstract or DOI."""
    p = F.from_json(payload, SEMANTIC_SCHOLAR)
    doi, abstract = tx.non_blank(p["externalIds"]["DOI"]), tx.non_blank(p["abstract"])
    record = paper(
        doi=doi, title=F.coalesce(tx.non_blank(p["title"]), F.lit(vocab.TITLE_MISSING)), authors=named(F.transform(p["authors"], lambda a: a["name"])), year=p["year"],
        abstract=abstract, source=F.lit("Semantic Scholar"), journal=tx.non_blank(p["venue"]), url=tx.non_blank(p["url"]),
    )
    return F.when(doi.isNotNull() & abstract.isNotNull(), record)


def own_text(node: ET.Element | None) -> str | None:
    """The text before a node's first child."""
    return (node.text or "").strip() or None if node is not None else None


def pubmed_record(xml: str | None) -> dict | None:
    article = ET.fromstring(xml).find(".//PubmedArticle") if xml else None
    if article is None:
        return None
    ids = [e for tag, attribute in (("ArticleId", "IdType"), ("ELocationID", "EIdType")) for e in article.iter(tag) if e.get(attribute, "").lower() == "doi"]
    sections = [(e.get("Label"), "".join(e.itertext()).strip()) for e in article.findall(".//Abstract/AbstractText")]
    abstract = " ".join(" ".join(f"{label}: {t}" if label else t for label, t in sections if t).split())
    doi = own_text(ids[0]) if ids else None
    if not doi or not abstract:
        return None
    names = [own_text(a.find("CollectiveName")) or own_text(a.find("LastName")) for a in article.findall(".//AuthorList/Author")]
    years = [own_text(article.find(p)) for p in (".//ArticleDate/Year", ".//JournalIssue/PubDate/Year")]
    spelt = re.search(r"\b(?:19|20)\d{2}\b", own_text(article.find(".//JournalIssue/PubDate/MedlineDate")) or "")
    year = next((int(y) for y in years if y and y.isdigit()), int(spelt[0]) if spelt else None)
    pmid = own_text(article.find(".//PMID"))
    return {
        "doi": doi, "title": own_text(article.find(".//ArticleTitle")) or vocab.TITLE_MISSING, "authors": [n for n in names if n], "year": year, "abstract": abstract, "source": "PubMed",
        "journal": own_text(article.find(".//Journal/Title")), "url": f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/" if pmid else None,
    }


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}


@F.pandas_udf(T.StructType([*[T.StructField(n, KINDS[t]) for n, t in (f.split(" ", 1) for f in PAPER.split(", "))], T.StructField("ok", T.BooleanType())]))
def _pubmed(payload: pd.Series) -> pd.DataFrame:
    rows = []
    for xml in payload:  # null where another source answered
        try:
            rows.append(pubmed_record(xml))
        except ET.ParseError:
            rows.append(None)
    names = [f.split(" ")[0] for f in PAPER.split(", ")]
    out = pd.DataFrame([{**dict.fromkeys(names), **(r or {})} for r in rows], columns=names)
    out["year"] = out["year"].astype("Int32")
    out["ok"] = [r is not None for r in rows]
    return out


def pubmed(payload: Column) -> Column:
    """The first article's record in PubMed XML (OP-18 to OP-20); null without DOI or abstract. No built-in flattens mixed XML content."""
    parsed = _pubmed(payload)
    return F.when(parsed["ok"], F.struct(*[parsed[f.split(" ")[0]].alias(f.split(" ")[0]) for f in PAPER.split(", ")]))


PARSERS = {"crossref": crossref, "openalex": openalex, "semantic_scholar": semantic_scholar, "pubmed": pubmed}
