"""Readers of record formats: article XML, nested JSON of several services, Atom feeds, vocabularies, ideas, packs. All give one common shape."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from papyrine.functions.text import clean, distinct_caseless, doi, from_inverted
from papyrine.session import reachable

#: The common record.
RECORD = ("source", "id", "doi", "pmid", "title", "abstract", "year", "venue", "authors", "citations", "type", "url")


def shaped(df: DataFrame, source: str, more: dict[str, Column] | None = None, **columns: Column) -> DataFrame:
    """Select the common record, then `more`; what a source lacks is null."""
    kinds = {"year": "int", "citations": "long", "authors": "array<string>"}
    fixed = {"source": F.lit(source)} | columns
    return df.select(*[fixed.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RECORD], *[v.alias(c) for c, v in (more or {}).items()])


def tree(xml: str) -> ElementTree.Element:
    """The document under a root of our own; names stay as they are written, prefix included, as they do in Spark's xpath."""
    made, parser = ElementTree.TreeBuilder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = made.start, made.end, made.data
    made.start("", {})
    parser.Parse(xml, True)
    made.end("")
    return made.close()


def fields(one: dict[str, str] | None = None, every: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A function of XML that reads all paths from one parse, where xpath would parse the text once a path: in `one` the text of the first node, empty if there is none, in `every` the texts right in each node.
    Paths are those of ElementTree, found anywhere. Null and empty texts give nulls; what is no XML is an error."""
    one, every = one or {}, every or {}

    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if not text:
                rows.append((None,) * (len(one) + len(every)))
                continue
            root = tree(text)
            firsts = [root.find(f".//{p}") for p in one.values()]
            lists = [[t for node in root.iterfind(f".//{p}") for t in (node.text, *(inside.tail for inside in node)) if t] for p in every.values()]
            rows.append((*["" if node is None else "".join(node.itertext()) for node in firsts], *lists))
        return pd.DataFrame(rows, columns=[*one, *every], dtype=object)

    kind = StructType([*[StructField(c, StringType()) for c in one], *[StructField(c, ArrayType(StringType())) for c in every]])
    return F.pandas_udf(read, kind).asNondeterministic()  # else a filter on what is read is sent below, where it reads again


ARTICLE = fields(
    {"pmid": "PMID", "doi": "ArticleId[@IdType='doi']", "year": "PubDate/Year", "date": "PubDate/MedlineDate", "venue": "Journal/Title"},
    {"last": "Author/LastName", "initials": "Author/Initials", "types": "PublicationType", "headings": "MeshHeading/DescriptorName"},
)


def article_xml(df: DataFrame, xml: str = "xml", headings: bool = False) -> DataFrame:
    """Rows of article XML, one article each: text with nested mark-up kept, abstract parts joined, a year found in free date text, eight authors; with `headings` also the descriptor names (see descriptors)."""
    reachable(df.sparkSession)
    r = df.withColumn("_r", ARTICLE(F.col(xml)))
    x = lambda c: F.nullif(F.col(f"_r.{c}"), F.lit(""))
    inner = lambda tag: clean(F.regexp_extract(xml, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    parts = F.transform(F.regexp_extract_all(xml, F.lit("(?s)<AbstractText[^>]*>(.*?)</AbstractText>"), 1), clean)
    year = F.coalesce(x("year"), F.nullif(F.regexp_extract("_r.date", r"(\d{4})", 1), F.lit("")))
    authors = F.slice(F.zip_with("_r.last", "_r.initials", lambda a, b: F.concat_ws(" ", a, b)), 1, 8)
    pmid = x("pmid")
    return shaped(
        r, "pubmed", {"headings": distinct_caseless(F.col("_r.headings"))} if headings else None, id=pmid, pmid=pmid, doi=doi(F.col("_r.doi")), title=inner("ArticleTitle"), abstract=F.array_join(parts, " "), year=year, venue=x("venue"),
        authors=authors, type=F.left(F.array_join("_r.types", "; "), F.lit(120)), url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")),
    )


def descriptors(xml: str = "xml") -> Column:
    """Descriptor names of an article, first spelling of each."""
    return distinct_caseless(F.xpath(F.col(xml), F.lit("//MeshHeading/DescriptorName/text()")))


EPMC = "struct<id:string,pmid:string,doi:string,title:string,abstractText:string,pubYear:string,authorString:string,citedByCount:long,journalTitle:string,journalInfo:struct<journal:struct<title:string>>,bookOrReportDetails:struct<publisher:string>,meshHeadingList:struct<meshHeading:array<struct<descriptorName:string>>>>"


def europe_json(df: DataFrame, json: str = "json") -> DataFrame:
    """Nested search results; the venue is the first of its alternatives that is not empty."""
    r = df.withColumn("_r", F.from_json(json, EPMC))
    venue = F.coalesce(*[F.nullif(F.col(p), F.lit("")) for p in ("_r.journalInfo.journal.title", "_r.journalTitle", "_r.bookOrReportDetails.publisher")])
    return shaped(r, "europepmc", id=F.col("_r.id"), pmid=F.col("_r.pmid"), doi=doi(F.col("_r.doi")), title=clean(F.col("_r.title")), abstract=clean(F.col("_r.abstractText")), year=F.col("_r.pubYear"), venue=venue, authors=F.slice(F.split("_r.authorString", r",\s*"), 1, 8), citations=F.col("_r.citedByCount"))


def europe_descriptors(json: str = "json") -> Column:
    names = F.filter(F.transform(F.from_json(json, EPMC)["meshHeadingList"]["meshHeading"], lambda m: m["descriptorName"]), lambda n: n.isNotNull() & (n != ""))
    return distinct_caseless(names)


WORK = "struct<id:string,doi:string,title:string,publication_year:int,cited_by_count:long,type:string,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>>"


def work_json(df: DataFrame, json: str = "json") -> DataFrame:
    """Works with an inverted index for an abstract."""
    r = df.withColumn("_r", F.from_json(json, WORK))
    return shaped(r, "openalex", id=F.col("_r.id"), doi=doi(F.col("_r.doi")), title=clean(F.col("_r.title")), abstract=from_inverted(F.col("_r.abstract_inverted_index")), year=F.col("_r.publication_year"), venue=F.col("_r.primary_location.source.display_name"), authors=F.slice(F.transform("_r.authorships", lambda a: a["author"]["display_name"]), 1, 8), citations=F.col("_r.cited_by_count"), type=F.col("_r.type"), url=F.col("_r.id"))


CROSSREF = "struct<DOI:string,title:array<string>,abstract:string,`container-title`:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,`is-referenced-by-count`:long,type:string,URL:string>"


def crossref_json(df: DataFrame, json: str = "json") -> DataFrame:
    r = df.withColumn("_r", F.from_json(json, CROSSREF))
    year = F.get(F.get(F.col("_r.issued.date-parts"), F.lit(0)), F.lit(0))
    return shaped(r, "crossref", id=F.col("_r.DOI"), doi=doi(F.col("_r.DOI")), title=clean(F.get("_r.title", F.lit(0))), abstract=clean(F.col("_r.abstract")), year=year, venue=F.get(F.col("_r.container-title"), F.lit(0)), authors=F.slice(F.transform("_r.author", lambda a: F.concat_ws(" ", a["given"], a["family"])), 1, 8), citations=F.col("_r.is-referenced-by-count"), type=F.col("_r.type"), url=F.col("_r.URL"))


def scholar_json(df: DataFrame, json: str = "json") -> DataFrame:
    kind = "struct<paperId:string,title:string,abstract:string,year:int,venue:string,citationCount:long,url:string,externalIds:struct<DOI:string,PubMed:string>,authors:array<struct<name:string>>>"
    r = df.withColumn("_r", F.from_json(json, kind))
    return shaped(r, "semanticscholar", id=F.col("_r.paperId"), doi=doi(F.col("_r.externalIds.DOI")), pmid=F.col("_r.externalIds.PubMed"), title=clean(F.col("_r.title")), abstract=F.col("_r.abstract"), year=F.col("_r.year"), venue=F.col("_r.venue"), authors=F.slice(F.transform("_r.authors", lambda a: a["name"]), 1, 8), citations=F.col("_r.citationCount"), url=F.col("_r.url"))


ENTRY = fields({c: c for c in ("id", "title", "summary", "published")}, {"names": "author/name"})


def atom(df: DataFrame, xml: str = "xml", year_from: int | None = None) -> DataFrame:
    """Atom entries, one a row; the service cannot filter by year, so the reader does; a null year passes."""
    reachable(df.sparkSession)
    r = df.withColumn("_r", ENTRY(F.col(xml)))
    x = lambda c: F.nullif(F.col(f"_r.{c}"), F.lit(""))
    out = shaped(r, "arxiv", id=F.regexp_extract(x("id"), r"([^/]+)$", 1), title=clean(x("title")), abstract=clean(x("summary")), year=F.substring(x("published"), 1, 4), authors=F.slice("_r.names", 1, 8), url=x("id"))
    return out if year_from is None else out.where(F.col("year").isNull() | (F.col("year") >= year_from))


def routed(domains: DataFrame, routing: DataFrame, general: str = "general") -> DataFrame:
    """routing: (domain, source, ord). Sources of each domain in order; domains without an entry get the general ones."""
    r = F.broadcast(routing)
    own = domains.join(r, "domain")
    rest = domains.join(r, "domain", "left_anti").join(r.where(F.col("domain") == general).drop("domain"))
    return own.unionByName(rest, allowMissingColumns=True)


DESCRIPTOR = fields({"ui": "DescriptorUI", "label": "DescriptorName/String"}, {"paths": "TreeNumber", "terms": "Term/String"})


def vocabulary_xml(df: DataFrame, xml: str = "xml", shortest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Descriptor records, one a row: (ui, label, paths) and (term, ui). A term of two descriptors is ambiguous and dropped."""
    reachable(df.sparkSession)
    heads = df.select(DESCRIPTOR(F.col(xml)).alias("_r")).select("_r.*")
    each = heads.select("ui", F.explode("terms").alias("raw")).select("ui", F.lower("raw").alias("term")).where(F.length("term") >= shortest).distinct()
    sole = each.groupBy("term").agg(F.min("ui").alias("ui"), F.count("*").alias("n")).where("n = 1").drop("n")
    return heads.select("ui", "label", "paths"), sole


def supplemented(terms: DataFrame, more: DataFrame) -> DataFrame:
    """Further (term, ui): readable ones that the main vocabulary lacks."""
    digits = F.length("term") - F.length(F.regexp_replace("term", "[0-9]", ""))
    fit = F.length("term").between(4, 60) & (F.size(F.split("term", " ")) <= 6) & (digits * 5 <= F.length("term") * 2)
    return terms.unionByName(more.where(fit).join(terms, "term", "left_anti"))


def typed(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited (ui, types), several lines a ui."""
    return spark.read.csv(path, sep="|", schema="ui string, type string").groupBy("ui").agg(F.array_sort(F.collect_set("type")).alias("types"))


def ideas(spark: SparkSession, path: str) -> DataFrame:
    """Ideas as a JSON array or as JSON lines; a missing id is made from the position in the file, counted from 1."""
    kind = "id string, code string, title string, statement string, rationale string"
    broken = spark.read.text(path).where("btrim(value) <> '' AND try_parse_json(value) IS NULL")
    rows = spark.read.schema(kind).option("multiLine", not broken.isEmpty()).json(path)
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    rows = rows.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    made = F.format_string("i%02d", F.col("ahead") + F.col("place") + 1)
    return rows.join(F.broadcast(ahead), "part").withColumn("id", F.coalesce("id", made)).drop("part", "place", "ahead")


def packs(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files: name, content, sha256, title."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    return text.select(F.regexp_extract("file", r"([^/]+)\.md$", 1).alias("name"), "content", F.sha2("content", 256).alias("sha256"), F.regexp_extract("content", r"(?m)^# (.+)$", 1).alias("title"))


def pack_section(content: Column, name: str) -> Column:
    """The part of a Markdown text under a heading of level two."""
    return F.nullif(F.btrim(F.regexp_extract(content, rf"(?ms)^## {name}[^\n]*\n(.*?)(?=^## |\z)", 1), F.lit(" \n")), F.lit(""))


def delimited(spark: SparkSession, path: str, most: int | None = 20_000) -> DataFrame:
    """CSV, TSV, semicolon or pipe file with a header, all columns text; the delimiter is the one most frequent in the header, a byte order mark goes, ragged rows are padded. `most` rows profile a file; None reads all of it."""
    head = spark.read.text(path).limit(1).select("value").first()
    line = head[0] if head else ""
    sep = max(",\t;|", key=line.count)
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="PERMISSIVE")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df if most is None else df.limit(most)


def stratified(df: DataFrame, by: str, per: int, seed: int = 7) -> DataFrame:
    """A sampling operator: `per` rows of each stratum, by a seeded hash of the row."""
    from papyrine.operators.relational import top

    return top(df, [by], [F.xxhash64(F.lit(seed), *df.columns), *map(F.col, df.columns)], per).drop("rank")


def resolved(refs: DataFrame, by_pmid: DataFrame, by_doi: DataFrame) -> DataFrame:
    """refs: (id, pmid, doi). Full-text ids by PMID, else by DOI."""
    out = refs.join(by_pmid.withColumnRenamed("pmcid", "_a"), "pmid", "left").join(by_doi.withColumnRenamed("pmcid", "_b"), "doi", "left")
    return out.withColumn("pmcid", F.coalesce("_a", "_b")).drop("_a", "_b")
