"""Article sources: fetched XML and annotation JSON as tables, and a paged source that reads them from files.

Articles: pmid, title, abstract, journal, pub_date, authors[], mesh_terms[], pmc_id, doi, pubmed_url, pdf_url.
"""

from __future__ import annotations

import hashlib
import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ARTICLE = "pmid string, title string, abstract string, journal string, pub_date string, authors array<string>, mesh_terms array<string>, pmc_id string, doi string, pubmed_url string, pdf_url string"
#: An article the annotation service always has: asked for along with others, and left out of what comes back.
SENTINEL = "12068308"
_ANNOTATION = "struct<id: string, text: string, infons: struct<type: string, identifier: string, id: string>, locations: array<struct<offset: int, length: int>>>"
BUCKET = 100_000
_ROLE = "struct<normalized_name: string, identifier: string>"
DOCUMENT = f"struct<pmid: string, id: string, _id: string, passages: array<struct<annotations: array<{_ANNOTATION}>>>, relations: array<struct<infons: struct<type: string, entity1: string, entity2: string, role1: {_ROLE}, role2: {_ROLE}>, nodes: array<struct<refid: string>>>>>"


def _text(e: ET.Element | None) -> str:
    return (e.text or "") if e is not None else ""


def parse_articles(xml: str) -> list[dict]:
    """Articles of one XML reply; none if it can't be read. Only an element's own text counts, and of several abstract
    texts the first."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for record in root.iter("PubmedArticle"):
        citation = record.find("MedlineCitation")
        article = citation.find("Article") if citation is not None else None
        if article is None:
            continue
        day = article.find("Journal/JournalIssue/PubDate")
        year, month = (day.find(x) if day is not None else None for x in ("Year", "Month"))
        people = [(a.find("ForeName"), a.find("LastName")) for a in article.findall("AuthorList/Author")]
        ids: dict[str, str] = {}
        for i in record.findall("PubmedData/ArticleIdList/ArticleId"):
            if i.text:
                ids[i.get("IdType", "")] = i.text
        pmid, pmc = _text(citation.find("PMID")), ids.get("pmc", "")
        out.append({
            "pmid": pmid, "title": _text(article.find("ArticleTitle")), "abstract": _text(article.find("Abstract/AbstractText")), "journal": _text(article.find("Journal/Title")),
            "pub_date": " ".join(filter(None, (_text(month), _text(year)))) if year is not None else "",
            "authors": [" ".join(filter(None, (_text(f), _text(n)))) for f, n in people if n is not None], "mesh_terms": [t for m in citation.findall("MeshHeadingList/MeshHeading/DescriptorName") if (t := m.text)],
            "pmc_id": pmc, "doi": ids.get("doi", ""), "pubmed_url": f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/" if pmid else "", "pdf_url": f"https://www.ncbi.nlm.nih.gov/pmc/articles/{pmc}/pdf/" if pmc else "",
        })
    return out


def articles_of(replies: DataFrame, column: str = "xml") -> DataFrame:
    """Articles of a table of XML replies."""
    names = [f.split(" ")[0] for f in ARTICLE.split(", ")]
    types = [pa.list_(pa.string()) if "array" in f else pa.string() for f in ARTICLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [a for x in b.column(0).to_pylist() if x for a in parse_articles(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    return replies.select(column).mapInArrow(run, ARTICLE)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files, split at articles by Spark's own reader; for files that are too large for one value."""
    schema = (
        "MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string>>>, AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>>, MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string>>>>>, "
        "PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>"
    )
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).filter("MedlineCitation.Article is not null")
    a = F.col("MedlineCitation.Article")
    day = a["Journal"]["JournalIssue"]["PubDate"]
    people = F.filter(a["AuthorList"]["Author"], lambda p: p["LastName"].isNotNull())

    def id_of(kind: str):
        hits = F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: (i["_IdType"] == kind) & i["_VALUE"].isNotNull())
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["_VALUE"], F.lit(""))

    def some(c):
        return F.coalesce(c, F.lit(""))

    none = F.array().cast("array<string>")
    out = raw.select(
        some(F.col("MedlineCitation.PMID._VALUE")).alias("pmid"), some(a["ArticleTitle"]).alias("title"), some(F.try_element_at(a["Abstract"]["AbstractText"], F.lit(1))).alias("abstract"), some(a["Journal"]["Title"]).alias("journal"),
        F.when(day["Year"].isNull(), "").otherwise(F.concat_ws(" ", day["Month"], day["Year"])).alias("pub_date"), F.coalesce(F.transform(people, lambda p: F.concat_ws(" ", p["ForeName"], p["LastName"])), none).alias("authors"),
        F.coalesce(F.filter(F.col("MedlineCitation.MeshHeadingList.MeshHeading.DescriptorName._VALUE"), lambda m: m.isNotNull()), none).alias("mesh_terms"), id_of("pmc").alias("pmc_id"), id_of("doi").alias("doi"),
    )
    return out.withColumns({"pubmed_url": F.when(F.col("pmid") != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/"))).otherwise(""), "pdf_url": F.when(F.col("pmc_id") != "", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), "pmc_id", F.lit("/pdf/"))).otherwise("")})


def annotations_of(replies: DataFrame, column: str = "json", sentinel: str | None = SENTINEL) -> DataFrame:
    """Annotation documents (id, passages, relations) of JSON replies: an object that holds a list, a list, or one
    document; ids end at "|"; the sentinel is left out."""
    body = F.trim(column)
    wrapped = F.from_json(body, f"struct<PubTator3: array<{DOCUMENT}>>")["PubTator3"]
    bare = F.from_json(body, f"array<{DOCUMENT}>")
    docs = F.when(F.get_json_object(body, "$.PubTator3").isNotNull(), wrapped).when(F.startswith(body, F.lit("[")), bare).otherwise(F.array(F.from_json(body, DOCUMENT)))
    d = replies.select(F.explode(docs).alias("d")).filter("d is not null")
    d = d.select(F.substring_index(F.coalesce("d.pmid", "d.id", "d._id"), "|", 1).alias("id"), F.coalesce("d.passages", F.from_json(F.lit("[]"), f"array<struct<annotations: array<{_ANNOTATION}>>>")).alias("passages"), "d.relations")
    d = d.filter("id is not null")
    return d if sentinel is None else d.filter(F.col("id") != sentinel)


def request_chunks(pmids: DataFrame, size: int = 50, sentinel: str = SENTINEL) -> DataFrame:
    """(chunk, pmids): what to ask the annotation service for, the sentinel added to each chunk that lacks it.

    Numbers are given within buckets of about ``BUCKET`` ids, so that no task has all of them; a bucket's last chunk is short.
    """
    buckets = -(-pmids.count() // BUCKET) or 1
    bucket = F.pmod(F.xxhash64("pmid"), F.lit(buckets))
    order = Window.partitionBy("bucket").orderBy("pmid")
    chunk = F.col("bucket") * -(-2 * BUCKET // size) + F.floor((F.row_number().over(order) - 1) / size)
    numbered = pmids.select("pmid", bucket.alias("bucket")).select("pmid", chunk.alias("chunk"))
    lists = numbered.groupBy("chunk").agg(F.sort_array(F.collect_list("pmid")).alias("pmids"))
    return lists.withColumn("pmids", F.when(F.array_contains("pmids", sentinel), F.col("pmids")).otherwise(F.concat("pmids", F.array(F.lit(sentinel)))))


def search_request(term: str, max_results: int = 20, start: int = 0, sort: str = "relevance", mindate: str = "", maxdate: str = "", history: bool = False) -> dict[str, str]:
    """Parameters of a search: 1 to 10,000 results from 0 on; dates are publication dates; with history none come back but the cursor."""
    out = {"db": "pubmed", "term": term, "retmode": "json", "sort": sort, "retmax": "0" if history else str(max(1, min(max_results, 10_000)))}
    out |= {"usehistory": "y"} if history else {"retstart": str(max(0, start))}
    if mindate or maxdate:
        out |= {"datetype": "pdat"} | ({"mindate": mindate} if mindate else {}) | ({"maxdate": maxdate} if maxdate else {})
    return out


def search_cursor(reply: str) -> dict[str, str | int]:
    """web_env, query_key and count of a search with history; an error if one is missing."""
    r = json.loads(reply).get("esearchresult", {})
    if not r.get("webenv") or not r.get("querykey"):
        raise ValueError("the search returned no history cursor")
    return {"web_env": r["webenv"], "query_key": r["querykey"], "count": int(r.get("count", 0))}


def pages(total: int, batch_size: int, start: int = 0, max_batches: int | None = None) -> list[tuple[int, int]]:
    """(retstart, retmax) until the end: pages of 1 to 500."""
    size = max(1, min(batch_size, 500))
    found = [(a, min(size, total - a)) for a in range(max(0, start), total, size)]
    return found if max_batches is None else found[:max_batches]


# --- transports: how requests are sent ---

MOST_IDS = 200  # of articles asked for by id in one request


class HttpTransport:
    """Requests to a literature service at ``base``, so far apart as it allows, again after errors."""

    def __init__(self, base: str, key: str = "", timeout: float = 60.0):
        from helixmill.functions.scoring import least_interval
        from helixmill.operators.jobs import RateLimiter

        self.base, self.key, self.timeout = base.rstrip("/"), key, timeout
        self._limit = RateLimiter(1 / least_interval(bool(key)))

    def get(self, endpoint: str, params: dict[str, str]) -> str:
        from urllib.parse import urlencode
        from urllib.request import urlopen

        from helixmill.operators.jobs import with_retries

        def once() -> str:
            self._limit.wait()
            with urlopen(f"{self.base}/{endpoint}?{urlencode(params | ({'api_key': self.key} if self.key else {}))}", timeout=self.timeout) as reply:
                return reply.read().decode("utf-8", "replace")

        return with_retries(once)


class RecordedTransport:
    """Replies that were stored: one file for each request, named by ``name_of``; a request without one is an OSError."""

    def __init__(self, folder: str):
        self.folder = folder

    @staticmethod
    def name_of(endpoint: str, params: dict[str, str]) -> str:
        return hashlib.sha256(json.dumps([endpoint, sorted(params.items())]).encode()).hexdigest()[:32]

    def get(self, endpoint: str, params: dict[str, str]) -> str:
        with open(os.path.join(self.folder, self.name_of(endpoint, params)), encoding="utf-8") as f:
            return f.read()


def fetch_request(cursor: dict, start: int, size: int) -> dict[str, str]:
    """Parameters of a page of what a search with history found: 1 to 500 articles from 0 on."""
    return {"db": "pubmed", "WebEnv": str(cursor["web_env"]), "query_key": str(cursor["query_key"]), "retstart": str(max(0, start)), "retmax": str(max(1, min(size, 500))), "retmode": "xml"}


def fetch_by_id_request(pmids: list[str]) -> dict[str, str]:
    """Parameters of a request for articles by id: the first ``MOST_IDS``."""
    return {"db": "pubmed", "id": ",".join(pmids[:MOST_IDS]), "retmode": "xml"}


def search_with_history(transport, term: str, **filters) -> dict[str, str | int]:
    """web_env, query_key and count of a search."""
    return search_cursor(transport.get("esearch.fcgi", search_request(term, history=True, **filters)))


def search_ids(transport, term: str, max_results: int = 20, start: int = 0, **filters) -> list[str]:
    """Ids of one page of a search."""
    return json.loads(transport.get("esearch.fcgi", search_request(term, max_results, start, **filters))).get("esearchresult", {}).get("idlist", [])


def fetch_pages(spark: SparkSession, transport, cursor: dict, pages: list[tuple[int, int]]) -> DataFrame:
    """Articles of some pages, with their page's number; each page is asked for by an executor, which needs no other."""
    rows = spark.createDataFrame([(k, a, n) for k, (a, n) in enumerate(pages)], "page int, retstart int, retmax int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = [transport.get("efetch.fcgi", fetch_request(cursor, a, n)) for a, n in zip(b.column("retstart").to_pylist(), b.column("retmax").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(replies, pa.string())], ["xml"])

    return articles_of(rows.repartition(max(1, len(pages)), "page").mapInArrow(run, "xml string"))


def fetch_articles(spark: SparkSession, transport, pmids: list[str]) -> DataFrame:
    """Articles by id, the first ``MOST_IDS`` of them."""
    return articles_of(spark.createDataFrame([(transport.get("efetch.fcgi", fetch_by_id_request(pmids)),)] if pmids else [], "xml string"))


class _Page(InputPartition):
    def __init__(self, start: int, size: int, cursor: dict | None = None):
        self.start, self.size, self.cursor = start, size, cursor


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.size = int(options.get("batchsize", "200"))

    def _transport(self):
        if "path" in self.options and "term" in self.options:
            return RecordedTransport(self.options["path"])
        return HttpTransport(self.options["url"], self.options.get("key", ""))

    def partitions(self) -> list[InputPartition]:
        o = self.options
        if "term" in o or "pmids" in o:
            if "pmids" in o:
                return [_Page(0, MOST_IDS)]
            filters = {k: o[k] for k in ("sort", "mindate", "maxdate") if k in o}
            cursor = search_with_history(self._transport(), o["term"], **filters)
            return [_Page(a, n, cursor) for a, n in pages(min(cursor["count"], int(o.get("total", cursor["count"]))), self.size)]
        return [_Page(a, n) for a, n in pages(int(o.get("total", str(len(os.listdir(o["path"]))))), self.size)]

    def _replies(self, partition: _Page) -> Iterator[str]:
        o = self.options
        if partition.cursor is not None:
            yield self._transport().get("efetch.fcgi", fetch_request(partition.cursor, partition.start, partition.size))
        elif "pmids" in o:
            transport = RecordedTransport(o["path"]) if "path" in o else HttpTransport(o["url"], o.get("key", ""))
            yield transport.get("efetch.fcgi", fetch_by_id_request([p.strip() for p in o["pmids"].split(",") if p.strip()]))
        else:
            for name in sorted(os.listdir(o["path"]))[partition.start : partition.start + partition.size]:
                with open(os.path.join(o["path"], name), encoding="utf-8") as f:
                    yield f.read()

    def read(self, partition: _Page) -> Iterator[tuple]:
        for reply in self._replies(partition):
            for a in parse_articles(reply):
                yield tuple(a[c.split(" ")[0]] for c in ARTICLE.split(", "))


class ArticleSource(DataSource):
    """``spark.dataSource.register(ArticleSource)``, then ``spark.read.format("articles")`` with these options:

    ``term`` (and ``sort``, ``mindate``, ``maxdate``, ``total``, ``batchsize``): a search with history, then a partition for
    each page of it; ``pmids``: articles by id, with commas; each from the service at ``url`` (and ``key``), or from replies
    recorded in ``path``. Only ``path``: a folder, which all executors see, of XML replies in order of their names, so many
    to a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return ARTICLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pages(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """(doc_id, page_no, content) of binary files; ``extract`` turns bytes into a list of page texts. Without one, files are taken for text with form feeds between pages."""
    extract = extract or (lambda data: data.decode("utf-8", "replace").split("\f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, t) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()) for k, t in enumerate(extract(c))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "page_no", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "doc_id string, page_no int, content string")
