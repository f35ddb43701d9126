"""Connectors: one table of what each source's answer looks like, one parser, and the rules of polling.

Answers come in as rows (source, payload): recorded ones in tests, those of an injected ``fetch`` otherwise; no request is made here.
A broken or empty answer gives no rows and never fails a job.  Bounded: a parsed answer is one page of a source's interface.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.sources.parsers import feed_items


class Spec(NamedTuple):
    """How a source answers: its list of items, and for each field the templates of which the first without a gap is taken."""

    layer: str
    items: str  # dotted paths to the list, alternatives by a bar; "" is the answer itself; "feed" is RSS or Atom
    url: tuple[str, ...]
    title: tuple[str, ...]
    date: tuple[str, ...]
    snippet: tuple[str, ...]
    tier: str  # "" follows from the URL
    verified: str  # "yes", "no", or a part of the URL that says yes
    poll: int  # seconds


_DOI = "https://doi.org/{doi}"
_OPEN = ("{open_access.oa_url}", _DOI)
_FEED = Spec("", "feed", ("{url}",), ("{title}",), ("{published_at}",), ("{snippet}",), "", "", 0)


def _json(layer, items, url, title, date, snippet, tier, verified, poll) -> Spec:
    wrap = lambda fields: tuple(f if "{" in f else f"{{{f}}}" for f in fields.split("|") if f)
    return Spec(layer, items, url if isinstance(url, tuple) else wrap(url), title if isinstance(title, tuple) else wrap(title), wrap(date), wrap(snippet), tier, verified, poll)


def _feed(layer, tier, verified, poll) -> Spec:
    return _FEED._replace(layer=layer, tier=tier, verified=verified, poll=poll)


# The sources' layers, field names, tiers and poll intervals.
SPECS = {
    "arxiv": _feed("A", "S", "yes", 120),
    "biorxiv": _json("A", "collection", _DOI, "title", "date", "abstract", "A", "no", 300),
    "medrxiv": _json("A", "collection", _DOI, "title", "date", "abstract", "A", "no", 300),
    "semanticscholar": _json("A", "data", ("{openAccessPdf.url}", "https://doi.org/{externalIds.DOI}"), "title", "publicationDate|year", "abstract", "", "no", 180),
    "pubmed": _json("A", "result", "https://pubmed.ncbi.nlm.nih.gov/{uid}/", "title", "pubdate", "", "S", "yes", 300),
    "europepmc": _json("A", "resultList.result", ("https://europepmc.org/article/PMC/{pmcid}", "https://europepmc.org/article/med/{pmid}", _DOI), "title", "firstPublicationDate", "", "A", "europepmc.org", 300),
    "core": _json("A", "results", "downloadUrl|doi|identifiers.0.identifier", "title", "publishedDate", "abstract", "A", "no", 600),
    "ssrn": _feed("A", "A", "ssrn.com", 900),
    "philpapers": _json("A", "|entries|results", ("{url}", "{link}", _DOI), "title", "date|year", "", "A", "philpapers.org", 900),
    "ieee": _json("A", "articles", ("{html_url}", "{pdf_url}", _DOI), "title", "publication_date", "abstract", "A", "ieee.org", 600),
    "acm": _json("A", "results", _OPEN, "title", "publication_date", "", "", "no", 600),
    "base": _json("A", "response.docs", "dclink.0|dclink|dcidentifier.0", "dctitle|dcsubject", "dcyear|dcdate", "", "", "no", 600),
    "chemrxiv": _json("A", "itemHits", ("https://doi.org/{item.doi}", _DOI, "{item.url}", "{url}"), "item.title|title", "item.statusDate|item.publishedDate|statusDate", "item.abstract|abstract", "A", "no", 600),
    "engrxiv": _json("A", "data", ("{attributes.preprint_doi_created}", "https://osf.io/{id}/"), "attributes.title|attributes.description", "attributes.date_created", "attributes.description", "A", "no", 900),
    "eurlex": _feed("B", "S", "yes", 600),
    "curia": _feed("B", "S", "curia.europa.eu", 1800),
    "federalregister": _json("B", "results", "html_url", "title", "publication_date", "abstract", "S", "yes", 900),
    "secedgar": _json("B", "hits.hits", "https://www.sec.gov/Archives/edgar/full-index/{_id}", ("{_source.display_names.0.name} SEC Filing", "SEC Filing"), "_source.file_date", "", "S", "yes", 900),
    "esma": _json("B", "results|items", "url|link", "title|name", "date|publication_date", "description|summary", "A", "esma.europa.eu", 1800),
    "eba": _feed("B", "A", "eba.europa.eu", 1800),
    "oecd": _json("B", "items|results", ("{url}", "{link}", *_OPEN), "title", "date|publicationDate|publication_date", "summary|description", "A", "oecd", 1800),
    "wto": _feed("B", "A", "wto.org", 3600),
    "wipo": _json("B", "resultsList.wipo:PCT", "https://patentscope.wipo.int/search/en/detail.jsf?docId={wipo:internationalApplicationNumber}", "wipo:inventionTitle|title", "wipo:internationalFilingDate", "", "S", "yes", 3600),
    "epo": _json("B", "ops:world-patent-data.ops:biblio-search.ops:search-result.ops:publication-reference", "https://worldwide.espacenet.com/patent/search?q={document-id.country.$}{document-id.doc-number.$}{document-id.kind.$}", "Patent {document-id.country.$}{document-id.doc-number.$}{document-id.kind.$}", "", "", "A", "yes", 3600),
    "imf": _json("C", "docs|results|items", "url|link", "title", "date|pubDate", "description|abstract", "S", "imf.org", 3600),
    "worldbank": _json("C", "documents", "url|pdfurl", "display_title|title", "docdt|repnb", "abstracts|abstract", "A", "worldbank.org", 3600),
    "fred": _json("C", "seriess", "https://fred.stlouisfed.org/series/{id}", "title", "last_updated|observation_end", "notes", "S", "yes", 3600),
    "ecb": _feed("C", "S", "ecb.europa.eu", 3600),
    "bis": _feed("C", "A", "bis.org", 3600),
    "eurostat": _feed("C", "S", "europa.eu", 3600),
    "undl": _feed("C", "A", "un.org", 3600),
    "irena": _json("C", "publications|results|items", ("{url}", "{pdfUrl}", *_OPEN), "title", "date|year|publication_date", "summary|abstract", "A", "irena.org", 7200),
    "owid": _json("C", "hits|items", ("https://ourworldindata.org/{slug}", "{url}", "{html_url}"), "title|OWID dataset: {name}", "publishedAt|date", "excerpt|summary", "A", "ourworldindata.org", 7200),
    "hdx": _json("C", "result.results", "https://data.humdata.org/dataset/{name}", "title|name", "metadata_modified|last_modified", "notes", "A", "yes", 7200),
    "github": _json("D", "items", "html_url", "full_name", "pushed_at", "description", "B", "yes", 900),
    "reddit": _json("D", "data.children", "data.url|data.permalink", "data.title", "data.created_utc", "data.selftext|data.link_flair_text", "C", "yes", 600),
    "stackexchange": _json("D", "items", "link", "title", "creation_date", "", "B", "yes", 1800),
    "producthunt": _json("D", "data.posts.edges", "node.url", "node.name", "node.createdAt", "node.tagline", "C", "yes", 3600),
    "paperswithcode": _json("D", "results", ("https://arxiv.org/abs/{arxiv_id}", "{url_pdf}", "{url_abs}"), "title", "published", "abstract", "B", "arxiv.org", 600),
    "mastodon": _json("D", "statuses", "url", "[{account.display_name}] {content}|[{account.username}] {content}", "created_at", "content", "C", "yes", 600),
    "youtube": _json("E", "items", "https://www.youtube.com/watch?v={id.videoId}", "snippet.title", "snippet.publishedAt", "snippet.description", "B", "yes", 3600),
    "podcastindex": _json("E", "feeds", "url|link", "title", "newestItemPublishTime", "description", "C", "yes", 3600),
    "ted": _feed("E", "B", "ted.com", 3600),
    "archive": _json("E", "response.docs", "https://archive.org/details/{identifier}", "title.0|title|identifier", "date", "description.0|description", "B", "yes", 3600),
    "jstor": _json("E", "results.items|results", ("{stableUrl}", "{doi}", "{open_access.oa_url}"), "title", "pubYear|publication_date", "snippet", "A", "jstor.org", 3600),
    "europeana": _json("E", "items", "edmIsShownAt.0|edmIsShownBy.0|guid", "title.0|title|dcTitle.0|dcTitle", "year.0|year|dcDate.0|dcDate", "dcDescription.0|dcDescription", "B", "europeana.eu", 7200),
}

#: Formats of dates that become ISO; others stay as they are.
DATES = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%a, %d %b %Y %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S GMT", "%d %b %Y", "%Y")
SNIPPET = 500


def iso(raw: str) -> str:
    """The date as ISO-8601 in its zone (UTC where it names none); seconds since 1970 too; what is no date stays."""
    if re.fullmatch(r"\d{9,11}(\.\d+)?", raw):
        return datetime.fromtimestamp(float(raw), UTC).isoformat()
    for form in DATES:
        try:
            at = datetime.strptime(raw[:32].strip(), form)
        except ValueError:
            continue
        return (at if at.tzinfo else at.replace(tzinfo=UTC)).isoformat()
    return raw


def _at(value, path: str):
    for step in path.split(".") if path else ():
        if isinstance(value, list) and step.isdigit():
            value = value[int(step)] if int(step) < len(value) else None
        else:
            value = value.get(step) if isinstance(value, dict) else None
    return value


def _filled(item, templates: tuple[str, ...]) -> str:
    """The first template whose places all have a value."""
    for template in templates:
        values = {p: _at(item, p) for p in re.findall(r"\{([^}]*)\}", template)}
        if all(v not in (None, "") and not isinstance(v, (dict, list)) for v in values.values()):
            return re.sub(r"\{([^}]*)\}", lambda m, v=values: str(v[m[1]]).strip(), template)
    return ""


def parse(source: str, payload: str | None) -> list[tuple]:
    """(url, title, published_at, tier, verified, snippet) of an answer's items; items without a URL are left out; tier "" follows from it."""
    spec = SPECS.get(source)
    if spec is None or not payload:
        return []
    if spec.items == "feed":
        items = [dict(zip(("url", "title", "published_at", "snippet"), x, strict=True)) for x in feed_items(payload)]
    else:
        try:
            answer = json.loads(payload)
        except ValueError:
            return []
        items = next((found for path in spec.items.split("|") if isinstance(found := _at(answer, path), (list, dict)) and (path or isinstance(found, list))), [])
        if isinstance(items, dict):  # items by their ids, or one item alone
            items = [{"uid": k, **v} for k, v in items.items() if isinstance(v, dict)] or [items]
    out = []
    for item in items:
        url = _filled(item, spec.url) if isinstance(item, dict) else ""
        if url:
            plain = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", _filled(item, spec.title))).strip()
            verified = spec.verified == "yes" or (spec.verified != "no" and spec.verified in url)
            out.append((url, plain, iso(_filled(item, spec.date)), spec.tier, verified, _filled(item, spec.snippet)[:SNIPPET]))
    return out


_ROW = "source string, position int, url string, title string, published_at string, tier string, verified boolean, snippet string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for source, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(source, k, *r) for k, r in enumerate(parse(source, payload))]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in _ROW.split(", ")])


def sources(payloads: DataFrame) -> DataFrame:
    """Items of answers (source, payload): source, layer, position, url, title, published_at, tier, verified and snippet."""
    rows = payloads.select("source", "payload").mapInArrow(_parsed, _ROW)
    layer = F.element_at(F.create_map(*[F.lit(x) for name, s in SPECS.items() for x in (name, s.layer)]), F.col("source"))
    return rows.withColumn("layer", layer).withColumn("tier", F.when(F.col("tier") == "", urls.tier(F.col("url"))).otherwise(F.col("tier")))


def fan_out(rows: DataFrame) -> DataFrame:
    """One row for each URL: that of the first layer, source and position."""
    order = F.struct("layer", "source", "position")
    return rows.groupBy("url").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), order).alias("r")).select("url", "r.*")


def newer(rows: DataFrame, marks: DataFrame, identity: str = "url") -> tuple[DataFrame, DataFrame]:
    """(rows beyond their source's high-water mark, compared as text; the marks afterwards) for marks (source, mark)."""
    seen = rows.join(marks, "source", "left").where(F.col("mark").isNull() | (F.col(identity) > F.col("mark"))).drop("mark")
    highest = seen.groupBy("source").agg(F.max(identity).alias("high"))
    after = marks.join(highest, "source", "full_outer").select("source", F.greatest("mark", "high").alias("mark"))
    return seen, after


def conditional(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """(source, payload, etag, changed) after answers (source, status, payload, etag): on 304 the cached payload stands."""
    old = cache.select("source", F.col("payload").alias("old"), F.col("etag").alias("old_etag"))
    same = F.coalesce(F.col("status") == 304, F.lit(False))
    both = old.join(answers, "source", "full_outer")
    keep = same | F.col("status").isNull()
    return both.select("source", F.when(keep, F.col("old")).otherwise(F.col("payload")).alias("payload"), F.when(keep, F.col("old_etag")).otherwise(F.coalesce("etag", "old_etag")).alias("etag"), (~keep).alias("changed"))


def retried(status: Column, attempt: Column, most: int = 3) -> Column:
    """Whether a request is made again: after no answer, 429, 503 and other server errors, up to ``most`` attempts; other 4xx never."""
    again = status.isNull() | status.isin(429, 503) | (status >= 500)
    return again & (attempt < most)


def wait_seconds(attempt: Column) -> Column:
    """Seconds before the next attempt: doubling, 2 at least and 30 at most."""
    return F.greatest(F.lit(2.0), F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(30.0)))


def fetched(requests: DataFrame, fetch: Callable[[str], tuple[int, str]], most: int = 3) -> DataFrame:
    """(source, status, payload, error, attempts) of requests (source, url) through an injected ``fetch`` (url) -> (status, body).

    A request that fails or raises gives an empty payload and its error; it never ends the job.
    """

    def one(url: str) -> tuple:
        status = body = error = None
        for attempt in range(1, most + 1):
            try:
                status, body = fetch(url)
                error = None if status < 400 else f"status {status}"
            except Exception as e:  # noqa: BLE001  whatever an injected function raises
                status, body, error = None, None, f"{type(e).__name__}: {e}"
            if error is None or (status is not None and status < 500 and status != 429):
                break
        return status, body if error is None else None, error, attempt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(u) for u in batch.column(1).to_pylist()]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], ["source", "status", "payload", "error", "attempts"])

    return requests.select("source", "url").mapInArrow(run, "source string, status int, payload string, error string, attempts int")


class Poll(NamedTuple):
    """What is known of a source between polls; times in seconds."""

    interval: int
    empty: int = 0
    errors: int = 0
    paused_until: int = 0


EMPTY_POLLS, ERROR_LIMIT, PAUSE, SLOWEST = 3, 5, 300, 3600


def step(state: Poll, at: int, ok: bool, found: bool, usual: int, slowest: int = SLOWEST) -> tuple[Poll, str]:
    """(state afterwards, what happened): a paused source is skipped; five errors in a row pause it; three empty polls double its
    interval; new items restore it."""
    if at < state.paused_until:
        return state, "skipped"
    if not ok:
        errors = state.errors + 1
        return (state._replace(errors=0, paused_until=at + PAUSE), "paused") if errors >= ERROR_LIMIT else (state._replace(errors=errors), "failed")
    if found:
        return Poll(usual), "found"
    empty = state.empty + 1
    slower = Poll(min(state.interval * 2, slowest)) if empty >= EMPTY_POLLS else Poll(state.interval, empty)
    return slower, "empty"


def rss(items: list[dict]) -> str:
    """A recorded feed, for tests and queries."""
    root = ElementTree.Element("rss")
    channel = ElementTree.SubElement(root, "channel")
    for item in items:
        node = ElementTree.SubElement(channel, "item")
        for name, value in item.items():
            ElementTree.SubElement(node, name).text = value
    return ElementTree.tostring(root, encoding="unicode")
