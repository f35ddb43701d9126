"""Answers of the connectors' sources, written by hand, and the item that each must give.

Each answer has the form that its source's public interface has.  ``{n}`` stands for a number from a given table, both in the answer
and in what is expected: url, title, published_at, tier, verified and snippet.
"""

from __future__ import annotations

from typing import NamedTuple


class Answer(NamedTuple):
    source: str
    layer: str
    payload: str
    url: str
    title: str
    published_at: str
    tier: str
    verified: bool
    snippet: str


_DAY, _NOON, _YEAR = "2024-03-05T00:00:00+00:00", "2024-03-05T06:07:08+00:00", "2024-01-01T00:00:00+00:00"
_ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title>'

ANSWERS = (
    Answer(
        "arxiv", "A",
        _ATOM + '<entry><id>http://arxiv.org/abs/2403.{n}v1</id><updated>2024-03-06T00:00:00Z</updated><published>2024-03-05T06:07:08Z</published>'
        '<title>Paper {n}\n  on carbon</title><summary>We  show it.</summary><link href="http://arxiv.org/abs/2403.{n}v1" rel="alternate" type="text/html"/>'
        '<link title="pdf" href="http://arxiv.org/pdf/2403.{n}v1" rel="related" type="application/pdf"/></entry></feed>',
        "http://arxiv.org/abs/2403.{n}v1", "Paper {n} on carbon", _NOON, "S", True, "We  show it.",
    ),
    Answer(
        "biorxiv", "A",
        '{"messages":[{"status":"ok","count":1}],"collection":[{"doi":"10.1101/2024.03.05.{n}","title":"Soil {n}","authors":"A, B.","date":"2024-03-05",'
        '"version":"1","category":"ecology","abstract":"Soils matter.","server":"biorxiv"}]}',
        "https://doi.org/10.1101/2024.03.05.{n}", "Soil {n}", _DAY, "A", False, "Soils matter.",
    ),
    Answer(
        "medrxiv", "A",
        '{"messages":[],"collection":[{"doi":"10.1101/2024.01.{n}","title":" Trial {n} ","date":"2024-03-05","abstract":"A trial."},{"doi":"","title":"no link"}]}',
        "https://doi.org/10.1101/2024.01.{n}", "Trial {n}", _DAY, "A", False, "A trial.",
    ),
    Answer(
        "semanticscholar", "A",
        '{"total":1,"offset":0,"data":[{"paperId":"p{n}","title":"Graph {n}","abstract":null,"year":2024,"publicationDate":null,'
        '"openAccessPdf":{"url":"https://www.biorxiv.org/content/{n}.pdf","status":"GREEN"},"externalIds":{"DOI":"10.1/x"}}]}',
        "https://www.biorxiv.org/content/{n}.pdf", "Graph {n}", _YEAR, "S", False, "",
    ),
    Answer(
        "pubmed", "A",
        '{"header":{"type":"esummary"},"result":{"uids":["{n}"],"{n}":{"uid":"{n}","pubdate":"05 Mar 2024","title":"Care {n}","source":"BMJ"}}}',
        "https://pubmed.ncbi.nlm.nih.gov/{n}/", "Care {n}", _DAY, "S", True, "",
    ),
    Answer(
        "europepmc", "A",
        '{"hitCount":1,"resultList":{"result":[{"id":"{n}","pmid":"{n}","pmcid":"PMC{n}","doi":"10.2/y","title":"Cell {n}","firstPublicationDate":"2024-03-05"}]}}',
        "https://europepmc.org/article/PMC/PMC{n}", "Cell {n}", _DAY, "A", True, "",
    ),
    Answer(
        "core", "A",
        '{"totalHits":1,"results":[{"id":{n},"title":"Thesis {n}","downloadUrl":"https://core.ac.uk/download/{n}.pdf","doi":null,"publishedDate":"2024-03-05T06:07:08",'
        '"abstract":"Long."}]}',
        "https://core.ac.uk/download/{n}.pdf", "Thesis {n}", _NOON, "A", False, "Long.",
    ),
    Answer(
        "ssrn", "A",
        "<rss version='2.0'><channel><title>SSRN</title><item><title>Working paper {n}</title><link>https://papers.ssrn.com/sol3/papers.cfm?abstract_id={n}</link>"
        "<pubDate>Tue, 05 Mar 2024 06:07:08 GMT</pubDate><description>On costs</description></item></channel></rss>",
        "https://papers.ssrn.com/sol3/papers.cfm?abstract_id={n}", "Working paper {n}", _NOON, "A", True, "On costs",
    ),
    Answer(
        "philpapers", "A",
        '{"entries":[{"id":"P{n}","title":"Ethics {n}","link":"https://philpapers.org/rec/P{n}","year":2024}]}',
        "https://philpapers.org/rec/P{n}", "Ethics {n}", _YEAR, "A", True, "",
    ),
    Answer(
        "ieee", "A",
        '{"total_records":1,"articles":[{"article_number":"{n}","title":"Grid {n}","html_url":"https://ieeexplore.ieee.org/document/{n}/",'
        '"pdf_url":"https://ieeexplore.ieee.org/stamp/{n}","publication_date":"2024","abstract":"Power."}]}',
        "https://ieeexplore.ieee.org/document/{n}/", "Grid {n}", _YEAR, "A", True, "Power.",
    ),
    Answer(
        "acm", "A",
        '{"meta":{"count":1},"results":[{"id":"https://openalex.org/W{n}","title":"Code {n}","doi":"10.1145/{n}","publication_date":"2024-03-05",'
        '"open_access":{"is_oa":true,"oa_url":"https://uni.edu/{n}.pdf"}}]}',
        "https://uni.edu/{n}.pdf", "Code {n}", _DAY, "A", False, "",
    ),
    Answer(
        "base", "A",
        '{"responseHeader":{"status":0},"response":{"numFound":1,"docs":[{"dcidentifier":["https://repo.example/{n}"],"dctitle":"Archive {n}","dcdate":"2024-03-05"}]}}',
        "https://repo.example/{n}", "Archive {n}", _DAY, "C", False, "",
    ),
    Answer(
        "chemrxiv", "A",
        '{"itemHits":[{"item":{"id":"c{n}","doi":"10.26434/chemrxiv-{n}","title":"Acid {n}","statusDate":"2024-03-05T06:07:08.000Z","abstract":"Acids."}}],"totalCount":1}',
        "https://doi.org/10.26434/chemrxiv-{n}", "Acid {n}", _NOON, "A", False, "Acids.",
    ),
    Answer(
        "engrxiv", "A",
        '{"data":[{"id":"e{n}","type":"preprints","attributes":{"title":"Bridge {n}","description":"On bridges.","date_created":"2024-03-05T06:07:08.123456",'
        '"preprint_doi_created":null}}],"links":{}}',
        "https://osf.io/e{n}/", "Bridge {n}", "2024-03-05T06:07:08.123456", "A", False, "On bridges.",
    ),
    Answer(
        "eurlex", "B",
        "<rss version='2.0'><channel><item><title>Directive {n}</title><link>https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:{n}</link>"
        "<pubDate>Tue, 05 Mar 2024 06:07:08 +0000</pubDate><description>OJ L</description></item></channel></rss>",
        "https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:{n}", "Directive {n}", _NOON, "S", True, "OJ L",
    ),
    Answer(
        "curia", "B",
        "<rss version='2.0'><channel><item><title>Case C-{n}/24</title><link>https://curia.europa.eu/juris/liste.jsf?num=C-{n}</link><pubDate>2024-03-05</pubDate>"
        "</item></channel></rss>",
        "https://curia.europa.eu/juris/liste.jsf?num=C-{n}", "Case C-{n}/24", _DAY, "S", True, "",
    ),
    Answer(
        "federalregister", "B",
        '{"count":1,"results":[{"title":"Rule {n}","type":"Rule","abstract":"A rule.","document_number":"{n}","html_url":"https://www.federalregister.gov/documents/{n}",'
        '"publication_date":"2024-03-05","agencies":[{"name":"SEC"}]}]}',
        "https://www.federalregister.gov/documents/{n}", "Rule {n}", _DAY, "S", True, "A rule.",
    ),
    Answer(
        "secedgar", "B",
        '{"took":5,"hits":{"total":{"value":1},"hits":[{"_index":"edgar","_id":"0001-{n}:f.htm","_source":{"file_date":"2024-03-05","display_names":[{"name":"ACME {n}"}]}}]}}',
        "https://www.sec.gov/Archives/edgar/full-index/0001-{n}:f.htm", "ACME {n} SEC Filing", _DAY, "S", True, "",
    ),
    Answer(
        "esma", "B",
        '{"results":[{"name":"Guideline {n}","link":"https://www.esma.europa.eu/document/{n}","publication_date":"2024/03/05","summary":"Guides."}]}',
        "https://www.esma.europa.eu/document/{n}", "Guideline {n}", _DAY, "A", True, "Guides.",
    ),
    Answer(
        "eba", "B",
        "<rss version='2.0'><channel><item><title>Standard {n}</title><link>https://www.eba.europa.eu/publications/{n}</link>"
        "<pubDate>Tue, 05 Mar 2024 06:07:08 GMT</pubDate><description>Banks</description></item></channel></rss>",
        "https://www.eba.europa.eu/publications/{n}", "Standard {n}", _NOON, "A", True, "Banks",
    ),
    Answer(
        "oecd", "B",
        '{"items":[{"title":"Outlook {n}","url":null,"link":null,"doi":"10.1787/{n}-en","publicationDate":"2024-03-05","description":"Growth."}]}',
        "https://doi.org/10.1787/{n}-en", "Outlook {n}", _DAY, "A", False, "Growth.",
    ),
    Answer(
        "wto", "B",
        "<rss version='2.0'><channel><item><title>Dispute DS{n}</title><link>https://www.wto.org/english/news_e/{n}.htm</link><pubDate>05 Mar 2024</pubDate>"
        "<description>Trade</description></item></channel></rss>",
        "https://www.wto.org/english/news_e/{n}.htm", "Dispute DS{n}", _DAY, "A", True, "Trade",
    ),
    Answer(
        "wipo", "B",
        '{"resultsList":{"wipo:PCT":[{"wipo:internationalApplicationNumber":"PCT/EP2024/{n}","wipo:inventionTitle":"Valve {n}","wipo:internationalFilingDate":"2024-03-05"}]}}',
        "https://patentscope.wipo.int/search/en/detail.jsf?docId=PCT/EP2024/{n}", "Valve {n}", _DAY, "S", True, "",
    ),
    Answer(
        "epo", "B",
        '{"ops:world-patent-data":{"ops:biblio-search":{"@total-result-count":"1","ops:search-result":{"ops:publication-reference":[{"document-id":'
        '{"@document-id-type":"docdb","country":{"$":"EP"},"doc-number":{"$":"{n}"},"kind":{"$":"B1"}}}]}}}}',
        "https://worldwide.espacenet.com/patent/search?q=EP{n}B1", "Patent EP{n}B1", "", "A", True, "",
    ),
    Answer(
        "imf", "C",
        '{"docs":[{"title":"Staff note {n}","url":"https://www.imf.org/en/Publications/{n}","pubDate":"Tue, 05 Mar 2024 06:07:08 GMT","abstract":"Debt."}]}',
        "https://www.imf.org/en/Publications/{n}", "Staff note {n}", _NOON, "S", True, "Debt.",
    ),
    Answer(
        "worldbank", "C",
        '{"rows":1,"total":1,"documents":{"D{n}":{"id":"{n}","display_title":"Project {n}","pdfurl":"https://documents.worldbank.org/{n}.pdf","docdt":"2024-03-05T06:07:08Z",'
        '"abstracts":"Roads."}}}',
        "https://documents.worldbank.org/{n}.pdf", "Project {n}", _NOON, "A", True, "Roads.",
    ),
    Answer(
        "fred", "C",
        '{"count":1,"seriess":[{"id":"S{n}","title":"Series {n}","frequency":"Monthly","last_updated":"soon","observation_end":"2024-03-05","notes":"Index."}]}',
        "https://fred.stlouisfed.org/series/S{n}", "Series {n}", "soon", "S", True, "Index.",
    ),
    Answer(
        "ecb", "C",
        "<rss version='2.0'><channel><item><title>Speech {n}</title><link>https://www.ecb.europa.eu/press/key/{n}.en.html</link>"
        "<pubDate>Tue, 05 Mar 2024 07:07:08 +0100</pubDate></item></channel></rss>",
        "https://www.ecb.europa.eu/press/key/{n}.en.html", "Speech {n}", "2024-03-05T07:07:08+01:00", "S", True, "",
    ),
    Answer(
        "bis", "C",
        "<rss version='2.0'><channel><item><title>Paper no {n}</title><link>https://www.bis.org/publ/work{n}.htm</link><pubDate>2024-03-05T06:07:08Z</pubDate>"
        "<description>Rates</description></item></channel></rss>",
        "https://www.bis.org/publ/work{n}.htm", "Paper no {n}", _NOON, "A", True, "Rates",
    ),
    Answer(
        "eurostat", "C",
        "<rss version='2.0'><channel><item><title>Table {n}</title><link>https://ec.europa.eu/eurostat/product?code={n}</link><pubDate>2024-03-05</pubDate>"
        "<description>Energy</description></item></channel></rss>",
        "https://ec.europa.eu/eurostat/product?code={n}", "Table {n}", _DAY, "S", True, "Energy",
    ),
    Answer(
        "undl", "C",
        "<rss version='2.0'><channel><item><title>Resolution {n}</title><link>https://digitallibrary.un.org/record/{n}</link>"
        "<pubDate>Tue, 05 Mar 2024 06:07:08 GMT</pubDate><description>GA</description></item></channel></rss>",
        "https://digitallibrary.un.org/record/{n}", "Resolution {n}", _NOON, "A", True, "GA",
    ),
    Answer(
        "irena", "C",
        '{"results":[{"title":"Solar {n}","pdfUrl":"https://www.irena.org/{n}.pdf","year":2024,"abstract":"Sun."}]}',
        "https://www.irena.org/{n}.pdf", "Solar {n}", _YEAR, "A", True, "Sun.",
    ),
    Answer(
        "owid", "C",
        '{"hits":[{"objectID":"{n}","slug":"chart-{n}","title":"Chart {n}","publishedAt":"2024-03-05T06:07:08.000Z","excerpt":"CO2."}],"nbHits":1}',
        "https://ourworldindata.org/chart-{n}", "Chart {n}", _NOON, "A", True, "CO2.",
    ),
    Answer(
        "hdx", "C",
        '{"success":true,"result":{"count":1,"results":[{"name":"data-{n}","title":"Relief {n}","metadata_modified":"2024-03-05T06:07:08.5","notes":"Camps."}]}}',
        "https://data.humdata.org/dataset/data-{n}", "Relief {n}", "2024-03-05T06:07:08.5", "A", True, "Camps.",
    ),
    Answer(
        "github", "D",
        '{"total_count":1,"incomplete_results":false,"items":[{"id":{n},"full_name":"acme/tool-{n}","html_url":"https://github.com/acme/tool-{n}",'
        '"description":null,"pushed_at":"2024-03-05T06:07:08Z"}]}',
        "https://github.com/acme/tool-{n}", "acme/tool-{n}", _NOON, "B", True, "",
    ),
    Answer(
        "reddit", "D",
        '{"kind":"Listing","data":{"after":null,"children":[{"kind":"t3","data":{"title":"Ask {n}","url":"https://www.reddit.com/r/esg/comments/{n}/",'
        '"permalink":"/r/esg/comments/{n}/","created_utc":1709618828.0,"selftext":"","link_flair_text":"Question"}}]}}',
        "https://www.reddit.com/r/esg/comments/{n}/", "Ask {n}", _NOON, "C", True, "Question",
    ),
    Answer(
        "stackexchange", "D",
        '{"items":[{"question_id":{n},"title":"How {n}?","link":"https://stackoverflow.com/questions/{n}/how","creation_date":1709618828,"score":3}],"has_more":false}',
        "https://stackoverflow.com/questions/{n}/how", "How {n}?", _NOON, "B", True, "",
    ),
    Answer(
        "producthunt", "D",
        '{"data":{"posts":{"edges":[{"node":{"id":"{n}","name":"App {n}","tagline":"Do it","url":"https://www.producthunt.com/posts/app-{n}","createdAt":"2024-03-05T06:07:08Z"}}]}}}',
        "https://www.producthunt.com/posts/app-{n}", "App {n}", _NOON, "C", True, "Do it",
    ),
    Answer(
        "paperswithcode", "D",
        '{"count":1,"results":[{"id":"m-{n}","arxiv_id":"2403.{n}","url_abs":"https://arxiv.org/abs/2403.{n}v2","title":"Model {n}","abstract":"Nets.","published":"2024-03-05"}]}',
        "https://arxiv.org/abs/2403.{n}", "Model {n}", _DAY, "B", True, "Nets.",
    ),
    Answer(
        "mastodon", "D",
        '{"accounts":[],"statuses":[{"id":"{n}","created_at":"2024-03-05T06:07:08.000Z","url":"https://mastodon.social/@ann/{n}","content":"<p>new <b>rule</b> {n}</p>",'
        '"account":{"username":"ann","display_name":"Ann"}}],"hashtags":[]}',
        "https://mastodon.social/@ann/{n}", "[Ann] new rule {n}", _NOON, "C", True, "<p>new <b>rule</b> {n}</p>",
    ),
    Answer(
        "youtube", "E",
        '{"kind":"youtube#searchListResponse","items":[{"id":{"kind":"youtube#video","videoId":"v{n}"},"snippet":{"publishedAt":"2024-03-05T06:07:08Z","title":"Talk {n}",'
        '"description":"Live"}}]}',
        "https://www.youtube.com/watch?v=v{n}", "Talk {n}", _NOON, "B", True, "Live",
    ),
    Answer(
        "podcastindex", "E",
        '{"status":"true","feeds":[{"id":{n},"title":"Cast {n}","url":"https://pod.example/{n}/feed.xml","link":"https://pod.example/{n}","description":"Weekly",'
        '"newestItemPublishTime":1709618828}],"count":1}',
        "https://pod.example/{n}/feed.xml", "Cast {n}", _NOON, "C", True, "Weekly",
    ),
    Answer(
        "ted", "E",
        "<rss version='2.0'><channel><item><title>Idea {n}</title><link>https://www.ted.com/talks/{n}</link><pubDate>Tue, 05 Mar 2024 06:07:08 +0000</pubDate>"
        "<description>Worth it</description></item></channel></rss>",
        "https://www.ted.com/talks/{n}", "Idea {n}", _NOON, "B", True, "Worth it",
    ),
    Answer(
        "archive", "E",
        '{"response":{"numFound":1,"docs":[{"identifier":"reel_{n}","title":["Reel {n}"],"date":"2024-03-05T06:07:08Z","description":["Old film"]}]}}',
        "https://archive.org/details/reel_{n}", "Reel {n}", _NOON, "B", True, "Old film",
    ),
    Answer(
        "jstor", "E",
        '{"results":[{"stableUrl":"https://www.jstor.org/stable/{n}","title":"Essay {n}","pubYear":"2024","snippet":"History."}]}',
        "https://www.jstor.org/stable/{n}", "Essay {n}", _YEAR, "A", True, "History.",
    ),
    Answer(
        "europeana", "E",
        '{"success":true,"items":[{"id":"/9/{n}","guid":"https://www.europeana.eu/item/9/{n}","title":["Map {n}"],"year":["2024"],"dcDescription":["Paper"]}]}',
        "https://www.europeana.eu/item/9/{n}", "Map {n}", _YEAR, "B", True, "Paper",
    ),
)
