"""Column builders over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "source", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "session_id")
# Domains by trust tier.
TIER_S = ("arxiv.org", "export.arxiv.org", "eur-lex.europa.eu", "ec.europa.eu", "publications.europa.eu", "pubmed.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov", "sec.gov", "wipo.int", "who.int", "imf.org", "federalregister.gov", "biorxiv.org", "medrxiv.org", "semanticscholar.org", "api.semanticscholar.org")
TIER_A = ("openalex.org", "api.openalex.org", "europepmc.org", "core.ac.uk", "ieee.org", "ieeexplore.ieee.org", "ssrn.com", "philpapers.org", "worldbank.org", "data.worldbank.org", "oecd.org", "oecd-ilibrary.org")
TIER_B = ("reuters.com", "ft.com", "bloomberg.com", "nature.com", "science.org", "bbc.com", "bbc.co.uk", "news.ycombinator.com", "hn.algolia.com", "github.com", "paperswithcode.com")
# Formats by the first pattern in the URL.
FORMATS = ((".pdf", "pdf"), (".docx", "docx"), (".xlsx", "xlsx"), (".pptx", "pptx"), ("/pdf/", "pdf"), ("youtube.com/watch", "video"), ("youtu.be/", "video"), (".mp3", "audio"), (".mp4", "video"), (".srt", "srt"), (".csv", "csv"), (".json", "json"))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(_host(url), r"^www\.", "")


def normalise(url: Column) -> Column:
    """Lower-cased scheme and host without any leading w and dots, no fragment, no path parameters, no tracking parameters, the others
    sorted, no final slash."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), ";[^/]*$", ""), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~F.split(p, "=").getItem(0).isin(*TRACKING))), "&")
    bare = F.regexp_replace(_host(url), r"^[w.]+", "")
    return F.when(scheme == "", F.lower(F.trim(url))).otherwise(F.concat(scheme, F.lit("://"), bare, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fingerprint(url: Column) -> Column:
    """First 8 bytes of the normalised URL's SHA-256, as 16 hexadecimal digits."""
    return F.substring(F.sha2(normalise(url), 256), 1, 16)


def _under(h: Column, domains) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | F.endswith(h, F.lit("." + d))
    return out


def tier(url: Column) -> Column:
    h = host(url)
    return F.when(_under(h, TIER_S), "S").when(_under(h, TIER_A) | h.rlike(r"\.(edu|gov|ac\.uk)$"), "A").when(_under(h, TIER_B), "B").otherwise("C")


def file_format(url: Column) -> Column:
    low = F.lower(url)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(f)) for p, f in FORMATS], F.lit("html"))
