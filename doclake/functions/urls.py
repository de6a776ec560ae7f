"""URLs of documents: which document a URL names, taken apart by scheme, host and path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A URL within text, up to white space, quotes or brackets.
URL = r"https?://[^\s\"'<>()\[\]]+"
#: Hosts of pages, domains of documents, and the first path segments under which documents stand.
PAGE_HOSTS = ("notion.so", "www.notion.so", "app.notion.com")
DOC_DOMAINS = ("feishu.cn", "feishu.net", "larksuite.com")
SURFACES = ("docx", "docs", "wiki", "sheets", "base", "bitable", "file", "minutes", "slides", "mindnotes")
#: Hosts whose images are to be fetched.
ASSET_HOST_PARTS = ("amazonaws.com", "secure.notion-static.com", "prod-files-secure")
ASSET_HOST_END = "file.notion.so"


def host_of(url: Column) -> Column:
    return F.lower(F.get(F.split(F.substring_index(url, "://", -1), "[/?#]", 2), F.lit(0)))


def path_of(url: Column) -> Column:
    """The path without the slash before it, without query and fragment; '' for none."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://", ""), r"[?#].*$", "")
    return F.coalesce(F.get(F.split(bare, "/", 2), F.lit(1)), F.lit(""))


def doc_token(url: Column, page_hosts: Iterable[str] = PAGE_HOSTS, doc_domains: Iterable[str] = DOC_DOMAINS) -> Column:
    """The token of the document that a URL names, null when it names none.

    On a page host it is the 32 hex digits that follow the last hyphen of the first segment (after ``p/``), in lower case;
    on a document domain or under it, the letters and digits of the segment after a surface.
    """
    host, segments = host_of(url), F.split(path_of(url), "/")
    first, second = F.get(segments, F.lit(0)), F.get(segments, F.lit(1))
    last = F.left(F.substring_index(F.when(first == "p", second).otherwise(first), "-", -1), F.lit(32))
    page = F.when(host.isin(*page_hosts) & last.rlike("^[0-9A-Fa-f]{32}$"), F.lower(last))
    under = F.lit(False)
    for d in doc_domains:
        under = under | (host == d) | host.endswith(f".{d}")
    word = F.regexp_extract(second, "^[A-Za-z0-9]+", 0)
    return F.coalesce(page, F.when(under & first.isin(*SURFACES) & (word != ""), word))


def is_asset(url: Column) -> Column:
    """Whether a URL is on a host whose files are fetched."""
    host, hit = host_of(url), F.lit(False)
    for part in ASSET_HOST_PARTS:
        hit = hit | host.contains(part)
    return hit | host.endswith(ASSET_HOST_END)


def urls(body: Column) -> Column:
    """The URLs of a body, in order, each as often as it stands."""
    return F.regexp_extract_all(body, F.lit(URL), F.lit(0))


def put_together(body: Column, pattern: str, found: Column, instead: Column) -> Column:
    """``body`` with the n-th match of ``pattern`` (``found``) replaced by ``instead[n]``, kept where that is null."""
    between = F.split(body, pattern, -1)
    return F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(instead, i), F.get(found, i), F.lit("")))), "")
