"""Markup in document bodies: images, links, tags, regions that aren't prose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from doclake.functions.ids import canonical_id
from doclake.functions.urls import DOC_DOMAINS, doc_token

#: A Markdown image: its description, which may hold bracketed text once; the target; a title that isn't kept.
_LABEL = r"(?:[^\[\]]|\[[^\[\]]*\])*"
IMAGE = r"!\[(" + _LABEL + r")\]\([ \t]*<?([^\s<>()]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'))?[ \t]*\)"
TAG = r"<([A-Za-z][A-Za-z0-9_-]*)"
#: Tags that are known not to be a loss, of all platforms and of one only.
_HTML = (
    "a", "p", "div", "span", "br", "hr", "b", "i", "u", "s", "strong", "em", "code", "pre", "blockquote", "mark", "del", "ins", "sub", "sup",
    "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody", "tr", "td", "th", "colgroup", "col", "img",
)
KNOWN_TAGS = (*_HTML, "page", "database", "synced_block", "empty-block", "column", "columns", "column_list", "callout", "toggle", "table_row")
FEISHU_TAGS = (*_HTML, "callout", "sheet", "base_refer", "bitable", "whiteboard", "title", "iframe")


def images(body: Column) -> Column:
    """The targets of Markdown images, in order."""
    return F.regexp_extract_all(body, F.lit(IMAGE), F.lit(2))


def asset_key(url: Column) -> Column:
    """What names an asset: its URL without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


_TAG_OF = r"<{0}(?:[\s/][^>]*)?>"


def tags_of(body: Column, name: str) -> Column:
    """The opening tags of one name, whole, in order."""
    return F.regexp_extract_all(body, F.lit(_TAG_OF.format(name)), F.lit(0))


def first_of(rows: Column, key: str) -> Column:
    """The members of an array of structs whose ``key`` is neither null, empty nor that of a member before."""
    keys = F.transform(rows, lambda r: r[key])
    return F.filter(rows, lambda r, i: r[key].isNotNull() & (r[key] != "") & (F.array_position(keys, r[key]) == i + 1))


def page_links(body: Column) -> Column:
    """(target, url) of what a page body refers to: pages by the id in their URL, databases by the id of their data source;
    each target once, in order of kind and first sight."""
    url = lambda tag: attributes(tag)["url"]
    pages = F.transform(tags_of(body, "page"), lambda t: F.struct(canonical_id(F.nullif(F.regexp_extract(url(t), "([0-9a-fA-F]{32})", 1), F.lit(""))).alias("target"), url(t).alias("url")))
    source = lambda tag: F.regexp_extract(attributes(tag)["data-source-url"], "^collection://([0-9a-fA-F-]{32,36})", 1)
    databases = F.transform(tags_of(body, "database"), lambda t: F.struct(canonical_id(source(t)).alias("target"), url(t).alias("url")))
    return first_of(F.concat(pages, databases), "target")


def entities_undone(c: Column) -> Column:
    """The five predefined entities as characters; the ampersand's last, so that nothing is undone twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def href_links(body: Column, doc_domains=DOC_DOMAINS) -> Column:
    """(target, url) of the document URLs that ``href`` attributes hold, each target once, in order of first sight."""
    found = F.regexp_extract_all(body, F.lit(r"href=\"([^\"]*)\""), F.lit(1))
    return first_of(F.transform(found, lambda u: F.struct(doc_token(entities_undone(u), (), doc_domains).alias("target"), entities_undone(u).alias("url"))), "target")


def xml_images(body: Column) -> Column:
    """(src, href, name) of the images of an XML body, in order; null where an attribute is missing."""
    return F.transform(tags_of(body, "img"), lambda t: F.struct(attributes(t)["src"].alias("src"), entities_undone(attributes(t)["href"]).alias("href"), attributes(t)["name"].alias("name")))


def whiteboard_tokens(body: Column) -> Column:
    return F.filter(F.transform(tags_of(body, "whiteboard"), lambda t: attributes(t)["token"]), lambda t: t.isNotNull())


def matched_images(markdown: Column, xml: Column) -> Column:
    """(key, url, body_url, name): the n-th Markdown image is the n-th XML image; surplus ones of either are left out, as are
    those without a token."""
    pairs = F.zip_with(images(markdown), xml_images(xml), lambda m, x: F.struct(x["src"].alias("key"), x["href"].alias("url"), entities_undone(m).alias("body_url"), x["name"].alias("name")))
    return F.filter(F.slice(pairs, 1, F.least(F.size(images(markdown)), F.size(xml_images(xml)))), lambda p: p["key"].isNotNull() & (p["key"] != ""))


def attributes(tag: Column) -> Column:
    """name -> value of a tag's double-quoted attributes; of a repeated name the last holds."""
    names = F.regexp_extract_all(tag, F.lit(r"([A-Za-z_:][-A-Za-z0-9_:.]*)=\"([^\"]*)\""), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(r"([A-Za-z_:][-A-Za-z0-9_:.]*)=\"([^\"]*)\""), F.lit(2))
    last = F.filter(F.transform(names, lambda x, i: F.struct(x.alias("k"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.size(names)), e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], F.element_at(values, e["i"] + 1))))


_TICK, _LINE = re.compile("`|\n"), re.compile(r"[^\n]+")


def _blanked(s: str, spans: list[tuple[int, int]]) -> str:
    if not spans:
        return s
    parts, at = [], 0
    for a, b in spans:
        parts += [s[at:a], _LINE.sub(lambda m: " " * len(m[0]), s[a:b])]
        at = b
    return "".join([*parts, s[at:]])


def mask_text(s: str | None) -> str | None:
    """The text with code blocks, inline code and comments blanked out, lengths and line ends kept.

    A fence without its end, an inline tick before the line's end and a comment that isn't closed mask nothing.
    """
    if s is None:
        return None
    spans, opened, at = [], None, 0
    for line in s.split("\n"):
        end = at + len(line)
        if line.strip().startswith("```"):
            if opened is None:
                opened = at
            else:
                spans.append((opened, end))
                opened = None
        at = end + 1
    s = _blanked(s, spans)
    spans, tick = [], None
    for m in _TICK.finditer(s):
        if m[0] == "\n":
            tick = None
        elif tick is None:
            tick = m.start()
        else:
            spans.append((tick + 1, m.start()))
            tick = None
    s = _blanked(s, spans)
    spans, at = [], 0
    while (a := s.find("<!--", at)) >= 0 and (b := s.find("-->", a)) >= 0:
        spans.append((a, b + 3))
        at = b + 3
    return _blanked(s, spans)


@pandas_udf(T.StringType())
def mask_regions(s: pd.Series) -> pd.Series:
    return s.map(mask_text, na_action="ignore")


def unknown_tags(masked: Column, known: tuple[str, ...] = KNOWN_TAGS) -> Column:
    """The names of opening tags outside masked regions that aren't known, in order and with repeats."""
    found = F.transform(F.regexp_extract_all(masked, F.lit(TAG), F.lit(1)), lambda t: F.lower(t))
    return F.filter(found, lambda t: ~t.isin(*known))


def loss_markers(body: Column, truncated: Column, unknown_ids: Column) -> Column:
    """``body`` after the markers of what was lost on the way."""
    cut = F.when(truncated, F.lit("<!-- doclake:truncated -->"))
    n = F.size(unknown_ids)
    blocks = F.when(n > 0, F.concat(F.lit('<!-- doclake:unknown-blocks n="'), n.cast("string"), F.lit('" ids="'), F.array_join(unknown_ids, ","), F.lit('" -->')))
    head = F.concat_ws("\n", cut, blocks)
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n"), body))


def pending_marker(body: Column, url: Column, marker: str = "<!-- doclake:pending -->") -> Column:
    """``body`` with a marker after each image of ``url`` that has none yet."""
    image = F.concat(F.lit("]("), url, F.lit(")"))
    plain = F.replace(body, F.concat(image, F.lit(marker)), image)
    return F.replace(plain, image, F.concat(image, F.lit(marker)))


def swap_destination(body: Column, old: Column, new: Column) -> Column:
    """``body`` with link targets ``old`` (bare or in angle brackets) replaced by ``new``, each in its own form."""
    for a, z in (("](", ")"), ("](<", ">)")):
        body = F.replace(body, F.concat(F.lit(a), old, F.lit(z)), F.concat(F.lit(a), new, F.lit(z)))
    return body


def annotate_fences(body: Column, tokens: Column, language: str = "mermaid") -> Column:
    """``body`` with the i-th token noted before the i-th fence of ``language``; surplus fences and tokens stay alone."""
    parts = F.split(body, f"(?m)^```{language}")
    fence = f"```{language}"
    rest = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda x, i: F.concat(F.when(i < F.size(tokens), F.concat(F.lit("<!-- doclake:board "), F.get(tokens, i), F.lit(" -->\n"))).otherwise(""), F.lit(fence), x),
    )
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


#: Kinds of documents that have a text of their own.
TEXT_TYPES = ("docx", "page", "db_row")


def selected_body(type_: Column, body: Column, markdown: Column, id_: Column, url: Column) -> Column:
    """The body that is written: of kinds with text what was fetched (``body``, or ``markdown`` when that is empty), else a note
    with the id and, where it is known, the URL."""
    note = F.concat(
        F.lit("> Standalone resource node ("), type_, F.lit("): this content is not expanded in the mirror; drill down or open the original online to view it.\n>\n> Drill-down token: `"), id_, F.lit("`"),
        F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("\n>\n> View online: "), url)).otherwise(""),
    )
    return F.when(type_.isin(*TEXT_TYPES), F.coalesce(F.nullif(body, F.lit("")), markdown, F.lit(""))).otherwise(note)


#: An embedded table: its opening tag and the closing one if that follows at once.
EMBEDDED = r"<(?:base_refer|bitable)(?:[\s/][^>]*)?>(?:\s*</(?:base_refer|bitable)>)?"


def online_table(url: Column, token: Column, table_id: Column, view_id: Column) -> Column:
    """A link to a table on the host of the document at ``url``, '' when that or the table isn't known."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), F.url_encode(c)))
    base = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    link = F.concat_ws("?", F.concat(base, F.lit("/base/"), token), F.nullif(F.concat_ws("&", part("table", table_id), part("view", view_id)), F.lit("")))
    return F.when((F.coalesce(base, F.lit("")) != "") & (F.coalesce(token, F.lit("")) != ""), F.concat(F.lit("[Open the bitable in Feishu]("), link, F.lit(")"))).otherwise("")


def table_note(attrs: Column) -> Column:
    """The comment that keeps what names an embedded table, in fixed order."""
    said = F.concat_ws(" ", *(F.when(F.coalesce(attrs[k], F.lit("")) != "", F.concat(F.lit(f'{k}="'), F.replace(F.replace(attrs[k], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))) for k in ("table-id", "token", "view-id")))
    return F.concat(F.lit("<!-- doclake:base_refer "), said, F.lit(" -->"))
