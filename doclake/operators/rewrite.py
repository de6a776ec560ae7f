"""Bodies with their document URLs turned into relative paths, and what files hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.text import relative_path, split_front_matter
from doclake.functions.urls import DOC_DOMAINS, PAGE_HOSTS, doc_token, put_together, urls, URL
from doclake.operators.links import resolve

#: The target of a Markdown link, bare or in angle brackets, with what is around it.
_DESTINATION = r"\]\((?:<[^<>\n]*>|(?:[^()<>\n]|\([^()<>\n]*\))*)\)"


def url_tokens(body: Column, page_hosts=PAGE_HOSTS, doc_domains=DOC_DOMAINS) -> Column:
    """(pos, url, token) of the document URLs of a body, in order, each as often as it stands."""
    each = F.transform(urls(body), lambda u, i: F.struct(i.alias("pos"), u.alias("url"), doc_token(u, page_hosts, doc_domains).alias("token")))
    return F.filter(each, lambda u: u["token"].isNotNull())


def rewrite_bodies(bodies: DataFrame, docs: DataFrame, aliases: DataFrame, page_hosts=PAGE_HOSTS, doc_domains=DOC_DOMAINS) -> DataFrame:
    """``bodies`` (id, path, body; one row per id) with ``body`` rewritten and ``rewritten``, the number of URLs replaced.

    A URL whose token resolves to an active document with a path becomes the relative path there; others stay, also those
    that begin with such a URL. The body is taken apart at its URLs and put together again, so nothing is searched for
    twice; front matter is left alone. Only URLs are moved to be resolved. Null bodies stay null with 0.
    """
    head, rest = split_front_matter(F.col("body"))
    parts = bodies.select("id", "path", F.col("body").alias("_all"), head.alias("_head"), rest.alias("_rest"))
    found = parts.select("id", F.col("path").alias("from_path"), F.explode(url_tokens(F.col("_rest"), page_hosts, doc_domains)).alias("u")).select("id", "from_path", "u.pos", "u.token")
    hits = resolve(found, docs, aliases, "token").where("path IS NOT NULL")
    swaps = hits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", relative_path(F.col("from_path"), F.col("path"))))).alias("_swaps"))
    j = parts.join(swaps, "id", "left")
    here = urls(F.col("_rest"))
    instead = F.transform(here, lambda u, i: F.col("_swaps")[i])
    done = F.when(F.col("_swaps").isNull(), F.col("_all")).otherwise(F.concat("_head", put_together(F.col("_rest"), URL, here, instead)))
    return j.select("id", "path", done.alias("body"), F.coalesce(F.size("_swaps"), F.lit(0)).alias("rewritten"))


def moved_bodies(bodies: DataFrame, links: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``bodies`` (id, body; one row per id) after moves, with ``applied``: relative links between documents follow them.

    ``links``: from_id, to_id, resolved. ``before``, ``after``: id, path of the active documents. A link is looked at when one
    of its ends has another path than before and both had and have one; its old target, bare or in angle brackets, gives way
    to the new one in the same form. Every target is looked up once, so a new target isn't taken for another's old one. Of
    two old targets that are written alike the one of the lesser document holds. Bodies come out whether or not they change.
    """
    end = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("path").alias(f"{name}_path"))
    paths = end(before, "old").join(end(after, "new"), F.col("old_id") == F.col("new_id")).where("old_path IS NOT NULL AND new_path IS NOT NULL")
    of = lambda name: paths.select(F.col("old_id").alias(f"{name}_id"), F.col("old_path").alias(f"{name}_old"), F.col("new_path").alias(f"{name}_new"))
    both = links.select("from_id", "to_id").distinct().join(of("from"), "from_id").join(of("to"), "to_id").where("from_old <> from_new OR to_old <> to_new")
    swaps = both.select("from_id", "to_id", relative_path(F.col("from_old"), F.col("to_old")).alias("was"), relative_path(F.col("from_new"), F.col("to_new")).alias("now")).where("was <> now")
    one = swaps.groupBy("from_id", "was").agg(F.min_by("now", "to_id").alias("now"))
    per = one.groupBy(F.col("from_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("was", "now"))).alias("_swaps"))
    head, rest = split_front_matter(F.col("body"))
    j = bodies.select("id", "body", head.alias("_head"), rest.alias("_rest")).join(per, "id", "left")
    found = F.regexp_extract_all("_rest", F.lit(_DESTINATION), F.lit(0))

    def follow(m: Column) -> Column:
        angled = F.startswith(m, F.lit("](<"))
        target = F.when(angled, F.substring(m, 4, F.length(m) - 5)).otherwise(F.substring(m, 3, F.length(m) - 3))
        now = F.col("_swaps")[target]
        return F.when(angled, F.concat(F.lit("](<"), now, F.lit(">)"))).otherwise(F.concat(F.lit("]("), now, F.lit(")")))

    instead = F.transform(found, follow)
    applied = F.size(F.filter(instead, lambda x: x.isNotNull()))
    done = F.when(F.col("_swaps").isNull(), F.col("body")).otherwise(F.concat("_head", put_together(F.col("_rest"), _DESTINATION, found, instead)))
    return j.select("id", done.alias("body"), F.when(F.col("_swaps").isNull() | F.col("body").isNull(), 0).otherwise(applied).alias("applied"))


def dirs_left_empty(before: DataFrame, after: DataFrame) -> DataFrame:
    """Directories that hold something of ``before`` and nothing of ``after`` (column ``path``), deepest included."""
    above = lambda df: df.where("path IS NOT NULL").select(F.split("path", "/").alias("s")).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda n: F.when(n < F.size("s"), F.array_join(F.slice("s", 1, n), "/")))).alias("dir")).where("dir IS NOT NULL").distinct()
    return above(before).join(above(after), "dir", "left_anti")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write (path, content) as files under ``root``, a folder all executors share: each to a temporary name, then renamed.
    Returns (path, bytes). Runs where the rows are; a task that is run again writes the same files again."""
    import os

    def run(batches):
        import pandas as pd

        for b in batches:
            sizes = []
            for path, content in zip(b["path"], b["content"], strict=True):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                data = (content or "").encode()
                with open(f"{full}.tmp-{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, full)
                sizes.append(len(data))
            yield pd.DataFrame({"path": b["path"], "bytes": sizes})

    return files.select("path", "content").mapInPandas(run, "path string, bytes bigint")
