"""Indexes as ordered lines: of the library and of each database.

An index of a large library is a large file, so it is given as lines with a key that orders them, to be written by range, not
as one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.text import link_dest, md_cell, relative_path

MAX_COLUMNS = 4


def columns_of(properties: DataFrame, n: int = MAX_COLUMNS) -> DataFrame:
    """(db_id, columns): the first ``n`` property names of each database of ``properties`` (db_id, row_id, key, value)."""
    names = properties.select("db_id", "key").distinct()
    nth = F.row_number().over(Window.partitionBy("db_id").orderBy("key"))
    return names.withColumn("nth", nth).where(F.col("nth") <= n).groupBy("db_id").agg(F.array_sort(F.collect_list("key")).alias("columns"))


def database_lines(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """(db_id, part, title, row_id, line): the index of each database in the order of these columns.

    ``rows``: db_id, index_path, row_id, title, path. Part 0 is the head, part 1 the rows by title, then id. A row without
    title shows its id, one without a file stands in bold.
    """
    cols = columns_of(properties)
    held = properties.join(cols, "db_id").where(F.array_contains("columns", F.col("key"))).groupBy("db_id", "row_id").agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("props"))
    r = rows.join(cols, "db_id", "left").join(held, ["db_id", "row_id"], "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
    text = md_cell(F.coalesce("title", F.lit("")))
    shown = F.when(text == "", md_cell(F.col("row_id"))).otherwise(text)
    first = F.when(F.col("path").isNull(), F.concat(F.lit("**"), shown, F.lit("**"))).otherwise(F.concat(F.lit("["), shown, F.lit("]("), link_dest(relative_path(F.col("index_path"), F.col("path"))), F.lit(")")))
    cells = F.transform("columns", lambda c: F.coalesce(md_cell(F.element_at("props", c)), F.lit("")))
    line = F.concat(F.lit("| "), F.array_join(F.concat(F.array(first), cells), " | "), F.lit(" |"))
    body = r.select("db_id", F.lit(1).alias("part"), F.coalesce("title", F.lit("")).alias("title"), "row_id", line.alias("line"))
    heads = rows.groupBy("db_id").agg(F.count("*").alias("n")).join(cols, "db_id", "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))
    names = F.concat(F.array(F.lit("Title")), F.transform("columns", lambda c: md_cell(c)))
    head = F.concat(
        F.lit("> "), F.col("n").cast("string"), F.lit(" rows total\n\n| "), F.array_join(names, " | "), F.lit(" |\n|"), F.repeat(F.lit("---|"), F.size(names))
    )
    return body.unionByName(heads.select("db_id", F.lit(0).alias("part"), F.lit("").alias("title"), F.lit("").alias("row_id"), head.alias("line")))


def bitable_lines(records: DataFrame, threshold: int = 200) -> DataFrame:
    """(table, part, raw_id, line) of each table of ``records`` (table, raw_id, cells: map of text): a Markdown table, or its
    columns alone when it has more than ``threshold`` records."""
    from doclake.functions.text import bitable_cell

    n = records.groupBy("table").agg(F.count("*").alias("n"))
    fields = records.select("table", F.explode(F.map_keys("cells")).alias("f")).distinct().groupBy("table").agg(F.array_sort(F.collect_list("f")).alias("fields"))
    t = n.join(fields, "table", "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    wrap = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    head = F.when(
        F.col("n") > threshold,
        F.concat(F.lit("Bitable ("), F.col("n").cast("string"), F.lit(" rows, over the inline threshold; showing structure only):\n\n- Columns: "), F.array_join("fields", ", ")),
    ).otherwise(F.concat(wrap(F.transform("fields", lambda f: bitable_cell(f))), F.lit("\n"), wrap(F.transform("fields", lambda f: F.lit("---")))))
    heads = t.select("table", F.lit(0).alias("part"), F.lit(None).cast(records.schema["raw_id"].dataType).alias("raw_id"), head.alias("line"))
    small = records.join(t.where(F.col("n") <= threshold), "table")
    row = wrap(F.transform("fields", lambda f: bitable_cell(F.coalesce(F.element_at("cells", f), F.lit("")))))
    return heads.unionByName(small.select("table", F.lit(1).alias("part"), "raw_id", row.alias("line")))


def embed_bitables(bodies: DataFrame, shown: DataFrame) -> DataFrame:
    """``bodies`` (id, body, url; one row per id) with embedded tables in place, and ``outcomes``, one per table in order.

    ``shown``: id, token, table_id, text (the table, or its columns alone when ``oversize``). A table that its tag doesn't
    name in full, and one that isn't in ``shown``, is ``failed``; the others are ``rendered`` or ``oversize``. The tag stays
    as a comment, a link to the table follows where the document's host is known. Of several texts of a table the least
    holds. Null bodies stay null.
    """
    from doclake.functions import markup as M
    from doclake.functions.text import join_blocks
    from doclake.functions.urls import put_together

    found = F.regexp_extract_all("body", F.lit(M.EMBEDDED), F.lit(0))
    tags = bodies.select("id", "url", F.posexplode(found).alias("pos", "tag")).select("id", "url", "pos", M.attributes(F.col("tag")).alias("a"))
    texts = shown.groupBy(F.col("id").alias("_id"), F.col("token").alias("_t"), F.col("table_id").alias("_tb")).agg(F.min(F.struct("text", "oversize")).alias("_s"))
    j = tags.join(texts, (F.col("id") == F.col("_id")) & (F.col("a")["token"] == F.col("_t")) & (F.col("a")["table-id"] == F.col("_tb")), "left")
    token, table_id = F.coalesce(F.col("a")["token"], F.lit("")), F.coalesce(F.col("a")["table-id"], F.lit(""))
    link = M.online_table(F.col("url"), token, table_id, F.col("a")["view-id"])
    named = (token != "") & (table_id != "")
    outcome = F.when(~named | F.col("_s").isNull(), "failed").when(F.col("_s.oversize"), "oversize").otherwise("rendered")
    block = F.when(~named, F.array(link)).when(F.col("_s").isNull(), F.array(F.concat(F.lit("> Failed to fetch the bitable; open it online to view. "), link))).otherwise(F.array(F.coalesce("_s.text", F.lit("")), link))
    done = j.select("id", "pos", outcome.alias("outcome"), join_blocks(F.concat(F.array(M.table_note(F.col("a"))), block)).alias("block"))
    per = done.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "block", "outcome"))).alias("_b"))
    b = bodies.join(per, F.col("id") == F.col("_id"), "left")
    body = F.when(F.col("_b").isNull(), F.col("body")).otherwise(put_together(F.col("body"), M.EMBEDDED, found, F.transform("_b", lambda x: x["block"])))
    return b.select("id", body.alias("body"), F.coalesce(F.transform("_b", lambda x: x["outcome"]), F.array().cast("array<string>")).alias("outcomes"))
