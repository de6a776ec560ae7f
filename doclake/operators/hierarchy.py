"""Parent links to whole hierarchies by tree contraction.

Each round rakes all leaves into their parents and compresses unary chains: a node whose only child is no leaf and whose hash
is less than its parent's and its child's is spliced out, its child linked to its parent. Every removal is recorded with the
distance to the parent, what hangs below the node, and what the link hides. A round removes all leaves and about a third
of every chain, so n nodes take O(log n) rounds at any depth. When only roots are left the records are undone in reverse
order: a node's depth and root follow from the parent it was removed from, its descendants from its own record and that of
the child it was spliced above. What contraction can't end is a loop: a chain that closes on itself shrinks to a node that
is its own parent. That node is set aside as a core, and all that leads to it has no root.

Rounds are joins and aggregations keyed by node. Each round is written to the shared folder, so that plans stay short and
nothing is lost with an executor; what later rounds read shrinks with every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from doclake.session import cut, discard, new_path


def _one_row_per_node(links: DataFrame) -> DataFrame:
    return links.where("node_id IS NOT NULL").groupBy("src", "node_id").agg(F.min("parent_id").alias("parent_id"))


def contract(links: DataFrame, paths: bool = False, label: str | None = None, max_rounds: int = 200) -> DataFrame:
    """(src, node_id, root_id, depth, n_desc) for each distinct node of ``links`` (src, node_id, parent_id).

    A node whose parent is null or no node of the same src is a root: itself as ``root_id``, depth 0. ``n_desc`` counts all
    nodes below. A node from which no root is reached (in or below a loop; a node may be its own parent) has root '', depth
    -1 and n_desc -1. Null nodes are left out; of several rows of a node the least non-null parent holds. An empty table
    gives no rows. With ``paths``, also ``path``: from the root to the node the ids, or the values of column ``label`` (then
    ``links`` must hold one row per node); null where there is no root.
    """
    nodes = _one_row_per_node(links) if label is None else links.where("node_id IS NOT NULL").select("src", "node_id", "parent_id", F.col(label).alias("tag"))
    kind = nodes.schema["tag"].dataType.simpleString() if label else "string"
    tag = ["tag"] if label else []
    mark = F.col("tag") if label else F.col("v")
    known = nodes.select(F.col("src").alias("_src"), F.col("node_id").alias("_p"))
    start = nodes.join(known, (F.col("src") == F.col("_src")) & (F.col("parent_id") == F.col("_p")), "left").select("src", F.col("node_id").alias("v"), F.col("_p").alias("p"), *tag)
    kids = start.where("p IS NOT NULL").groupBy(F.col("src").alias("_src"), F.col("p").alias("_v")).agg(F.count("*").alias("_k"))
    zero = F.lit(0).cast("bigint")
    hops = [F.array().cast(f"array<{kind}>").alias("hops")] if paths else []
    # acc: nodes raked into v; hid, hops: what the link to p hides (count with all below; ids from v upwards).
    state = start.join(kids, (F.col("src") == F.col("_src")) & (F.col("v") == F.col("_v")), "left").select(
        "src", "v", "p", F.coalesce("_k", F.lit(0)).cast("int").alias("kids"), F.lit(1).cast("bigint").alias("dist"), zero.alias("acc"), zero.alias("hid"), F.lit(0).alias("turn"), *hops, *tag
    )
    spark = links.sparkSession
    rounds: list[DataFrame] = []
    passing: list[str] = []
    hops = ["hops", *tag] if paths else []
    for k in range(max_rounds):
        below = state.where("p IS NOT NULL AND p <> v")
        leaf = F.col("kids") == 0
        gathered = below.groupBy(F.col("src").alias("_src"), F.col("p").alias("_v")).agg(
            F.count("*").alias("_all"),
            F.count(F.when(leaf, 1)).alias("_leaves"),
            F.coalesce(F.sum(F.when(leaf, F.col("acc") + F.col("hid") + 1)), F.lit(0)).alias("_raked"),
            F.max(F.when(~leaf, F.col("v"))).alias("c"),
            F.max(F.when(~leaf, F.col("hid"))).alias("c_hid"),
        )
        j = state.join(gathered, (F.col("src") == F.col("_src")) & (F.col("v") == F.col("_v")), "left").drop("_src", "_v")
        left = F.coalesce(F.col("_all") - F.col("_leaves"), F.lit(0)).cast("int")
        # The round's number is data: as a literal it would have every round compiled anew.
        rank = lambda c: F.xxhash64(c, F.col("turn"))
        low = (left == 1) & (F.col("_leaves") == 0) & (rank(F.col("v")) < rank(F.col("p"))) & (rank(F.col("v")) < rank(F.col("c")))
        act = (
            F.when(F.col("p").isNull(), "root")
            .when(F.col("p") == F.col("v"), "core")
            .when(leaf, "rake")
            .when(low, "compress")
            .otherwise("keep")
        )
        met = Observation()
        told = (
            j.select("src", "v", "p", left.alias("kids"), "dist", (F.col("acc") + F.coalesce("_raked", F.lit(0))).alias("acc"), "hid", "turn", *hops, "c", "c_hid", act.alias("act"))
            .observe(met, F.count(F.when(F.col("act").isin("keep", "rake", "compress"), 1)).alias("open"))
        )
        done = cut(told, f"contract-{k}", passing)
        rounds.append(done)
        # Roots and cores stay until all that hangs on them is gone; each round they take what is raked into them.
        # The count is taken while writing; a task that ran twice may count twice, but none that is left counts as none.
        if not met.get["open"]:
            break
        stay = done.where("act IN ('keep', 'root', 'core')")
        # A spliced node tells its only child, by the child's key: a parent of many is no one's join key here.
        spliced = done.where("act = 'compress'").select(F.col("src").alias("_src"), F.col("c").alias("_v"), F.col("p").alias("_p"), F.col("dist").alias("_dist"), (F.col("acc") + F.col("hid") + 1).alias("_hid"), *([F.concat(F.array(mark), F.col("hops")).alias("_hops")] if paths else []))
        s = stay.join(spliced, (F.col("src") == F.col("_src")) & (F.col("v") == F.col("_v")), "left")
        state = s.select(
            "src",
            "v",
            F.coalesce("_p", "p").alias("p"),
            "kids",
            (F.col("dist") + F.coalesce("_dist", zero)).alias("dist"),
            "acc",
            (F.col("hid") + F.coalesce("_hid", zero)).alias("hid"),
            (F.col("turn") + 1).alias("turn"),
            *([F.when(F.col("_v").isNull(), F.col("hops")).otherwise(F.concat("hops", "_hops")).alias("hops"), *tag] if paths else []),
        )
    else:
        raise RuntimeError(f"contraction did not end in {max_rounds} rounds")

    root = F.col("act") == "root"
    known_path = [F.when(root, F.array(mark)).alias("path")] if paths else []
    base = new_path(spark, "found")

    def keep(k: int, df: DataFrame) -> DataFrame:
        """All that is found so far: one folder, so that plans don't grow with the rounds."""
        df.write.parquet(f"{base}/round={k}")
        return spark.read.schema(df.schema).option("basePath", base).parquet(base)

    found = keep(len(rounds), rounds[-1].select("src", "v", F.when(root, F.col("v")).otherwise("").alias("root_id"), F.when(root, 0).otherwise(-1).cast("bigint").alias("depth"), F.when(root, F.col("acc")).otherwise(-1).cast("bigint").alias("n_desc"), *known_path))
    for k, done in reversed(list(enumerate(rounds[:-1]))):
        gone = done.where("act IN ('rake', 'compress')")
        up = found.select(F.col("src").alias("_us"), F.col("v").alias("_uv"), F.col("root_id"), F.col("depth").alias("_ud"), *([F.col("path").alias("_up")] if paths else []))
        down = found.select(F.col("src").alias("_ds"), F.col("v").alias("_dv"), F.col("n_desc").alias("_dn"))
        r = gone.join(up, (F.col("src") == F.col("_us")) & (F.col("p") == F.col("_uv"))).join(down, (F.col("src") == F.col("_ds")) & (F.col("c") == F.col("_dv")) & (F.col("act") == "compress"), "left")
        rooted = F.col("root_id") != ""
        below = F.when(F.col("act") == "compress", F.col("acc") + F.col("c_hid") + 1 + F.col("_dn")).otherwise(F.col("acc"))
        part = r.select(
            "src",
            "v",
            "root_id",
            F.when(rooted, F.col("_ud") + F.col("dist")).otherwise(-1).cast("bigint").alias("depth"),
            F.when(rooted, below).otherwise(-1).cast("bigint").alias("n_desc"),
            *([F.when(rooted, F.concat("_up", F.reverse("hops"), F.array(mark))).alias("path")] if paths else []),
        )
        found = keep(k, part)
    for path in passing:
        discard(spark, path)
    return found.select("src", F.col("v").alias("node_id"), "root_id", F.col("depth").cast("int"), F.col("n_desc").cast("int"), *(["path"] if paths else []))
