"""Parent-child links to full hierarchies: splitters, a reduced pointer graph, exact expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import short_id
from weftline.operators.skew import hot_keys, join_unique
from weftline.session import Scratch

SPLIT_EVERY = 8
CYCLE = "CYCLE"


def walk(scratch: Scratch, walks: DataFrame, path: bool) -> DataFrame:
    """Double every open walk until it stands on a stop; rows that remain open lead into a cycle.

    ``walks``: node, at, steps, done[, path]; one row a node, stops among them (steps 0 or done).
    In a round each open walk takes over the walk of the node it stands on. When a round closes no
    walk, the open set is closed under these jumps, so none of it can ever reach a stop. A finished
    walk is written once; only open ones go through a round, and the job that writes them counts them.
    """
    first, before = scratch.write_counted(walks.hint("rebalance"), ~F.col("done"), "walk")
    closed, left = first.filter("done"), first.filter("not done")
    while before:
        to = closed.unionByName(left)
        to = to.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("done").alias("_done"), *([F.col("path").alias("_path")] if path else []))
        opened = join_unique(left, to, "at", "inner", total=before).select(
            "node", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"),
            *([F.concat("path", "_path").alias("path")] if path else []),
        )
        new, now = scratch.write_counted(opened.hint("rebalance"), ~F.col("done"), "walk")  # files of a fair size, one where rows are few
        closed, left = closed.unionByName(new.filter("done")), new.filter("not done")
        if now == before:
            break
        before = now
    return closed.unionByName(left)


def resolve_forest(pointers: DataFrame, *, split_every: int = SPLIT_EVERY, path: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Root, depth and path of every node of a pointer graph of unknown depth.

    ``pointers``: ``node``, ``parent``; one row a node. Returns ``node``, ``root``, ``depth`` (links
    up to the root) and, with ``path``, the ids from the root down to the node. Nodes on a cycle or
    below one have root ``CYCLE``, depth -1 and path null. Roots themselves have no row. Empty in,
    empty out; a self-pointing node is a cycle.

    1. Splitters: nodes whose hash falls on every ``split_every``-th value, and nodes with very many
       children (at most 1,000), so that no walk crosses a hot node.
    2. Every node walks to its next splitter or root, by pointer doubling.
    3. The splitters' own walks are the reduced graph, about n / split_every nodes; it is solved the
       same way with roots as the only stops.
    4. Each node's walk is extended by its splitter's solution. Open walks of step 2 are on or below
       cycles without a splitter and are told apart there; cycles with splitters stay open in step 3.
    """
    spark = pointers.sparkSession
    scratch = scratch or Scratch(spark, "forest")
    p, n = scratch.write_counted(pointers.select("node", "parent").filter("node is not null and parent is not null"), F.lit(True), "pointers")
    hot = hot_keys(p, "parent", n)

    def splitter(c: str) -> Column:
        return (F.pmod(F.xxhash64(c), F.lit(split_every)) == 0) | F.coalesce(F.col(c).isin(hot), F.lit(False)) if hot else F.pmod(F.xxhash64(c), F.lit(split_every)) == 0

    none = F.array().cast("array<string>")
    roots = p.select(F.col("parent").alias("node")).distinct().join(p.select("node"), "node", "left_anti")
    stops = roots.select("node", F.col("node").alias("at"), F.lit(0).alias("steps"), F.lit(True).alias("done"), *([none.alias("path")] if path else []))
    start = p.select("node", F.col("parent").alias("at"), F.lit(1).alias("steps"), splitter("parent").alias("done"), *([F.array("node").alias("path")] if path else []))
    walked = walk(scratch, start.unionByName(stops), path)

    own = walked.filter("steps > 0")
    reduced = own.filter(splitter("node") & F.col("done")).withColumn("done", F.lit(False))
    reduced = walk(scratch, reduced.unionByName(walked.filter("steps = 0")), path)
    solved = reduced.select(F.col("node").alias("at"), F.when(F.col("done"), F.col("at")).alias("_root"), F.col("steps").alias("_more"), *([F.col("path").alias("_rest")] if path else []))
    out = join_unique(own, solved, "at", "left", total=n)
    found = F.col("done") & F.col("_root").isNotNull()
    return out.select(
        "node", F.when(found, F.col("_root")).otherwise(F.lit(CYCLE)).alias("root"), F.when(found, F.col("steps") + F.col("_more")).otherwise(F.lit(-1)).cast("int").alias("depth"),
        *([F.when(found, F.reverse(F.concat("path", "_rest", F.array("_root")))).alias("path")] if path else []),
    )


def canonical_ids(rows: DataFrame, node: str, canonical: str, scratch: Scratch) -> DataFrame:
    """``id`` -> ``own``: each id with a row and the id it stands for, followed repeatedly.

    A null canonical id means the id itself. Ids whose alias chain is a cycle stand for themselves;
    ids whose chain ends at an id without a row are left out. Of contradicting rows of one id the
    smallest canonical id is taken.
    """
    ids = rows.groupBy(F.col(node).alias("id")).agg(F.min(F.when(F.col(canonical) != F.col(node), F.col(canonical))).alias("to")).filter("id is not null")
    ids = scratch.write(ids, "ids")
    stands = resolve_forest(ids.filter("to is not null").select(F.col("id").alias("node"), F.col("to").alias("parent")), scratch=scratch)
    stands = stands.select(F.col("node").alias("id"), F.when(F.col("root") == CYCLE, F.col("node")).otherwise(F.col("root")).alias("own"))
    known = ids.select(F.col("id").alias("own"))
    plain = ids.filter("to is null").select("id", F.col("id").alias("own"))
    return scratch.write(plain.unionByName(join_unique(stands, known, "own", "inner")), "canonical")


def institution_links(institutions: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``id`` -> ``own``, ``node`` -> ``parent``) of the institutions table.

    A link holds if the child's ``parent_ids`` or the parent's ``child_ids`` tells it; lineage tells
    none. Ids are read as short ids; links to ids without a row and to the node itself are dropped.
    Should several parents be told for one node, the smallest id is its parent, so the result is a
    forest. Repeats of rows, null lists, null elements and other columns do not matter.
    """
    rows = institutions.select(short_id("institution_id").alias("id"), short_id("canonical_institution_id").alias("canonical"), "parent_ids", "child_ids")
    ids = canonical_ids(rows, "id", "canonical", scratch)
    up = rows.select(F.col("id").alias("child"), F.explode("parent_ids").alias("x")).select("child", short_id("x").alias("parent"))
    down = rows.select(F.col("id").alias("parent"), F.explode("child_ids").alias("x")).select(short_id("x").alias("child"), "parent")
    told = up.unionByName(down).filter("child is not null and parent is not null").distinct()
    told = told.join(ids.select(F.col("id").alias("child"), F.col("own").alias("node")), "child").select("node", "parent")
    told = join_unique(told, ids.select(F.col("id").alias("parent"), "own"), "parent", "inner")
    return ids, told.filter("node <> own").groupBy("node").agg(F.min("own").alias("parent"))


def institution_roots(institutions: DataFrame) -> DataFrame:
    """One row for each institution that has a parent: its root and depth, or CYCLE and -1."""
    scratch = Scratch(institutions.sparkSession, "p2")
    _, links = institution_links(institutions, scratch)
    out = resolve_forest(links, scratch=scratch)
    return out.select(F.col("node").alias("institution_id"), F.col("root").alias("root_institution_id"), "depth")


def institution_hierarchy(institutions: DataFrame) -> DataFrame:
    """Every institution with its path from the root, depth, root and number of descendants.

    An institution without parent is its own root at depth 0. On or below a cycle: root CYCLE, depth
    -1, path and descendants null.
    """
    scratch = Scratch(institutions.sparkSession, "p2")
    ids, links = institution_links(institutions, scratch)
    below = scratch.write(resolve_forest(links, path=True, scratch=scratch), "paths")
    own = ids.select(F.col("own").alias("node")).distinct()
    tree = own.join(below, "node", "left")
    alone = F.col("root").isNull()
    tree = tree.select(
        "node", F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"), F.when(alone, F.lit(0)).otherwise(F.col("depth")).alias("depth"),
        F.when(alone, F.array("node")).otherwise(F.col("path")).alias("path"),
    )
    counts = descendants(below).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    out = tree.join(counts, "node", "left")
    return out.select(
        F.col("node").alias("institution_id"), F.col("root").alias("root_institution_id"), "depth", "path",
        F.when(F.col("depth") >= 0, F.coalesce("n", F.lit(0))).alias("descendant_count"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every node; rows, not lists, so no group is ever collected."""
    p = paths.filter("path is not null").select("node", "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "ancestor"))
    return p.select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("i")).cast("int").alias("distance"))


def institution_descendants(institutions: DataFrame) -> DataFrame:
    scratch = Scratch(institutions.sparkSession, "p2")
    _, links = institution_links(institutions, scratch)
    d = descendants(resolve_forest(links, path=True, scratch=scratch))
    return d.select(F.col("ancestor").alias("institution_id"), F.col("descendant").alias("descendant_id"), "distance")
