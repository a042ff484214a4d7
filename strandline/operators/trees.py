"""Trees in Newick form as tables of nodes, and their midpoint roots.

All follows from running sums and last values over the marks of a text, in stretches of them, so no task holds a tree and
no step goes from a node to the next. Only a text itself is one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import checkpoint
from strandline.sources.tables import STRETCH, carried

QUOTED = "'[^']*(?:''[^']*)*'"
#: A bracket or comma, the name and the length behind it, and whether a bracket opens next.
MARK = rf"([(),])\s*({QUOTED}|[^(),:;\[\]']*)\s*(?::\s*([^(),:;\[\]'\s]*))?(?=\s*(\(?))"


def running(rows: DataFrame, value: Column, name: str, *keys: str) -> DataFrame:
    """rows (number, ...) with the sum of value up to each number, that number's included, without a task that sees all rows of a key."""
    rows = rows.withColumns({name: value, "_stretch": F.expr(f"number div {STRETCH}")})
    total = rows.groupBy(*keys, "_stretch").agg(F.sum(name).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*keys, "_stretch", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    here = F.sum(name).over(Window.partitionBy(*keys, "_stretch").orderBy("number"))
    return rows.withColumn(name, here).join(before, [*keys, "_stretch"]).withColumn(name, F.col(name) + F.col("_before")).drop("_stretch", "_before")


def nodes(texts: DataFrame) -> DataFrame:
    """(tree, node, parent, name, length, leaf, open) of (tree, text), a tree a text.

    node is the place of a node's last mark, open that of its first, so the nodes below it are those between. The root has
    no parent. Names may be quoted, and comments in brackets are left out; lengths are absolute, null where there is none. A
    null or empty text has no nodes; brackets that don't match are an error.
    """
    clean = F.regexp_replace("text", rf"({QUOTED})|\[[^\]]*\]", "$1")
    rows = texts.select("tree", F.concat(F.lit(","), clean).alias("text")).where(F.col("text").rlike(r"[^\s,;]"))
    rows = rows.select("tree", *(F.regexp_extract_all("text", F.lit(MARK), F.lit(k)).alias(c) for k, c in enumerate(("mark", "label", "size", "next"), 1)))
    sign = lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    open_ = F.aggregate("mark", F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, c: F.struct((a["now"] + sign(c)).alias("now"), F.least(a["least"], a["now"] + sign(c)).alias("least")))
    rows = rows.withColumn("_open", open_).withColumn("mark", F.when((F.col("_open.now") == 0) & (F.col("_open.least") == 0), F.col("mark")).otherwise(F.raise_error(F.lit("brackets of a tree don't match"))))
    rows = rows.select("tree", F.posexplode(F.arrays_zip("mark", "label", "size", "next")).alias("number", "x")).select("tree", F.col("number").cast("long").alias("number"), "x.mark", "x.label", "x.size", "x.next")
    rows = checkpoint(running(rows, sign(F.col("mark")), "level", "tree"))
    none = F.lit(None).cast("long")
    closing = rows.where("mark = ')'").select("tree", (F.col("level") + 1).alias("level"), "number", F.col("number").alias("closes"), none.alias("opens"))
    opening = rows.where("mark = '('").select("tree", "level", "number", none.alias("closes"), F.col("number").alias("opens"))
    own = rows.where("mark = ')' or next = ''").withColumns({"closes": none, "opens": none})
    # The next bracket that closes a node's level is its parent, and the last one that opened it is where a node begins.
    after = own.select("tree", "level", "number", "closes").withColumn("own", F.lit(True)).unionByName(closing.select("tree", "level", "number", "closes", F.lit(False).alias("own")))
    parent = carried(after.withColumn("number", -F.col("number")), F.col("closes"), "parent", "tree", "level").where("own").select("tree", (-F.col("number")).alias("number"), "parent")
    begin = carried(closing.unionByName(opening), F.col("opens"), "open", "tree", "level").where("closes is not null").select("tree", "number", "open")
    leaf = F.col("mark") != ")"
    label = F.regexp_replace("label", r"\s+$", "")
    name = F.when(label.startswith("'"), F.replace(F.regexp_replace(label, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(F.nullif(label, F.lit("")))
    joined = own.select("tree", "number", "mark", "label", "size").join(parent, ["tree", "number"]).join(begin, ["tree", "number"], "left")
    return joined.select("tree", F.col("number").alias("node"), "parent", name.alias("name"), F.abs(F.col("size").try_cast("double")).alias("length"), leaf.alias("leaf"), F.coalesce("open", "number").alias("open"))


def to_root(tree_nodes: DataFrame) -> DataFrame:
    """nodes with dist, the length of the way to the root: what is open at a node and its own. No length counts as 0."""
    size = F.when(F.col("parent").isNotNull(), F.coalesce("length", F.lit(0.0))).otherwise(0.0)
    rows = tree_nodes.withColumn("_size", size)
    begun = rows.where("not leaf").select("tree", F.col("open").alias("number"), F.col("_size").alias("x"), F.lit(False).alias("own"))
    ended = rows.select("tree", F.col("node").alias("number"), F.when(F.col("leaf"), 0.0).otherwise(-F.col("_size")).alias("x"), F.lit(True).alias("own"))
    sums = running(begun.unionByName(ended), F.col("x"), "sum", "tree").where("own").select("tree", F.col("number").alias("node"), "sum")
    return rows.join(sums, ["tree", "node"]).withColumn("dist", F.col("sum") + F.col("_size")).drop("sum", "_size")


def midpoints(tree_nodes: DataFrame) -> DataFrame:
    """(tree, node, above, half, first, second): the middle of each tree's longest path between leaves, above node by that length.

    The leaf farthest from the root is one end of such a path, the leaf farthest from that one the other. Where two leaves'
    ways meet is the innermost node open at both: before the first leaf the last one that opened, behind it the next that closes.
    Ties go to the earlier leaf. A tree of one leaf has none.
    """
    far = checkpoint(to_root(tree_nodes))
    end = far.where("leaf").groupBy("tree").agg(F.max(F.struct("dist", (-F.col("node")).alias("at"))).alias("x")).select("tree", (-F.col("x.at")).alias("first"), F.col("x.dist").alias("reach"))
    rows = far.join(end, "tree")
    path = rows.where("open <= first and first <= node")
    leaves = rows.where("leaf and node != first")
    place = lambda sign, side, at: leaves.where(side).select("tree", (sign * F.col("node")).alias("number"), F.lit(None).cast("double").alias("meet"), "dist", "reach", "first").unionByName(path.where("not leaf").select("tree", (sign * F.col(at)).alias("number"), F.col("dist").alias("meet"), F.lit(None).cast("double").alias("dist"), "reach", "first"))
    met = carried(place(F.lit(1), "node < first", "open"), F.col("meet"), "meet", "tree").unionByName(carried(place(F.lit(-1), "node > first", "node"), F.col("meet"), "meet", "tree")).where("dist is not null")
    span = met.groupBy("tree").agg(F.max(F.struct((F.col("reach") + F.col("dist") - 2 * F.col("meet")).alias("d"), (-F.abs("number")).alias("at"))).alias("x"))
    over = path.join(span.select("tree", (F.col("x.d") / 2).alias("half"), (-F.col("x.at")).alias("second")), "tree").where("reach - dist <= half")
    return over.groupBy("tree").agg(F.max(F.struct("node", (F.col("half") - F.col("reach") + F.col("dist")).alias("above"), "half", "first", "second")).alias("x")).select("tree", "x.*")


def midpoint_rooted(tree_nodes: DataFrame, middle: DataFrame | None = None) -> DataFrame:
    """(tree, node, parent, name, length, leaf) with the root, as node 0, in the middle of each tree's longest path.

    Nodes between it and the old root turn round. An old root that then has one child goes, and its lengths are added up. A
    tree whose middle is its root, or with one leaf, stays.
    """
    rows = tree_nodes.join((middle or midpoints(tree_nodes)).select("tree", F.col("node").alias("_low"), "above"), "tree", "left")
    tops = rows.where("parent is null").select("tree", F.col("node").alias("_root"), F.coalesce(F.col("node") != F.col("_low"), F.lit(False)).alias("_moves"))
    rows = checkpoint(rows.join(tops, "tree"))
    kids = rows.where("_moves and parent = _root").groupBy("tree").agg((F.count("*") <= 2).alias("_goes"))
    way = rows.where("_moves and parent is not null and open <= _low and _low <= node")
    here = F.col("node") == F.col("_low")
    turned = way.select("tree", F.col("parent").alias("node"), F.when(here, F.lit(0)).otherwise(F.col("node")).alias("_to"), (F.coalesce("length", F.lit(0.0)) - F.when(here, F.col("above")).otherwise(0.0)).alias("_long"))
    root = rows.where("_moves and parent is null").join(turned, ["tree", "node"]).join(kids, "tree").select("tree", F.col("_to").alias("_root_to"), F.col("_long").alias("_root_long"), "_goes")
    out = rows.join(turned, ["tree", "node"], "left").join(root, "tree", "left")
    gone = F.coalesce(F.col("_goes"), F.lit(False))
    below = F.col("_moves") & gone & (F.col("parent") == F.col("_root")) & ~((F.col("open") <= F.col("_low")) & (F.col("_low") <= F.col("node")))
    low = F.col("_moves") & here
    out = out.where(~(gone & F.col("_moves") & F.col("parent").isNull()))
    pick = lambda new, turn, over, plain: F.when(low, new).when(F.col("_to").isNotNull(), turn).when(below, over).otherwise(plain)
    to = pick(F.lit(0).cast("long"), F.col("_to"), F.col("_root_to"), F.col("parent"))
    size = pick(F.col("above"), F.col("_long"), F.coalesce("length", F.lit(0.0)) + F.col("_root_long"), F.col("length"))
    made = tops.where("_moves").select("tree", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("length"), F.lit(False).alias("leaf"))
    return out.select("tree", "node", to.alias("parent"), "name", size.alias("length"), "leaf").unionByName(made)
