"""The synteny graph: oriented neighbours of families, canonical links, blocks and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import Turns, numbered


def adjacent(features: DataFrame) -> DataFrame:
    """(genome, contig, pos, family, strand, before, strand_before): each gene with the one before it on its contig."""
    w = Window.partitionBy("genome", "contig").orderBy("pos")
    return features.select("genome", "contig", "pos", "family", "strand", F.lag("family").over(w).alias("before"), F.lag("strand").over(w).alias("strand_before"))


def contig_positions(features: DataFrame) -> DataFrame:
    return features.withColumn("ordinal", F.row_number().over(Window.partitionBy("genome", "contig").orderBy("pos")))


def nearest_copies(features: DataFrame) -> DataFrame:
    """(family, genome, locus, nearest): the least distance to another copy of the genome on the same contig; null if alone."""
    w = Window.partitionBy("family", "genome", "contig").orderBy("pos")
    return features.withColumn("nearest", F.least(F.col("pos") - F.lag("pos").over(w), F.lead("pos").over(w) - F.col("pos"))).select("family", "genome", "locus", "nearest")


def intergenic(features: DataFrame) -> DataFrame:
    """(genome, contig, pos, gap, kind) from (start, end): the gap to the gene before, by the two strands."""
    w = Window.partitionBy("genome", "contig").orderBy("start", "pos")
    rows = features.withColumn("_end", F.lag("end").over(w)).withColumn("_strand", F.lag("strand").over(w)).where("_end is not null")
    a, b = F.col("_strand"), F.col("strand")
    kind = F.when((a == "+") & (b == "+"), "CO_F").when((a == "-") & (b == "-"), "CO_R").when((a == "-") & (b == "+"), "DP").otherwise("DT")
    return rows.select("genome", "contig", "pos", (F.col("start") - F.col("_end") - 1).alias("gap"), kind.alias("kind"))


def _neighbouring(features: DataFrame) -> DataFrame:
    """adjacent() of genes whose neighbour before is of another family: tandem copies make no link."""
    return adjacent(features).where("before is not null and before != family")


def edges(features: DataFrame) -> DataFrame:
    """(src, src_side, dst, dst_side, weight): which end of a family meets which end of another, seen from both.

    A gene on the forward strand ends downstream (D) and begins upstream (U); on the other strand the reverse. A family
    next to itself makes no edge.
    """
    pairs = _neighbouring(features)
    leave = F.when(F.col("strand_before") == "+", "D").otherwise("U")
    enter = F.when(F.col("strand") == "+", "U").otherwise("D")
    turn = F.col("family") < F.col("before")
    # A link is counted in one spelling, and has its second after that: half as much is dealt out.
    once = pairs.select(
        F.least("before", "family").alias("src"), F.when(turn, enter).otherwise(leave).alias("src_side"),
        F.greatest("before", "family").alias("dst"), F.when(turn, leave).otherwise(enter).alias("dst_side"))
    once = once.groupBy("src", "src_side", "dst", "dst_side").agg(F.count("*").alias("weight"))
    ways = F.array(F.struct("src", "src_side", "dst", "dst_side"), F.struct(F.col("dst").alias("src"), F.col("dst_side").alias("src_side"), F.col("src").alias("dst"), F.col("src_side").alias("dst_side")))
    return once.select(F.explode(ways).alias("e"), "weight").select("e.*", "weight")


def canonical_links(features: DataFrame) -> DataFrame:
    """(n1, n2, weight): each link once, a `-` behind a name that is read backwards.

    Two genes of one strand keep their direction: A, B and B, A are two links, whichever strand both are on. If the
    strands differ, the link has two spellings (A, B- is B, A- read from the other end, and A-, B is B-, A); the one that
    begins with the smaller name stands for both.
    """
    pairs = _neighbouring(features)
    first, second = F.least("before", "family"), F.greatest("before", "family")
    here, there = F.col("strand"), F.col("strand_before")
    minus = lambda c: F.concat(c, F.lit("-"))
    n1 = F.when((there == "+") & (here == "+"), F.col("before")).when((there != "+") & (here != "+"), F.col("family")).when(there == "+", first).otherwise(minus(first))
    n2 = F.when((there == "+") & (here == "+"), F.col("family")).when((there != "+") & (here != "+"), F.col("before")).when(there == "+", minus(second)).otherwise(second)
    return pairs.groupBy(n1.alias("n1"), n2.alias("n2")).agg(F.count("*").alias("weight"))


def edge_lines(edge_rows: DataFrame) -> DataFrame:
    """(n1, n2, weight) of edges as files have them: n2 has a `-` if it is entered at its end, for each side of n1 a row."""
    return edge_rows.select(F.col("src").alias("n1"), F.when(F.col("dst_side") == "D", F.concat("dst", F.lit("-"))).otherwise(F.col("dst")).alias("n2"), "weight")


def node_weights(features: DataFrame) -> DataFrame:
    """(family, n_genomes, n_loci, dosage)."""
    return features.groupBy("family").agg(F.count_distinct("genome").alias("n_genomes"), F.count("*").alias("n_loci")).withColumn("dosage", F.col("n_loci") / F.col("n_genomes"))


def neighbours(edge_rows: DataFrame, reversed_: bool = False) -> DataFrame:
    """(family, upstream, downstream): neighbours of each side, swapped for a reversed node."""
    up, down = ("D", "U") if reversed_ else ("U", "D")
    side = lambda x: F.array_sort(F.collect_set(F.when(F.col("src_side") == x, F.concat("dst", "dst_side"))))
    return edge_rows.groupBy(F.col("src").alias("family")).agg(side(up).alias("upstream"), side(down).alias("downstream"))


def block_links(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, a_side, b, b_side): links along which blocks run.

    Each is the only one of its end, seen from both ends, and joins families of as many genomes; tandem copies don't count.
    """
    real = edge_rows.where("src != dst")
    single = real.groupBy("src", "src_side").agg(F.count("*").alias("n"), F.first("dst").alias("dst"), F.first("dst_side").alias("dst_side")).where("n = 1").drop("n")
    back = single.select(F.col("src").alias("dst"), F.col("src_side").alias("dst_side"), F.col("dst").alias("src"), F.col("dst_side").alias("src_side"))
    mutual = single.join(back, ["src", "src_side", "dst", "dst_side"], "left_semi")
    n = nodes.select("family", "n_genomes")
    same = mutual.join(n.toDF("src", "n_src"), "src").join(n.toDF("dst", "n_dst"), "dst").where("n_src = n_dst")
    return same.where("src < dst").select(F.col("src").alias("a"), F.col("src_side").alias("a_side"), F.col("dst").alias("b"), F.col("dst_side").alias("b_side"))


def laid(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, path, before, n, turned): nodes (node, n) in a row along links (a, a_side, b, b_side), which are seen from both ends.

    A side, 0 or 1, has one link at most, so nodes lie on paths and rings; who enters by one side leaves by the other. A path
    is named by its smallest node and begins at the smaller of its ends; a ring begins at its smallest node, which is left by
    side 1. `before` is the sum of n of the nodes before; those left by side 0 are turned.

    Steps, from each node by each side, are doubled: after k rounds a row knows what the next 2^k nodes are. Rounds are joins, as
    many as the longest path's logarithm, and no task sees a path.
    """
    turns = Turns(links.sparkSession, 2)
    sides = sizes.select("node", F.col("n").cast("long").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    ways = links.select(F.col("a").alias("node"), F.col("a_side").alias("side"), F.col("b").alias("to"), (1 - F.col("b_side")).alias("to_side"))
    # low: the smallest node of those seen, and the side that it is left by; far: the n up to it; gone: the n of all that were seen;
    # end: the last node, where nothing follows.
    now = turns.put(sides.join(ways, ["node", "side"], "left").select(
        "node", "side", "n", "to", "to_side", F.col("node").alias("low"), F.col("side").alias("low_side"), F.col("n").alias("far"), F.col("n").alias("gone"),
        F.when(F.col("to").isNull(), F.col("node")).alias("end"), F.lit(True).alias("new")))
    # Rings have no end: when no row of theirs sees a smaller node in a step twice as long, each has seen the smallest.
    while now.where("to is not null").limit(1).count() and now.where("new").limit(1).count():
        there = now.select(F.col("node").alias("to"), F.col("side").alias("to_side"), *(F.col(c).alias(f"_{c}") for c in ("to", "to_side", "low", "low_side", "far", "gone", "end")))
        less = F.col("_low") < F.col("low")
        better = lambda mine, other: F.when(less, other).otherwise(mine)  # noqa: E731, B023
        stepped = now.where("to is not null").join(there, ["to", "to_side"]).select(
            "node", "side", "n", F.col("_to").alias("to"), F.col("_to_side").alias("to_side"), F.least("low", "_low").alias("low"), better(F.col("low_side"), F.col("_low_side")).alias("low_side"),
            better(F.col("far"), F.col("gone") + F.col("_far")).alias("far"), (F.col("gone") + F.col("_gone")).alias("gone"), F.col("_end").alias("end"), (less | F.col("_end").isNotNull()).alias("new"))
        now = turns.put(now.where("to is null").withColumn("new", F.lit(False)).unionByName(stepped))
    one, two = (now.where(f"side = {k}").select("node", *(["n"] if k else []), *(F.col(c).alias(f"{c}{k}") for c in ("low", "low_side", "far", "gone", "end"))) for k in (0, 1))
    ring = F.col("end0").isNull()
    turned = F.when(ring, F.col("low_side0") == 1).otherwise(F.col("end1") < F.col("end0"))
    back = F.when(F.col("turned"), F.when(ring, F.col("far1")).otherwise(F.col("gone1"))).otherwise(F.when(ring, F.col("far0")).otherwise(F.col("gone0")))
    both = one.join(two, "node").withColumn("turned", turned)
    return both.select("node", F.least("low0", "low1").alias("path"), (back - F.col("n")).alias("before"), "n", "turned")


def _laid_families(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """laid() of families along block links; U is side 0, D is side 1."""
    number = lambda c: F.when(F.col(c) == "D", 1).otherwise(0).alias(c)
    links = block_links(edge_rows, nodes).select("a", number("a_side"), "b", number("b_side"))
    back = links.select(F.col("b").alias("a"), F.col("b_side").alias("a_side"), F.col("a").alias("b"), F.col("a_side").alias("b_side"))
    return laid(checkpointed(links.unionByName(back)), nodes.select(F.col("family").alias("node"), F.lit(1).alias("n")))


def blocks(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(family, block): block is the smallest family that block links reach; a family without any is its own."""
    return _laid_families(edge_rows, nodes).select(F.col("node").alias("family"), F.col("path").alias("block"))


def block_paths(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(block, family, ord, reversed): each block as a path from its smaller end; a ring begins at its smallest family."""
    rows = _laid_families(edge_rows, nodes)
    return rows.select(F.col("path").alias("block"), F.col("node").alias("family"), (F.col("before") + 1).cast("int").alias("ord"), F.col("turned").alias("reversed"))


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows that are used several times by what follows: they are written once, as a table whose size Spark knows."""
    return Turns(rows.sparkSession, 1).put(rows)


def ranked_blocks(block_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(block, n_genomes, length, rank) of (family, block): by genomes, then length, then name."""
    return numbered(_block_genomes(block_rows, nodes), "rank", F.desc("n_genomes"), F.desc("length"), F.col("block"))


def block_ends(paths: DataFrame) -> DataFrame:
    """(block, family, side, end): the free side of the first (end 0) and last (end 1) family of each block."""
    last = paths.withColumn("_most", F.max("ord").over(Window.partitionBy("block")))
    first = last.where("ord = 1").select("block", "family", F.when(F.col("reversed"), "D").otherwise("U").alias("side"), F.lit(0).alias("end"))
    return first.unionByName(last.where("ord = _most").select("block", "family", F.when(F.col("reversed"), "U").otherwise("D").alias("side"), F.lit(1).alias("end")))


def out_links(edge_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(block, end, family, to, to_side, other): links that leave a block at its ends, and the block that they lead into."""
    at = block_ends(paths).select(F.col("family").alias("src"), F.col("side").alias("src_side"), "block", "end")
    rows = edge_rows.select("src", "src_side", F.col("dst").alias("to"), F.col("dst_side").alias("to_side")).join(at, ["src", "src_side"])
    return rows.join(paths.select(F.col("family").alias("to"), F.col("block").alias("other")), "to").select("block", "end", F.col("src").alias("family"), "to", "to_side", "other")


def end_links(edge_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(block, end, other, other_end, weight): links between ends of blocks."""
    e = block_ends(paths)
    a = e.select(F.col("family").alias("src"), F.col("side").alias("src_side"), "block", "end")
    b = e.select(F.col("family").alias("dst"), F.col("side").alias("dst_side"), F.col("block").alias("other"), F.col("end").alias("other_end"))
    return edge_rows.join(a, ["src", "src_side"]).join(b, ["dst", "dst_side"]).select("block", "end", "other", "other_end", "weight")


def _block_genomes(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    return paths.join(nodes.select("family", "n_genomes"), "family").groupBy("block").agg(F.max("n_genomes").alias("n_genomes"), F.count("*").alias("length"))


def reciprocal(edge_rows: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(block, end, other, other_end): ends of two blocks that have each other as the only one to go on to.

    Of all links that leave an end, only those into other blocks of as many genomes count; there must be one, it must
    lead to an end, and that end must in turn have this link only.
    """
    n = _block_genomes(paths, nodes).select("block", "n_genomes")
    out = out_links(edge_rows, paths).where("block != other").join(n, "block").join(n.toDF("other", "n_other"), "other").where("n_genomes = n_other")
    one = out.groupBy("block", "end").agg(F.count("*").alias("n"), F.first("other").alias("other"), F.first("to").alias("to"), F.first("to_side").alias("to_side")).where("n = 1").drop("n")
    ends = block_ends(paths).select(F.col("block").alias("other"), F.col("family").alias("to"), F.col("side").alias("to_side"), F.col("end").alias("other_end"))
    led = one.join(ends, ["other", "to", "to_side"]).select("block", "end", "other", "other_end")
    back = led.toDF("other", "other_end", "block", "end")
    return led.join(back, ["block", "end", "other", "other_end"], "left_semi")


def _laid_blocks(edge_rows: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """laid() of blocks along their reciprocal ends, with how many families they have."""
    ends = reciprocal(edge_rows, nodes, paths).select(F.col("block").alias("a"), F.col("end").alias("a_side"), F.col("other").alias("b"), F.col("other_end").alias("b_side"))
    return laid(checkpointed(ends), paths.groupBy(F.col("block").alias("node")).agg(F.max("ord").alias("n")))


def joined_blocks(edge_rows: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(block, joined): blocks that reciprocal ends join, over any number of hops, under their smallest block."""
    return _laid_blocks(edge_rows, nodes, paths).select(F.col("node").alias("block"), F.col("path").alias("joined"))


def connected_paths(edge_rows: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(block, family, ord, reversed): as block_paths(), of what reciprocal ends connect to one path, named by its smallest block.

    A path begins at its smaller end, a ring at its smallest block, which keeps its direction.
    """
    placed = _laid_blocks(edge_rows, nodes, paths).select(F.col("node").alias("block"), F.col("path").alias("joined"), "before", "n", "turned")
    ord_ = F.col("before") + F.when(F.col("turned"), F.col("n") + 1 - F.col("ord")).otherwise(F.col("ord"))
    return paths.join(placed, "block").select(F.col("joined").alias("block"), "family", ord_.cast("int").alias("ord"), (F.col("reversed") != F.col("turned")).alias("reversed"))


def reversed_loops(edge_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(block): those with a link from one end to the family at the other; a block of one family has none."""
    ends = block_ends(paths).select(F.col("block").alias("other"), F.col("family").alias("to"), F.col("end").alias("to_end"))
    return out_links(edge_rows, paths).where("block = other").join(ends, ["other", "to"]).where("end != to_end and family != to").select("block").distinct()


def classify_blocks(edge_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(block, n_up, n_down, kind): what a block is by the links that leave its first and its last family, wherever they lead.

    One link to other blocks at each end: insertion(loop) if both lead to one block, else insertion. Over five at an end:
    superconnector. All others: multiconnector. A block that also links to itself has `self-loop;` in front.
    """
    links = out_links(edge_rows, paths)
    count = lambda end: F.sum(F.when((F.col("end") == end) & (F.col("block") != F.col("other")), 1).otherwise(0)).cast("long")
    lead = lambda end: F.max(F.when((F.col("end") == end) & (F.col("block") != F.col("other")), F.col("other")))
    each = links.groupBy("block").agg(count(0).alias("n_up"), count(1).alias("n_down"), lead(0).alias("_up"), lead(1).alias("_down"), F.max(F.col("block") == F.col("other")).alias("_self"))
    all_ = paths.select("block").distinct().join(each, "block", "left").na.fill(0, ["n_up", "n_down"]).na.fill(False, ["_self"])
    kind = (
        F.when((F.col("n_up") == 1) & (F.col("n_down") == 1), F.when(F.col("_up") == F.col("_down"), "insertion(loop)").otherwise("insertion"))
        .when((F.col("n_up") > 5) | (F.col("n_down") > 5), "superconnector").otherwise("multiconnector")
    )
    return all_.select("block", "n_up", "n_down", F.concat(F.when(F.col("_self"), "self-loop;").otherwise(""), kind).alias("kind"))


def order(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(family, block, ord) of connected paths: ranked by genomes, then length, then name; the family's place in its path.

    The rank is over paths only, of which there are far fewer than loci.
    """
    ranked = ranked_blocks(paths, nodes)
    return paths.join(ranked.select("block", "rank"), "block").select("family", F.col("rank").cast("int").alias("block"), "ord")


def block_lines(edge_rows: DataFrame, nodes: DataFrame, paths: DataFrame, led: bool = False) -> DataFrame:
    """(block_number, number_isolates, number_clusters_in_block, clusters_in_block, number_upstream_links, number_downstream_links,
    upstream_links, downstream_links): the table of blocks, numbered by rank; a `-` behind a family that is read backwards.

    With `led`, upstream_blocks and downstream_blocks too: for each link in its order, the number of the block that it leads into.
    """
    signed = F.when(F.col("reversed"), F.concat("family", F.lit("-"))).otherwise(F.col("family"))
    names = paths.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", signed.alias("x")))), lambda x: x["x"]), ",").alias("clusters_in_block"))
    to = F.when(F.col("to_side") == "D", F.concat("to", F.lit("-"))).otherwise(F.col("to"))
    ranked = ranked_blocks(paths, nodes)
    links = out_links(edge_rows, paths).withColumn("x", to)
    links = links.join(ranked.select(F.col("block").alias("other"), F.col("rank").alias("at")), "other") if led else links.withColumn("at", F.lit(0))
    side = lambda end: F.array_sort(F.collect_set(F.when(F.col("end") == end, F.struct("x", "at"))))
    rows = ranked.join(names, "block").join(links.groupBy("block").agg(side(0).alias("up"), side(1).alias("down")), "block", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    text = lambda c, k="x": F.when(n(c) > 0, F.array_join(F.transform(c, lambda x: x[k].cast("string")), ",")).otherwise("NA")
    into = [text("up", "at").alias("upstream_blocks"), text("down", "at").alias("downstream_blocks")] if led else []
    return rows.select(
        F.col("rank").alias("block_number"), F.col("n_genomes").alias("number_isolates"), F.col("length").alias("number_clusters_in_block"), "clusters_in_block",
        n("up").alias("number_upstream_links"), n("down").alias("number_downstream_links"), *into, text("up").alias("upstream_links"), text("down").alias("downstream_links"))


def block_files(edge_rows: DataFrame, nodes: DataFrame, paths: DataFrame, connected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of blocks, of connected paths with where their links lead and what kind they are, and of those that loop back."""
    kinds = numbered_kinds(edge_rows, nodes, connected)
    whole = checkpointed(block_lines(edge_rows, nodes, connected, True).join(kinds, "block_number"))
    return block_lines(edge_rows, nodes, paths), whole.drop("loops"), whole.where("loops").drop("loops", "description", "upstream_blocks", "downstream_blocks")


def numbered_kinds(edge_rows: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(block_number, description, loops): the kind of each block by its rank, and whether it loops back on itself."""
    loops = reversed_loops(edge_rows, paths).withColumn("_l", F.lit(True))
    rows = ranked_blocks(paths, nodes).select("block", F.col("rank").alias("block_number")).join(classify_blocks(edge_rows, paths), "block").join(loops, "block", "left")
    return rows.select("block_number", F.col("kind").alias("description"), F.coalesce("_l", F.lit(False)).alias("loops"))


def gfa(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(part, name, line): S lines of all families, with a placeholder for the sequence, then L lines of canonical links."""
    s = nodes.select(F.lit(1).alias("part"), F.col("family").alias("name"), F.concat_ws("\t", F.lit("S"), "family", F.lit("A"), F.concat(F.lit("RC:i:"), F.col("n_genomes").cast("string"))).alias("line"))
    name = lambda c: F.regexp_replace(c, "-$", "")
    sign = lambda c: F.when(F.col(c).endswith("-"), "-").otherwise("+")
    line = F.concat_ws("\t", F.lit("L"), name("n1"), sign("n1"), name("n2"), sign("n2"), F.lit("0M"))
    return s.unionByName(links.select(F.lit(2).alias("part"), F.concat_ws(":", "n1", "n2").alias("name"), line.alias("line")))


def fastg(nodes: DataFrame, links: DataFrame, length: int = 200) -> DataFrame:
    """(name, line): a record for each canonical link: its two families with their genomes, and a placeholder sequence."""
    n = nodes.select("family", "n_genomes")
    plain = lambda c: F.regexp_replace(c, "-$", "")
    rows = links.join(n.toDF("_a", "_na"), plain("n1") == F.col("_a")).join(n.toDF("_b", "_nb"), plain("n2") == F.col("_b"))
    one = lambda c, k, m: F.concat(F.lit("EDGE_"), k, F.lit(f"_length_{length}_cov_"), F.col(m).cast("string"), F.when(F.col(c).endswith("-"), "'").otherwise(""))
    line = F.concat(F.lit(">"), one("n1", "_a", "_na"), F.lit(":"), one("n2", "_b", "_nb"), F.lit(";\n" + "N" * length))
    return rows.select(F.concat_ws(":", "n1", "n2").alias("name"), line.alias("line"))


def sort_families(table: DataFrame, order_rows: DataFrame, by_genomes: bool = False) -> DataFrame:
    """The family table with its order columns, sorted by block, then number of genomes if asked, then place; numbers as numbers.

    Families that the graph doesn't have, as those over its dosage, keep their rows: they come last, without a place.
    """
    joined = table.join(order_rows.select(F.col("family").alias("gene_family"), F.col("block").alias("cluster"), F.col("ord").alias("cluster_order")), "gene_family", "left")
    return joined.orderBy(F.asc_nulls_last("cluster"), *([F.desc("number_genomes")] if by_genomes else []), F.asc_nulls_last("cluster_order"), "gene_family")
