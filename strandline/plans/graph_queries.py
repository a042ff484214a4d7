"""Queries on the synteny graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions.names import padded, shared_folder
from strandline.operators import families as fam
from strandline.operators import graph
from strandline.plans.projections import FEATURES, LIST, categories, features, info, loci_list, sql, table
from strandline.sources import sinks

QUERIES, SQL = {}, {}
# Contigs of a partition.
CONTIGS = 200_000


def query(name: str, parts: list[str], select: str | None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if select is not None:
            SQL[name] = sql(parts, select, recursive)
        return f

    return keep


EDGES = [*FEATURES, "edges"]
query("win_adjacent_genes", FEATURES, "SELECT * FROM adjacent")(lambda s, d: graph.adjacent(features(s, d)))
query("win_contig_position", FEATURES, "SELECT locus, row_number() OVER (PARTITION BY genome, contig ORDER BY pos) AS ordinal FROM features")(lambda s, d: graph.contig_positions(features(s, d)).select("locus", F.col("ordinal").cast("long").alias("ordinal")))
query("win_min_neighbour_dist", FEATURES, "SELECT family, genome, locus, least(pos - lag(pos) OVER o, lead(pos) OVER o - pos) AS nearest FROM features WINDOW o AS (PARTITION BY family, genome, contig ORDER BY pos)")(lambda s, d: graph.nearest_copies(features(s, d)))
query("win_intergenic", FEATURES, """, f AS (SELECT *, pos * 1000 AS start, pos * 1000 + length AS stop FROM features), g AS (SELECT genome, contig, pos, start, strand, lag(stop) OVER o AS e, lag(strand) OVER o AS b FROM f WINDOW o AS (PARTITION BY genome, contig ORDER BY start, pos))
SELECT genome, contig, pos, start - e - 1 AS gap, CASE WHEN b = '+' AND strand = '+' THEN 'CO_F' WHEN b = '-' AND strand = '-' THEN 'CO_R' WHEN b = '-' THEN 'DP' ELSE 'DT' END AS kind FROM g WHERE e IS NOT NULL""")(
    lambda s, d: graph.intergenic(features(s, d).withColumn("start", F.col("pos") * 1000).withColumn("end", F.col("pos") * 1000 + F.col("length"))))
query("graph_edges", EDGES, "SELECT * FROM edges")(lambda s, d: graph.edges(features(s, d)))
query("agg_edge_weight", EDGES, "SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY ALL")(lambda s, d: graph.edges(features(s, d)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
query("agg_graph_node_weight", EDGES, "SELECT *, n_loci / n_genomes AS dosage FROM nodes")(lambda s, d: graph.node_weights(features(s, d)))
query("graph_canonical_links", [*EDGES, "links"], "SELECT * FROM canonical")(lambda s, d: graph.canonical_links(features(s, d)))
query("graph_find_links", EDGES, """SELECT src AS family, list_sort(coalesce(list(DISTINCT dst || dst_side) FILTER (src_side = 'U'), [])) AS upstream, list_sort(coalesce(list(DISTINCT dst || dst_side) FILTER (src_side = 'D'), [])) AS downstream
FROM edges GROUP BY src""")(lambda s, d: graph.neighbours(graph.edges(features(s, d))))
query("sink_edges", EDGES, "SELECT src || chr(9) || dst || CASE WHEN dst_side = 'D' THEN '-' ELSE '' END || chr(9) || weight AS line FROM edges")(
    lambda s, d: graph.edge_lines(graph.edges(features(s, d))).select(F.concat_ws("\t", "n1", "n2", F.col("weight").cast("string")).alias("line")))
query("sink_gfa1", [*EDGES, "links"], """SELECT 1 AS part, family AS name, concat_ws(chr(9), 'S', family, 'A', 'RC:i:' || n_genomes) AS line FROM nodes
UNION ALL SELECT 2, n1 || ':' || n2, concat_ws(chr(9), 'L', rtrim(n1, '-'), CASE WHEN ends_with(n1, '-') THEN '-' ELSE '+' END, rtrim(n2, '-'), CASE WHEN ends_with(n2, '-') THEN '-' ELSE '+' END, '0M') FROM canonical""")(
    lambda s, d: graph.gfa(graph.node_weights(features(s, d)), graph.canonical_links(features(s, d))))
query("sink_fastg", [*EDGES, "links"], """SELECT n1 || ':' || n2 AS name, '>EDGE_' || a.family || '_length_200_cov_' || a.n_genomes || CASE WHEN ends_with(n1, '-') THEN chr(39) ELSE '' END || ':EDGE_' || b.family || '_length_200_cov_' || b.n_genomes
    || CASE WHEN ends_with(n2, '-') THEN chr(39) ELSE '' END || ';' || chr(10) || repeat('N', 200) AS line FROM canonical JOIN nodes a ON a.family = rtrim(n1, '-') JOIN nodes b ON b.family = rtrim(n2, '-')""")(
    lambda s, d: graph.fastg(graph.node_weights(features(s, d)), graph.canonical_links(features(s, d))))


def synteny(s, d):
    """Orders as genomes whose order of genes is mostly the same: (genome, contig, pos, strand, family).

    Fifty order numbers are a segment of twelve families, and each customer among them has a contig of it. In some
    segments some genomes lack a family, have four turned round, have the contig twice over, or a family inserted that
    is the same everywhere.
    """
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("c"), F.expr("o_orderkey div 50").alias("s"))
    parts = max(s.sparkContext.defaultParallelism, orders.count() // CONTIGS)
    # Contigs of a name lie together: neighbours are found where they are, and links of a segment counted before they are dealt out.
    of = orders.select("c", "s", F.concat(F.lit("u"), F.col("c").cast("string")).alias("genome"), F.concat(F.lit("k"), F.col("s").cast("string")).alias("contig")).repartition(parts, "contig").dropDuplicates(["genome", "contig"])
    of = of.withColumn("segment", F.concat(F.lit("s"), padded(F.col("s"), 4), F.lit("_")))
    rows = of.withColumn("j", F.explode(F.expr("sequence(0, if(s % 4 = 0 and c % 3 = 0, 12, 11))"))).where("not (s % 3 = 0 and c % 5 = 0 and j = 6)")
    turned = F.expr("s % 3 = 1 and c % 7 = 0 and j between 4 and 7")
    rows = rows.withColumn("again", F.explode(F.expr("if(s % 3 = 2 and c % 4 = 0 and j < 12, array(0, 40), array(0))")))
    more = F.col("j") == 12
    pos = F.when(more, 7).when(turned, 22 - 2 * F.col("j")).otherwise(2 * F.col("j")) + F.col("again")
    family = F.when(more, "t").otherwise(F.concat("segment", F.lpad(F.col("j").cast("string"), 2, "0")))
    return rows.select("genome", "contig", pos.cast("long").alias("pos"), F.when(turned, "-").otherwise("+").alias("strand"), family.alias("family"))


SYNTENY = """sized AS (SELECT DISTINCT o_custkey AS c, o_orderkey // 50 AS s FROM orders
), turned AS (
    SELECT c, s, j, again, s % 3 = 1 AND c % 7 = 0 AND j BETWEEN 4 AND 7 AS turn
    FROM (SELECT c, s, j, unnest(CASE WHEN s % 3 = 2 AND c % 4 = 0 THEN [0, 40] ELSE [0] END) AS again FROM (SELECT c, s, unnest(range(0, 12)) AS j FROM sized)) WHERE NOT (s % 3 = 0 AND c % 5 = 0 AND j = 6)
), genes AS (
    SELECT 'u' || c AS genome, 'k' || s AS contig, CASE WHEN turn THEN 22 - 2 * j ELSE 2 * j END + again AS pos, CASE WHEN turn THEN '-' ELSE '+' END AS strand, format('s{:04d}_{:02d}', s, j) AS family FROM turned
    UNION ALL SELECT 'u' || c, 'k' || s, 7, '+', 't' FROM sized WHERE s % 4 = 0 AND c % 3 = 0
), steps AS (
    SELECT family, strand, lag(family) OVER o AS before, lag(strand) OVER o AS strand_before FROM genes WINDOW o AS (PARTITION BY genome, contig ORDER BY pos)
), met AS (SELECT before, family, CASE WHEN strand_before = '+' THEN 'D' ELSE 'U' END AS leave, CASE WHEN strand = '+' THEN 'U' ELSE 'D' END AS enter FROM steps WHERE before <> family
), ways AS (SELECT DISTINCT * FROM (SELECT before AS src, leave AS src_side, family AS dst, enter AS dst_side FROM met UNION ALL SELECT family, enter, before, leave FROM met)
), sizes AS (SELECT family, count(DISTINCT genome) AS n_genomes FROM genes GROUP BY family
), single AS (SELECT src, src_side, first(dst) AS dst, first(dst_side) AS dst_side FROM ways GROUP BY src, src_side HAVING count(*) = 1
), mutual AS (
    SELECT a.* FROM single a JOIN single b ON a.src = b.dst AND a.src_side = b.dst_side AND a.dst = b.src AND a.dst_side = b.src_side
    JOIN sizes x ON x.family = a.src JOIN sizes y ON y.family = a.dst WHERE x.n_genomes = y.n_genomes
), reach(a, b) AS (SELECT src, dst FROM mutual UNION SELECT r.a, m.dst FROM reach r JOIN mutual m ON r.b = m.src
), least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a
), blocks AS (SELECT family, least(family, coalesce(b, family)) AS block FROM sizes LEFT JOIN least_of ON a = family
), begun AS (
    SELECT block, coalesce(min(family) FILTER (n < 2), min(family)) AS start FROM (SELECT block, family, (SELECT count(*) FROM mutual WHERE src = family) AS n FROM blocks) GROUP BY block
), walk(block, family, side, ord, start) AS (
    SELECT block, start, CASE WHEN EXISTS (SELECT 1 FROM mutual WHERE src = start AND src_side = 'U') AND NOT EXISTS (SELECT 1 FROM mutual WHERE src = start AND src_side = 'D') THEN 'U' ELSE 'D' END, 1, start FROM begun
    UNION ALL SELECT block, dst, CASE WHEN dst_side = 'U' THEN 'D' ELSE 'U' END, ord + 1, start FROM walk JOIN mutual ON src = family AND src_side = side WHERE dst <> start
), paths AS (SELECT block, family, ord, side = 'U' AS reversed FROM walk
), """


def _ends(paths: str, ends: str, out: str) -> str:
    """The free ends of paths and the links that leave them, under these names."""
    return f"""{ends} AS (
    SELECT block, family, CASE WHEN reversed THEN 'D' ELSE 'U' END AS side, 0 AS stop FROM {paths} WHERE ord = 1
    UNION ALL SELECT block, family, CASE WHEN reversed THEN 'U' ELSE 'D' END, 1 FROM {paths} QUALIFY ord = max(ord) OVER (PARTITION BY block)
), {out} AS (
    SELECT e.block, stop, e.family, dst AS to_family, dst_side AS to_side, p.block AS other FROM {ends} e JOIN ways ON src = e.family AND src_side = side JOIN {paths} p ON p.family = dst
)"""


CONNECTED = SYNTENY + _ends("paths", "ends", "leaving") + """, weights AS (SELECT block, max(n_genomes) AS n, count(*) AS length FROM paths JOIN sizes USING (family) GROUP BY block
), one AS (
    SELECT l.block, stop, first(other) AS other, first(to_family) AS to_family, first(to_side) AS to_side FROM leaving l JOIN weights x ON x.block = l.block JOIN weights y ON y.block = other
    WHERE l.block <> other AND x.n = y.n GROUP BY l.block, stop HAVING count(*) = 1
), led AS (SELECT one.block, one.stop, other, e.stop AS other_stop FROM one JOIN ends e ON e.block = other AND e.family = to_family AND e.side = to_side
), meet AS (SELECT a.* FROM led a JOIN led b ON a.block = b.other AND a.stop = b.other_stop AND a.other = b.block AND a.other_stop = b.stop
), hops(a, b) AS (SELECT block, other FROM meet UNION SELECT h.a, m.other FROM hops h JOIN meet m ON h.b = m.block
), least_hop AS (SELECT a, min(b) AS b FROM hops GROUP BY a
), joined AS (SELECT block, least(block, coalesce(b, block)) AS joined FROM weights LEFT JOIN least_hop ON a = block
), outset AS (
    SELECT joined, coalesce(min(block) FILTER (n < 2), min(block)) AS start, count(*) FILTER (n < 2) > 0 AS open FROM (SELECT joined, block, (SELECT count(*) FROM meet WHERE meet.block = joined.block) AS n FROM joined) GROUP BY joined
), trail(joined, block, leave, before, start) AS (
    SELECT joined, start, CASE WHEN open AND EXISTS (SELECT 1 FROM meet WHERE block = start AND stop = 0) THEN 0 ELSE 1 END, 0::BIGINT, start FROM outset
    UNION ALL SELECT t.joined, m.other, 1 - m.other_stop, t.before + w.length, t.start FROM trail t JOIN meet m ON m.block = t.block AND m.stop = t.leave JOIN weights w ON w.block = t.block WHERE m.other <> t.start
), connected AS (
    SELECT t.joined AS block, family, CAST(before + CASE WHEN leave = 0 THEN length + 1 - ord ELSE ord END AS INT) AS ord, reversed <> (leave = 0) AS reversed FROM trail t JOIN paths p ON p.block = t.block JOIN weights w ON w.block = t.block
), """ + _ends("connected", "last_ends", "last_leaving")
RANKED = """, ranked AS (SELECT block, n_genomes, length, row_number() OVER (ORDER BY n_genomes DESC, length DESC, block) AS rank
    FROM (SELECT block, max(n_genomes) AS n_genomes, count(*) AS length FROM {0} JOIN sizes USING (family) GROUP BY block))"""


def _synteny(s, d):
    rows = synteny(s, d)
    return graph.checkpointed(graph.edges(rows)), graph.checkpointed(graph.node_weights(rows))


def _paths(s, d):
    e, n = _synteny(s, d)
    return e, n, graph.checkpointed(graph.block_paths(e, n))


def _connected(s, d):
    e, n, p = _paths(s, d)
    return e, n, graph.checkpointed(graph.connected_paths(e, n, p))


def blocks_query(name: str, text: str):
    return query(name, [], "WITH RECURSIVE " + text)


blocks_query("graph_syntenic_blocks", SYNTENY + "done AS (SELECT 1)\nSELECT * FROM blocks")(lambda s, d: graph.blocks(*_synteny(s, d)))
blocks_query("graph_block_paths", SYNTENY + "done AS (SELECT 1)\nSELECT * FROM paths")(lambda s, d: graph.block_paths(*_synteny(s, d)))
blocks_query("graph_join_blocks", CONNECTED + "\nSELECT * FROM joined")(lambda s, d: graph.joined_blocks(*_paths(s, d)))
blocks_query("graph_connect_blocks", CONNECTED + "\nSELECT * FROM connected")(lambda s, d: graph.connected_paths(*_paths(s, d)))
blocks_query("graph_reversed_loops", CONNECTED + """
SELECT DISTINCT l.block FROM last_leaving l JOIN last_ends e ON e.block = l.block AND e.family = to_family AND e.stop <> l.stop WHERE l.block = l.other AND l.family <> to_family""")(lambda s, d: (lambda e, n, p: graph.reversed_loops(e, p))(*_connected(s, d)))  # fmt: skip
blocks_query("graph_classify_blocks", CONNECTED + """, counted AS (
    SELECT b.block, count(*) FILTER (stop = 0 AND other <> b.block) AS n_up, count(*) FILTER (stop = 1 AND other <> b.block) AS n_down, max(other) FILTER (stop = 0 AND other <> b.block) AS up, max(other) FILTER (stop = 1 AND other <> b.block) AS down,
        count(*) FILTER (other = b.block) > 0 AS own FROM (SELECT DISTINCT block FROM connected) b LEFT JOIN last_leaving l ON l.block = b.block GROUP BY b.block)
SELECT block, n_up, n_down, CASE WHEN own THEN 'self-loop;' ELSE '' END || CASE WHEN n_up = 1 AND n_down = 1 THEN CASE WHEN up = down THEN 'insertion(loop)' ELSE 'insertion' END
    WHEN n_up > 5 OR n_down > 5 THEN 'superconnector' ELSE 'multiconnector' END AS kind FROM counted""")(lambda s, d: (lambda e, n, p: graph.classify_blocks(e, p))(*_connected(s, d)))  # fmt: skip
blocks_query("graph_order", CONNECTED + RANKED.format("connected") + "\nSELECT family, CAST(rank AS INT) AS block, ord FROM connected JOIN ranked USING (block)")(lambda s, d: (lambda e, n, p: graph.order(p, n))(*_connected(s, d)))
blocks_query("sort_blocks", SYNTENY + "done AS (SELECT 1)" + RANKED.format("paths") + "\nSELECT block, n_genomes, length, rank FROM ranked")(lambda s, d: (lambda e, n, p: graph.ranked_blocks(p, n))(*_paths(s, d)))
blocks_query("sink_blocks", CONNECTED + RANKED.format("connected") + """, named AS (
    SELECT block, string_agg(family || CASE WHEN reversed THEN '-' ELSE '' END, ',' ORDER BY ord) AS clusters FROM connected GROUP BY block
), sides AS (
    SELECT block, count(DISTINCT x) FILTER (stop = 0) AS n_up, count(DISTINCT x) FILTER (stop = 1) AS n_down, string_agg(DISTINCT x, ',' ORDER BY x) FILTER (stop = 0) AS up, string_agg(DISTINCT x, ',' ORDER BY x) FILTER (stop = 1) AS down
    FROM (SELECT block, stop, to_family || CASE WHEN to_side = 'D' THEN '-' ELSE '' END AS x FROM last_leaving) GROUP BY block)
SELECT rank AS block_number, n_genomes AS number_isolates, length AS number_clusters_in_block, clusters AS clusters_in_block, coalesce(n_up, 0) AS number_upstream_links, coalesce(n_down, 0) AS number_downstream_links,
    coalesce(up, 'NA') AS upstream_links, coalesce(down, 'NA') AS downstream_links FROM ranked JOIN named USING (block) LEFT JOIN sides USING (block)""")(lambda s, d: graph.block_lines(*(lambda e, n, p: (e, n, p))(*_connected(s, d))))  # fmt: skip



def _block_text(paths: str, leaving: str) -> str:
    """The tables ranked_, named_ and sides_ of blocks by their paths and the links that leave them."""
    return RANKED.format(paths).replace("ranked", f"ranked_{paths}") + f""", named_{paths} AS (
    SELECT block, string_agg(family || CASE WHEN reversed THEN '-' ELSE '' END, ',' ORDER BY ord) AS clusters FROM {paths} GROUP BY block
), sides_{paths} AS (
    SELECT l.block, count(*) FILTER (stop = 0) AS n_up, count(*) FILTER (stop = 1) AS n_down, string_agg(x, ',' ORDER BY x) FILTER (stop = 0) AS up, string_agg(x, ',' ORDER BY x) FILTER (stop = 1) AS down,
        string_agg(CAST(rank AS VARCHAR), ',' ORDER BY x) FILTER (stop = 0) AS up_blocks, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY x) FILTER (stop = 1) AS down_blocks
    FROM (SELECT DISTINCT block, stop, other, to_family || CASE WHEN to_side = 'D' THEN '-' ELSE '' END AS x FROM {leaving}) l JOIN ranked_{paths} r ON r.block = l.other GROUP BY l.block
), text_{paths} AS (
    SELECT block, rank, concat_ws(chr(9), rank, n_genomes, length, clusters, coalesce(n_up, 0), coalesce(n_down, 0)) AS head, coalesce(up_blocks, 'NA') || chr(9) || coalesce(down_blocks, 'NA') AS led, coalesce(up, 'NA') || chr(9) || coalesce(down, 'NA') AS links
    FROM ranked_{paths} JOIN named_{paths} USING (block) LEFT JOIN sides_{paths} USING (block))"""


@blocks_query("sink_block_files", CONNECTED + _block_text("paths", "leaving") + _block_text("connected", "last_leaving") + """, loops AS (
    SELECT DISTINCT l.block FROM last_leaving l JOIN last_ends e ON e.block = l.block AND e.family = to_family AND e.stop <> l.stop WHERE l.block = l.other AND l.family <> to_family
), counted AS (
    SELECT b.block, count(*) FILTER (stop = 0 AND other <> b.block) AS n_up, count(*) FILTER (stop = 1 AND other <> b.block) AS n_down, max(other) FILTER (stop = 0 AND other <> b.block) AS up, max(other) FILTER (stop = 1 AND other <> b.block) AS down,
        count(*) FILTER (other = b.block) > 0 AS own FROM (SELECT DISTINCT block FROM connected) b LEFT JOIN last_leaving l ON l.block = b.block GROUP BY b.block
), kinds AS (
    SELECT block, CASE WHEN own THEN 'self-loop;' ELSE '' END || CASE WHEN n_up = 1 AND n_down = 1 THEN CASE WHEN up = down THEN 'insertion(loop)' ELSE 'insertion' END WHEN n_up > 5 OR n_down > 5 THEN 'superconnector' ELSE 'multiconnector' END AS kind FROM counted)
SELECT 'syntenic_blocks' AS file, head || chr(9) || links AS line FROM text_paths
UNION ALL SELECT 'connected_blocks', concat_ws(chr(9), head, led, links, kind) FROM text_connected JOIN kinds USING (block)
UNION ALL SELECT 'reversed', head || chr(9) || links FROM text_connected JOIN loops USING (block)
UNION ALL SELECT 'order', concat_ws(chr(9), family, rank, ord) FROM connected JOIN ranked_connected USING (block)""")  # fmt: skip
def sink_block_files(s, d):
    """(file, line): the four files of blocks, read back without their headers."""
    e, n, p = _paths(s, d)
    c = graph.checkpointed(graph.connected_paths(e, n, p))
    sinks.blocks(*graph.block_files(e, n, p, c), graph.order(c, n), at := f"{shared_folder(s)}/blocks-{uuid.uuid4().hex}")
    each = s.read.option("recursiveFileLookup", True).text(at).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("file"), F.col("value").alias("line"))
    return each.where("line not like 'block_number%'")


def _order(s, d):
    f = features(s, d).select("family").distinct()
    return f.select("family", F.expr("cast(substring(family, 2) as int) % 5").cast("int").alias("block"), F.expr("cast(substring(family, 2) as int) div 5").cast("int").alias("ord"))


query("sort_graph_order", LIST, """, t AS (SELECT family AS gene_family, count(DISTINCT genome) AS number_genomes, CAST(substr(family, 2) AS INT) % 5 AS cluster, CAST(substr(family, 2) AS INT) // 5 AS cluster_order FROM loci_list WHERE threshold = 50 GROUP BY family)
SELECT *, row_number() OVER (ORDER BY cluster, number_genomes DESC, cluster_order) AS row FROM t""")(
    lambda s, d: graph.sort_families(fam.genomes_per_allele(loci_list(s, d)).where("threshold = 50").select(F.col("family").alias("gene_family"), F.col("n_genomes").alias("number_genomes")), _order(s, d), True).selectExpr(
        "*", "row_number() over (order by cluster, number_genomes desc, cluster_order) row"))
query("join_order", LIST, """SELECT DISTINCT family AS gene_family, CAST(substr(family, 2) AS INT) % 5 AS cluster, CAST(substr(family, 2) AS INT) // 5 AS cluster_order FROM loci_list""")(
    lambda s, d: graph.sort_families(loci_list(s, d).select(F.col("family").alias("gene_family")).distinct(), _order(s, d)))
TABLE = [*LIST, "categories", "doses", "stats", "children", "unique_alleles", "family_rows", "names", "lengths", "at_top", "table"]
query("sink_ordered_table", TABLE, """SELECT allele AS allele_name, family AS gene_family, * EXCLUDE (allele, family), CASE WHEN family < 'g00040' THEN CAST(substr(family, 2) AS INT) % 5 END AS cluster,
CASE WHEN family < 'g00040' THEN CAST(substr(family, 2) AS INT) // 5 END AS cluster_order FROM family_table""")(
    lambda s, d: graph.sort_families(fam.family_table(loci_list(s, d), info(s, d), categories(s, d)), _order(s, d).where("family < 'g00040'")))
