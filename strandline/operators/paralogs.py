"""Paralogs: which loci of a genome are copies and which are fragments, and how a family splits into single-copy alleles.

From hits a family is the unit of the pandas step. A family of many rows is split by rounds that count its genomes and
copies over all tasks, a smaller one by one task; aligned families are not held by any task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import Turns, checkpoint
from strandline.operators import sites
from strandline.operators.families import copy_id, doses, with_categories
from strandline.operators.filters import pair_coverage

# Fixed values of the rules: least coverage, bonus for neighbours and how near they are, and how short a sum may fall;
# the number of a locus whose name has none.
LEAST_COVERAGE, NEAR, NEAR_BONUS, WORST, NO_NUMBER = 10, 2, 0.20, -0.25, 100
# Of the family's genomes, by how much a round without a split lowers the demands.
STEP, STEP_MORE, STEP_MOST = 0.05, 0.0125, 0.25
ANY = 1 << 62  # copies: no limit
#: Rows of the loci list of a family that one task splits at most, of many families whose genomes a task counts, and of a
#: small side that is sent to all tasks.
ROWS, COUNTED, FEW = 100_000, 500_000, 20_000
ALIGNED_MOST = 0.75  # of either sequence's columns, that two fragments of one gene may share


def locus_number(locus: str) -> int:
    """The number at the end of a locus' name, which says where in its genome it stands."""
    found = re.search(r"_(\d+)$", locus)
    return int(found[1]) if found else NO_NUMBER


def _combinations(start: np.ndarray, end: np.ndarray, length: np.ndarray, number: np.ndarray, size: int, most: int) -> Iterator[tuple[float, tuple[int, ...]]]:
    """(score, members) of all combinations of 2 to `most` parts whose sum does not fall under the limit.

    A part that has new places of the reference gains nothing, but loses what its length differs from their number, and
    gains the bonus if it stands near the part before. The score is the sum less the places that no part covers. What
    cannot reach the limit, whatever follows, is not carried on.
    """
    worst, bonus, n = WORST * size, NEAR_BONUS * size, len(start)

    def grow(members: tuple[int, ...], covered: list[tuple[int, int]], total: float) -> Iterator[tuple[float, tuple[int, ...]]]:
        k = np.arange(members[-1] + 1, n)
        new = np.maximum(end[k] - start[k] + 1, 0)
        for a, b in covered:
            new = new - np.maximum(np.minimum(end[k], b) - np.maximum(start[k], a) + 1, 0)
        sums = total - np.abs(new - length[k]) + np.where(np.abs(number[k] - number[members[-1]]) <= NEAR, bonus, 0.0)
        for j in np.flatnonzero(sums + bonus * (most - len(members) - 1) >= worst):
            x, s = int(k[j]), float(sums[j])
            union = _union([*covered, (int(start[x]), int(end[x]))])
            if s >= worst:
                yield s - (size - sum(b - a + 1 for a, b in union)), (*members, x)
            if len(members) + 1 < most:
                yield from grow((*members, x), union, s)

    for x in range(n):
        first = -abs(max(int(end[x]) - int(start[x]) + 1, 0) - float(length[x]))
        if first + bonus * (most - 1) >= worst:
            yield from grow((x,), _union([(int(start[x]), int(end[x]))]), first)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[0] <= s[1]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def classify_family(rows: pd.DataFrame, hits: dict[tuple[str, str], tuple[int, int, float]], lengths: dict[str, int], most: int = 3) -> list[tuple[str, int, int, int]]:
    """(locus, mc, ff, ff_group) of one family. rows: locus, genome, rep; hits: (rep, rep) -> (start, end on the second, percent coverage).

    Two representatives overlap if they have a hit and the smaller coverage of the two directions is enough; those that
    don't may be parts of one gene. Within a genome, in locus order: a locus that overlaps all others is a copy. Else the
    longest representative that it overlaps, which may be its own, is the reference; of the others that overlap the
    reference but not the locus, none makes it a copy, one a pair of fragments, and several leave it for later. What is
    left is scored in combinations of 2 to `most` loci by what they cover of the last such reference; the best ones that
    share no locus are fragments, the rest are copies. A locus without a hit on the reference is in no combination.
    """
    reps = sorted(set(rows["rep"]), key=lambda r: (-lengths[r], r))

    def meet(a: str, b: str) -> bool:
        cover = [hits[x][2] for x in ((a, b), (b, a)) if x in hits]
        return a == b or bool(cover) and min(cover) >= LEAST_COVERAGE

    apart = {a for a in reps for b in reps if not meet(a, b)}
    own = lambda r: (1, lengths[r]) if r == reference else hits.get((r, reference), (0, -1))[:2]
    out: dict[str, tuple[int, int, int]] = {}
    for _, part in rows.groupby("genome", sort=True):
        loci = sorted(part["locus"])
        rep = dict(zip(part["locus"], part["rep"], strict=True))
        group, reference, done = 0, None, set()
        for x in loci:
            if x in done:
                continue
            if rep[x] not in apart:
                out[x] = (1, 0, 0)
                done.add(x)
                continue
            reference = next(r for r in reps if meet(r, rep[x]))
            partners = [y for y in loci if y not in done and meet(rep[y], reference) and not meet(rep[y], rep[x])]
            if not partners:
                out[x] = (1, 0, 0)
                done.add(x)
            elif len(partners) == 1:
                group += 1
                out[x] = out[partners[0]] = (0, 1, group)
                done |= {x, partners[0]}
        pool = [x for x in loci if x not in done]
        fit = [x for x in pool if rep[x] == reference or (rep[x], reference) in hits]
        if len(fit) > 1:
            spans = np.array([own(rep[x]) for x in fit], dtype=np.int64)
            sizes = np.array([lengths.get(x, lengths[rep[x]]) for x in fit], dtype=np.int64)
            scored = _combinations(spans[:, 0], spans[:, 1], sizes, np.array([locus_number(x) for x in fit]), lengths[reference], most)
            for _, members in sorted(scored, key=lambda c: (-c[0], c[1])):
                combo = {fit[k] for k in members}
                if not done & combo:
                    group += 1
                    out.update(dict.fromkeys(combo, (0, 1, group)))
                    done |= combo
        for x in loci:
            out.setdefault(x, (1, 0, 0))
    return [(x, *v) for x, v in sorted(out.items())]


def classify(members: DataFrame, hits: DataFrame, lengths: DataFrame, threshold: float = 50, most: int = 3) -> DataFrame:
    """Paralog categories (locus, family, genome, mc, ff, ff_group, length_cluster).

    members: (family, locus, genome, rep), rep the locus of the same length cluster that stands for it; hits between
    representatives in the columns of para_hits; lengths: (locus, length) of representatives, and of other loci where
    they are known. Only hits at or over the threshold count.
    """
    near = hits.where((F.col("pident") >= threshold) & (F.col("q") != F.col("s")))
    near = near.groupBy("q", "s").agg(F.min_by(F.struct("sstart", "send", "qcovs"), "qcovs").alias("h")).select("q", "s", "h.*")
    family = members.select("family", F.col("rep").alias("q")).distinct()
    near = near.join(family, "q").groupBy("family").agg(F.collect_list(F.struct("q", "s", "sstart", "send", "qcovs")).alias("hits"))
    sized = lengths.select("locus", F.col("length").alias("own_length"))
    rows = members.join(lengths.select(F.col("locus").alias("rep"), F.col("length").alias("rep_length")), "rep").join(sized, "locus", "left").join(near, "family", "left")
    # A family's hits go with one of its rows only.
    first = rows.groupBy("family").agg(F.min("locus").alias("first"))
    rows = rows.join(first, "family").withColumn("hits", F.when(F.col("locus") == F.col("first"), F.col("hits"))).drop("first")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for listed in part["hits"]:
            for h in listed if listed is not None else ():
                found[h["q"], h["s"]] = (h["sstart"], h["send"], h["qcovs"])
        sizes = dict(zip(part["rep"], part["rep_length"].astype(int), strict=True))
        known = part[part["own_length"].notna()]
        own = dict(zip(known["locus"], known["own_length"].astype(int), strict=True))
        order = {r: k + 1 for k, r in enumerate(sorted(sizes, key=lambda r: (-sizes[r], r)))}
        got = {x: v for x, *v in classify_family(part, found, own | sizes, most)}
        out = part[["locus", "family", "genome", "rep"]].copy()
        for k, c in enumerate(("mc", "ff", "ff_group")):
            out[c] = [got[x][k] for x in out["locus"]]
        out["length_cluster"] = [order[r] for r in out["rep"]]
        return out.drop(columns="rep")

    return rows.groupBy("family").applyInPandas(run, "locus string, family string, genome string, mc int, ff int, ff_group int, length_cluster int")


def classify_aligned(alignment: DataFrame, positions: DataFrame, overlap: float = 0.9) -> DataFrame:
    """As classify, from aligned families (family, locus, genome, aln) and places on contigs (locus, pos); a locus without one is at 0.

    Sequences whose filled columns agree in 90 percent or more of both are one length cluster, the shortest first. If all
    are one, or all are equally long, each locus of a genome with several is a copy with a number of its own. Else each
    genome's loci fall into groups, those that stand nearest to another first (sites.gene_groups()). A genome of several
    groups is multicopy, a group of several loci is one gene in fragments. No task holds a family or a genome.
    A null family or genome is one like any other, a null sequence has no filled column.
    """
    rows = alignment.select("family", "locus", "genome", sites.packed(F.col("aln")).alias("s")).select("family", "locus", "genome", "s.bits", "s.n")
    rows = checkpoint(rows.join(positions.select("locus", "pos"), "locus", "left").na.fill(0, ["pos"]))
    found = checkpoint(sites.length_clusters(rows, overlap))
    plain = found.groupBy("family").agg(((F.min("n") == F.max("n")) | (F.max("length_cluster") == 1)).alias("plain"))
    same = lambda x, y, *names: [x[c].eqNullSafe(y[c]) for c in names]
    rows = rows.join(found, same(rows, found, "family", "bits")).select(*(rows[c] for c in rows.columns), "length_cluster")
    genome = Window.partitionBy("family", "genome")
    along = genome.orderBy("pos", "locus")
    near = F.least(F.col("pos") - F.lag("pos").over(along), F.lead("pos").over(along) - F.col("pos"))  # of what is there
    rows = sites.gene_groups(rows.withColumn("near", F.coalesce(near, F.lit(0))), ALIGNED_MOST)
    rows = rows.join(plain, same(rows, plain, "family")).select(*(rows[c] for c in rows.columns), "plain")
    copies, fragments = F.max("genes").over(genome) > 1, F.count("*").over(Window.partitionBy("family", "genome", "genes")) > 1
    number = F.when(F.count("*").over(genome) > 1, F.row_number().over(genome.orderBy("locus"))).otherwise(0)
    choose = lambda x, y: F.when(F.col("plain"), x).otherwise(y).cast("int")
    return rows.select(
        "locus", "family", "genome", choose(F.lit(1), copies.cast("int")).alias("mc"), choose(F.lit(0), fragments.cast("int")).alias("ff"),
        choose(number, F.col("genes")).alias("ff_group"), choose(F.lit(1), F.col("length_cluster")).alias("length_cluster"))


def _lowered(genomes: int, n_cut: int, t_cut: int, cut_off: float) -> tuple[int, int] | None:
    """The demands a step lower; at the cut-off from the top again with any number of copies, and after those None."""
    was, i = n_cut, STEP
    while i <= STEP_MOST:
        n_cut, new = int(was - genomes * i), int(was + genomes * i)
        if n_cut < was:
            break
        i += STEP_MORE
    t_cut = t_cut if t_cut == ANY else new
    if n_cut <= int(genomes * cut_off) or n_cut == 1:
        return None if t_cut == ANY else (genomes, ANY)
    return n_cut, t_cut


def _chosen(counted: list[tuple[int, int]], genomes: int, n_cut: int, t_cut: int, cut_off: float, strict: bool) -> tuple[list[int], int, int]:
    """Which of the alleles, given as (genomes, copies) of what is left of them, are taken next, and the demands that they meet; none: the search ends."""
    while True:
        if strict:
            scored = [(0.0, k) for k, (g, t) in enumerate(counted) if g == t == genomes]
        else:
            scored = [(1 + (1 - g / genomes) + (t - g) / genomes, k) for k, (g, t) in enumerate(counted) if g >= n_cut and t <= t_cut and g > 1]
        if scored:
            least = min(scored)[0]
            return [k for s, k in scored if s == least], n_cut, t_cut
        lower = None if strict else _lowered(genomes, n_cut, t_cut, cut_off)
        if lower is None:
            return [], n_cut, t_cut
        n_cut, t_cut = lower


def _in_order(alleles: list, strict: bool) -> list:
    """Alleles (threshold, allele, ...) as their turn comes."""
    return sorted(alleles, key=lambda x: (-x[0] if strict else x[0], x[1]))


def split_family(rows: pd.DataFrame, cut_off: float = 0.75, strict: bool = False) -> dict[str, int]:
    """Locus -> group from 1, of one family with columns locus, threshold, allele, genome, copy (what counts as one gene copy).

    An allele above the lowest threshold is taken if it has nearly as many genomes as asked for and hardly more copies
    than genomes; the best score goes first, and of equal ones the lower threshold. If genomes are gone after that, the
    demands and the scores begin anew with the number left. A round that takes nothing lowers the demands by a step, down
    to the cut-off; then they begin once more at the top, with any number of copies allowed. The rest is the last group.
    """
    base = rows[rows["threshold"] == rows["threshold"].min()]
    left = dict(zip(base["locus"], zip(base["genome"], base["copy"], strict=True), strict=True))
    count = lambda loci: (len({left[x][0] for x in loci}), len({left[x] for x in loci}))
    above = rows[rows["threshold"] > rows["threshold"].min()]
    alleles = [x[2] for x in _in_order([(t, a, list(g["locus"])) for (t, a), g in above.groupby(["threshold", "allele"])], strict)]
    group_of: dict[str, int] = {}
    genomes = n_cut = t_cut = group = 0
    while left:
        remain, copies = count(left)
        if remain == 1 or remain == copies:
            break
        if remain != genomes:  # fewer genomes are left: the demands begin anew with their number
            genomes = n_cut = t_cut = remain
        taken, n_cut, t_cut = _chosen([count([x for x in loci if x in left]) for loci in alleles], genomes, n_cut, t_cut, cut_off, strict)
        if not taken:
            break
        for k in taken:
            here = [x for x in alleles[k] if x in left]
            group += bool(here)
            for x in here:
                group_of[x] = group
                left.pop(x, None)
    if left:
        group_of.update(dict.fromkeys(left, group + 1))
    return group_of


PATH = "array<struct<threshold: int, allele: string>>"
STATE = {"genomes": "bigint", "n_cut": "bigint", "t_cut": "bigint", "parts": "int", "left": f"array<{PATH}>", "taken": f"array<struct<path: {PATH}, part: int>>"}


def split_round(was, counted, cut_off: float, strict: bool) -> tuple:
    """The STATE of a family after the next round of split_family(), from the last one and (threshold, allele, g, t) of what is left.

    Loci of the same alleles are always taken together: `left` and `taken` are distinct lists of alleles, not loci. The
    count without a threshold is of all that is left. With nothing left the family is done.
    """
    alleles = _in_order([x for x in counted if x["threshold"] is not None], strict)
    remain, copies = next((x["g"], x["t"]) for x in counted if x["threshold"] is None)
    genomes, n_cut, t_cut, parts, left, taken = (was[c] for c in STATE)
    chosen: list[int] = []
    if remain > 1 and remain != copies:
        if remain != genomes:
            genomes = n_cut = t_cut = remain
        chosen, n_cut, t_cut = _chosen([(x["g"], x["t"]) for x in alleles], genomes, n_cut, t_cut, cut_off, strict)
    turn = {tuple(alleles[k][:2]): i for i, k in enumerate(chosen)}
    first = [min((turn[tuple(x)] for x in path if tuple(x) in turn), default=None) for path in left]
    part = {i: parts + n for n, i in enumerate(sorted({i for i in first if i is not None}), 1)}
    parts += len(part)
    taken = taken + [(path, part[i]) for path, i in zip(left, first, strict=True) if i is not None]
    left = [path for path, i in zip(left, first, strict=True) if i is None]
    if left and not chosen:
        parts, left, taken = parts + 1, [], taken + [(path, parts + 1) for path in left]
    return genomes, n_cut, t_cut, parts, left, taken


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _split_large(loci: DataFrame, tasks: int, cut_off: float, strict: bool) -> DataFrame:
    """(family, path, part, parts) of loci (family, genome, copy, path): the group of each list of alleles, and how many its family has.

    A round counts genomes and copies over so many tasks. What one task holds of a family are its alleles and their counts.
    """
    turns = Turns(loci.sparkSession, 2)
    step = F.udf(lambda was, counted: split_round(was, counted, cut_off, strict), f"struct<{", ".join(f"{c}: {t}" for c, t in STATE.items())}>")
    empty = {c: F.lit(0) for c in ("genomes", "n_cut", "t_cut", "parts")} | {"left": F.col("left"), "taken": F.array()}
    state = turns.put(loci.groupBy("family").agg(F.collect_set("path").alias("left")).select("family", *(empty[c].cast(t).alias(c) for c, t in STATE.items())))
    everything = F.array(F.lit(None).cast("struct<threshold: int, allele: string>"))
    while not (todo := state.where("size(left) > 0")).isEmpty():
        paths = _few(todo.select("family", F.explode("left").alias("path")))
        # Dealt out once; what follows needs no other order until there is a row for an allele.
        each = loci.join(paths, ["family", "path"]).repartition(tasks, "family", "genome").select("family", "genome", "copy", F.explode(F.concat(everything, "path")).alias("x"))
        each = each.groupBy("family", "x.threshold", "x.allele", "genome").agg(F.count_distinct("copy").alias("t"))
        counts = each.groupBy("family", "threshold", "allele").agg(F.count("*").alias("g"), F.sum("t").alias("t"))
        counts = counts.groupBy("family").agg(F.collect_list(F.struct("threshold", "allele", "g", "t")).alias("counted"))
        now = todo.join(counts, "family").select("family", step(F.struct(*STATE), "counted").alias("now")).select("family", "now.*")
        state = turns.put(now.unionByName(state.where("size(left) = 0")))
    return state.select("family", "parts", F.explode("taken").alias("x")).select("family", "x.path", "x.part", "parts")


def split(loci: DataFrame, categories: DataFrame | None = None, cut_off: float = 0.75, strict: bool = False, most: int = ROWS) -> DataFrame:
    """The loci list with families split: <family>_<group>, alleles <family>_<group>_<n> with the allele's own n.

    A family of one group keeps its names. One of over `most` rows is held by no task.
    """
    allele = F.struct(F.col("threshold").cast("int").alias("threshold"), "allele", "genome", copy_id().alias("copy"))
    listed = Turns(loci.sparkSession, 1).put(with_categories(loci, categories).groupBy("family", "locus").agg(F.collect_list(allele).alias("x")))
    size = listed.groupBy("family").agg(F.min(F.array_min("x.threshold")).alias("low"), F.sum(F.size("x")).alias("n"))
    large = checkpoint(size.where((F.col("n") > most) & F.col("family").isNotNull()))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        group = split_family(part, cut_off, strict)
        out = part[["locus", "family", "threshold", "allele", "genome"]].copy()
        if max(group.values()) > 1:
            out["family"] = out["family"] + "_" + out["locus"].map(group).astype(str)
            number = [re.search(r"_(\d+)$", a) for a in out["allele"]]
            out["allele"] = [f"{f}_{n[1]}" if n else f for f, n in zip(out["family"], number, strict=True)]
        return out

    columns = "locus string, family string, threshold int, allele string, genome string"
    n = large.agg(F.sum("n")).first()[0]
    if n is None:
        return listed.select("family", "locus", F.inline("x")).groupBy("family").applyInPandas(run, columns)
    # Sent to all tasks: of `most` rows there is one family at most.
    large = F.broadcast(large.drop("n"))
    small = listed.join(large, "family", "left_anti").select("family", "locus", F.inline("x")).groupBy("family").applyInPandas(run, columns)
    above = F.filter("x", lambda x: (x["threshold"] > F.col("low")) & x["allele"].isNotNull())
    path = F.array_sort(F.array_distinct(F.transform(above, lambda x: F.struct(x["threshold"].alias("threshold"), x["allele"].alias("allele")))))
    base = F.get(F.filter("x", lambda x: x["threshold"] == F.col("low")), F.lit(0))
    rows = listed.join(large, "family").select("family", "locus", "x", base.alias("base"), path.alias("path"))
    tasks = max(loci.sparkSession.sparkContext.defaultParallelism, -(-n // COUNTED))
    found = _split_large(rows.where("base is not null").select("family", "base.genome", "base.copy", "path"), tasks, cut_off, strict)
    rows = rows.join(_few(found), ["family", "path"], "left").withColumn("old", F.col("family")).withColumn("family", F.when(F.col("parts") > 1, F.concat("family", F.lit("_"), "part")).otherwise(F.col("family")))
    rows = rows.select("locus", "old", "family", F.inline("x"))
    number = F.regexp_extract("allele", r"(_\d+)$", 1)
    rows = rows.withColumn("allele", F.when(F.col("family") != F.col("old"), F.concat("family", number)).otherwise(F.col("allele")))
    return small.unionByName(rows.select("locus", "family", "threshold", "allele", "genome"))


def split_log(split_loci: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(family, line) of split families: the old name, then each group as `name(loci/genomes/copies)` in order of its number."""
    low = F.min("threshold").over(Window.partitionBy("family"))
    base = with_categories(split_loci.withColumn("_low", low).where("threshold = _low").drop("_low"), categories).withColumn("copy", F.concat_ws("|", "genome", copy_id()))
    each = base.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("genome").alias("g"), F.count_distinct("copy").alias("t"))
    text = F.concat("family", F.lit("("), F.concat_ws("/", *(F.col(c).cast("string") for c in "ngt")), F.lit(")"))
    number = F.coalesce(F.expr("try_cast(regexp_extract(family, '_([0-9]+)$', 1) as int)"), F.lit(0))
    rows = each.groupBy(F.regexp_replace("family", r"_\d+$", "").alias("old")).agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), text.alias("x")))).alias("groups"))
    return rows.select(F.col("old").alias("family"), F.concat_ws("\t", F.col("old"), F.array_join(F.transform("groups", lambda x: x["x"]), "\t")).alias("line"))


def best_scores(loci: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(family, threshold, allele): of each family's alleles above its lowest threshold and of several genomes, those of the best score.

    The score is that by which split_family() chooses: the share of the family's genomes that an allele lacks, and its
    copies beyond one a genome.
    """
    each = doses(loci, categories).groupBy("family", "threshold", "allele").agg(F.count("*").alias("g"), F.sum("dose").alias("t"))
    family = Window.partitionBy("family")
    each = each.withColumn("n", F.max("g").over(family)).withColumn("low", F.min("threshold").over(family)).where("threshold > low and g > 1")
    # Times n, so that whole numbers are compared: n * (1 + (1 - g / n) + (t - g) / n).
    return each.withColumn("r", F.rank().over(family.orderBy(2 * F.col("n") + F.col("t") - 2 * F.col("g")))).where("r = 1").select("family", "threshold", "allele")


def apart(representatives: DataFrame, hits: DataFrame) -> DataFrame:
    """(a, b, apart): each two representatives (cluster, locus) of a cluster, and whether they may be parts of one gene.

    They are apart without a hit, or if the smaller coverage of the two directions is under LEAST_COVERAGE percent.
    """
    r = representatives.select("cluster", "locus")
    pairs = r.toDF("cluster", "a").join(r.toDF("cluster", "b"), "cluster").where("a < b").select("a", "b")
    return pairs.join(pair_coverage(hits), ["a", "b"], "left").select("a", "b", F.coalesce(F.col("coverage") < LEAST_COVERAGE, F.lit(True)).alias("apart"))


def replaced(loci: DataFrame, split_loci: DataFrame, families: DataFrame) -> DataFrame:
    """The loci list without `families` (family), and split_loci in their place."""
    return loci.join(families, "family", "left_anti").select(*loci.columns).unionByName(split_loci.select(*loci.columns))


def truncation_groups(loci: DataFrame, categories: DataFrame | None, assigned: DataFrame) -> DataFrame:
    """(threshold, allele, genome, copies): gene copies of what is left after the assigned loci."""
    return doses(loci.join(assigned.select("locus"), "locus", "left_anti"), categories).select("threshold", "allele", "genome", F.col("dose").alias("copies"))
