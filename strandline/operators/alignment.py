"""Alignments: center-star per family, back-translation, concatenation over families, and distinct sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.names import checkpoint, numbered
from strandline.operators import sites

#: Sequences of a block whose columns are held against each other, so many columns at once.
PAIRS, COLUMNS = 2048, 8192
#: Sequences of a small family's block, partitions that blocks are dealt into at most, and pairs of a batch of rows.
FEW_PAIRS, PRODUCTS, OVERLAPS = 256, 2048, 1 << 16
#: Distinct sequences of a family that one task aligns, and places of a matrix that it holds for a pair.
ROWS, CELLS = 1024, 1 << 22
#: Names that are sent to all tasks at most.
FEW = 20_000


def _score_row(above: np.ndarray, hit: np.ndarray, ramp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next row of a matrix of scores, and what each place gets from the diagonal; hit is 2 where letters are equal, else -1."""
    diag = above[:-1] + hit
    best = np.concatenate((above[:1] - 2, np.maximum(diag, above[1:] - 2)))
    return np.maximum.accumulate(best + ramp) - ramp, diag


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    ramp = 2 * np.arange(len(y) + 1)
    row = -ramp
    for c in x:
        row = _score_row(row, np.where(y == c, 2, -1), ramp)[0]
    return row


def _steps(x: np.ndarray, y: np.ndarray, cells: int) -> list[int]:
    """The steps of a best alignment: 1 a letter of both, 2 of x alone, 3 of y alone."""
    n, m = len(x), len(y)
    short = min(n, m)
    head = int(np.argmin(np.append(x[:short] == y[:short], False)))
    tail = int(np.argmin(np.append(x[::-1][: short - head] == y[::-1][: short - head], False)))
    if head or tail:
        return [1] * head + _steps(x[head : n - tail], y[head : m - tail], cells) + [1] * tail
    if not n or not m:
        return [2] * n + [3] * m
    if n * m > cells and n > 1:
        half = n // 2
        cut = int(np.argmax(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
        return _steps(x[:half], y[:cut], cells) + _steps(x[half:], y[cut:], cells)
    ramp = 2 * np.arange(m + 1)
    row, back = -ramp, np.full((n + 1, m + 1), 3, dtype=np.int8)
    back[1:, 0] = 2
    for i in range(n):
        up = row[1:] - 2
        row, diag = _score_row(row, np.where(y == x[i], 2, -1), ramp)
        back[i + 1, 1:] = np.where(row[1:] == diag, 1, np.where(row[1:] == up, 2, 3))
    i, j, out = n, m, []
    while i or j:
        out.append(step := int(back[i, j]))
        i, j = i - (step != 3), j - (step != 2)
    return out[::-1]


def pair_gaps(a: str, b: str, cells: int = CELLS) -> tuple[str, str]:
    """Both sequences with gaps, aligned globally: match 2, mismatch -1, gap -2.

    A matrix has `cells` places at most, or a row: beyond that the first half of a goes with the part of b that gives the
    best sum of both halves' scores, so memory follows the lengths and not their product.
    """
    p, q, i, j = [], [], 0, 0
    for step in _steps(np.frombuffer(a.encode("utf-32-le"), "<u4"), np.frombuffer(b.encode("utf-32-le"), "<u4"), cells):
        p.append(a[i] if step != 3 else "-")
        q.append(b[j] if step != 2 else "-")
        i, j = i + (step != 3), j + (step != 2)
    return "".join(p), "".join(q)


def center_star(seqs: dict[str, str]) -> dict[str, str]:
    """All sequences with gaps, of equal length: each is aligned with the longest, whose gaps are merged. One sequence stays as it is."""
    if len(seqs) < 2:
        return dict(seqs)
    names = sorted(seqs, key=lambda x: (-len(seqs[x]), x))
    center = seqs[names[0]]
    pairs = {x: pair_gaps(center, seqs[x]) for x in names[1:]}
    gaps = [0] * (len(center) + 1)  # the most gaps that any pair puts before each place of the center
    for c, _ in pairs.values():
        at = n = 0
        for ch in c:
            if ch == "-":
                n += 1
            else:
                gaps[at] = max(gaps[at], n)
                at, n = at + 1, 0
        gaps[at] = max(gaps[at], n)
    out = {names[0]: "".join("-" * gaps[k] + ch for k, ch in enumerate(center)) + "-" * gaps[len(center)]}
    for x, (c, s) in pairs.items():
        parts, at, held = [], 0, []
        for ch, other in zip(c + "\0", s + "\0", strict=True):
            if ch == "-":
                held.append(other)
                continue
            parts.append("".join(held) + "-" * (gaps[at] - len(held)))
            held = []
            if ch != "\0":
                parts.append(other)
            at += 1
        out[x] = "".join(parts)
    return out


def against_center(center: str, seq: str) -> tuple[str, list[int], list[int]]:
    """seq aligned with center, the places of center before which it has letters of its own, and how many."""
    own, aligned = pair_gaps(center, seq)
    x = np.frombuffer(own.encode("utf-32-le"), "<u4") == ord("-")
    place = np.cumsum(~x)[x]  # letters of center before each gap in it
    at, n = np.unique(place, return_counts=True)
    return aligned, at.tolist(), n.tolist()


def widened(aligned: str, own: dict[int, int], gaps: list[tuple[int, int]]) -> str:
    """A sequence of against_center() with room at all places of a family's gaps, (place, letters) in order."""
    parts, last, letters = [], 0, 0
    for place, most in gaps:
        letters += (n := own.get(place, 0))
        parts += [aligned[last : place + letters], "-" * (most - n)]
        last = place + letters
    return "".join(parts) + aligned[last:]


def aligned_rows(rows: DataFrame, text: Column) -> DataFrame:
    """rows with aln, as center_star() of each family's text, but with no task that holds a family; null counts as empty.

    A family's distinct texts are aligned with its longest in parts of ROWS. What comes back to a family is the most
    letters before each place of its longest text; with that, each text is widened by itself. Rows without a family are one.
    """
    rows = rows.withColumn("_text", F.coalesce(text, F.lit("")))
    each = rows.groupBy(F.col("family").alias("_family"), "_text").agg(F.min("locus").alias("_first"))
    order = F.struct(-F.length("_text"), "_first", "_text")
    center = each.groupBy(F.col("_family").alias("_of")).agg(F.min_by("_text", order).alias("_center"), F.ceil(F.count("*") / F.lit(ROWS)).alias("_parts"))
    dealt = each.join(center, F.col("_family").eqNullSafe(F.col("_of"))).withColumn("_part", F.pmod(F.xxhash64("_text"), F.col("_parts")))
    dealt = dealt.repartition("_family", "_part").select("_family", "_text", "_center")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, texts, centers = batch.columns
            got = [against_center(c, t) for t, c in zip(texts.to_pylist(), centers.to_pylist(), strict=True)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([family, texts, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], ints), pa.array([x[2] for x in got], ints)], names=["_family", "_text", "_aln", "_at", "_n"])

    kind = each.schema["_family"].dataType.simpleString()
    pairs = checkpoint(dealt.mapInArrow(pair, f"_family {kind}, _text string, _aln string, _at array<int>, _n array<int>"))
    runs = pairs.select("_family", F.explode(F.arrays_zip("_at", "_n")).alias("x")).groupBy("_family", F.col("x._at").alias("at")).agg(F.max("x._n").alias("n"))
    gaps = runs.groupBy(F.col("_family").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("_gaps"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, texts, aligned, at, n, gaps = batch.columns
            rooms = ([(x["at"], x["n"]) for x in g or ()] for g in gaps.to_pylist())
            out = [widened(x, dict(zip(p, k, strict=True)), g) for x, p, k, g in zip(aligned.to_pylist(), at.to_pylist(), n.to_pylist(), rooms, strict=True)]
            yield pa.RecordBatch.from_arrays([family, texts, pa.array(out, pa.string())], names=["_of", "_texts", "aln"])

    wide = pairs.join(gaps, F.col("_family").eqNullSafe(F.col("_of")), "left").drop("_of").mapInArrow(widen, f"_of {kind}, _texts string, aln string")
    return rows.drop("aln").join(wide, F.col("family").eqNullSafe(F.col("_of")) & (F.col("_text") == F.col("_texts"))).drop("_text", "_of", "_texts")


def align_families(rows: DataFrame, kernel=None) -> DataFrame:
    """(family, locus, genome, aln) of (family, locus, genome, seq). Another kernel, from names to sequences, takes a family at a time."""
    if kernel is None:
        return aligned_rows(rows.select("family", "locus", "genome", "seq"), F.col("seq")).select("family", "locus", "genome", "aln")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        got = kernel(dict(zip(part["locus"], part["seq"], strict=True)))
        return part[["family", "locus", "genome"]].assign(aln=part["locus"].map(got))

    return rows.groupBy("family").applyInPandas(run, "family string, locus string, genome string, aln string")


def thread_codons(aligned: str, nucleotides: str) -> str:
    """Codons in place of an aligned protein's letters, which leaves out the first codon and the stop; those frame the result. Under two codons: as it is."""
    codons = [nucleotides[k : k + 3] for k in range(0, len(nucleotides), 3)]
    if len(codons) < 2:
        return nucleotides
    inner = iter(codons[1:-1])
    return codons[0] + "".join("---" if a == "-" else next(inner) for a in aligned) + codons[-1]


def back_translate(rows: DataFrame, kernel=None) -> DataFrame:
    """(family, locus, genome, aln) of (family, locus, genome, seq, protein): proteins are aligned, then codons threaded back in. Without gaps it is seq."""
    rows = rows.select("family", "locus", "genome", F.coalesce("seq", F.lit("")).alias("_codons"), F.expr("substring(coalesce(protein, ''), 2, greatest(length(protein) - 2, 0))").alias("seq"))
    if kernel is None:
        got = aligned_rows(rows, F.col("seq"))
    else:
        got = align_families(rows, kernel).join(rows.select("family", "locus", "genome", "_codons").distinct(), ["family", "locus", "genome"])
    thread = F.pandas_udf(lambda aligned, seqs: pd.Series([thread_codons(a, x) for a, x in zip(aligned, seqs, strict=True)], dtype=object), "string")
    return got.select("family", "locus", "genome", thread("aln", "_codons").alias("aln"))


def _letters(aln: Column, gaps: str) -> Column:
    return F.length(F.translate(aln, gaps, ""))


def slim(aligned: DataFrame) -> DataFrame:
    """aligned with its gaps at the end left out, and the whole length as _width: what is dealt out and sorted follows the letters, not the families' widths."""
    # One pass over runs of gaps.
    return aligned.withColumns({"_width": F.length("aln"), "aln": F.regexp_replace("aln", r"(?<!-)-++\z", "")})


def full(rows: DataFrame) -> DataFrame:
    """The rows of slim() with their gaps again."""
    return rows.withColumn("aln", F.rpad("aln", F.col("_width"), F.lit("-"))).drop("_width")


def _firsts(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """rows, one for each of the keys: the largest size, the first locus of ties, with n, how many there are. Texts are not sorted, only met again."""
    at = F.struct((-size).alias("m"), "locus")
    best = checkpoint(rows.select(*keys, at.alias("_at")).groupBy(*keys).agg(F.min("_at").alias("_at"), F.count("*").alias("n")))
    best = best.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_at.locus").alias("_locus"), "n")
    if best.count() <= FEW:
        best = F.broadcast(best)
    # A genome may be null; a locus never is.
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = rows.join(best, [F.col("locus") == F.col("_locus"), *same]).drop("_locus", *(f"_{k}" for k in keys))
    return met.dropDuplicates([*keys, "locus"])


def longest_per_genome(aligned: DataFrame, gaps: str = "-N") -> DataFrame:
    """(family, genome, locus, aln, n): the sequence with the most letters but `gaps`, the first locus of ties, and how many there are.

    Of rows of slim(), which are read twice, as they are.
    """
    rows = aligned if "_width" in aligned.columns else checkpoint(slim(aligned.select("family", "genome", "locus", "aln")))
    return full(_firsts(rows, ["family", "genome"], _letters(F.col("aln"), gaps))).select("family", "genome", "locus", "aln", "n")


def offsets(aligned: DataFrame, order: DataFrame) -> DataFrame:
    """(family, start, end): each family's place in the concatenation, from 1, of aligned sequences or rows of slim(). Families, not sequences, are what one task orders."""
    width = aligned.groupBy("family").agg(F.max(F.col("_width") if "_width" in aligned.columns else F.length("aln")).alias("width")).join(order.select("family", "block", "ord"), "family")
    w = Window.orderBy("block", "ord", "family").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("width").over(w)
    return width.select("family", (end - F.col("width") + 1).cast("long").alias("start"), end.cast("long").alias("end"))


def concatenate(aligned: DataFrame, order: DataFrame, genomes: DataFrame, gap: str = "N", several: bool = False, amino: bool = False) -> DataFrame:
    """(genome, aln): families end to end in graph order.

    aligned may be rows of slim(). In a sequence - and N, or - and * of amino acids, become `gap`. A missing family is all `gap`, one with several copies
    is all -, unless its longest is wanted; their letters alone decide which is longest.
    """
    gaps = "-*" if amino else "-N"
    place = offsets(aligned, order)
    best = longest_per_genome(aligned, gaps).select("family", "genome", F.translate("aln", gaps, gap * len(gaps)).alias("aln"), "n")
    grid = place.withColumn("width", F.col("end") - F.col("start") + 1).crossJoin(genomes.select("genome").distinct()).join(best, ["family", "genome"], "left")
    width = F.col("width").cast("int")
    text = F.when(F.col("aln").isNull(), F.repeat(F.lit(gap), width)).when((F.col("n") > 1) & F.lit(not several), F.repeat(F.lit("-"), width)).otherwise(F.rpad("aln", width, F.lit(gap)))
    items = F.array_sort(F.collect_list(F.struct("start", text.alias("text"))))
    return grid.groupBy("genome").agg(F.array_join(F.transform(items, lambda x: x["text"]), "").alias("aln"))


def offsets_gff(place: DataFrame, name: str = "Pangenome") -> DataFrame:
    """(family, line): a feature line for each family's span."""
    line = F.concat_ws("\t", F.lit(name), F.lit("NA"), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID="), "family", F.lit(";gene="), "family"))
    return place.select("family", line.alias("line"))


def unique_sequences(aligned: DataFrame) -> DataFrame:
    """(family, seq_id, aln, genome): each distinct sequence, numbered by its first locus, and the genomes that have it."""
    # Sequences are told apart by a digest and their length; each is dealt out once, by the genome that has it.
    rows = checkpoint(slim(aligned).select("family", "genome", "locus", "aln", "_width", F.sha2("aln", 256).alias("_d")))
    first = checkpoint(rows.groupBy("family", "_d", "_width").agg(F.min("locus").alias("first")))
    # Numbered in ranges over all families, then from 1 in each, so that no task orders a family.
    ranked = checkpoint(numbered(first, "_n", F.col("family"), F.col("first"), F.col("_d")))
    start = ranked.groupBy("family").agg(F.min("_n").alias("_start"))
    start = F.broadcast(start) if start.count() <= FEW else start
    named = ranked.join(start, "family").select("family", "_d", "_width", (F.col("_n") - F.col("_start") + 1).alias("seq_id"))
    once = rows.groupBy("family", "_d", "_width", "genome").agg(F.first("aln").alias("aln"))
    return full(once.join(named, ["family", "_d", "_width"])).select("family", "seq_id", "aln", "genome")


def subset(aligned: DataFrame, loci: DataFrame, alleles: DataFrame, genomes: DataFrame | None = None, policy: str = "dash") -> DataFrame:
    """(allele, genome, locus, aln) of the chosen alleles' own loci. A genome with several: all (multi), its longest (rep), or - all along (dash)."""
    own = loci.join(alleles.select("allele"), "allele", "left_semi").select("allele", "locus").distinct()
    rows = full(slim(aligned).join(own, "locus"))
    rows = rows if genomes is None else rows.join(genomes.select("genome"), "genome", "left_semi")
    if policy == "multi":
        return rows.select("allele", "genome", "locus", "aln")
    rows = full(_firsts(checkpoint(slim(rows)), ["allele", "genome"], F.length(F.replace("aln", F.lit("-"), F.lit("")))))
    if policy == "dash":
        rows = rows.withColumn("aln", F.when(F.col("n") > 1, F.repeat(F.lit("-"), F.length("aln"))).otherwise(F.col("aln")))
    elif policy != "rep":
        raise ValueError("policy is multi, rep or dash")
    return rows.select("allele", "genome", "locus", "aln")


def column_overlaps(aligned: DataFrame, share: float = 0.9) -> DataFrame:
    """(family, a, b, both, similar): filled columns that each two sequences of a family have in common.

    A family's sequences meet in blocks, PAIRS by PAIRS at most, as packed bits whose zeros at the end are left out; a block
    is a product of their columns as ones and zeros, as far as the shorter side has any.
    """
    bits = checkpoint(aligned.select("family", "locus", sites.packed(F.col("aln")).alias("x")).select("family", "locus", "x.bits", "x.n"))
    # Up to eight blocks of a family that is no smaller than FEW_PAIRS for each, so that products are many.
    count = bits.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / F.lit(PAIRS)), F.least(F.lit(8), F.ceil(F.count("*") / F.lit(FEW_PAIRS)))).cast("int").alias("s"))
    cells = count.agg(F.sum(F.expr("cast(s as long) * (s + 1) div 2"))).first()[0] or 1
    rows = bits.join(count, "family").withColumn("own", F.pmod(F.xxhash64("locus"), F.col("s")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.select("family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "locus", "bits", "n")

    def met(part: pa.Table) -> Iterator[pa.RecordBatch]:
        family, first = part["family"][0].as_py(), part["p"][0].as_py()
        names, bits, own = part["locus"].to_pylist(), part["bits"].to_pylist(), part["own"].to_numpy()
        n, wide = part["n"].to_numpy().astype(np.int32), np.array([len(x) for x in bits])
        rank = np.empty(len(names), dtype=np.int32)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        names = pa.array(names, pa.string())
        same = first == part["q"][0].as_py()
        sides = [np.flatnonzero(own == first)] * 2 if same else [np.flatnonzero(own == first), np.flatnonzero(own != first)]
        both = np.zeros([len(x) for x in sides], dtype=np.int32)
        last = min(wide[x].max(initial=0) for x in sides)
        for k in range(0, last, COLUMNS // 8):
            # Sequences that end before these columns have none in common with any.
            at, filled = [np.flatnonzero(wide[x] > k) for x in sides], []
            for x, here in zip(sides[: 1 if same else 2], at, strict=False):
                held = np.zeros((len(here), min(COLUMNS // 8, last - k)), dtype=np.uint8)
                for i, c in enumerate(x[here].tolist()):
                    b = bits[c][k : k + held.shape[1]]
                    held[i, : len(b)] = np.frombuffer(b, "u1")
                filled.append(np.unpackbits(held, axis=1).astype(np.float32))
            both[np.ix_(*at)] += np.rint(filled[0] @ filled[-1].T).astype(np.int32)
        x, y = sides
        step = max(1, OVERLAPS // max(1, len(y)))
        for begin in range(0, len(x), step):
            part_ = both[begin : begin + step]
            i, j = np.repeat(x[begin : begin + step], len(y)), np.tile(y, len(part_))
            m = part_.ravel()
            if same:
                once = i < j
                i, j, m = i[once], j[once], m[once]
            turn = rank[i] > rank[j]
            a, b = np.where(turn, j, i), np.where(turn, i, j)
            similar = (m >= share * n[i]) & (m >= share * n[j])
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(family, pa.string()), len(m)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(m.astype(np.int64)), pa.array(similar)], names=["family", "a", "b", "both", "similar"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("family", "p", "q")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if held and keys[begin] != at:
                    yield from met(pa.Table.from_batches(held))
                    held = []
                at = keys[begin]
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from met(pa.Table.from_batches(held))

    # Few bytes, much work each: a number of partitions that Spark does not make smaller.
    dealt = rows.repartition(min(cells, PRODUCTS), "family", "p", "q").sortWithinPartitions("family", "p", "q")
    return dealt.mapInArrow(run, "family string, a string, b string, both long, similar boolean")


def column_counts(aligned: DataFrame) -> DataFrame:
    """(family, place, letter, n): how many sequences of a family have each letter A to Z at each place, from 1; other characters are gaps.

    Tasks sum up their own rows first, so what is dealt out follows the widths of families, not their sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, np.ndarray] = {}
            for family, aln in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(aln.upper().encode("ascii", "replace"), "u1")
                counts = held.get(family)
                if counts is None or len(counts) < len(x):
                    grown = np.zeros((len(x), 26), dtype=np.int32)
                    if counts is not None:
                        grown[: len(counts)] = counts
                    held[family] = counts = grown
                at = np.flatnonzero((x >= 65) & (x <= 90))
                counts[at, x[at] - 65] += 1
            for family, counts in held.items():
                place, letter = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([family] * len(place), pa.string()), pa.array(place + 1, pa.int32()), pa.array(letter + 65, pa.int32()), pa.array(counts[place, letter], pa.int64())], names=["family", "place", "code", "n"])

    found = aligned.select("family", "aln").mapInArrow(run, "family string, place int, code int, n long")
    return found.groupBy("family", "place", "code").agg(F.sum("n").alias("n")).select("family", "place", F.char("code").alias("letter"), "n")


def percent_identity(aligned: DataFrame) -> DataFrame:
    """(family, sequences, width, average, overall): percent identity of aligned families, from the letters of their columns.

    average: of all pairs of sequences and places at which both have a letter, those with equal letters; 0 if there are
    none. overall: of all places, those at which every sequence has the same letter. Pairs are counted, not made.
    """
    place = column_counts(aligned).groupBy("family", "place").agg(F.sum("n").alias("filled"), F.max("n").alias("top"), F.sum(F.col("n") * (F.col("n") - 1)).alias("equal"))
    size = aligned.groupBy("family").agg(F.count("*").alias("sequences"), F.max(F.length("aln")).cast("long").alias("width"))
    rows = size.join(place, "family", "left").groupBy("family", "sequences", "width")
    sums = rows.agg(F.sum("equal").alias("equal"), F.sum(F.col("filled") * (F.col("filled") - 1)).alias("pairs"), F.count_if(F.col("top") == F.col("sequences")).alias("whole"))
    return sums.select("family", "sequences", "width", F.when(F.col("pairs") > 0, 100.0 * F.col("equal") / F.col("pairs")).otherwise(0.0).alias("average"), F.when(F.col("width") > 0, 100.0 * F.col("whole") / F.col("width")).otherwise(0.0).alias("overall"))


def family_sequences(families: DataFrame, loci: DataFrame, seqs: DataFrame) -> DataFrame:
    """(family, locus, genome, seq) of the chosen families; a locus without a sequence is an error to look for with left_anti."""
    return loci.join(families.select("family"), "family", "left_semi").select("family", "locus", "genome").distinct().join(seqs.select("locus", "seq"), "locus")
