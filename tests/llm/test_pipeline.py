"""The pipeline against a plain version of its stages, over the smallest documents."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import mixing, packing, secrets

DIR = "/root/testdata/sf0.001"


def shingles_of(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "mixing", "best_fit_packing"]

    first = stages["language_id"](spark, docs, DIR)
    assert first.columns == columns
    rows = {r["doc_id"]: r for r in first.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i for i, t in texts.items() if t and any(c.isalpha() for c in t)} >= set(rows) and len(rows) > 0.9 * len(texts)

    second = stages["simhash_near_dedup"](spark, first, DIR)
    ids = sorted(rows)
    sets = {i: shingles_of(rows[i]["text"]) for i in ids}
    least = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = least[a], least[b]
                least = {k: min(x, y) if v in (x, y) else v for k, v in least.items()}
    kept = sorted({*least.values()})
    assert second.columns == columns and sorted(r["doc_id"] for r in second.collect()) == kept

    third = stages["secret_scan"](spark, second, DIR)
    novelty = secrets.Novelty(secrets.identifiers(second))
    want = {i: secrets._redacted(rows[i]["text"], secrets.scan_text(rows[i]["text"], novelty)) for i in kept}
    assert third.columns == columns and {r["doc_id"]: r["text"] for r in third.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect())

    fourth = stages["mixing"](spark, third, DIR)
    size = {i: len(t.split()) for i, t in want.items()}
    times = {r["doc_id"]: r["epochs"] + (r["part"] > 0 and 2 * r["part"] >= r["size"]) for r in mixing.mix(third).collect()}
    got = [r["doc_id"] for r in fourth.collect()]
    assert fourth.columns == columns and sorted(got) == sorted(i for i, n in times.items() for _ in range(n))

    last = stages["best_fit_packing"](spark, fourth, DIR).collect()
    assert sum(r["length"] for r in last) == sum(size[i] for i in got)
    used = {}
    for r in last:
        if r["bin_id"] is not None:
            used[r["bin_id"], r["bin_length"]] = used.get((r["bin_id"], r["bin_length"]), 0) + r["length"]
    assert all(b == min(c for c in packing.CAPACITIES if c >= n) for (_, b), n in used.items())


def test_near_dedup_drops_rows_and_not_ids(spark):
    """Null ids and repeated ones: only rows that are copies themselves go, and one of each component stays."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    near = lambda k: text(k) + " end"
    rows = [(1, text(1)), (None, near(1)), (None, text(2)), (5, text(3)), (9, near(3)), (9, text(4)), (None, text(5)), (None, near(5)), (7, text(6)), (7, text(6)), (None, text(7)), (None, text(7))]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    fives = [x for x in got if x in ((None, text(5)), (None, near(5)))]
    assert len(fives) == 1
    assert got == sorted([(1, text(1)), (None, text(2)), (5, text(3)), (9, text(4)), (7, text(6)), (None, text(7)), *fives], key=str)


#: Names that stages or their operators use themselves.
CLASHES = "gone component score lang_pred fps spans s cut epochs target source_size part _size _at _row _key _n _text _id _hash _first _i _h id k h best text_hash place n size kept".split()


def test_stages_lose_no_row_to_nulls_repeats_or_names(spark):
    """Null in any column, empty and long texts, ties, repeated rows, an empty table and clashing names, through all stages."""
    word = lambda k: " ".join(f"thing{k}x{j} and the other" for j in range(12))
    rows = [(k, word(k), "en" if k % 4 else None, "a" if k % 3 else None) for k in range(60)]
    rows += [(None, word(k), "en", "b") for k in range(60, 66)] + [(None, None, None, None), (70, "", "en", "a"), (71, None, "en", "a"), (72, "123 456", None, None), (73, word(73) + " word" * 40_000, "en", "a")]
    rows += [(5, word(5), "en", "a"), (5, word(5), "fr", "z"), (6, word(74), "en", "a"), (3, word(3), None, None)]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in CLASHES}).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    has_letter = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    wanted = sorted(set(has_letter), key=str)
    for table, want in ((docs, wanted), (docs.limit(0), [])):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == docs.columns
            got = now.collect()
            if name == "language_id":
                assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == (sorted(has_letter, key=str) if want else [])
            elif name != "mixing":
                assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want
            assert all(r[c] == c for r in got for c in CLASHES)
            now = spark.createDataFrame(got, now.schema)
        assert bool(stages_last(spark, now)) == bool(want)
    repeats = [(r["lang"], r["source"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect() if r["doc_id"] == 5]
    assert repeats == [(r["lang"], r["source"]) for r in corpus_pipeline.near_dedup(spark, docs.orderBy(F.desc("source")), "").collect() if r["doc_id"] == 5] and len(repeats) == 1
    plain = docs.select("doc_id", "text")
    assert corpus_pipeline.secret_scan(spark, plain, "").columns == plain.columns


def stages_last(spark, docs):
    return corpus_pipeline.pack(spark, docs, "").collect()
