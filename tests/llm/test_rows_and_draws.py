"""Importance resampling, row patterns and exact dedup against plain versions, and in odd cases."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, patterns, resampling

DOCS = "doc_id long, text string, _text string, _row long, rank string, score string, kept string, _key int"


def docs_of(spark, rows, parts=3):
    """documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "r", "s", "k", 7) for i, t in rows], DOCS).repartition(parts)


@pytest.fixture
def many_ranges(spark):
    """As on a cluster: small partitions are not put together."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcXYZé1") for _ in range(r.randint(1, 6))) for _ in range(80)]
    rows = [(k, "".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", "\x00", "-"]) for _ in range(r.randint(0, 60)))) for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(30)] + [(300 + k, rows[0][1]) for k in range(40)]
    rows += [(None, rows[0][1])] * 3 + [(300, rows[0][1])] * 2 + [(None, None), (None, ""), (400, None), (401, ""), (402, "é" * 400), (403, "word " * 3000), (403, "word " * 3000)]
    return rows


# ---- exact dedup


@pytest.mark.parametrize("head, lengths, heads", [(256, 1 << 20, 1 << 27), (3, 1 << 15, 1 << 15)])
def test_exact_dedup(spark, texts, head, lengths, heads):
    got = exact_dedup.dedup(docs_of(spark, texts), carry=("_text",), head=head, lengths=lengths, heads=heads).collect()
    same = {}
    for i, t in texts:
        same.setdefault(t or "", []).append(i)
    best = {t: max((i for i in of if i is not None), default=None) for t, of in same.items()}
    want = Counter((i, best[t or ""], len(same[t or ""])) for i, t in texts)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(same)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"]) and all(r["_text"] == "x" for r in got)


def test_exact_dedup_reads_in_full_only_what_shares_length_and_head(spark):
    rows = [(1, "aaa"), (2, "aab"), (3, "bbbbb"), (4, "aaa"), (5, "abcd"), (6, "abce")]
    got = {r["doc_id"]: r for r in exact_dedup.dedup(docs_of(spark, rows), head=2).collect()}
    assert {k for k, r in got.items() if r["full_sha256"]} == {1, 2, 4, 5, 6}
    got = {r["doc_id"]: r for r in exact_dedup.dedup(docs_of(spark, rows), head=256).collect()}
    assert {k for k, r in got.items() if r["full_sha256"]} == {1, 4}
    assert got[1]["full_sha256"] == hashlib.sha256(b"aaa").hexdigest() and not got[1]["kept"] and got[1]["keep_id"] == 4


def test_exact_dedup_of_nothing_and_of_any_key(spark):
    assert exact_dedup.dedup(docs_of(spark, [])).collect() == []
    rows = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u")], "doc_id string, text string")
    assert {(r[0], r[1], r[3]) for r in exact_dedup.dedup(rows).collect()} == {("b", "b", True), ("a", "b", False), ("c", "c", True)}


# ---- importance resampling


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=5, least=20):
    crc = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(crc, plain_features(x)[1]))
    for x in target:
        t.update(map(crc, plain_features(x)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        w, f = plain_features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in map(crc, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, order[: len(order) * percent // 100]


@pytest.mark.parametrize("percent, parts", [(5, 3), (60, 11), (100, 2), (0, 3)])
def test_resampling(spark, texts, percent, parts, many_ranges):
    many_ranges(parts)
    target = [texts[5][1], texts[8][1] + " extra words", None, ""]
    got = resampling.resample(docs_of(spark, texts), spark.createDataFrame([(t,) for t in target], "text string"), percent).collect()
    want, drawn = plain_resample(texts, target, percent)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "eligible")) for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == [(r[3], r[0]) for r in drawn]


def test_one_score_over_many_ranges(spark, many_ranges):
    """All rows share a score, and many of them a key: ranks are still 1, 2, 3 by key."""
    many_ranges(9)
    keys = [*range(300), *[7] * 200, *[None] * 50]
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k, 5, True, n) for n, k in enumerate(keys)], "doc_id long, score long, eligible boolean, rank long").repartition(7)
    got = sorted((r for r in resampling.draw(rows.withColumnRenamed("rank", "other"), 520).collect() if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 521))
    assert [r["doc_id"] for r in got] == sorted(keys, key=lambda k: (k is None, k or 0))[:520]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_features_of_pieces(monkeypatch, texts, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    for _, t in texts[:60]:
        w, f = plain_features(t)
        got = list(resampling.features(None if t is None else t.encode()))
        assert sum(n for n, _ in got) == len(w)
        assert Counter(x for _, found in got for x in found) == Counter(zlib.crc32(x.encode()) for x in f)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs_of(spark, []), none).collect() == []
    got = resampling.resample(docs_of(spark, [(1, None), (2, "a b"), (3, "w " * 40)]), none, percent=100).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 0, None), (2, 3, None), (3, 117, 1)}


# ---- row patterns

CLICKS = "click_id long, ts timestamp, client_id long, kind string, value double, props string, _range int, no long, cents string"
BEGIN = datetime.datetime(2024, 1, 1)


def clicks_of(spark, rows):
    return spark.createDataFrame([(i, None if s is None else BEGIN + datetime.timedelta(microseconds=s), c, k, v, p, 1, 1, "c") for i, s, c, k, v, p in rows], CLICKS).repartition(4)


def plain_matches(rows, within=600_000_000):
    """Start by start and row by row, as a backtracking search would."""
    by = {}
    for i, s, c, k, v, _ in set(rows):
        if c is not None and s is not None:
            by.setdefault(c, []).append((s, i, None if v is None or not math.isfinite(v) else math.floor(100 * v + 0.5), k))
    out = []
    for c, of in by.items():
        of.sort(key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3] == "purchase", x[3] not in (None, "error")))
        start = no = 0
        while start < len(of):
            found = None
            for j in range(start + 1, len(of)):
                a, (s0, _, v0, _), (s, i, v, k) = of[start], of[j - 1], of[j]
                if a[2] is None or v is None or s - s0 > within:
                    break
                if k == "purchase" and v >= a[2]:
                    found = j
                    break
                if k in (None, "error") or v == v0:
                    break
            if found is None:
                start += 1
                continue
            part = of[start : found + 1]
            no += 1
            text = "A" + "".join("D" if y[2] < x[2] else "U" for x, y in zip(part, part[1:-1], strict=False)) + "P"
            out.append((c, no, part[0][1], part[-1][1], len(part), sum(x[2] for x in part), text))
            start = found + 1
    return sorted(out)


def made_clicks(seed, n, clients, gaps, kinds, values):
    r = random.Random(seed)
    at = Counter()
    rows = []
    for i in range(n):
        c = r.choice(clients)
        at[c] += r.choice(gaps)
        rows.append((i, at[c], c, r.choice(kinds), r.choice(values), f"p{i % 3}"))
    return rows


CASES = {
    "mixed": ([1, 1, 1, 2, 3, None], [0, 1, 60_000_000, 600_000_000, 600_000_001], ["view", "view", "click", "purchase", "error", None], [1.0, 2.0, 2.004, 3.5, -1.25, 7.0, None]),
    "one long run": ([1], [1000], ["view", "view", "view", "view", "purchase"], [x / 7 for x in range(-40, 400)]),
    "goals are low": ([1, 2], [1000], ["view"] * 12 + ["purchase"], [x / 3 for x in range(1000)]),
    "equal amounts": ([1], [5], ["view", "purchase"], [1.0, 2.0, 3.0]),
    "no goal": ([1], [5], ["view", "click"], [1.0, 2.0, 3.0, 4.0]),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("parts, batch", [(1, 10000), (13, 10000), (5, 4), (40, 3)])
def test_patterns(spark, many_ranges, case, parts, batch):
    many_ranges(parts)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = made_clicks(len(case) + parts, 400, *CASES[case])
        rows += rows[:40] + [(1000, None, 1, "view", 1.0, "p"), (1001, 5, 1, "view", float("nan"), "p"), (1002, 6, 1, "view", float("inf"), "p"), (None, 7, 1, "purchase", 9.0, "p")]
        rows = [(-1 if r[0] is None else r[0], *r[1:]) for r in rows]
        got = patterns.match(clicks_of(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(tuple(r) for r in got) == plain_matches(rows)


@pytest.mark.parametrize("seed", range(60))
def test_ranges_agree_with_the_whole(seed):
    """The parts that tasks and the driver run, on ranges and batches of a few rows."""
    import pyarrow as pa

    r = random.Random(seed)
    rows = made_clicks(seed, r.choice([1, 2, 30, 200]), *CASES[r.choice(sorted(CASES))])
    rows = sorted({x for x in rows if x[2] is not None}, key=lambda x: (x[2], x[1], x[0]))
    if not rows:
        return
    cuts = sorted({0, len(rows), *(r.randrange(len(rows) + 1) for _ in range(r.choice([0, 3, 20])))})
    number = lambda v: None if v is None else math.floor(100 * v + 0.5)
    ranges = {}
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        size = r.choice([1, 2, 50])
        ranges[2 * k] = [
            pa.RecordBatch.from_pydict({"key": [x[2] for x in p], "ts": [x[1] for x in p], "id": [x[0] for x in p], "cents": pa.array([number(x[4]) for x in p], pa.int64()), "goal": [x[3] == "purchase" for x in p], "mid": [x[3] not in (None, "error") for x in p]})
            for p in (rows[i : min(b, i + size)] for i in range(a, b, size))
        ]
    parts = patterns.linked({k: patterns.sight(iter(x), patterns.WITHIN) for k, x in ranges.items()}, patterns.WITHIN)
    ways = {k: {w[0]: w[1:] for w in patterns.ways_out(iter(x), parts[k], patterns.WITHIN)} for k, x in ranges.items()}
    patterns.entries(parts, ways)
    found = [x for k, b in ranges.items() for out in patterns.found_in(iter(b), k, parts[k], patterns.WITHIN) for x in out]
    whole = [(x[0], x[5], x[6], x[7], x[8], x[9]) for x in found if x[3] is None]
    for to in {x[3:5] for x in found if x[3] is not None}:
        of = sorted((x for x in found if x[3:5] == to), key=lambda x: x[1])
        whole.append((of[0][0], of[0][5], of[-1][6], sum(x[7] for x in of), sum(x[8] for x in of), "".join(x[9] for x in of)))
    assert sorted(whole) == sorted((x[0], *x[2:]) for x in plain_matches(rows))


def test_patterns_of_nothing_and_of_any_key(spark):
    assert patterns.match(clicks_of(spark, [])).collect() == []
    rows = clicks_of(spark, [(1, 0, 1, "view", 1.0, "p"), (2, 1, 1, "purchase", 1.0, "p")]).withColumn("client_id", F.lit("é")).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert [tuple(r) for r in patterns.match(rows).collect()] == [("é", 1, 1, 2, 2, 200, "AP")]
