"""Row pattern matching of `A (D|U)*? P` over each key's rows in order: a start, rows that fall or rise, and a goal.

A start's match ends at the nearest goal to its right that is worth no less, within its run of rows that fall or rise. All
starts of a run are settled offline, by union-find: in the order of increasing worth, goals that are too low for the start
are deleted, which joins them to the goal on their right; the root of the first goal after the start is the nearest that
is left. Then matches are taken from left to right.

Rows are sorted into ranges, so a key of any size is dealt out, and a range is read in stretches that no match can leave. A
range tells the driver only what neighbours must know: its first and last row, its amount of goals in sight from the left
(rising amounts only) and where a search that enters it comes out. That is a small row for each partition. A match over
several ranges is put together from a piece of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.llm._common import checkpoint

WITHIN = 600_000_000  # microseconds
NONE = np.iinfo(np.int64).min


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); null for a value that is null or no finite number."""
    value = value.cast("double")
    return F.when(F.abs(value) < float("inf"), F.floor(100 * value + 0.5))


def in_order(rows: DataFrame, key: str, ts: str, order: str, value: str, kind: str, goal: str, bad: str) -> DataFrame:
    """(_range, key, ts, id, cents, goal, mid): the distinct rows with key and ts, sorted into ranges, each of them a partition."""
    rest = [F.to_json(F.struct(F.col(c).alias("c"))) if "map<" in t or "variant" in t else F.col(c) for c, t in rows.toDF(*(f"_c{k}" for k in range(len(rows.columns)))).dtypes]
    plain = rows.toDF(*(f"_c{k}" for k in range(len(rows.columns))))
    of = {c: F.col(f"_c{k}") for k, c in enumerate(rows.columns)}
    # What is not needed later only tells rows apart: two hashes of 64 bits, of rows that agree in all else.
    same = [F.xxhash64(*rest), F.xxhash64(F.lit(1), *rest)]
    given = plain.where(of[key].isNotNull() & of[ts].isNotNull()).select(
        of[key].alias("key"), of[ts].alias("ts"), of[order].alias("id"), cents(of[value]).alias("cents"), F.coalesce(of[kind] == goal, F.lit(False)).alias("goal"), F.coalesce(of[kind] != bad, F.lit(False)).alias("mid"), *(s.alias(f"same{k}") for k, s in enumerate(same))
    )
    by = ["key", "ts", "id", "cents", "goal", "mid"]
    ranged = given.distinct().select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    return checkpoint(ranged.select(F.spark_partition_id().alias("_range"), *by))


@dataclass
class Rows:
    """Some rows in order, with how each follows the row before it."""

    key: pa.Array
    id: pa.Array
    ts: np.ndarray
    cents: np.ndarray
    goal: np.ndarray  # of a goal's kind
    mid: np.ndarray  # of a kind that may stand between
    near: np.ndarray = field(default=None)  # same key, in time, and both rows have an amount

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        col = lambda c: batch.column(batch.schema.get_field_index(c))
        flag = lambda c: col(c).to_numpy(zero_copy_only=False).astype(bool)
        return Rows(col("key"), col("id"), col("ts").cast(pa.int64()).to_numpy(), pc.fill_null(col("cents"), NONE).to_numpy(), flag("goal"), flag("mid"))

    def __len__(self) -> int:
        return len(self.ts)

    def part(self, a: int, b: int) -> Rows:
        return Rows(self.key[a:b], self.id[a:b], *(None if x is None else x[a:b] for x in (self.ts, self.cents, self.goal, self.mid, self.near)))

    def then(self, more: Rows) -> Rows:
        arrays = [pa.concat_arrays([a, b]) for a, b in ((self.key, more.key), (self.id, more.id))]
        return Rows(*arrays, *(np.concatenate((a, b)) for a, b in ((self.ts, more.ts), (self.cents, more.cents), (self.goal, more.goal), (self.mid, more.mid), (self.near, more.near))))

    def follow(self, before: Rows | None, within: int) -> Rows:
        """Sets near; before: the row before these."""
        n = len(self)
        self.near = np.zeros(n, dtype=bool)
        if n > 1:
            same = pc.equal(self.key[1:], self.key[: n - 1]).to_numpy(zero_copy_only=False).astype(bool)
            self.near[1:] = same & (self.ts[1:] - self.ts[:-1] <= within) & (self.cents[1:] != NONE) & (self.cents[:-1] != NONE)
        if before is not None and n:
            self.near[0] = before.key[0] == self.key[0] and self.ts[0] - before.ts[0] <= within and self.cents[0] != NONE and before.cents[0] != NONE
        return self

    def flags(self, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rows may end a match that began before them, and which may stand inside one; before: the cents of the row before these."""
        above = np.concatenate(([before], self.cents[:-1]))
        return self.near & self.goal, self.near & self.mid & (self.cents != above)


def stretches(batches: Iterator[pa.RecordBatch], within: int, first: dict | None) -> Iterator[tuple[int, Rows, int, bool]]:
    """(place, rows, cents before them, whether they are the last): a range's rows, cut where no match can pass.

    first: near and cents of what stands before the range. A stretch holds a batch and the longest run at most.
    """
    held, last, at, before = None, None, 0, NONE if first is None else first["cents"]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = Rows.of(batch).follow(last, within)
        if last is None and first is not None:
            new.near[0] = first["near"]
        last = new.part(len(new) - 1, len(new))
        held = new if held is None else held.then(new)
        ends, passes = held.flags(before)
        cuts = np.flatnonzero(~(ends | passes))
        if len(cuts) and (cut := int(cuts[-1])) > 0:
            yield at, held.part(0, cut), before, False
            before, at, held = int(held.cents[cut - 1]), at + cut, held.part(cut, len(held))
    if held is not None:
        yield at, held, before, True


def ends_of(rows: Rows, before: int, beyond: list[tuple[int, int, int]]) -> np.ndarray:
    """For each row the place of the last row of a match that starts there, or -1.

    beyond: goals after these rows in sight, of rising cents; the k-th of them has the place len(rows) + k.
    """
    n = len(rows)
    out = np.full(n, -1, dtype=np.int64)
    goal, passes = rows.flags(before)
    at = np.concatenate((np.flatnonzero(goal), np.arange(n, n + len(beyond))))
    if not len(at):
        return out
    worth = np.concatenate((rows.cents[goal], np.array([c for c, *_ in beyond], dtype=np.int64)))
    # The last place that a match may have: a goal that can't stand inside is in sight, what is behind it isn't.
    stops = np.flatnonzero(~passes)
    after = np.searchsorted(stops, np.arange(n), side="right")
    stop = np.append(stops, n + len(beyond))[after]
    most = np.where(np.append(goal[stops], False)[after], stop, stop - 1)
    first = np.searchsorted(at, np.arange(n), side="right")
    starts = np.flatnonzero((rows.cents != NONE) & (first < len(at)) & (np.append(at, n + len(beyond) + 1)[first] <= most))
    starts = starts[np.argsort(rows.cents[starts], kind="stable")]
    up = list(range(len(at) + 1))  # the goal that stands for this one; the last stands for none
    low = np.argsort(worth, kind="stable")
    gone, ordered, low_list = 0, worth[low].tolist(), low.tolist()
    at_list, many = at.tolist(), len(at)
    found = []
    for c, k, limit in zip(rows.cents[starts].tolist(), first[starts].tolist(), most[starts].tolist(), strict=True):
        while gone < many and ordered[gone] < c:
            up[low_list[gone]] = low_list[gone] + 1
            gone += 1
        while up[k] != k:
            up[k] = k = up[up[k]]
        found.append(at_list[k] if k < many and at_list[k] <= limit else -1)
    out[starts] = found
    return out


def sight(batches: Iterator[pa.RecordBatch], within: int) -> dict[str, Any] | None:
    """What a range's neighbours must know: its first and last row, and of the goals that a search from the left meets after its first row those of rising cents, and whether the search ends in this range."""
    seen, stop, first, last, n = [], False, None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Rows.of(batch).follow(last, within)
        goal, passes = rows.flags(NONE if last is None else int(last.cents[0]))
        if first is None:
            first, goal[0], passes[0] = rows.part(0, 1), False, True  # judged when the row before is known
        if not stop:
            end = int(np.argmin(passes)) if not passes.all() else len(rows)
            stop = end < len(rows)
            top = seen[-1][0] if seen else NONE
            for k in np.flatnonzero(goal[: end + 1]).tolist():
                if (c := int(rows.cents[k])) > top:
                    seen.append((c, n + k))
                    top = c
        n, last = n + len(rows), rows.part(len(rows) - 1, len(rows))
    one = lambda r: {"key": r.key[0].as_py(), "ts": int(r.ts[0]), "cents": int(r.cents[0]), "goal": bool(r.goal[0]), "mid": bool(r.mid[0])}
    return None if first is None else {"n": n, "first": one(first), "last": one(last), "seen": seen, "stop": stop}


def linked(parts: dict[int, dict[str, Any]], within: int) -> dict[int, dict[str, Any]]:
    """Adds to each range near and cents of the row before it, the goals beyond it in sight (cents, range, place), where searches may enter it, and the next range."""
    order = sorted(parts)
    for before, k in zip([None, *order], order, strict=False):
        p = parts[k]
        a, b = parts[before]["last"] if before is not None else None, p["first"]
        near = a is not None and a["key"] == b["key"] and b["ts"] - a["ts"] <= within and NONE not in (a["cents"], b["cents"])
        p["near"], p["cents"] = near, a["cents"] if a else NONE
        goal, passes = near and b["goal"], near and b["mid"] and a["cents"] != b["cents"]
        if not passes:
            p["seen"], p["stop"] = [], True
        if goal:
            p["seen"] = [(b["cents"], 0), *(x for x in p["seen"] if x[0] > b["cents"])]
    beyond, following = [], None
    for k in reversed(order):
        p = parts[k]
        p["beyond"], p["next"] = beyond, following
        own = [(c, k, place) for c, place in p["seen"]]
        top = own[-1][0] if own else NONE
        beyond, following = own if p["stop"] else own + [x for x in beyond if x[0] > top], k
    return parts


def ways_out(batches: Iterator[pa.RecordBatch], part: dict[str, Any], within: int) -> list[tuple[int, int, int]]:
    """(entry, range, place): where a search that enters this range at `entry` goes on in a later one, -1 where there is none.

    Where no match can pass some row, all entries have the way out of the last such row.
    """
    for at, rows, before, is_last in stretches(batches, within, part):
        if is_last:
            n, beyond = len(rows), part["beyond"]
            found = ends_of(rows, before, beyond)
            goal, passes = rows.flags(before)
            out: list[tuple[int, int]] = [(-1 if part["next"] is None else part["next"], 0)] * (n + 1)
            for k in range(n - 1, -1, -1):
                end = int(found[k])
                out[k] = out[k + 1] if end < 0 else out[end + 1] if end < n else (beyond[end - n][1], beyond[end - n][2] + 1)
            whole = at > 0 or not (goal[0] or passes[0])
            return [(e, *out[0 if whole else e]) for e in {0, *(place + 1 for _, place in part["seen"])}]
    return []


def entries(parts: dict[int, dict[str, Any]], ways: dict[int, dict[int, tuple[int, int]]]) -> None:
    """Sets in each range its entry: the place at which the search enters it, or None if a match passes over it; and the way out."""
    for p in parts.values():
        p["entry"], p["way"] = None, None
    at = (min(parts), 0) if parts else (-1, 0)
    while at[0] >= 0:
        p = parts[at[0]]
        p["entry"], p["way"] = at[1], ways[at[0]][at[1]]
        at = p["way"]
    came = None  # by which way the search has come to the range at or after this one
    for k in sorted(parts, reverse=True):
        p = parts[k]
        if p["entry"] is not None:
            came = (k, p["entry"])
        p["came"] = came


def found_in(batches: Iterator[pa.RecordBatch], number: int, part: dict[str, Any], within: int) -> Iterator[list[tuple]]:
    """Rows (key, range, no, to_range, to_place, first_id, last_id, n_rows, sum_cents, labels) by stretch: whole matches, with to_range null, and pieces of others.

    no counts the key's matches that start in this range. A piece has the way out that its match takes.
    """
    entry, key, no = part["entry"], None, 0
    left = part["n"] if entry is None else entry  # rows of a match from before
    for at, rows, before, is_last in stretches(batches, within, part):
        out = []
        n = len(rows)
        if left > at:  # always in the first stretch, as what cuts it off ends the match
            b = min(n, left - at) - 1
            x = np.concatenate(([before], rows.cents[: b + 1]))
            text = np.where(x[1:] < x[:-1], b"D", b"U").tobytes().decode()
            ends = entry is not None
            out.append((rows.key[0].as_py(), number, None, *part["came"], None, rows.id[b].as_py() if ends else None, b + 1, int(rows.cents[: b + 1].sum()), text[:-1] + "P" if ends else text))
        if entry is not None:
            found = ends_of(rows, before, part["beyond"] if is_last else [])
            starts = np.flatnonzero(found >= 0)
            place = max(0, left - at)
            sums = np.concatenate(([0], np.cumsum(np.where(rows.cents == NONE, 0, rows.cents))))
            fall = np.where(np.concatenate(([False], rows.cents[1:] < rows.cents[:-1])), b"D", b"U").tobytes().decode()
            for s, e in zip(starts.tolist(), found[starts].tolist(), strict=True):
                if s < place:
                    continue
                here = rows.key[s].as_py()
                no = no + 1 if here == key else 1
                key, last = here, min(e, n - 1)
                whole = e < n
                to = (None, None) if whole else part["way"]
                text = "A" + fall[s + 1 : last + 1]
                out.append((here, number, no, *to, rows.id[s].as_py(), rows.id[last].as_py() if whole else None, last + 1 - s, int(sums[last + 1] - sums[s]), text[:-1] + "P" if whole else text))
                place = e + 1
        yield out


def match(rows: DataFrame, key: str = "client_id", ts: str = "ts", order: str = "click_id", value: str = "value", kind: str = "kind", goal: str = "purchase", bad: str = "error", within: int = WITHIN) -> DataFrame:
    """(key, match_no, first_id, last_id, n_rows, sum_cents, labels): the matches of `A (D|U)*? P` in each key's rows.

    Rows without key or ts are left out, rows repeated in all columns count once, and rows are ordered by ts and `order`,
    then by cents and kind. cents: see cents(); a row without any fits no letter. A fits any other row; D and U need cents
    below or above those of the row before and a kind that is neither null nor `bad`; P needs the kind `goal` and the
    cents of A at least. All but A need to be `within` microseconds of the row before. The nearest P ends a match, and
    the search goes on after it. labels has a letter a row. An empty table has no matches; columns of any names may stand
    beside these.

    No key is one task's: rows are sorted into ranges over all keys. A run is held in one task as far as it lies in one
    range. The labels of one match are one string, put together by one task.
    """
    spark = rows.sparkSession
    ordered = in_order(rows, key, ts, order, value, kind, goal, bad)
    at = ordered.schema.names.index("_range")
    kinds = dict(ordered.dtypes)

    def number_of(first: pa.RecordBatch) -> int:
        return first.column(at)[0].as_py()

    def begun(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, Iterator[pa.RecordBatch]]:
        """The range's number, and its batches; a range without rows has none."""
        for first in batches:
            if first.num_rows:
                def all_(first: pa.RecordBatch = first) -> Iterator[pa.RecordBatch]:
                    yield first
                    yield from batches
                return number_of(first), all_()
        return None, iter(())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, all_ = begun(batches)
        if k is not None and (seen := sight(all_, within)):
            yield pa.RecordBatch.from_pylist([{"k": k, "first_key": seen["first"].pop("key"), "last_key": seen["last"].pop("key"), **{x: {**seen[x]} for x in ("first", "last")}, "n": seen["n"], "stop": seen["stop"], "seen": [{"c": c, "at": p} for c, p in seen["seen"]]}], schema=told)

    row = "struct<ts: long, cents: long, goal: boolean, mid: boolean>"
    schema = f"k int, first_key {kinds['key']}, last_key {kinds['key']}, first {row}, last {row}, n long, stop boolean, seen array<struct<c: long, at: long>>"
    told = _arrow(schema)
    parts = {}
    for r in ordered.mapInArrow(look, schema).collect():  # a row a partition
        parts[r["k"]] = {"n": r["n"], "stop": r["stop"], "seen": [(x["c"], x["at"]) for x in r["seen"]], "first": r["first"].asDict() | {"key": r["first_key"]}, "last": r["last"].asDict() | {"key": r["last_key"]}}
    linked(parts, within)
    sent = spark.sparkContext.broadcast(parts)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, all_ = begun(batches)
        if k is not None:
            ways = ways_out(all_, sent.value[k], within)
            yield pa.RecordBatch.from_pydict({"k": [k] * len(ways), "entry": [w[0] for w in ways], "to": [w[1] for w in ways], "place": [w[2] for w in ways]}, schema=pa.schema([("k", pa.int32()), ("entry", pa.int64()), ("to", pa.int32()), ("place", pa.int64())]))

    ways: dict[int, dict[int, tuple[int, int]]] = {}
    for r in ordered.mapInArrow(leave, "k int, entry long, to int, place long").collect():
        ways.setdefault(r["k"], {})[r["entry"]] = (r["to"], r["place"])
    entries(parts, ways)
    final = spark.sparkContext.broadcast(parts)
    schema = f"key {kinds['key']}, _range int, no long, to int, place long, first_id {kinds['id']}, last_id {kinds['id']}, n_rows long, sum_cents long, labels string"
    made = _arrow(schema)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, all_ = begun(batches)
        if k is not None:
            for out in found_in(all_, k, final.value[k], within):
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)

    found = checkpoint(ordered.mapInArrow(take, schema))
    parted = found.where("to is not null").groupBy("to", "place").agg(
        F.max("key").alias("key"), F.min("_range").alias("_range"), F.max("no").alias("no"), F.max("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n_rows").alias("n_rows"), F.sum("sum_cents").alias("sum_cents"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "labels"))), lambda x: x["labels"]), "").alias("labels"))
    whole = found.where("to is null").drop("to", "place").unionByName(parted.select(*(c for c in found.columns if c not in ("to", "place"))))
    counts = found.where("no is not null").groupBy("key", "_range").agg(F.max("no").alias("_most"))
    ahead = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Only a range's first key can have rows in ranges before: a row a partition at most.
    ahead = counts.select("key", "_range", F.sum("_most").over(ahead).alias("_ahead")).where("_ahead > 0")
    all_ = whole.join(F.broadcast(ahead), ["key", "_range"], "left")
    return all_.select(F.col("key").alias(key), (F.col("no") + F.coalesce("_ahead", F.lit(0))).cast("long").alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))
