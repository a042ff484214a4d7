"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

The base kinds are patterns. The method adds `novel`: a long token of letters and digits that ends within REACH characters
before a sensitive word or starts within as many after it, with the lines and dotted parts that go on with it, whose
marginal cost is high: the bytes that zstandard needs for the surroundings with the token, less those for the
surroundings alone, where the compressor is primed with a dictionary of identifiers. Names, paths and repeats of what
stands around cost little; keys cost most of their length.

The dictionary is the corpus' own: the runs of letters that most documents have, counted over all of them, as many as
DICTIONARY bytes hold, and after them some names that code is full of. It holds runs and not whole names, so that a key
that is in a thousand copies of a document does not become part of it.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import checkpoint

# The base patterns, the least length of each kind, and the order of kinds.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?ai:secret|token|passw|passphrase|credential|api.?key|access.?key|private.?key|auth|bearer|signature|session)")
LEAST = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: What can follow a part of a key: a part after a dot, or a line that is nothing but a part.
PART = re.compile(r"""\.([A-Za-z0-9+/_=-]+)|["'\\]?[\x20\t]*\r?\n[\x20\t]*["']?([A-Za-z0-9+/_=-]+)(?=["'\\]?[\x20\t]*(?:\r?\n|\Z))""")
#: Identifiers that code is full of; the compressor starts with them.
IDENTIFIERS = """
import from return class function const static public private protected export default async await string number boolean
true false null none self this new delete void int float double char bool byte array list map set dict key value name
path file data config settings option params request response header body client server host port user admin account
password passwd secret token api_key apikey access_key private_key auth authorization bearer session signature
credential environment getenv process.env os.environ localhost 127.0.0.1 example.com http:// https:// www. .com .org
.net /usr/local/bin /var/log /etc/ 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""
#: Bytes of the corpus' dictionary, the runs of letters in it, and how many of them a task counts before it passes them on.
DICTIONARY, LETTERS, HELD = 1 << 16, re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}"), 1 << 17
#: A key costs about what its own characters cost in another order; a name costs less, as its parts are in the dictionary
#: or around it. OWN and SLACK (bytes) leave room for chance; of TRIALS orders the cheapest counts. Names of parts that the
#: dictionary lacks are told from keys by their letters: a key's runs of one class are shorter than RUN on average, or its
#: letters follow each other as if drawn by lot rather than as in words.
AROUND, REACH, OWN, SLACK, TRIALS, RUN = 128, 64, 0.96, 1.5, 4, 4.2
RUNS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Parts between separators that names are made of: numbers and times, words with a number, and short folders of a path.
NUMBER, NAMED = re.compile(r"[0-9]{1,8}|[0-9]{1,4}T[0-9]{1,6}Z?"), re.compile(r"(?:[A-Z]?[a-z]{2,})+[0-9]{0,3}|[A-Z]+[0-9]{0,3}|[a-z][0-9]{0,3}")
FOLDER, SEPARATOR = re.compile(r"[a-z]{1,4}|[A-Z]{1,4}"), re.compile(r"[^A-Za-z0-9]+")
# Percent of the letters a to z in texts, about the mean of English, French, German and Spanish.
FREQUENCY = (8.5, 1.6, 3.3, 4.4, 14.5, 1.5, 1.9, 3.2, 7.2, 0.4, 0.7, 4.3, 2.8, 7.5, 5.9, 2.4, 0.7, 6.7, 7.3, 6.9, 4.6, 1.4, 1.1, 0.3, 0.9, 0.7)
#: Bits a pair of letters that speak for words at least; letters drawn by lot have about -1, words of the dictionary about 1.
LIKE = -0.2
#: How much these count among the letters that follow one in the dictionary: a share of what was seen, and so many more.
UNSEEN = (1.0, 20)


def _pairs(words: Iterable[str]) -> list[str]:
    return [w[k : k + 2].lower() for w in words for k in range(len(w) - 1)]


def identifiers(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> str:
    """What the names in docs are made of: runs of letters by the number of documents that have them, the most frequent last.

    All documents are counted, whole; of the result `size` bytes at most reach the driver. What only one document has is
    left out. Equal counts are ordered by the runs themselves; of those that don't all fit, a hash decides. Null texts
    and empty tables give none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["run", "n"])
        for batch in batches:
            for t in batch.column(0):
                held.update(set(LETTERS.findall(t.as_py() or "")))
                if len(held) > HELD:
                    yield told()
                    held.clear()
        yield told()

    counts = docs.select(F.col(text).alias("t")).mapInArrow(count, "run string, n long")
    # Tasks have summed up what they can: dealt out first, it is not held in a second table on its way.
    counts = counts.repartition("run").groupBy("run").agg(F.sum("n").alias("n")).where("n > 1")
    # Where the dictionary is full shows from sums by level of frequency, and within the last level by hash.
    counts = checkpoint(counts.withColumn("level", F.floor(16 * F.log2("n")).cast("int")).withColumn("part", F.pmod(F.xxhash64("run"), F.lit(1024)).cast("int")))
    room = F.sum(F.length("run") + 1).alias("room")

    def full(sums: list[tuple[int, int]], left: int) -> tuple[int | None, int]:
        """The first of (key, bytes) that no longer fits, and what is left then."""
        for key, n in sums:
            if n > left:
                return key, left
            left -= n
        return None, left

    level, left = full(sorted(counts.groupBy("level").agg(room).collect(), reverse=True), size)
    chosen = counts if level is None else counts.where(F.col("level") > level)
    if level is not None:
        last = counts.where(F.col("level") == level)
        part, _ = full(sorted(last.groupBy("part").agg(room).collect()), left)
        chosen = chosen.unionByName(last if part is None else last.where(F.col("part") < part))
    return " ".join(r["run"] for r in sorted(chosen.select("n", "run").collect()))


class Novelty:
    """Marginal compressed bytes of a token in its surroundings."""

    def __init__(self, corpus: str = "") -> None:
        """corpus: the corpus' dictionary, as identifiers() gives it."""
        primed = zstandard.ZstdCompressionDict(" ".join((corpus + IDENTIFIERS).split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pairs = Counter(_pairs(corpus.split()))
        after = Counter()
        for pair, n in pairs.items():
            after[pair[0]] += n
        letters = {chr(97 + k): f / sum(FREQUENCY) for k, f in enumerate(FREQUENCY)}
        #: For each pair of letters, in bits, how much likelier the second one is after the first in words than by lot.
        self.wordly = {x + y: math.log2(26 * (pairs[x + y] + (UNSEEN[0] * after[x] + UNSEEN[1]) * p) / (after[x] + UNSEEN[0] * after[x] + UNSEEN[1])) for x in letters for y, p in letters.items()}
        self.known = bool(pairs)
        self.squeeze = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)

    def cost(self, around: str, *tokens: str) -> list[int]:
        """The bytes of each token by itself after the surroundings."""
        whole = around.encode(errors="replace") + b"\n"
        alone = len(self.squeeze.compress(whole))
        return [len(self.squeeze.compress(whole + x.encode())) - alone for x in tokens]

    def wordy(self, parts: Iterable[str]) -> bool:
        """Whether letters follow each other as in words, in all parts together; without a dictionary nothing speaks against it."""
        pairs = _pairs(y for part in parts for y in re.findall("[A-Za-z]+", part))
        return not self.known or sum(self.wordly[x] for x in pairs) > LIKE * len(pairs)

    def like_a_name(self, token: str) -> bool:
        runs = RUNS.findall(token)
        if sum(map(len, runs)) >= RUN * len(runs) and self.wordy([token]):
            return True
        parts = [x for x in SEPARATOR.split(token) if x and not NUMBER.fullmatch(x)]
        if token.count("/") >= max(2, len(parts) // 2):
            parts = [x for x in parts if not FOLDER.fullmatch(x)]
        return SEPARATOR.search(token) is not None and all(map(NAMED.fullmatch, parts)) and (not parts or self.wordy(parts))

    def judge(self, around: str, token: str) -> bool:
        """Whether the token is a key; the orders tried depend on the token alone."""
        if self.like_a_name(token):
            return False
        draw = random.Random(token)
        cost, *others = self.cost(around, token, *("".join(draw.sample(token, len(token))) for _ in range(TRIALS)))
        return cost + SLACK >= OWN * min(others)


def scan_text(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) in code points, end exclusive, by start and kind. A null text has none."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found + [(a, b, 3) for a, b in _novel(text, sorted(found), novelty)])


def _novel(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int]]:
    """Spans of whole keys near a sensitive word, before or after it, of which other kinds leave LEAST characters or more."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
    begins, reach = [a for a, _, _ in taken], list(accumulate((b for _, b, _ in taken), max))
    found: dict[int, int] = {}

    def free(a: int, b: int) -> bool:
        """Whether enough of a token is in no span, or all of a short part."""
        k = bisect_left(begins, b)
        if not k or reach[k - 1] <= a:
            return True
        left, at = 0, a
        for x, y, _ in taken[bisect_right(reach, a) : k]:
            left += max(0, min(x, b) - at)
            at = max(at, y)
        return left + max(0, b - at) >= LEAST

    def is_secret(a: int, b: int) -> bool:
        token = text[a:b]
        return any(c.isalpha() for c in token) and novelty.judge(text[max(0, a - AROUND) : a] + text[b : b + AROUND], token)

    def follow(a: int, b: int) -> None:
        """Parts after (a, b) that belong to the same key, up to the first that doesn't."""
        lines = 1
        while m := PART.match(text, b):
            x, y = m.span(m.lastindex)
            wrapped = m.lastindex == 2
            if x in found or not free(x, y):
                return
            # A short part can't be judged by its cost: it is the last of a wrapped key, or mixes letters and digits.
            short = any(c.isdigit() for c in text[x:y]) and any(c.isalpha() for c in text[x:y]) or "=" in text[x:y] or wrapped and lines > 1
            # Lines of a wrapped key are as long as the one before, but for the last.
            like = wrapped and y - x == b - a >= 32 and not text[x:y].isalpha() and not RUNS.fullmatch(text[x:y])
            if not (like or (is_secret(x, y) if y - x >= LEAST else short)):
                return
            found[x] = y
            lines += wrapped
            if wrapped and y - x < b - a:
                return
            a, b = x, y

    seen = before = 0
    for near, end in words:
        for k in range(bisect_right(ends, max(before, near - REACH - 1)), len(tokens)):
            a, b = max(starts[k], seen), min(ends[k], near)
            if starts[k] >= near:
                break
            before = max(before, ends[k])
            if b - a >= LEAST and a not in found and free(a, b) and is_secret(a, b):
                found[a] = b
                if b == ends[k]:
                    follow(a, b)
        for k in range(bisect_right(ends, max(seen, end)), len(tokens)):
            a, b = max(starts[k], end), ends[k]
            if a > end + REACH:
                break
            seen = max(seen, b)
            if b - a >= LEAST and a not in found and free(a, b) and is_secret(a, b):
                found[a] = b
                follow(a, b)
    for a, b, kind in taken:
        if kind == 0 and b - a >= 32:
            follow(_value(text, a, b), b)
    # A token can be found both before one word and after another.
    out: list[tuple[int, int]] = []
    for a, b in sorted(found.items()):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _value(text: str, a: int, b: int) -> int:
    """Where the value of an assignment starts."""
    return ASSIGN.match(text, a, b).start(1)


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind:string,start:long,end:long>>"


def _apply(docs: DataFrame, text: str, column: str, kind: str, make, corpus: str) -> DataFrame:
    """docs with `column` made of (text, spans of the text)."""
    schema = docs.drop(column).select("*", F.lit(None).cast(kind).alias(column)).schema
    for f in schema:
        f.nullable = True
    arrow = SPAN if kind == SPANS else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(corpus)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(text))
            new = pa.array([make(x, scan_text(x, novelty)) for x in (v.as_py() for v in values)], arrow)
            rest = [k for k, n in enumerate(batch.schema.names) if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), new], names=[*(batch.schema.names[k] for k in rest), column])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", corpus: str | None = None) -> DataFrame:
    """(key, spans): a row for each row of docs, repeated rows and null keys included.

    spans: array of (kind, start, end) by start, then kind; empty for a null or empty text. corpus: the dictionary, by
    default that of docs. An empty table gives an empty result; other columns are not read.
    """
    told = lambda _, found: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in found]
    return _apply(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text, "spans", SPANS, told, identifiers(docs, text) if corpus is None else corpus).drop(text)


def _redacted(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    out, at = [], 0
    for a, b, _ in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = b
    return text if not found else "".join((*out, text[at:]))


def redact(docs: DataFrame, text: str = "text", corpus: str | None = None) -> DataFrame:
    """docs with each span of its text (overlapping ones as one) replaced by [secret].

    All rows and columns stay, whatever their names; a null or empty text stays as it is. Spans are those of scan().
    """
    return _apply(docs, text, text, "string", _redacted, identifiers(docs, text) if corpus is None else corpus).select(*docs.columns)
