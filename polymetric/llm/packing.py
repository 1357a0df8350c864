"""Best-fit packing by bin completion with branch and bound.

Documents become pieces of at most ``capacity`` tokens.  All that packing
needs of them is how many there are of each length, at most ``capacity``
numbers whatever the corpus: the driver plans patterns of lengths, each with
the number of sequences that use it, and every piece finds its place from its
rank among the pieces of its length.

The plan takes the largest length left, enumerates the undominated fillings
of what it leaves free, and branches over them.  Best-fit decreasing gives
the first incumbent; a branch is cut when its waste so far shows that it
can't use fewer sequences than the incumbent.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType

from .common import materialize, ship, without

CAPACITY = 2048
#: Nodes that the search may open before it settles for the incumbent, and
#: fillings tried at a node.  They bound the time, not what is packed.
NODES, BRANCHES = 4000, 12
SPECIAL = "<|endoftext|>"
#: Stretches on which the faster library needs quadratic time.
tough = re.compile(r"\S{2000}|\s{2000}").search


# ---- the plan -------------------------------------------------------------

Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, and the number of such sequences


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: those of the lengths over half, and what does not fit beside them."""
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    over = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # over[k]: pieces of k or more
    words = np.concatenate([[0], np.cumsum(counts * sizes)])
    # For every k: pieces of more than capacity - k stand alone, those over half are apart, smaller ones than k are left out.
    k, half = np.arange(1, capacity // 2 + 1), capacity // 2 + 1
    large = over[capacity - k + 1]
    middle = over[half] - large
    free = middle * capacity - (words[capacity - k + 1] - words[half])
    small = words[half] - words[k]
    return max(best, int((large + middle + np.maximum(0, -((free - small) // capacity))).max(initial=0)))


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Each length from the largest down goes where it leaves least free, many pieces at a time."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    done: list[Pattern] = []
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for free in sorted(f for f in open_ if f >= size):
            while left and open_.get(free):
                items, n = open_[free].popitem()
                k = free // size
                use = min(n, left // k)
                if use == 0:  # the last sequence of these takes fewer
                    k, use = left, 1
                if n > use:
                    open_[free][items] = n - use
                rest = open_.setdefault(free - k * size, {})
                rest[items + (size,) * k] = rest.get(items + (size,) * k, 0) + use
                left -= k * use
        if left:
            k = capacity // size
            for per, n in ((k, left // k), (left % k, 1)):
                if per and n:
                    rest = open_.setdefault(capacity - per * size, {})
                    rest[(size,) * per] = rest.get((size,) * per, 0) + n
    for d in open_.values():
        done.extend(d.items())
    return sorted(done, reverse=True)


def fillings(counts: np.ndarray, free: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``free`` from what is left, least waste first.

    A single piece dominates all smaller ones, so of the singles only the
    largest that fits counts; a set is kept with the largest last piece
    that fits beside the others, and only if it holds more than that single
    piece, which would hold it otherwise.  Every filling is then completed
    until nothing more fits.
    """
    fit = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))

    def complete(items: tuple[int, ...]) -> tuple[int, ...]:
        out, room = list(items), free - sum(items)
        while room > 0:
            size = int(fit[room])
            while size and counts[size] <= out.count(size):
                size = int(fit[size - 1])
            if not size:
                break
            out.append(size)
            room -= size
        return tuple(sorted(out, reverse=True))

    single = int(fit[free])
    if not single:
        return [()]
    found = {complete((single,))}
    first = np.flatnonzero(counts[: free + 1])[::-1]
    second = fit[free - first]
    both = np.minimum(first, second) * ((first != second) | (counts[first] > 1)) + first
    both = np.where((second > 0) & (second <= first), both, 0)
    for i in np.argsort(-both, kind="stable")[:BRANCHES]:
        if both[i] > single:
            found.add(complete((int(first[i]), int(second[i]))))
    if min(free - sum(f) for f in found):
        for a in first[: 4 * BRANCHES]:
            room = free - int(a)
            b = first[first <= min(room, int(a))]
            c = fit[room - b] if len(b) else b
            good = np.flatnonzero((c > 0) & (c <= b))
            for j in good[np.argsort(-(b[good] + c[good]), kind="stable")[:2]]:
                items = (int(a), int(b[j]), int(c[j]))
                if all(counts[s] >= items.count(s) for s in items):
                    found.add(complete(items))
    return sorted(found, key=lambda f: (free - sum(f), tuple(-s for s in f)))[:BRANCHES]


def maximal(counts: np.ndarray, free: int) -> Iterator[tuple[int, ...] | None]:
    """Every set of pieces that fits into ``free`` and leaves no room for a piece more, large pieces first; None now and then between them."""
    sizes = [int(s) for s in np.flatnonzero(counts[: free + 1])[::-1]]
    have = [int(counts[s]) for s in sizes]
    after = [*np.cumsum([s * n for s, n in zip(sizes[::-1], have[::-1])])[::-1].tolist(), 0]
    steps = 0

    def grow(i: int, room: int, items: tuple[int, ...], spare: int):
        # ``spare`` is the least size of which a piece was left out: less than that may stay free.
        nonlocal steps
        steps += 1
        if steps % 64 == 0:
            yield None
        for j in range(i, len(sizes)):
            if room - after[j] >= spare:
                return
            s = sizes[j]
            most = min(have[j], room // s)
            for n in range(most, 0, -1):
                yield from grow(j + 1, room - n * s, items + (s,) * n, s if n < have[j] else spare)
            spare = s
        if room < spare:
            yield items

    yield from grow(0, free, (), free + 1)


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns that use every piece of ``counts`` (by length, from 0) once, in as few sequences as the search finds."""
    counts = np.asarray(counts, dtype=np.int64).copy()
    counts[0] = 0
    sizes, total = np.arange(capacity + 1), int((counts * np.arange(capacity + 1)).sum())
    if total == 0:
        return []
    alone: list[Pattern] = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    bound = lower_bound(counts, capacity)
    incumbent = best_fit_decreasing(counts, capacity)
    best = sum(n for _, n in incumbent)
    counts[capacity] = 0
    used0 = sum(n for _, n in alone)
    # A frame: what is left, sequences used, waste so far, fillings to try, and the pattern that led here.
    path: list[Pattern] = []

    whole = False

    def tries(left: np.ndarray) -> Iterator[tuple[tuple[int, ...], int] | None]:
        """Fillings with the largest piece and how often each is used: the promising ones as often as they can, or all in all numbers."""
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for f in maximal(rest, capacity - largest) if whole else fillings(rest, capacity - largest):
            if f is None:
                yield None
                continue
            items = tuple(sorted((largest, *f), reverse=True))
            each = np.bincount(items, minlength=capacity + 1)
            most = int((left[each > 0] // each[each > 0]).min())
            for n in range(most, 0 if whole else most - 1, -1):
                yield items, n

    def frame(left: np.ndarray, used: int, waste: int):
        return [left, used, waste, tries(left)]

    if not counts.any():
        return alone
    stack = [frame(counts, used0, 0)]
    opened = 1
    while stack and best > bound and opened < max(nodes, 4 * capacity):
        left, used, waste, options = stack[-1]
        option = next(options, ())
        if option is None:
            opened += 1
            continue
        if not option:
            stack.pop()
            if path:
                path.pop()
            if not stack and not whole:  # the promising ones are through: what is left of the nodes goes to all
                whole = True
                stack.append(frame(counts, used0, 0))
            continue
        items, n = option
        each = np.bincount(items, minlength=capacity + 1)
        after, now = left - n * each, used + n
        lost = waste + n * (capacity - sum(items))
        rest = int((after * sizes).sum())
        opened += 1
        # Waste bound: a better plan has no more free places than this; or what is left needs too many sequences by itself.
        if lost > (best - 1) * capacity - total or now + lower_bound(after, capacity) >= best:
            continue
        if rest == 0:
            best, incumbent = now, [*alone, *path, (items, n)]
            continue
        path.append((items, n))
        stack.append(frame(after, now, lost))
    return incumbent


def places(patterns: list[Pattern], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by their rank: runs sorted by length and first rank."""
    rows, cursor, base = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for items, n in patterns:
        offset = 0
        for size in sorted(set(items), reverse=True):
            k = items.count(size)
            rows.append((size, int(cursor[size]), k, base, offset))
            cursor[size] += k * n
            offset += k * size
        base += n
    rows.sort()
    names = ("length", "first", "per", "base", "offset")
    return {name: np.array([r[i] for r in rows], dtype=np.int64) for i, name in enumerate(names)}


def locate(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces with these lengths and ranks."""
    out_s, out_o = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
    start = np.searchsorted(table["length"], length, side="left")
    end = np.searchsorted(table["length"], length, side="right")
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        lo, hi = start[at[0]], end[at[0]]
        i = lo + np.searchsorted(table["first"][lo:hi], rank[at], side="right") - 1
        j = rank[at] - table["first"][i]
        out_s[at] = table["base"][i] + j // table["per"][i]
        out_o[at] = table["offset"][i] + (j % table["per"][i]) * size
    return out_s, out_o


# ---- pieces ---------------------------------------------------------------


class Encoder:
    """Ids as the tokenizers library gives them, specials in the text included.

    The same vocabulary as ranks runs several times faster in tiktoken and
    gives the same ids; texts with a special string, or with stretches that
    would take it quadratic time, go to the library itself.
    """

    def __init__(self, path: str, ranks: str):
        self.path, self.fast, self._slow = path, _fast(ranks), None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or tough(text):
            if self._slow is None:
                self._slow = _slow(self.path)
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(2)
def _fast(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={})


@lru_cache(2)
def _slow(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """``key, piece, start, length, ids``: documents as token ids, cut to ``capacity``.

    A document is its ids and then ``end``; a null text is empty, so every
    row, repeated or not, gives one piece at least.  Only documents over
    ``capacity`` are cut, and their first piece may be shorter.  ``ids`` is
    binary, four little-endian bytes a token.  An empty table gives an empty
    one; other columns of ``df`` are left out.
    """
    ship(df.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    data = df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = data.drop("__text").schema.add("piece", IntegerType()).add("start", "long").add("length", "long").add("ids", "binary")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                row, piece, start, length, ids = [], [], [], [], []
                for i, t in enumerate(some.column(1).to_pylist()):
                    found = np.append(encoder.ids(t), np.uint32(end)).astype("<u4", copy=False)
                    n = len(found)
                    k = -(-n // capacity)
                    a = 0
                    for p in range(k):
                        b = n - capacity * (k - 1 - p)
                        row.append(i), piece.append(p), start.append(a), length.append(b - a), ids.append(found[a:b].tobytes())
                        a = b
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=[key, "piece", "start", "length", "ids"],
                )

    return data.mapInArrow(cut, schema)


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``df``, which has ``length``, with ``sequence_id`` and ``offset`` (long).

    ``length`` is 1 to ``capacity``.  Pieces of one length are alike to the
    plan, however many there are: they are ranked by the task that wrote
    them, so a length that a third of the rows have is spread over the tasks.
    An empty table gives an empty one.  Columns of ``df`` named
    ``sequence_id`` or ``offset`` are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    data = without(df, "sequence_id", "offset", "__id", "__part")
    written = materialize(data.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    written = written.withColumn("__part", F.shiftright("__id", 33))
    counts = written.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    table = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect():  # at most capacity rows
        table[r["length"]] = r["n"]
    known = spark.sparkContext.broadcast(places(plan(table, capacity), capacity))  # bounded by capacity

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = locate(known.value, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")
    first = counts.withColumn("__before", before).select("length", "__part", "__before")
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("length", "__part").orderBy("__id")) - 1
    ranked = written.join(first, ["length", "__part"]).withColumn("__rank", rank)
    out = ranked.withColumn("__place", place("length", "__rank"))
    return out.select(*[F.col(f"`{c}`") for c in data.columns], F.col("__place.sequence_id").alias("sequence_id"), F.col("__place.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, starts``: whole sequences from packed pieces with ``ids``, and where pieces start."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # no more pieces than a sequence has tokens
    joined = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return joined.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.offset").alias("starts"))


def pack_documents(docs: DataFrame) -> DataFrame:
    digest = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    packed = pack(digest)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
