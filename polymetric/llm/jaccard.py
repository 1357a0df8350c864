"""Grouped prefix join: documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

A document is its set of distinct shingles, as 64-bit hashes.  Equal sets are
one class.  All sets are put in one order of shingles, frequent ones last;
similar sets then share a shingle among their first ones, the prefix.
Classes with the same size and prefix are one group, and a prefix shingle
posts groups.  Links are verified on the whole sets in two steps:

1. stars: each group against those it shares most shingles with among the
   most central ones of its postings, which have least of their own in their
   prefixes, and each class of a group against the group's first class.  This is linear in the postings and joins most of a family of
   copies into one component;
2. all pairs of groups in a posting that are still in different components,
   less those that their sizes, or the number of prefix shingles they share,
   rule out, expanded to their classes.

A pair inside a component cannot change the components, so nothing is lost
by leaving it out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.contraction import roots
from .common import SPACES, discard, fresh, materialize, ship

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
TOP, BOTTOM = 80, 100
#: Shingles found in a stretch of STRETCH shingles LOCAL times or more are
#: counted; of those with HOT or more in all, the HOTTEST most frequent ones
#: go last in the order.  This only steers the order: any order is correct.
STRETCH, LOCAL, HOT, HOTTEST = 1 << 21, 2, 8, 1 << 20
#: Rounds of stars, and hubs of a group in each.
ROUNDS, HUBS = 1, 3
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
#: Keys of so many rows (16 bytes each) are broadcast; more are joined by a shuffle.
SMALL = 1_000_000

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingle_batch(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sets of texts, one after another, each sorted, and where they start and end.

    A text's set has the hashes of its distinct shingles; of fewer than five
    words, the one of them all; without words, none.  Bytes split at the
    contract's white space and lower A to Z only.
    """
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(starts[-1]))
    m = max(0, len(h) - WORDS + 1)
    s = np.zeros(m, dtype=np.uint64)
    for j in range(WORDS):
        s += h[j : j + m] * _K[j]
    s = mixed(s)
    out = []
    for n, at in zip(lengths.tolist(), starts.tolist()):
        if n >= WORDS:
            own = np.sort(s[at : at + n - WORDS + 1])
            new = np.empty(len(own), dtype=bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif n:
            out.append(mixed((h[at : at + n] * _K[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(_EMPTY)
    return np.concatenate([_EMPTY, *out]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


_EMPTY = np.empty(0, dtype=np.uint64)


def digests(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits a set that tell sets apart, as two signed longs."""
    sums = []
    for k in (_K[0], _K[1]):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(flat ^ k), dtype=np.uint64)])
        sums.append(total[offsets[1:]] - total[offsets[:-1]])
    sums[0] += np.diff(offsets).astype(np.uint64)
    return sums[0].view(np.int64), sums[1].view(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-TOP * n // BOTTOM) + 1 if n else 0


def _rows(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            yield some, some.column(text).to_pylist()


def _i64(x) -> pa.Array:
    return pa.array(x, pa.int64())


def signatures(docs: DataFrame) -> DataFrame:
    """``kind, doc_id, th, n, c1, c2``: kind 0 for each document; kind 1 for a shingle (c1) that a stretch holds n times."""
    schema = docs.select("doc_id").schema
    for name in ("th", "n", "c1", "c2", "kind"):
        schema = schema.add(name, "long")

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = WordHashes(), [], 0, set()
        id_type = None

        def frequent() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()  # in place: a worker holds a stretch about once
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            times = np.diff(first, append=len(every))
            values, times = every[first[times >= LOCAL]], times[times >= LOCAL]
            zero = np.zeros(len(values), dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(values), id_type), _i64(zero), _i64(times), _i64(values.view(np.int64)), _i64(zero), _i64(zero + 1)],
                names=["doc_id", "th", "n", "c1", "c2", "kind"],
            )

        for batch, texts in _rows(batches, 2):
            id_type = batch.column(0).type
            flat, offsets = shingle_batch(texts, hashes)
            c1, c2 = digests(flat, offsets)
            for i, key in enumerate(zip(c1.tolist(), c2.tolist())):
                if key not in seen:  # copies of one set count once in a stretch
                    seen.add(key)
                    held.append(flat[offsets[i] : offsets[i + 1]])
                    size += len(held[-1])
            n = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _i64(n), _i64(c1), _i64(c2), _i64(np.zeros(len(n), dtype=np.int64))],
                names=["doc_id", "th", "n", "c1", "c2", "kind"],
            )
            if size >= STRETCH:
                yield frequent()
                size, seen = 0, set()
        if held:
            yield frequent()

    return docs.mapInArrow(sign, schema)


def prefixes(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``c1, c2, n, prefix`` of the sets of documents, each set once a task."""
    known = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOTTEST pairs

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, order = WordHashes(), set(), Order(*known.value)
        for _, texts in _rows(batches, 2):
            flat, offsets = shingle_batch(texts, hashes)
            level = order.levels_of(flat)
            c1, c2 = digests(flat, offsets)
            new, first = [], [_EMPTY]
            for i, key in enumerate(zip(c1.tolist(), c2.tolist())):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if a == b or key in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                new.append(i)
                s = flat[a:b] if level is None or not level[a:b].any() else flat[a:b][np.argsort(level[a:b], kind="stable")]
                first.append(s[: prefix_length(b - a)])
            ends = np.cumsum([len(p) for p in first]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_i64(c1[new]), _i64(c2[new]), _i64(np.diff(offsets)[new]), pa.ListArray.from_arrays(pa.array(ends), _i64(np.concatenate(first).view(np.int64)))],
                names=["c1", "c2", "n", "prefix"],
            )

    return docs.mapInArrow(cut, "c1 long, c2 long, n long, prefix array<long>")


class Order:
    """The common order of shingles: by level of frequency, 0 for all but the frequent ones, then by hash."""

    def __init__(self, values: np.ndarray, levels: np.ndarray):
        self.values, self.levels = values, levels
        self.maybe = np.zeros(1 << 22, dtype=bool)  # a quick no for most shingles
        self.maybe[values & np.uint64((1 << 22) - 1)] = True

    def levels_of(self, flat: np.ndarray) -> np.ndarray | None:
        at = np.flatnonzero(self.maybe[flat & np.uint64((1 << 22) - 1)])
        if not len(at):
            return None
        out = np.zeros(len(flat), dtype=np.int8)
        found = np.minimum(np.searchsorted(self.values, flat[at]), len(self.values) - 1)
        out[at] = np.where(self.values[found] == flat[at], self.levels[found], 0)
        return out


def sets(docs: DataFrame) -> DataFrame:
    """``c1, c2, shingles`` of documents."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for _, texts in _rows(batches, 2):
            flat, offsets = shingle_batch(texts, hashes)
            c1, c2 = digests(flat, offsets)
            yield pa.RecordBatch.from_arrays(
                [_i64(c1), _i64(c2), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _i64(flat.view(np.int64)))],
                names=["c1", "c2", "shingles"],
            )

    return docs.mapInArrow(whole, "c1 long, c2 long, shingles array<long>")


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has been counted to be small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def similar(overlap: Column, n: Column, m: Column) -> Column:
    return BOTTOM * overlap >= TOP * (n + m - overlap)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Of ``a, b`` (numbers of classes) those whose sets are similar, as a table ``name``.

    Sets are made again from one document of each class that a pair names.
    """
    nodes = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    needed = materialize(classes.join(nodes, "cid").select("cid", "c1", "c2", "rep"), "needed")
    keys = small(needed.select(F.col("rep.doc_id").alias("rid"), F.col("rep.th").alias("rth")))
    some = docs.join(keys, (docs["th"] == keys["rth"]) & docs["doc_id"].eqNullSafe(keys["rid"]), "left_semi")
    found = materialize(sets(some).join(needed.select("cid", "c1", "c2"), ["c1", "c2"]).select("cid", "shingles"), "sets")
    b = pairs.join(found.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = b.join(found.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    overlap = F.size(F.array_intersect("sa", "sb"))
    links = materialize(both.where(similar(overlap, F.size("sa"), F.size("sb"))).select("a", "b"), name)
    discard(needed, found)
    return links


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents and classes of ``df``.

    Documents: ``doc_id, th, n, c1, c2`` one row a row of ``df`` (``th`` is a
    hash of the text); classes: ``c1, c2, component, rep`` with a number for
    each component and one document (``doc_id, th``) of each class, the first.
    A null or empty text, and one of white space, has an empty set and no
    class.  Rows may repeat, and ids may be null or repeat: sets, not ids,
    are joined.  An empty table gives empty ones.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("t"))
    signed = materialize(signatures(docs), "signatures")
    rows = signed.where("kind = 0").drop("kind")
    hot = signed.where("kind = 1").groupBy("c1").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    frequent = hot.orderBy(F.desc("n"), "c1").limit(HOTTEST).toPandas()  # bounded by HOTTEST
    values = frequent["c1"].to_numpy(dtype=np.int64).view(np.uint64)
    levels = np.floor(np.log2(np.maximum(frequent["n"].to_numpy(dtype=np.int64), 1))).astype(np.int8)
    by = np.argsort(values)

    reps = rows.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("rep"))
    first = prefixes(docs, (values[by], levels[by])).groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    numbered = first.withColumn("gid", F.xxhash64("n", "prefix")).join(reps, ["c1", "c2"]).withColumn("cid", F.monotonically_increasing_id())
    written = materialize(numbered, "classes")
    classes = written.select("cid", "c1", "c2", "n", "gid", "rep")

    # Groups post their prefixes; postings of a single class say nothing.
    groups = written.groupBy("n", "gid", "prefix").agg(F.count("*").alias("k"))
    posts = groups.select("gid", "n", "k", F.posexplode("prefix").alias("pos", "token"))
    token = Window.partitionBy("token")
    posts = posts.select("token", "gid", "n", "pos", F.sum("k").over(token).alias("all")).where("all > 1").drop("all")
    # A group is the more central, the less of its prefix is its own: the text that copies were made from, say.
    group = Window.partitionBy("gid", "n")
    lonely = 1 - F.count("*").over(group) / (F.col("n") - behind(F.col("n")))
    posts = posts.withColumn("before", F.row_number().over(group.orderBy("pos")) - 1).withColumn("lonely", lonely)
    posts = materialize(posts, "central-postings")

    def labelled(links: DataFrame) -> DataFrame:
        found = roots(links)
        return materialize(classes.join(found, classes["cid"] == found["node"], "left").select("cid", "c1", "c2", "n", "gid", "rep", F.coalesce("root", "cid").alias("component")), "labelled")

    def still_open(label: DataFrame) -> DataFrame:
        """Postings whose groups are in different components yet."""
        u = posts.join(label.select("gid", "component").distinct(), "gid")
        u = u.withColumn("low", F.min("component").over(token)).withColumn("high", F.max("component").over(token))
        return materialize(u.where("low < high").drop("low", "high"), "open-postings")

    # Stars: first with each group as one, which its first class stands for.
    heads = classes.groupBy("gid").agg(F.min("cid").alias("component"))
    inside = classes.join(heads, "gid").where("cid <> component").select(F.col("component").alias("a"), F.col("cid").alias("b"))
    u, head = posts.join(heads, "gid"), heads.withColumn("cid", F.col("component"))
    tried, links, label = None, None, None
    for r in range(ROUNDS):
        pairs = star(u, head, r)
        pairs = materialize(pairs.union(inside) if r == 0 else pairs, "star")
        found = verified(pairs, classes, docs, "links")
        tried, links = (pairs, found) if r == 0 else (tried.union(pairs), links.union(found))
        if r == 0 or not found.isEmpty():
            label = labelled(links)
            u = still_open(label)
            head = label.groupBy("gid", "component").agg(F.min("cid").alias("cid"))
        if u.isEmpty():
            break

    # What is left: pairs in a posting that are in different components.
    x, y = u.select("token", *[F.col(c).alias(f"{c}_x") for c in ("gid", "n", "pos", "before", "component")]), u.select("token", *[F.col(c).alias(f"{c}_y") for c in ("gid", "n", "pos", "before", "component")])
    sizes = F.col("n_x"), F.col("n_y")
    # Of what lies before a shared shingle, without what is one group's own, and
    # of what lies behind it, the sets share no more than the smaller part.
    most = F.least("before_x", "before_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    met = x.join(y, "token").where((F.col("component_x") < F.col("component_y")) & similar(most, *sizes))
    met = met.groupBy("gid_x", "component_x", "n_x", "gid_y", "component_y", "n_y").agg(F.count("*").alias("k"))
    open_ = met.where(similar(at_most(F.col("k"), *sizes), *sizes)).drop("n_x", "n_y", "k")
    in_x = label.select(F.col("gid").alias("gid_x"), F.col("component").alias("component_x"), F.col("cid").alias("a"))
    in_y = label.select(F.col("gid").alias("gid_y"), F.col("component").alias("component_y"), F.col("cid").alias("b"))
    rest = open_.join(in_x, ["gid_x", "component_x"]).join(in_y, ["gid_y", "component_y"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        # What is linked already is one node now.
        more = verified(rest, classes, docs, "more-links")
        of = label.select(F.col("cid").alias("a"), F.col("component").alias("ca")), label.select(F.col("cid").alias("b"), F.col("component").alias("cb"))
        joined = roots(more.join(of[0], "a").join(of[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        moved = label.join(joined, label["component"] == joined["node"], "left").withColumn("component", F.coalesce("root", "component"))
        before, label = label, materialize(moved.select("c1", "c2", "component", "rep"), "relabelled")
        discard(before, more)
    discard(written, posts, rest, u, pairs, found)
    return rows, label.select("c1", "c2", "component", "rep")


def star(posts: DataFrame, head: DataFrame, r: int) -> DataFrame:
    """``a, b``: for each group and component the HUBS it shares most shingles with of those that come first in a posting.

    The most central ones come first, then the round's own order decides; a
    hub is in another component.  ``posts`` has ``token, gid, n, lonely,
    component``; ``head`` has the class that
    stands for a group in a component.
    """
    token = Window.partitionBy("token")
    me = F.struct("lonely", F.xxhash64(F.lit(r), "gid", "component").alias("o"), F.col("component").alias("c"), F.col("gid").alias("g"), F.col("n").alias("n"))
    p = posts.withColumn("me", me).withColumn("one", F.min("me").over(token))
    p = p.withColumn("two", F.min(F.when(F.col("component") != F.col("one.c"), F.col("me"))).over(token))
    p = p.withColumn("hub", F.when(F.col("component") != F.col("one.c"), F.col("one")).otherwise(F.col("two"))).where(F.col("hub").isNotNull())
    n, m = F.col("n"), F.col("hub.n")
    met = p.where(sizes_fit(n, m)).groupBy("gid", "component", "n", "hub").agg(F.count("*").alias("k"))
    # Only shingles for which a group is first are counted: a third of what is
    # needed will do.  What is left out here is found in the last step.
    met = met.where(similar(at_most(3 * F.col("k"), n, m), n, m))
    best = F.row_number().over(Window.partitionBy("gid", "component").orderBy(F.desc("k"), "hub"))
    met = met.withColumn("r", best).where(F.col("r") <= HUBS).select("gid", "component", F.col("hub.g").alias("g"), F.col("hub.c").alias("c"))
    mine = head.select("gid", "component", F.col("cid").alias("b"))
    its = head.select(F.col("gid").alias("g"), F.col("component").alias("c"), F.col("cid").alias("a"))
    return met.join(mine, ["gid", "component"]).join(its, ["g", "c"]).select("a", "b")


def at_most(shared: Column, n: Column, m: Column) -> Column:
    """The largest intersection of sets whose prefixes share so many shingles.

    What else they share lies behind the prefix that ends first in the order.
    """
    return shared + F.greatest(behind(n), behind(m))


def behind(n: Column) -> Column:
    return F.ceil(n * TOP / BOTTOM) - 1


def sizes_fit(n: Column, m: Column) -> Column:
    return BOTTOM * F.least(n, m) >= TOP * F.greatest(n, m)


def link(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row of ``df``.

    ``component_id`` is the least id that links reach; a document with an
    empty set has its own.  See ``jaccard_components`` for nulls and
    repetitions; a component without any id has a null one.
    """
    rows, classes = jaccard_components(df, key, text)
    least = classes.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
    of_class = materialize(classes.join(least, "component").select("c1", "c2", "component_id"), "class-ids")
    out = rows.join(of_class, ["c1", "c2"], "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of ``df`` the row with the least id (rows equal in id and text: one of them), all columns.

    Rows without any word are linked with nothing and stay, each of them; so
    does every column, whatever its name.  An empty table gives an empty one.
    """
    rows, classes = jaccard_components(df, key, text)
    th, its_id, its_th = fresh(df, "text_hash"), fresh(df, "kept_id"), fresh(df, "kept_hash")
    kept = classes.groupBy("component").agg(F.min("rep").alias("rep")).select(F.col("rep.doc_id").alias(its_id), F.col("rep.th").alias(its_th))
    kept = small(materialize(kept, "kept"))
    hashed = df.withColumn(th, F.xxhash64(F.col(text).cast("string")))
    empty = F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(SPACES)) == ""
    one = hashed.where(~empty).join(kept, F.col(th).eqNullSafe(F.col(its_th)) & F.col(key).eqNullSafe(F.col(its_id)), "left_semi")
    return one.dropDuplicates([key, th]).unionByName(hashed.where(empty)).drop(th)


def jaccard_query(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * inter >= 80 * (a.n + b.n - inter)
), r(x, y) AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x, min(y) AS y FROM r GROUP BY x
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
"""
