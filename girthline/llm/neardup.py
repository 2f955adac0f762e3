"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact check.

A document's set holds its distinct five-word shingles (words are runs without white space, A-Z lowered; fewer than five
words make one shingle; no words or a null text make an empty set, linked with nothing). Two documents are linked if the
Jaccard similarity of their sets is at least ``percent`` / 100, checked on the full sets of 64-bit shingle hashes (two unlike
shingles of a pair are taken for equal with a probability of 2^-64 for each two).

* Documents with equal sets, told by 128 bits, are one node. Each node's shingle hashes are thrown once into ``BINS`` bins by their
  value; the smallest of each bin is the signature, and an empty bin takes the value of a bin that a hash sequence of its own number
  reaches first (optimal densification). ``ROWS`` bins make a band key: a pair at 0.85 shares none of the 60 bands with a
  probability of about 5e-9, one at 0.8 of 2e-5.
* A bucket (nodes with one band key) gives a star: an edge from each member, a ray, to the smallest one, its centre; so its pairs are as many as
  its members. Edges whose set sizes or signatures rule the similarity out go; the others are checked on the full sets.
* A star may miss a link between two of its rays. A bucket whose rays are in one component is settled. What the rays of the others hold together is a
  family, and all its members that are in unlike components are compared on their full sets: a family is dealt to parts of about ``PART_MEMBERS``
  members and ``PART_ELEMENTS`` elements, each pair of parts goes to a task of its own, and products of 0-1 matrices count there what each two sets share.
  A pair of parts gives links between components only, fewer than it has members, and no pair is ever a row. Nothing is capped or sampled: no link within a bucket is lost.
* Members of a family's largest component are not compared with each other. So a member is moved as often as there are parts outside of it (one outside also as often as
  there are parts inside): once or twice in families of up to ``PART_MEMBERS``, beyond that the counting grows with members outside times members of the family, in memory that does not grow.
* A ray and its centre, which may have very many, meet by a join that deals such a centre to many tasks (``spread_join``).
* Components grow by alternating large and small stars over the links, and over roots alone for the links found in families. Nothing is collected to the
  driver. Tables are dropped once nothing reads them.

Ties and repeated rows: equal rows share node, component and verdict. A row without an id takes part, but never gives a
component its name; where no row of a component has an id, ``component_id`` is null. Other columns are not looked at. A text of any
length is worked on whole; memory is bounded by a slice of half a megabyte or the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girthline.llm import bytewords as B
from girthline.llm.spread import spread_join
from girthline.llm.store import Store

BINS, ROWS, BROADCAST_ROWS = 480, 8, 500_000
BANDS = BINS // ROWS
#: Members and elements of their sets in one part of a family, about; and columns of a 0-1 matrix.
PART_MEMBERS, PART_ELEMENTS, COLUMNS = 1024, 1 << 19, 4096
#: A smaller set has no partner at 0.8 or more but its equal: 4 of 5 is the first such ratio.
LEAST = 4

_EDGES = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS)
_EDGES = np.array([int(x) for x in _EDGES[:-1]], np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value for each bin, of a sorted set that isn't empty."""
    at = np.append(np.searchsorted(shingles, _EDGES), len(shingles))
    full = at[:-1] < at[1:]
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[at[:-1][full]]
    empty, step = np.flatnonzero(~full), 0
    while len(empty):
        step += 1
        other = (B.mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) % np.uint64(BINS)).astype(np.int64)
        found = full[other]
        out[empty[found]] = out[other[found]]
        empty = empty[~found]
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        x = B.mix(x * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return x


SKETCH = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()),
])


@F.arrow_udf(SKETCH)
def sketched(text: pa.Array) -> pa.Array:
    """Set size, a 128-bit digest of the set (zeros for an empty one), band keys, and the lowest byte of each signature value."""
    sizes, digests, bands, sketches = [], [], [], []
    for found in B.shingle_sets(text, B.NOT_SPACE):
        sizes.append(len(found))
        digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else bytes(16))
        if len(found) >= LEAST:
            sig = signature(found)
            bands.append(_band_keys(sig).view(np.int64))
            sketches.append(sig.astype(np.uint8).tobytes())
        else:
            bands.append(np.zeros(0, np.int64))
            sketches.append(None)
    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), *(pa.array(halves[:, k].copy()) for k in (0, 1)), B.lists(bands, pa.int64()), pa.array(sketches, pa.binary())],
        names=["n", "d1", "d2", "bands", "sketch"],
    )


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingles(text: pa.Array) -> pa.Array:
    return B.lists([x.view(np.int64) for x in B.shingle_sets(text, B.NOT_SPACE)], pa.int64())


@F.arrow_udf(T.DoubleType())
def alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal bytes of two sketches."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, BINS) for v in (a, b))
    return pa.array((x == y).mean(axis=1) if len(x) else np.zeros(0))


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes allow the similarity and whose signatures agree within six standard deviations."""
    t = percent / 100
    least = F.lit(t) - 6 * F.sqrt(F.lit(t * (1 - t)) / F.least(F.lit(BINS), F.col("nu"), F.col("nv")))
    sized = pairs.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    return sized.where(alike("su", "sv") >= least)


@F.arrow_udf(T.LongType())
def n_common(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many elements two sorted lists share."""
    return pa.array([len(np.intersect1d(x.values, y.values, True)) for x, y in zip(a, b)], pa.int64())


def components(links: DataFrame, store: Store) -> DataFrame:
    """(node, root) of every node with a link but the roots, root being the smallest node it reaches; ``links`` has (u, v)."""
    def turned(a: str, b: str, names: tuple[str, str], flag: bool = False) -> Column:
        ends = ((a, b, 1), (b, a, 0))
        return F.explode(F.array(*(F.struct(F.col(x).alias(names[0]), (F.lit(up) if flag else F.col(y)).alias(names[1])) for x, y, up in ends)))

    edges, stored = links.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi != lo"), None
    while True:
        both = edges.select(turned("hi", "lo", ("x", "y")).alias("e")).select("e.*")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pulled = large.join(least, "hi")
        edges = store.keep(pulled.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.toDF("hi", "lo")).distinct())
        if stored is not None:
            store.drop(stored)
        stored = edges
        # Done when all are stars: no node has two edges upwards or is above one node and below another.
        ends = edges.select(turned("hi", "lo", ("x", "up"), flag=True).alias("e"))
        if ends.groupBy("e.x").agg(F.sum("e.up").alias("n"), F.min("e.up").alias("least")).where("n > 1 OR n = 1 AND least = 0").isEmpty():
            return edges.toDF("node", "root")


def _rooted(rows: DataFrame, label: DataFrame, node: str, root: str) -> DataFrame:
    """Adds the column ``root`` of the column ``node``."""
    known = label.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(known, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")


def _grown(label: DataFrame, links: DataFrame, store: Store) -> DataFrame:
    """The labels with further links, by components of the roots that these connect."""
    ends = _rooted(_rooted(links, label, "u", "ru"), label, "v", "rv").where("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
    merged = components(store.keep(ends), store)
    moved = label.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    return store.keep(moved.select("node", F.coalesce("_to", "root").alias("root")).union(merged))


def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, store: Store) -> DataFrame:
    """``node, n, s``: the sorted shingle hashes of the wanted nodes, taken anew from one text each."""
    one = store.keep(nodes.join(wanted, "node").select("node", "n", "at.*"))
    n = one.count()
    found = texts.join(F.broadcast(one) if n <= BROADCAST_ROWS else one, F.col("row_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_text")))
    sets = store.keep(found.select("node", "n", shingles("text").alias("s")))
    # A row that stands there several times gives its set as often.
    sets = sets if sets.count() == n else store.keep(sets.dropDuplicates(["node"]))
    store.drop(one)
    return sets


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _with_centre(pairs: DataFrame, facts: DataFrame, key: str, store: Store) -> DataFrame:
    """``pairs`` with the facts of their centre ``key``, of which a single one may have most pairs."""
    return spread_join(pairs, store.keep(facts.join(pairs.groupBy(key).agg(F.count("*").alias("n_rows")), key)), [key], "u")


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``; with each other one of ``a`` if there is no ``b``."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (a, b) if x is not None]
    if b is None:
        met, times = np.unique(sides[0][0], return_counts=True)
        met = met[times > 1]
    else:
        met = np.intersect1d(sides[0][0], sides[1][0])
    cells = []
    for values, row in sides:
        column = np.searchsorted(met, values)
        shared = np.flatnonzero(column < len(met))
        shared = shared[met[column[shared]] == values[shared]]
        shared = shared[np.argsort(column[shared], kind="stable")]
        cells.append((row[shared], column[shared]))
    out = np.zeros((len(a), len(a if b is None else b)), np.int64)
    for lo in range(0, len(met), COLUMNS):
        ones = []
        for x, (row, column) in zip((a, b), cells):
            first, last = np.searchsorted(column, (lo, lo + COLUMNS))
            ones.append(np.zeros((len(x), min(COLUMNS, len(met) - lo)), np.float32))
            ones[-1][row[first:last], column[first:last] - lo] = 1
        out += (ones[0] @ ones[-1].T).astype(np.int64)
    return out


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first member of each component of a symmetric matrix of neighbours to its others."""
    left, edges = np.ones(len(near), bool), []
    for start in range(len(near)):
        front = np.array([start] if left[start] else [], np.int64)
        left[front] = False
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            edges += [(start, x) for x in front.tolist()]
    return edges


def _between_parts(percent: int):
    """A function of the members of one pair of parts: (u, v) of roots that links between them hold together."""

    def between(table: pa.Table) -> pa.Table:
        part, root, n = (table[c].to_numpy() for c in ("part", "root", "n"))
        sets = [x.values.to_numpy() for x in table["s"]]
        i, j = (table[c][0].as_py() for c in "ij")
        x, y = (np.flatnonzero(part == k) for k in (i, j))
        edges, roots = [], np.unique(root)
        if len(roots) > 1 and len(x) and len(y):
            common = common_counts([sets[k] for k in x], None if i == j else [sets[k] for k in y])
            linked = (common * (100 + percent) >= (n[x][:, None] + n[y]) * percent) & (root[x][:, None] != root[y])
            at, to = np.nonzero(linked)
            at, to = np.searchsorted(roots, root[x])[at], np.searchsorted(roots, root[y])[to]
            near = np.zeros((len(roots), len(roots)), bool)
            near[at, to] = near[to, at] = True
            edges = forest(near)
        ends = roots[np.array(edges, np.int64).reshape(-1, 2)]
        return pa.table({"u": ends[:, 0], "v": ends[:, 1]})

    return between


def _next_members(members: DataFrame, store: Store) -> DataFrame:
    """Members of families (``g, u, root, n, s``), dealt to pairs ``i, j`` of the family's parts, of which ``part`` is their own.

    Parts of members in the family's largest component come last and are not paired with each other.
    """
    per = members.groupBy("g", "root").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"))
    sums = per.groupBy("g").agg(F.max(F.struct("n_rows", "n", "root")).alias("home"), F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"))

    def parts(rows: Column, n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(rows / PART_MEMBERS), F.ceil(n / PART_ELEMENTS)).cast("int")

    outside = parts(F.col("n_rows") - F.col("home.n_rows"), F.col("n") - F.col("home.n"))
    facts = store.keep(sums.select("g", "n_rows", F.col("home.root").alias("home"), outside.alias("outside"), parts(F.col("home.n_rows"), F.col("home.n")).alias("inside")))
    held = spread_join(members, facts, ["g"], "u").withColumn("is_inside", F.col("root") == F.col("home"))
    place = F.when(F.col("is_inside"), F.col("outside") + F.pmod(F.hash("u"), "inside")).otherwise(F.pmod(F.hash("u"), "outside"))
    others = F.sequence(F.lit(0), F.col("outside") - 1 + F.when(F.col("is_inside"), 0).otherwise(F.col("inside")))
    dealt = held.select("g", "root", "n", "s", place.alias("part"), F.explode(others).alias("other"))
    return dealt.select("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "root", "n", "s")


def _family_links(rays: DataFrame, label: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, store: Store) -> DataFrame:
    """(u, v) of roots that links between members of one family hold together; ``rays`` has (u, v) of the families."""
    of = components(rays, store)
    family = store.keep(of.toDF("u", "g").union(of.select(F.col("root").alias("u"), F.col("root").alias("g")).distinct()))
    sets = _sets(texts, nodes, family.select(F.col("u").alias("node")), store).withColumnRenamed("node", "u")
    members = store.keep(_rooted(family.join(sets, "u"), label, "u", "root"))
    store.drop(family)
    found = _next_members(members, store).groupBy("g", "i", "j").applyInArrow(_between_parts(percent), "u long, v long")
    return store.keep(found.distinct())


def _labels(nodes: DataFrame, texts: DataFrame, percent: int, store: Store) -> DataFrame:
    """(node, root) of every node with a link but the roots."""
    buckets = nodes.where("sketch IS NOT NULL").select("node", F.explode("bands").alias("key"))
    centres = store.keep(buckets.groupBy("key").agg(F.min("node").alias("c"), F.count("*").alias("n_rows")).where("n_rows > 1"))
    met = spread_join(buckets, centres.withColumn("k", F.col("n_rows")), ["key"], "node").where("node != c")
    met = store.keep(met.select("key", F.col("node").alias("u"), F.col("c").alias("v"), "k"))
    store.drop(centres)
    rays = store.keep(met.select("u", "v").distinct())

    facts = {x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv"}
    likely = store.keep(_plausible(_with_centre(rays.join(facts["u"], "u"), facts["v"], "v", store), percent).select("u", "v", "nu", "nv"))
    sets = _sets(texts, nodes, _ends(likely), store)
    sides = {x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "uv"}
    checked = _with_centre(likely.join(sides["u"], "u"), sides["v"], "v", store)
    same = n_common("su", "sv")
    links = store.keep(checked.where(same * (100 + percent) >= (F.col("nu") + F.col("nv")) * percent).select("u", "v"))
    store.drop(sets, likely)
    label = components(links, store)

    # Rays of one bucket that are not in one component; a bucket of two has no two rays.
    several = met.where("k > 2")
    roots = _rooted(several, label, "u", "root").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n_rows"))
    unsettled = store.keep(roots.where("a < b").select("key", "n_rows"))
    left = store.keep(spread_join(several, unsettled, ["key"], "u").select("u", "v").distinct())
    store.drop(rays, met, unsettled)
    if left.isEmpty():
        return label
    return _grown(label, _family_links(left, label, nodes, texts, percent, store), store)


def _grouped(docs: DataFrame, percent: int, row_id: str, text: str) -> DataFrame:
    """The rows of ``near_duplicates`` with the ``root`` node of their component, null without words."""
    store = Store(docs.sparkSession)
    texts = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    rows = store.keep(texts.select("row_id", "text_key", sketched("text").alias("k")).select("row_id", "text_key", "k.*"))
    first = F.min(F.struct(F.col("row_id").alias("at_id"), F.col("text_key").alias("at_text")))
    nodes = store.keep(
        rows.where("n > 0").groupBy("d1", "d2").agg(
            F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
            F.min("row_id").alias("name"), first.alias("at"), F.count("*").alias("n_rows"),
        ).withColumn("node", F.monotonically_increasing_id())
    )
    work = Store(docs.sparkSession)
    label = _labels(nodes, texts, percent, work)
    rooted = store.keep(_rooted(nodes.select("node", "name", "d1", "d2", "n_rows"), label, "node", "root"))
    names = store.keep(rooted.groupBy("root").agg(F.min("name").alias("component_id"), F.count("*").alias("n_rows")))
    of = store.keep(spread_join(rooted.withColumnRenamed("n_rows", "n_copies"), names, ["root"], "node").select("d1", "d2", F.col("n_copies").alias("n_rows"), "component_id", "root"))
    out = (F.col("row_id").alias(row_id), "text_key", F.col("n").alias("n_shingles"))
    full = spread_join(rows.where("n > 0").select("row_id", "text_key", "n", "d1", "d2"), of, ["d1", "d2"], "row_id").select(*out, "component_id", "root")
    empty = rows.where("n = 0").select(*out, F.col("row_id").alias("component_id"), F.lit(None).cast(full.schema["root"].dataType).alias("root"))
    found = store.keep(full.unionByName(empty).withColumn("kept", F.col(row_id).eqNullSafe(F.col("component_id"))))
    work.drop_all()
    store.drop_all(but=(found,))
    return found


def near_duplicates(docs: DataFrame, percent: int = 85, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``row_id``, ``text_key`` (hash of the text), ``n_shingles``, ``component_id``, ``kept``."""
    return _grouped(docs, percent, row_id, text).drop("root")


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents without all but one of each group; documents without words and rows without an id stay.

    Groups are told apart by their root and not by the id that names them, so unlike texts under one id all stay.
    """
    stay = _grouped(docs, percent, "doc_id", "text").where("kept")
    one = stay.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "root").agg(F.min("text_key").alias("text_key")).drop("root")
    always = stay.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "text_key").distinct()
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at_id, at_text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    keys = one.select(F.col("doc_id").alias("k_id"), "text_key", F.lit(True).alias("once")).union(always.select("doc_id", "text_key", F.lit(False)))
    joined = inner.join(keys, at_id.eqNullSafe(F.col("k_id")) & (F.xxhash64(at_text) == F.col("text_key")))
    rank = F.row_number().over(Window.partitionBy("k_id", "text_key").orderBy("k_id"))
    return joined.withColumn("rank", rank).where("rank = 1 OR NOT once").select(*inner.columns).toDF(*names)
