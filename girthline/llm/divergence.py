"""How the sources of a language differ in their terms: exact counts by length-bucketed packing, divergences in integers.

A term is a run of ASCII letters and of characters beyond ASCII, A-Z lowered. In a task, terms of up to 8 bytes become one unsigned 64-bit word
and terms of up to 16 bytes two (zeros fill up: no term holds a zero byte); they lie in buckets by their length in pairs of bytes, and each bucket
is radix-sorted by 16-bit digits, as many as its length needs, and run-counted. Longer terms lie in buckets by powers of two of their length and are
sorted as bytes. As the texts of a slice are ordered by group and sorting is stable, a run also shows its groups and documents.

* Each slice of ``SLICE`` bytes of whole texts (or one longer text) gives a row for each (lang, source, term); Spark adds them up. So memory is
  bounded by a slice or the longest text, and no key is hot: a term of a group comes once from each slice.
* A language keeps the terms in at least ``least`` of its documents. With V kept terms and N occurrences of them in a group, a term
  counted c times there has p = 1 + floor(10^9 (c + 2) / (N + 2 V)); the division goes by thousands, exact for N + 2 V below 9 * 10^15.
* A pair of sources sums f = floor((p - q)^2 / (p + q)) over all kept terms. Terms that neither has add V f(z, z'), z being the p of
  a term not there. What a term of one source changes depends on its count alone, so it is taken from a table of counts. Terms of both are read in
  order, and a task adds up the pairs of neighbours in numpy; it stores sums for each pair of sources, not for each term.

Null text, lang or source count as empty. Equal rows count as often as they stand. A group without terms has N = 0, and takes part; a
language without kept terms gives 0 for each pair and no terms. Ties are ordered by the UTF-8 bytes of the item. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girthline.llm import bytewords as B
from girthline.llm.spread import spread_join
from girthline.session import cut

SLICE, LEAST, TOP, PLACES = 8 << 20, 10, 10, 64

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_HIGH = np.array([0] + [(1 << 64) - (1 << 64 - 8 * n) for n in range(1, 9)], np.uint64)


def _packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """One or two big-endian words of each span of at most 16 bytes; ``data`` has 16 more bytes at its end."""
    loads = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    out = [loads[starts].astype(np.uint64) & _HIGH[np.minimum(lengths, 8)]]
    if len(lengths) and lengths.max() > 8:
        out.append(loads[starts + 8].astype(np.uint64) & _HIGH[lengths - 8])
    return out


def _radix_order(words: list[np.ndarray], digits: int) -> np.ndarray:
    """Stable order by the first ``digits`` 16-bit digits of the words, the last digit first."""
    order = None
    for d in range(digits - 1, -1, -1):
        digit = (words[d // 4] >> np.uint64(48 - 16 * (d % 4))).astype(np.uint16)
        step = np.argsort(digit if order is None else digit[order], kind="stable")
        order = step if order is None else order[step]
    return order


def _strings(parts: np.ndarray) -> pa.Array:
    """A string column from rows of bytes that end in zeros."""
    inside = parts != 0
    ends = np.concatenate(([0], np.cumsum(inside.sum(1)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(ends.tobytes()), pa.py_buffer(parts[inside].tobytes()))


def _runs(changed: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted occurrences: where each run of one term and group begins, its group, length, and count of documents."""
    new = np.ones(len(group), bool)
    new[1:] = changed | (group[1:] != group[:-1])
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    return at, group[at], np.diff(np.append(at, len(new))), np.add.reduceat(fresh.astype(np.int64), at)


def term_runs(strings: pa.Array, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket: terms, their groups, counts and documents. ``group`` ascends and numbers the texts' groups."""
    data, at = B.flat(strings)
    data = np.append(B.LOWER[data], np.zeros(16, np.uint8))
    starts, ends, first = B.words(data[:-16], at, LETTERS)
    doc = np.repeat(np.arange(len(group), dtype=np.int32), np.diff(first))
    lengths = ends - starts
    bucket = np.where(lengths <= 16, (lengths + 1) // 2, 8 + np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        s, n, d = starts[mine], lengths[mine], doc[mine]
        if b <= 8:
            words = _packed(data, s, n)
            order = _radix_order(words, int(b))
            words, d = [w[order] for w in words], d[order]
            changed = np.zeros(len(d) - 1, bool)
            for w in words:
                changed |= w[1:] != w[:-1]
            place, g, count, docs = _runs(changed, group[d], d)
            parts = np.column_stack([w[place].astype(">u8").view(np.uint8).reshape(-1, 8) for w in words])
            yield _strings(parts), g, count, docs
        else:
            width = int(n.max())
            padded = np.zeros((len(s), width), np.uint8)
            if width <= 256:
                padded[np.arange(width) < n[:, None]] = data[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())]
            else:
                for row, at_byte, size in zip(padded, s.tolist(), n.tolist()):
                    row[:size] = data[at_byte:at_byte + size]
            whole = padded.view(f"S{width}").ravel()
            order = np.argsort(whole, kind="stable")
            whole, d = whole[order], d[order]
            place, g, count, docs = _runs(whole[1:] != whole[:-1], group[d], d)
            yield _strings(padded[order[place]]), g, count, docs


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source"))
        group = np.asarray(lang.indices).astype(np.int64) * max(len(source.dictionary), 1) + np.asarray(source.indices)
        order = np.argsort(group, kind="stable")
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64)[order])
        first = 0
        while first < len(order):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE, "right")))
            here = order[first:last]
            for terms, g, count, docs in term_runs(batch.column("text").take(pa.array(here)), group[here]):
                li, si = g // len(source.dictionary), g % len(source.dictionary)
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(li)).cast(pa.string()), source.dictionary.take(pa.array(si)).cast(pa.string()), terms,
                     pa.array(count, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)
            first = last


def _scaled(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in longs; null where nothing is kept."""
    d = F.when(kept > 0, total + 2 * kept)
    out, rest = F.lit(1).cast("long"), count + 2
    for power in (1_000_000, 1_000, 1):
        out = out + F.call_function("div", rest * 1000, d) * power
        rest = (rest * 1000) % d
    return out


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f_numpy(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms of both sources change in the sum of each pair of sources; rows come ordered by lang, term and source."""
    def sums(t: pa.Table) -> pa.RecordBatch:
        source = t.column("source").combine_chunks().dictionary_encode()
        lang = t.column("lang").combine_chunks().dictionary_encode()
        s, n = np.asarray(source.indices).astype(np.int64), max(len(source.dictionary), 1)
        p, z = np.asarray(t.column("p")), np.asarray(t.column("z"))
        word, keys, values = np.cumsum(starts(t)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, len(s)):
            a = np.flatnonzero(word[step:] == word[:-step])
            if not len(a):
                break
            b = a + step
            keys.append((np.asarray(lang.indices).astype(np.int64)[a] * n + s[a]) * n + s[b])
            values.append(_f_numpy(p[a], p[b]) - _f_numpy(p[a], z[b]) - _f_numpy(z[a], p[b]) + _f_numpy(z[a], z[b]))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(values))
        take = lambda d, i: d.dictionary.take(pa.array(i)).cast(pa.string())
        return pa.record_batch({"lang": take(lang, key // (n * n)), "source": take(source, key // n % n), "item": take(source, key % n), "value": pa.array(total)})

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(len(t), bool)
        if len(t) > 1:
            same = [np.asarray(pc.equal(t.column(c).combine_chunks()[1:], t.column(c).combine_chunks()[:-1])) for c in ("lang", "term")]
            new[1:] = ~(same[0] & same[1])
        return new

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        last = int(np.flatnonzero(starts(table))[-1]) if len(table) else 0
        if last:
            yield sums(table.slice(0, last))
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield sums(rest)


def term_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, n_lang`` of the kept terms where they occur: occurrences in the group and in the language."""
    rows = docs.select(*(F.col(c).cast("string").alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    one = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    return (
        one.withColumn("all_docs", F.sum("docs").over(whole)).withColumn("n_lang", F.sum("n").over(whole))
        .where(F.col("all_docs") >= least).select("lang", "source", "term", "n", "n_lang")
    )


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` for each other source of the language, ``term`` for the ``top`` terms that
    the source has more of than its language."""
    kept = cut(term_counts(docs, least, text, lang, source))
    occurring = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_rows"))
    langs = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = occurring.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "n_rows", "v", "lang_total"])
    groups = cut(groups.withColumn("z", _scaled(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    rows = cut(spread_join(kept, groups, ["lang", "source"], "term").withColumn("p", _scaled(F.col("n"), F.col("total"), F.col("v"))))

    # A language is dealt to PLACES places, each of which knows all its sources: the result has a row for each two of them anyway.
    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zi"), F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))).alias("place"))
    dealt = lambda d, *by: d.withColumn("place", F.pmod(F.xxhash64(*by), F.lit(PLACES)).cast("int")).join(others, ["lang", "place"]).where("source <> item")
    pairs = dealt(groups.select("lang", "source", "v", "z"), "source")
    none = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _f(F.col("z"), F.col("zi"))).otherwise(F.lit(0).cast("long")).alias("value"))
    by_count = dealt(rows.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("terms")), "source", "p")
    one = by_count.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (_f(F.col("p"), F.col("zi")) - _f(F.col("z"), F.col("zi")))).alias("value"))
    ordered = rows.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = ordered.mapInArrow(_shared, "lang string, source string, item string, value bigint")
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = none.union(one).union(turned(one)).union(both).union(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = _scaled(F.col("n_lang"), F.col("lang_total"), F.col("v"))
    terms = rows.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = ("lang", "source", "part", "item", "value", "rank")
    pair_rows = summed.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*out)
    return pair_rows.union(terms.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*out))
