"""Exact duplicates by deterministic block naming: blocks, then pairs of names, are sorted and named by integers.

A text without the characters of ``[\\x20\\x09-\\x0D]`` is cut into blocks of ``block`` bytes (an empty one is one empty block). The distinct
blocks are sorted and numbered; each document becomes a sequence of numbers. Then the distinct pairs of neighbours are sorted and
numbered, which halves every sequence (the last number of an odd one is paired with a number that no block has), until each document has one
number. Two documents are equal if and only if they have the same count of blocks and the same number: nothing is decided by a hash.

* Blocks are moved once, to be told apart, after each task has dropped its own repetitions; so a text that fills a third of the
  table moves once for each task. What is stored of a block is its number and a 64-bit key. Where different blocks share a key, which the
  sort shows, those blocks get names of their own and are found by their whole bytes.
* Documents find their blocks' numbers by those keys; a key with many rows is dealt to many tasks (``spread_join``).
* The rounds are as many as the longest text has doublings of a block, each on at most half the rows.

Null texts count as empty, and all empty texts are equal. Of equal texts the row with the most code points in its original text
stays, then the smallest id (a row without an id comes last), then any one of the repeated rows. Rows are told apart by a number
that is given once and stored, so repeated rows and ids stay apart. Other columns are not looked at. Texts of any length are one row
of at most 2 GB, as in Spark itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girthline.llm.spread import spread_join
from girthline.llm.store import Store

BLOCK = 4096
#: The second name of a pair whose first is the last of an odd sequence; no name is as small.
ALONE = -1 << 62


def normalised(text: Column) -> Column:
    """UTF-8 bytes of the text without white space; empty for a null."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "").cast("binary")


def block_key(block: Column) -> Column:
    return F.xxhash64(block)


def _pieces(docs: DataFrame, row_id: str, text: str, block: int) -> DataFrame:
    """One row for each block of each row; the facts of a row stand beside its first block."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(row_id).alias("row_id"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"), normalised(F.col(text)).alias("body"),
    )
    blocks = F.expr(f"transform(sequence(0, greatest(1, (octet_length(body) + {block - 1}L) div {block}) - 1), i -> substring(body, cast(i * {block} + 1 as int), {block}))")
    cut_up = rows.select("uid", F.struct("row_id", "n_chars", F.sha2("body", 256).alias("sha256")).alias("fact"), blocks.alias("blocks"))
    # Never empty; but the plain form would have Spark infer a filter that works the body out again for each of its blocks.
    out = cut_up.select("uid", "fact", F.size("blocks").alias("n"), F.posexplode_outer("blocks").alias("pos", "block"))
    return out.select("uid", "n", "pos", "block", block_key(F.col("block")).alias("key"), F.when(F.col("pos") == 0, F.col("fact")).alias("fact"))


def _named(found: DataFrame, keys: list[str], keep: list[str], store: Store) -> DataFrame:
    """The distinct ``keys`` sorted and numbered; ``keep`` are the columns to be stored with the number and the count of rows."""
    distinct = found.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return store.keep(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()).select(*keep, "name", "n_rows"))


def _first_names(pieces: DataFrame, store: Store) -> DataFrame:
    """``uid, pos, n, fact, name`` of all blocks."""
    names = _named(pieces, ["key", "block"], ["key"], store)
    shared = store.keep(names.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    whole = F.lit(b"").cast("binary")
    if not shared.isEmpty():
        own = _named(pieces.join(shared, "key", "left_semi"), ["key", "block"], ["key", "block"], store)
        marked = F.concat(F.lit(b"=").cast("binary"), F.col("block"))
        names = store.keep(
            names.join(shared, "key", "left_anti").select("key", whole.alias("whole"), "name", "n_rows")
            .union(own.select("key", marked, -1 - F.col("name"), "n_rows"))
        )
        pieces = pieces.join(shared.withColumn("several", F.lit(True)), "key", "left")
        whole = F.when(F.col("several"), marked).otherwise(whole)
    else:
        names = names.withColumn("whole", whole)
    found = pieces.select("uid", "pos", "n", "fact", "key", whole.alias("whole"))
    return store.keep(spread_join(found, names, ["key", "whole"], "uid").select("uid", "pos", "n", "fact", "name"))


def identities(docs: DataFrame, row_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``uid, row_id, n_chars, sha256, n_blocks, name``: equal texts, and only those, have equal ``n_blocks`` and ``name``."""
    store = Store(docs.sparkSession)
    level = _first_names(_pieces(docs, row_id, text, block), store)
    facts = level.where("pos = 0").select("uid", "fact.*", F.col("n").alias("n_blocks"))
    done = level.where("n = 1").select("uid", "name")
    left = level.where("n > 1").select("uid", "pos", "n", "name")
    longest = left.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        side = [F.min(F.when(F.col("pos") % 2 == i, F.col("name"))) for i in (0, 1)]
        pairs = store.keep(
            left.groupBy("uid", F.floor(F.col("pos") / 2).cast("int").alias("at"), F.ceil(F.col("n") / 2).cast("int").alias("half"))
            .agg(side[0].alias("a"), F.coalesce(side[1], F.lit(ALONE)).alias("b"))
        )
        names = _named(pairs, ["a", "b"], ["a", "b"], store)
        level = store.keep(spread_join(pairs, names, ["a", "b"], "uid").select("uid", F.col("at").alias("pos"), F.col("half").alias("n"), "name"))
        store.drop(pairs, names)
        done, left = done.union(level.where("n = 1").select("uid", "name")), level.where("n > 1")
        longest = -(-longest // 2)
    found = store.keep(facts.join(done, "uid"))
    store.drop_all(but=(found,))
    return found


def exact_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row: ``row_id``, ``keep_id`` (id of the row that stays), ``group_size``, ``kept``, ``text_sha256`` (of the
    normalised text) and the identity ``n_blocks, name``."""
    rows, store = identities(docs, row_id, text, block), Store(docs.sparkSession)
    first = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("row_id").isNull().alias("none"), "row_id", "uid"))
    groups = store.keep(
        rows.groupBy("n_blocks", "name").agg(F.count("*").alias("n_rows"), first.alias("first"))
        .select("n_blocks", "name", "n_rows", F.col("n_rows").alias("group_size"), F.col("first.row_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"))
    )
    found = spread_join(rows, groups, ["n_blocks", "name"], "uid")
    return found.select(F.col("row_id").alias(row_id), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha256").alias("text_sha256"), "n_blocks", "name")


def without_copies(docs: DataFrame, row_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one for each distinct normalised text."""
    stay = exact_duplicates(docs, row_id, text, block).where("kept").select(F.col(row_id).alias("_id"), F.col("text_sha256").alias("_sha"))
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at_id, at_text = F.col(f"c{names.index(row_id)}"), F.col(f"c{names.index(text)}")
    inner = inner.withColumn("_sha", F.sha2(normalised(at_text), 256)).withColumn("_chars", F.coalesce(F.char_length(at_text), F.lit(0)))
    found = inner.join(stay, at_id.eqNullSafe(F.col("_id")) & (inner["_sha"] == stay["_sha"])).drop(stay["_sha"])
    # Rows with one id and equal normalised texts: the longest, any one of those.
    columns = [f"c{i}" for i in range(len(names))]
    best = found.groupBy("_id", "_sha").agg(F.max_by(F.struct(*columns), "_chars").alias("row"))
    return best.select("row.*").toDF(*names)
