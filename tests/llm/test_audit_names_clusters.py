"""Divergence of sources, block names and rotated clusters on awkward rows, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("girthline.llm")

from girthline.llm import blocknames, clusters, divergence, queries, spread  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, term string, name int, n_rows int"


def words(rng, n, longest=7):
    return " ".join("".join(rng.choice("aeioubdgké你") for _ in range(rng.randint(1, longest))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = words(rng, 60).split() + ["x" * 8, "y" * 9, "z" * 16, "Z" * 17, "q" * 33, "Q" * 300, "ab" * 2_000, "ÿ" * 9, "Straße", "straße"]
    out = [
        (i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "a"]), "t", 1, 2)
        for i in range(90)
    ]
    out += [(100 + i, None, "en", "only nulls", None, None, None) for i in range(3)]
    out += [(200, "", None, None, None, None, None), (201, "lone", "xx", "s", None, None, None), (202, "a@b[c`d{e", "xx", "t", None, None, None)]
    out += [out[5], out[5], (None, "a b", "en", "a", "t", 1, 1), (None, None, None, None, None, None, None)]
    out += [(300 + i, "Same text", "hot", f"s{i % 3}", None, None, None) for i in range(40)]
    return out + [(340, " Same\t\n\x0b\x0c\rtext ", "hot", "s0", None, None, None), (341, "Same text", "hot", "s0", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def divergent(rows, least=10, top=10):
    """Plain and dense: every kept term of every group."""
    count, seen, groups = defaultdict(Counter), defaultdict(set), set()
    for r, (_, text, lang, source, *_rest) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = t.translate(LOWER)
            count[lang, source][t] += 1
            seen[lang, t].add(r)
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), d in seen.items() if x == lang and len(d) >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def scaled(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        q, p = scaled(whole), {s: scaled(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 10, 8 << 20])
def test_divergences_are_those_of_dense_tables(docs, rows, monkeypatch, slice_bytes):
    monkeypatch.setattr(divergence, "SLICE", slice_bytes)
    got = [tuple(r) for r in divergence.divergences(docs).collect()]
    want = divergent(rows)
    assert len(got) == len(want) and set(got) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(len(r[3]) > 16 for r in want)


def test_divergences_of_empty_tables_and_of_no_kept_term(spark, docs, rows):
    assert divergence.divergences(docs.limit(0)).count() == 0
    few = [r for r in rows if r[2] == "xx"]
    got = {tuple(r) for r in divergence.divergences(spark.createDataFrame(few, DOCS)).collect()}
    assert got == {("xx", "s", "pair", "t", 0, 1), ("xx", "t", "pair", "s", 0, 1)}


def test_runs_of_packed_terms_are_plain_counts():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aZé") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 400]))) for _ in range(50)) for _ in range(30)] + ["", None]
    group = np.sort(np.array([rng.randint(0, 3) for _ in texts]))
    want, docs_of = Counter(), defaultdict(set)
    for i, text in enumerate(texts):
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            want[t.translate(LOWER), int(group[i])] += 1
            docs_of[t.translate(LOWER), int(group[i])].add(i)
    got, got_docs = Counter(), Counter()
    for terms, g, n, d in divergence.term_runs(pa.array(texts), group):
        for t, x, c, k in zip(terms.to_pylist(), g.tolist(), n.tolist(), d.tolist()):
            assert (t, x) not in got
            got[t, x], got_docs[t, x] = c, k
    assert got == want and got_docs == {k: len(v) for k, v in docs_of.items()}


def test_scaled_counts_are_exact_for_large_numbers(spark):
    rng = random.Random(5)
    cases = [(c, n, v) for n in (0, 1, 10 ** 6, 8 * 10 ** 15) for v in (1, 77, 10 ** 6) for c in {0, n, n // 3, rng.randint(0, n)}]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", divergence._scaled(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10 ** 9 * (r.c + 2) // (r.n + 2 * r.v) for r in df.collect())


def duplicates(rows):
    groups = defaultdict(list)
    plain = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    for i, t in enumerate(plain):
        groups[t].append(i)
    out = []
    for t, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[best][0], len(members), hashlib.sha256(t.encode()).hexdigest()) for i in members]
    return out, len(groups)


def lengths(seed):
    """Texts around block ends, that differ in one place only."""
    rng = random.Random(seed)
    base = "".join(rng.choice("ab é\n") for _ in range(700))
    texts = [base, base[:-1], base + "x", base[:300] + "X" + base[301:], "Y" + base[1:], base * 3, base * 3 + " ", base * 3 + "a", base.replace("\n", " "), "a" * 64, "a" * 65, "a" * 128, "ab" * 64]
    return [(1000 + i, t, "en", "s", None, None, None) for i, t in enumerate(texts + texts[:4])]


@pytest.mark.parametrize("block, weak", [(4096, False), (16, False), (16, True), (7, True)])
def test_block_names_find_equal_texts_and_no_others(spark, rows, monkeypatch, block, weak):
    rows = rows + lengths(1)
    if weak:  # most keys are shared by different blocks
        monkeypatch.setattr(blocknames, "block_key", lambda b: F.crc32(b) % 5)
    found = blocknames.exact_duplicates(spark.createDataFrame(rows, DOCS), block=block).collect()
    want, n_groups = duplicates(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter(want)
    assert sum(r.kept for r in found) == n_groups and all(r.doc_id == r.keep_id for r in found if r.kept)
    assert len({(r.n_blocks, r.name) for r in found}) == n_groups


def test_block_names_of_empty_tables_and_long_texts(spark, docs):
    assert blocknames.exact_duplicates(docs.limit(0)).count() == 0
    long = "0123456789abcdef" * 300_000
    table = spark.createDataFrame([(1, long), (2, long + "x"), (3, "\n" + long), (4, long[:-1] + "e")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in blocknames.exact_duplicates(table).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_without_copies_keeps_whole_rows(docs, rows):
    kept = blocknames.without_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == duplicates(rows)[1] and all(tuple(r) in set(rows) for r in got)


def test_spread_join_deals_hot_keys(spark):
    table = spark.range(5000).select(F.col("id").alias("uid"), F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 50).alias("k"))
    keyed = table.groupBy("k").agg(F.count("*").alias("n_rows")).withColumn("v", F.col("k") * 2).checkpoint()
    joined = spread.spread_join(table, keyed, ["k"], "uid")
    assert sorted(map(tuple, joined.select("uid", "k", "v").collect())) == sorted((i, k, 2 * k) for i, k in ((r.uid, r.k) for r in table.collect()))


@pytest.mark.parametrize("hot", [True, False])
def test_spread_join_is_one_join(spark, hot):
    """pipeline near_dedup: no row goes through an outer join with the hot keys; a hot key is dealt to its places, also if the key's types differ."""
    table = spark.range(6000).select(F.col("id").alias("uid"), (F.col("id") % (7 if hot else 3000)).cast("int").alias("a"), F.concat(F.lit("b"), F.col("id") % 3).alias("b"))
    keyed = table.groupBy(F.col("a").cast("long").alias("a"), "b").agg(F.count("*").alias("n_rows")).withColumn("v", F.col("a") * 2).checkpoint()
    joined = spread.spread_join(table, keyed, ["a", "b"], "uid", keep=True)
    assert re.findall(r"Join (\w+)", joined._jdf.queryExecution().optimizedPlan().toString()) == ["Inner"]
    sizes = {(r.a, r.b): r.n_rows for r in keyed.collect()}
    want = sorted((r.uid, r.a, r.b, 2 * r.a, sizes[r.a, r.b]) for r in table.collect())
    assert sorted(map(tuple, joined.select("uid", "a", "b", "v", "n_rows").collect())) == want


def test_keys_of_one_digest_are_dealt_alike(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(spread.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(5)))
    table = spark.range(900).select(F.col("id").alias("uid"), F.when(F.col("id") < 500, F.col("id") % 4).otherwise(F.col("id")).alias("k"))
    keyed = table.groupBy("k").agg(F.count("*").alias("n_rows")).checkpoint()
    assert sorted(r.uid for r in spread.spread_join(table, keyed, ["k"], "uid").collect()) == list(range(900))


def lloyd(rows, dims, k, rounds, seed):
    """Plain Python integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    best = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = defaultdict(list)
        for _, x in kept:
            at[best(x)[1]].append(x)
        centroids = [[sum(v) // len(at[j]) for v in zip(*at[j])] if at[j] else c for j, c in enumerate(centroids)]
    found = [(i, *best(x)[::-1]) for i, x in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, c, d in found)


def vectors(dims, n, seed, scale=1.0):
    rng = random.Random(seed)
    hubs = [[rng.uniform(-scale, scale) for _ in range(dims)] for _ in range(5)]
    out = [(i, [float(np.float32(x + rng.gauss(0, 0.1 * scale))) for x in rng.choice(hubs)]) for i in range(n)]
    out += [out[0], (n, out[1][1]), (None, out[2][1]), (None, out[3][1]), (n + 1, None), (n + 2, []), (n + 3, [0.5] * (dims + 1)), (n + 4, [0.0] * dims)]
    bad = [float("nan"), float("inf"), -float("inf"), None]
    return out + [(n + 10 + i, [x] + [0.0] * (dims - 1)) for i, x in enumerate(bad)] + [(n + 30 + i, [0.25] * dims) for i in range(30)]


@pytest.mark.parametrize("dims, lead, n, scale", [(64, 16, 200, 1.0), (6, 2, 300, 100_000.0), (3, 3, 60, 0.002), (4, 1, 4, 1.0)])
def test_clusters_are_those_of_plain_integers(spark, dims, lead, n, scale):
    rows = vectors(dims, n, dims, scale)
    table = spark.createDataFrame([(v, i, 5) for i, v in rows], "embedding array<double>, vec_id long, cluster int")
    got = clusters.with_inertia(*clusters.clustered(table, dims=dims, lead=lead)).collect()
    assert Counter(map(tuple, got)) == lloyd(rows, dims, 8, 10, 3)


def test_clusters_of_few_no_and_too_large_vectors(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    kind = "vec_id long, embedding array<float>"
    got = clusters.with_inertia(*clusters.clustered(spark.createDataFrame(rows, kind), dims=2, lead=1)).collect()
    assert Counter(map(tuple, got)) == lloyd(rows, 2, 8, 10, 3)
    assert clusters.with_inertia(*clusters.clustered(spark.createDataFrame([], kind), dims=2, lead=1)).count() == 0
    with pytest.raises(Exception, match="fit a long"):
        clusters.clustered(spark.createDataFrame([(1, [1e20, 0.0])], kind), dims=2, lead=1)


def test_the_bound_spares_exact_distances():
    rng = np.random.default_rng(1)
    hubs = rng.integers(-2000, 2000, (8, 64))
    x = hubs[rng.integers(0, 8, 4000)] + rng.integers(-200, 200, (4000, 64))
    turn = np.linalg.eigh(np.cov(x.T))[1][:, ::-1].copy()
    best, distance, tested = clusters.nearest(x, *clusters._rotated(x, turn, 16), hubs, turn)
    plain = ((x[:, None, :] - hubs) ** 2).sum(2)
    assert (best == plain.argmin(1)).all() and (distance == plain.min(1)).all() and tested < 1.5 * len(x)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_block_names", "op13_rotated_clusters"])
def test_queries_equal_their_sql(spark, name):
    from checks import compare

    assert compare.compare(spark, compare.connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLE[name]) == ""
