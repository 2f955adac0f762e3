"""Corpus operators on small tables with awkward rows, against brute force."""

import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("girthline.llm")

from checks import compare  # noqa: E402
from girthline.llm import (  # noqa: E402
    containment, licenses, mixing, neardup, preference, quality, queries, sharding, tokenfiles, toxicity, urls,
)

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, source string, size string, row_id int, node int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def changed(text, places, seed=1):
    words = text.split()
    for k in range(places):
        words[(k + 1) * len(words) // (places + 1)] = f"x{seed}y{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    long = prose(3, 6000)
    texts = [prose(1, 200), changed(prose(1, 200), 2), changed(prose(1, 200), 5, 2), prose(1, 200).upper(), None, "", "  \n\t ",
             "one two three", "one two three", "One  two three", "a b c d", "é 你好 🙂 x y z", long, changed(long, 30), long + " tail",
             "same line\nsame line\n\nother line\nsame line", "w " * 300, "### $$$ %%% " * 40, prose(5, 60) + " Licensed under CC BY-NC 4.0. " + prose(6, 10),
             "The GNU General Public License. gnu general public license; MIT License, MIT LICENSE apache license", "mit licenses cc b y"]
    out = [(i, t, f"s{i % 3}", "clash", i, 7) for i, t in enumerate(texts)]
    return out + [out[0], out[0], (None, prose(9, 70), None, None, None, None), (None, None, None, None, None, None), (900, prose(1, 200), "s0", None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, pattern):
    words = re.findall(pattern, (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent):
    sets = [shingles(r[1], "[^\x20\x09-\x0D]+") for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) * 100 >= len(a | sets[j]) * percent:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return Counter((r[0], len(s), least.get(g)) for r, s, g in zip(rows, sets, group))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(docs, rows, percent):
    got = neardup.near_duplicates(docs, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_and_rays_lose_no_link(spark):
    # Each text differs a little from the next: the ends of a chain are unlike, and many texts share buckets.
    base, rows = prose(11, 120), []
    for i in range(40):
        base = changed(base, 1, i) if i % 10 else prose(100 + i, 120)
        rows.append((i, base, "s", "", 0, 0))
    random.Random(2).shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 85)


def test_deduplicate_keeps_one_of_each_group(docs, rows):
    left = neardup.deduplicate(docs, 80).collect()
    assert left[0].asDict().keys() == {"doc_id", "text", "source", "size", "row_id", "node"}
    ids = Counter(r.doc_id for r in left)
    assert ids[0] == 1 and ids[3] == ids[900] == ids[8] == ids[9] == 0 and ids[7] == 1
    assert ids[4] == ids[5] == ids[6] == 1 and ids[None] == 2


def test_deduplicate_keeps_unlike_texts_of_one_id(spark):
    one, other, third = prose(21, 120), prose(22, 120), prose(23, 120)
    rows = [(7, one), (7, other), (7, other), (7, changed(other, 1)), (8, changed(one, 1)), (9, third), (7, ""), (9, changed(third, 1))]
    got = [tuple(r) for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()]
    assert Counter(i for i, _ in got) == {7: 3, 9: 1}
    assert {(7, one), (7, "")} < set(got) and len({(7, other), (7, changed(other, 1))} & set(got)) == 1


def test_bands_miss_little_at_the_threshold():
    import numpy as np

    rng, missed = np.random.default_rng(4), 0
    for n in (14, 40, 400):
        for _ in range(60):
            common = round(n * 0.85)
            pool = np.unique(rng.integers(0, 1 << 63, 4 * n, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[n - common:n], pool[n:n + max(0, common + round((n - common) * 0.0) - common)])))
            x, y = (neardup._band_keys(neardup.signature(s)) for s in (a, b))
            missed += not (x == y).any()
    assert missed == 0


def test_contained_items_equal_brute_force(spark, docs, rows, monkeypatch):
    items = [(0, prose(1, 200)[:180]), (1, "one two three"), (2, ""), (3, None), (4, " ".join(prose(3, 6000).split()[500:540])),
             (5, "nowhere to be found " * 3), (None, "a b c d"), (4, "one two three")]
    pattern = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = Counter()
    for r in rows:
        d = shingles(r[1], pattern)
        for i, t in items:
            s = shingles(t, pattern)
            if s and len(s & d) * 100 >= 80 * len(s):
                want[(r[0], i, len(s), len(s & d))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {r[1] for r in rows if any((s := shingles(t, pattern)) and len(s & shingles(r[1], pattern)) * 100 >= 80 * len(s) for _, t in items)}
    clean = Counter(r[0] for r in rows if r[1] not in bad)
    for bound in (containment.BROADCAST_SHINGLES, 0):
        monkeypatch.setattr(containment, "BROADCAST_SHINGLES", bound)
        got = containment.contained_items(docs, bench).collect()
        assert Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got) == want
        assert Counter(r.doc_id for r in containment.decontaminate(docs, bench).collect()) == clean
        assert containment.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_licences_equal_brute_force(docs, rows):
    got = {(r.doc_id, r.n_words): r for r in licenses.scanned(docs).collect()}
    for r in rows:
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        row = got[(r[0], len(words))]
        assert (row.n_base, row.base_labels) == (len(places), ",".join(sorted({x for _, x in places})))
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert 0 <= row.score <= 1 and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
    assert got[(18, 77)].labels == "cc-by,cc-by-nc" and got[(18, 77)].score == 1.0
    assert licenses.scanned(docs).count() == len(rows)


def test_token_files_round_trip(docs, rows, tmp_path, spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    odd = ["", " ", "a  b", "a \n b  c", "\u00a0\u3000 x", "it's  'll we've\t\tq", "<|endoftext|> a <|endoftext|>", "1 22 333 4444", "a" * 5000 + " " * 300 + "b", "\x1c a \x1f b"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    tokenfiles.write_token_files(table, f"file://{tmp_path}/out", path)
    got = sorted(tokenfiles.read_token_files(spark, f"file://{tmp_path}/out").collect(), key=lambda r: r.start)
    ids = [r.row_id if r.row_id is not None else -1 for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    want = Counter()
    for i, t in [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(odd)]:
        tokens = reference.encode(t or "", add_special_tokens=False).ids + [0]
        want[(i, len(tokens), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in tokens)))] += 1
    assert Counter((r.row_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_block_files_cross_blocks(tmp_path):
    import numpy as np

    ids = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint32)
    with open(tmp_path / "x", "wb") as out:
        writer = tokenfiles.BlockWriter(out, 64)
        for piece in np.array_split(ids, 37):
            writer.add(piece)
        writer.close()
    with open(tmp_path / "x", "rb") as source:
        reader = tokenfiles.BlockReader(source, os.path.getsize(tmp_path / "x"))
        for first, n in ((0, 1000), (63, 2), (500, 1), (999, 1), (64, 64), (5, 0)):
            assert np.array_equal(np.concatenate([*reader.read(first, n), np.zeros(0, np.uint32)]), ids[first:first + n])


def test_quality_equals_brute_force(docs, rows):
    got = Counter(tuple(r) for r in quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))] += 1
    assert got == want


def test_cascade_order_doesnt_change_the_verdict(docs):
    found = quality.measured(docs)
    names = list(quality.RULES)
    one, two = (found.select(quality.cascade(order).isNull().alias("ok")).collect() for order in (names, names[::-1]))
    assert one == two
    order = quality.ordered_rules(docs)
    assert [r / c for _, c, r in order] == sorted((r / c for _, c, r in order), reverse=True)


def test_mixing_draws(spark, docs, rows, nothing):
    assert mixing.mixed(nothing).count() == 0
    again = [sorted(map(str, mixing.mixed(docs.repartition(n)).drop("mix_key").collect())) for n in (1, 5)]
    assert again[0] == again[1]
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"), F.when(F.col("id") < 3900, "big").otherwise("rare").alias("source"))
    found = mixing.mixed(many, {"big": 1.0, "rare": 9.0}, 2.0).groupBy("source").agg(F.count("*").alias("n"), F.max("rate").alias("rate")).collect()
    n = {r.source: r.n for r in found}
    assert {r.source: round(r.rate, 6) for r in found} == {"big": round(800 / 3900, 6), "rare": 72.0}  # above PART: drawn in two parts
    assert abs(n["big"] - 800) < 6 * 800**0.5 and abs(n["rare"] - 7200) < 6 * 7200**0.5


def test_shards(spark, docs, rows, nothing):
    assert sharding.sharded(nothing, 4).count() == 0
    hot = docs.select("doc_id", "text", "size").union(spark.range(3000).select(F.col("id") + 5000, F.lit("the same text over and over"), F.lit(None)))
    got = sharding.sharded(hot, 7).collect()
    assert len(got) == len(rows) + 3000
    per = {s: [r for r in got if r.shard == s] for s in range(7)}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in per.values())
    sizes = [sum(r.size for r in x) for x in per.values()]
    assert sum(sizes) == sum(len((r.text or "").encode()) + 16 for r in got) and max(sizes) - min(sizes) < max(r.size for r in got)
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)


def test_urls(spark):
    cases = [("http://a.example.net/en/1", "example.net/en/", "allow"), ("http://EXAMPLE.net/fr/", "net/", "block"), ("http://x.net", None, "allow"),
             ("http://x.net?q=/", None, "allow"), ("ftp://a.org/fr/x?y#z", "org/fr/", "allow"), ("https://badexample.com/de/", None, "allow"),
             ("https://b.example.com/de/?x", "example.com/de/", "block"), (None, None, "allow"), ("no scheme", None, "allow"), ("", None, "allow"),
             ("http://" + "a." * 3000 + "net/" + "x" * 50000, "net/", "block"), ("http://a.example.net/en/1", "example.net/en/", "allow"), ("x://u:/en/://net/", None, "allow")]
    pages = spark.createDataFrame([(i if i % 4 else None, u, "clash") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host string")
    got = urls.judged(pages, urls.rule_table(pages)).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter((i if i % 4 else None, a, b) for i, (_, a, b) in enumerate(cases))
    tied = spark.createDataFrame([("net", "/ab", "allow"), ("b.net", "/", "block"), ("b.net", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    page = spark.createDataFrame([(1, "http://b.net/ab")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urls.judged(page, tied).collect()] == [("b.net/", "block")]
    assert [r.verdict for r in urls.judged(page, tied.limit(0)).collect()] == ["allow"]


def test_urls_with_a_second_scheme(spark):
    cases = {
        "http://example.net?u=http://x/en/": ("example.net", "", None, "allow"),
        "http://example.net#http://x/en/": ("example.net", "", None, "allow"),
        "http://a.net?u=http://b/en/": ("a.net", "", None, "allow"),
        "http://a.net://b/en/": ("a.net:", "//b/en/", None, "allow"),
        "http://a.net/x?u=http://b/en/": ("a.net", "/x", "net/", "block"),
        "://example.net/en/\n?q": ("example.net", "/en/\n", "example.net/en/", "allow"),
        "a\nb://EXAMPLE.net/en/": ("example.net", "/en/", "example.net/en/", "allow"),
        "http://": ("", "", None, "allow"), "http:/a/en/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, urls.rule_table(pages)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_toxicity_on_held_out_documents(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(900):
        words = prose(i, rng.randint(5, 400)).split()
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "Nastig", "grobian"]) + rng.choice(["", "s", "en"]))
        rows.append((i, " ".join(words), "s", "", 0, 0))
        labels.append((i, int(toxic) if i < 700 else None))
    docs, table = spark.createDataFrame(rows + [(None, None, None, None, None, None), (5000, "", "s", "", 0, 0)], DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = {i: any(x in t.lower() for x in ("vilewort", "nastig", "grobian")) for i, t, *_ in rows}
    got = toxicity.severities(docs, table).collect()
    held = [r for r in got if r.doc_id is not None and 700 <= r.doc_id < 900]
    assert sum(r.rejected == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert not any(r.rejected for r in got if r.doc_id in (None, 5000))
    for r in got:
        assert abs(sum((r.p0, r.p1, r.p2, r.p3)) - 1) < 1e-9 and abs(r.severity - (r.p1 + 2 * r.p2 + 3 * r.p3)) < 1e-9
    more = {i: sum(t.lower().count(x) for x in ("vilewort", "nastig", "grobian")) for i, t, *_ in rows}
    mild, grave = ([r.severity for r in held if more[r.doc_id] in k] for k in ((2,), (5, 6)))
    assert sum(mild) / len(mild) < sum(grave) / len(grave)
    assert not any(r.rejected for r in toxicity.severities(docs, table.where("toxic = 1")).collect())
    assert toxicity.without_toxic(docs, table).columns == docs.columns


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    a = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", None, ""), (2, 1, "assistant", "x", ""), (3, 0, "user", "q", ""), (3, 0, "user", "q", ""), (None, 0, "user", "z", ""), (4, None, "user", "n", "")]
    b = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "bad", ""), (1, 2, "user", "why", ""), (2, 0, "user", None, ""), (2, 1, "assistant", "x", ""), (3, 0, "user", "q", ""), (5, 0, "assistant", "only", ""), (4, None, "user", "n", "")]
    got = preference.preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    seen = Counter((r.pair_id, r.part, r.turn, r.role, r.train) for r in got)
    assert seen == Counter({(1, "prompt", 0, "user", False): 1, (1, "chosen", 1, "assistant", True): 1, (1, "rejected", 1, "assistant", True): 1, (1, "rejected", 2, "user", False): 1,
                            (2, "prompt", 0, "user", False): 1, (2, "prompt", 1, "assistant", False): 1, (3, "prompt", 0, "user", False): 1, (3, "chosen", 0, "user", False): 1,
                            (4, "prompt", None, "user", False): 1, (5, "rejected", 0, "assistant", True): 1})
    assert [r.segment for r in got if r.part == "chosen" and r.pair_id == 1] == ["<|assistant|>\ngood\n<|end|>\n"]


@pytest.mark.parametrize("operator", [
    lambda d: neardup.near_duplicates(d), lambda d: neardup.deduplicate(d), lambda d: licenses.scanned(d), lambda d: quality.judged(d),
    lambda d: containment.contained_items(d, d.withColumnRenamed("doc_id", "item_id")),
    lambda d: urls.judged(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), urls.rule_table(d)),
])
def test_empty_tables(nothing, operator):
    assert operator(nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, name):
    assert compare.compare(spark, compare.connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLE[name]) == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"] and out.count() > 0
