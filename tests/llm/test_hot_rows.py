"""Groups that hold most rows, unlike texts that weak hashes confuse, and the pipeline row by row."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("girthline.llm")

from girthline.llm import bytewords, containment, neardup, preference, sharding, tokenfiles, toxicity, urls  # noqa: E402
from tests.llm.test_corpus import DOCS, brute_components, changed, prose, shingles  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def thue_morse(n):
    """Two unlike texts on which every polynomial hash modulo 2^64 agrees."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_span_hashes_tell_words_apart():
    texts = [*thue_morse(1024), *thue_morse(2048), *thue_morse(16), "A" * 300, "a" * 300, "a" * 301, "a" * 255, "a", "b", "a\x00", "\x00a", "aaaaaaaab", "baaaaaaaa"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for seed in (0, 1):
        plain = bytewords.span_hashes(data, ends - [len(t) for t in texts], ends, False, seed)
        assert len(set(plain.tolist())) == len(texts)
    lowered = bytewords.span_hashes(data, ends - [len(t) for t in texts], ends, True)
    assert len(set(lowered.tolist())) == len(texts) - 1 and lowered[6] == lowered[7]


def test_unlike_words_are_no_near_duplicates_and_no_leak(spark):
    a, b = thue_morse(1024)
    docs = spark.createDataFrame([(1, a, "", "", 0, 0), (2, b, "", "", 0, 0), (3, f"{a} x y z w", "", "", 0, 0), (4, f"{b} x y z w", "", "", 0, 0)], DOCS)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    items = spark.createDataFrame([(7, a), (8, f"{b} x y z w")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in containment.contained_items(docs, items).collect()} == {(1, 7), (4, 8)}


@pytest.mark.parametrize("weak", [False, True])
def test_token_ids_of_unlike_pieces(monkeypatch, weak):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    if weak:  # the first hash hardly tells anything
        whole = bytewords.span_hashes
        monkeypatch.setattr(bytewords, "span_hashes", lambda d, s, e, low, seed=0: whole(d, s, e, low, seed) % np.uint64(7) if seed == 0 else whole(d, s, e, low, seed))
    plain = Tokenizer.from_file(path)
    texts = [*thue_morse(1024), prose(1, 80), prose(2, 80), "", "a b c\n\n d", prose(1, 80).upper()]
    encoder = tokenfiles.PieceEncoder(path)
    for _ in range(2):
        assert [x.tolist() for x in encoder.texts(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_families_around_the_threshold_lose_no_link(spark, monkeypatch, broadcast):
    """Copies that differ from their centre by more than the threshold, but in pairs by less, among many that are linked with none."""
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", broadcast)
    rng, rows = random.Random(8), []
    base = prose(50, 160)
    for i in range(70):
        loose = changed(base, rng.choice([3, 5, 6, 7]), 1000 + i)
        rows.append((i, loose, "", "", 0, 0))
        if i % 3 == 0:
            rows.append((500 + i, changed(loose, rng.choice([1, 2, 3]), 3000 + i), "", "", 0, 0))
    rows += [rows[3], rows[3], (None, rows[5][1], "", "", 0, 0)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    want = brute_components(rows, 85)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert 20 < len({c for _, _, c in want}) < 90


def test_families_spread_their_links_in_few_pairs(spark, monkeypatch):
    """Members of a family without links meet their centre and a few others, not each other."""
    seen, real = [], neardup._next_members

    def counted(*a):
        more = real(*a)
        seen.append(more.count())
        return more

    monkeypatch.setattr(neardup, "_next_members", counted)
    base, n = prose(60, 200), 150
    rows = [(i, changed(base, 9, 100 + i), "", "", 0, 0) for i in range(n)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 85)
    assert sum(seen) < 8 * n


@pytest.mark.parametrize("percent", [85, 80])
def test_parts_of_a_family_lose_no_link(spark, monkeypatch, percent):
    """Links between members of one part, of two parts, and of a part in the largest component, counted over several slices of elements."""
    for name, value in (("PART_MEMBERS", 9), ("COLUMNS", 64)):
        monkeypatch.setattr(neardup, name, value)
    rng, base = random.Random(9), prose(70, 160)
    rows = [(i, changed(base, rng.choice([1, 2, 3, 5, 7, 9]), 5000 + i), "", "", 0, 0) for i in range(60)]
    rows += [(200 + i, changed(rows[i][1], rng.choice([1, 2, 3]), 6000 + i), "", "", 0, 0) for i in range(0, 60, 4)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, percent)


def test_tables_of_a_family_grow_with_its_members(spark, monkeypatch):
    """op9_minhash_near_dedup and near_dedup of the pipeline: no table between holds elements or pairs of members of unsettled buckets."""
    sizes, real = [], neardup.Store.keep

    def counted(self, df):
        out = real(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup.Store, "keep", counted)
    base, n = prose(61, 200), 150
    rows = [(i, changed(base, random.Random(i).choice([2, 4, 6, 8]), 100 + i), "", "", 0, 0) for i in range(n)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 85)
    assert max(sizes) <= neardup.BANDS * n


def test_common_counts_equal_brute_force():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(k)] for k in (20, 7))
    assert neardup.common_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    square = neardup.common_counts(a)
    assert all(square[i, j] == len(np.intersect1d(a[i], a[j])) for i in range(20) for j in range(20) if i != j)


def test_equal_rows_are_cut_like_others(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 250)
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("equal in all columns").alias("text"))
    other = spark.range(100).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("row "), F.col("id")).alias("text"))
    got = sharding.sharded(same.union(other), 4).collect()
    assert len(got) == 3100 and Counter((r.doc_id, r.text) for r in got)[1, "equal in all columns"] == 3000
    per = {s: [r for r in got if r.shard == s] for s in range(4)}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in per.values())
    sizes = [sum(r.size for r in x) for x in per.values()]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 4 and all(r.text_crc32 == zlib.crc32(r.text.encode()) for r in got)


def test_an_id_on_many_rows_counts_once_in_the_fit(spark, monkeypatch):
    rows = [(i, prose(i, 40) + (" vile scum" if i % 2 else "")) for i in range(60)] + [(1, prose(1000 + i, 5)) for i in range(500)] + [(2, prose(2, 40))] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sizes, real = [], toxicity.fit_arrays
    monkeypatch.setattr(toxicity, "fit_arrays", lambda bins, counts, y, told: (sizes.append(len(y)), real(bins, counts, y, told))[1])
    toxicity.fit(docs, labels)
    assert sizes == [60]


def test_rejected_sides_of_ids_with_gaps(spark):
    talk = [("user", "q"), ("assistant", "first"), ("user", "more"), ("assistant", "last")]
    rows = [(c, t, role, f"{text} {c}", 1) for c in (3, 10, 44, 100, 7000) for t, (role, text) in enumerate(talk)] + [(55, 0, "user", "alone", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = preference.preferences(*preference.swapped_replies(table)).collect()
    parts = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.turn, r.place)):
        parts[r.pair_id, r.part].append(r.segment.split("\n")[1])
    assert {p for p, _ in parts} == {3, 10, 44, 100, 7000}
    # 3: last reply of the next; 10: first reply; 44: ends early; 7000 takes the first conversation's.
    assert parts[3, "rejected"] == ["last 10"] and parts[3, "chosen"] == ["last 3"] and len(parts[3, "prompt"]) == 3
    assert parts[10, "rejected"] == ["last 44", "more 10", "last 10"] and parts[10, "prompt"] == ["q 10"]
    assert parts[44, "rejected"] == [] and parts[44, "chosen"] == ["last 44"]
    assert parts[7000, "rejected"] == ["last 3", "more 7000", "last 7000"]
    single = table.where("conv_id = 3")
    assert preference.preferences(*preference.swapped_replies(single)).count() == 0
    assert preference.preferences(*preference.swapped_replies(table.limit(0))).count() == 0


def test_only_the_first_scheme_counts(spark):
    pages = spark.createDataFrame([(1, "http://a.net?u=http://b.com/en/"), (2, "http://example.net#x://y/en/"), (3, "http://example.net?u=http://x/en/")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judged(pages, urls.rule_table(pages)).collect()}
    assert got == {1: ("a.net", "", None), 2: ("example.net", "", None), 3: ("example.net", "", None)}


def test_empty_tables_of_files_severities_and_pipeline_stages(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tokenfiles.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert toxicity.severities(docs, labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_pipeline_equals_brute_force_stage_by_stage(spark):
    import corpus_pipeline

    docs, stages = spark.read.parquet(f"{FOLDER}/documents.parquet"), dict(corpus_pipeline.STAGES)
    before = docs.collect()

    def through(name, kept):
        rows = spark.createDataFrame(kept, docs.schema) if kept else docs.limit(0)
        return stages[name](spark, rows, FOLDER).collect()

    # Toxicity: what the fitted model's own chances say, worked out from its weights.
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    weight = dict(zip(model.bins.tolist(), model.weights.tolist()))
    clean = [r for r in before if not plainly_toxic(r.text, model, weight)]
    kept = through("toxicity", before)
    assert sorted(kept) == sorted(clean)

    groups = defaultdict(list)
    pure = [r for r in kept if r.text and r.text.split()]
    for (doc_id, _, root), n in brute_components([(r.doc_id, r.text) for r in pure], corpus_pipeline.SIMILARITY).items():
        groups[root].append(doc_id)
    alone = {r.doc_id for r in kept} - {r.doc_id for r in pure}
    kept_near = through("near_dedup", kept)
    assert sorted(r.doc_id for r in kept_near) == sorted({min(g) for g in groups.values()} | alone) and set(kept_near) <= set(kept)

    items = [shingles(r.text, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaks(text):
        s = shingles(text, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        return any(i and 100 * len(i & s) >= corpus_pipeline.CONTAINED * len(i) for i in items)

    kept_pure = through("decontamination", kept_near)
    assert sorted(kept_pure) == sorted(r for r in kept_near if not leaks(r.text))

    size = Counter()
    for r in kept_pure:
        size[r.source] += len((r.text or "").encode())
    power = sum(v ** 0.7 for v in size.values() if v)
    want = Counter()
    for r in kept_pure:
        rate = size[r.source] ** 0.7 / power * sum(size.values()) / size[r.source] if size[r.source] else 0.0
        parts = max(math.ceil(rate / 64), 1)
        for i in range(1, parts + 1):
            u, k = int(hashlib.md5(f"mix-1|{i}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2 ** 52, 0
            term = total = math.exp(-rate / parts)
            while total < u:
                k, term = k + 1, term * rate / parts / (k + 1)
                total += term
            want[r] += k
    mixed = through("mixing", kept_pure)
    assert Counter(mixed) == +want

    out = through("sharding", mixed)
    assert Counter(tuple(r)[:len(docs.columns)] for r in out) == Counter(map(tuple, mixed))
    per = {s: [r for r in out if r.shard == s] for s in range(corpus_pipeline.SHARDS)}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in per.values())
    assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in out)


def plainly_toxic(text, model, weight):
    """Verdict of the ordinal model for one text, feature by feature."""
    (bins, counts), = toxicity._counts(pa.array([text]))
    score = sum(math.log1p(c) * weight.get(b, 0.0) for b, c in zip(bins.tolist(), counts.tolist()))
    return 1.0 / (1.0 + math.exp(min(max(score - model.thresholds[0], -500), 500))) < 0.5 and score > 0
