import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann_partitions, best_fit, divergence, nbsvm, near_dup, source_mix, suffix_dedup, super_minhash, token_store, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < size else [tuple(words[i : i + size]) for i in range(len(words) - size + 1)])


def near_groups(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def removed(rows, length):
    seen, out = set(), {}
    for i, text in sorted({r for r in rows if r[0] is not None}):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                mark[p : p + length] = b"\x01" * length
            else:
                seen.add(raw[p : p + length])
        kept = bytes(x for x, y in zip(raw, mark, strict=True) if not y)
        spans = sum(1 for p in range(len(raw)) if mark[p] and (not p or not mark[p - 1]))
        out[i] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, sf_dir, size, percent):
    docs = small_docs(spark, sf_dir)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, size, percent).collect()}
    assert got == near_groups(pairs(docs), size, percent)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 2)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], "new", *base[i:]])) for i in range(1, 25)] + [(90, "alone here with other words"), (91, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 3, 85).collect()}
    assert got == near_groups(rows, 3, 85)


def test_near_duplicates_edges(edge_docs, no_docs):
    rows = near_dup.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[2].component_id == 1 and not got[2].kept and got[1].kept
    assert all(got[i].component_id == i and got[i].n_shingles == 0 for i in (3, 4, 5))
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_super_minhash_is_that_of_single_steps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64)) for n in (1, 3, 40, 700)]
    firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = super_minhash.signatures(np.concatenate(sets), firsts, 24)
    for s, row in zip(sets, got, strict=True):
        want = [None] * 24
        for x in s:
            state = super_minhash.mix(np.array([x]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            perm = list(range(24))
            for j in range(24):
                state = super_minhash.mix(state + np.uint64(0xBF58476D1CE4E5B9))
                k = j + int(((int(state[0]) & 0xFFFFFFFF) * (24 - j)) >> 32)
                perm[j], perm[k] = perm[k], perm[j]
                offer = (j << 32) | (int(state[0]) >> 32)
                want[perm[j]] = offer if want[perm[j]] is None else min(want[perm[j]], offer)
        assert row.tolist() == want


@pytest.mark.parametrize("group", [2048, 2])
def test_repeats_match_brute_force(spark, sf_dir, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    docs = small_docs(spark, sf_dir).select("doc_id", "text")
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed_spans), len(r.removed_spans), hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == removed(pairs(docs), 100)


def test_repeats_edges(spark, edge_docs, no_docs):
    done = suffix_dedup.remove_repeats(edge_docs, length=20)
    assert done.count() == edge_docs.count() and {*edge_docs.columns} <= {*done.columns} and done.filter("runs = 7 and rest = 7 and n_words = 7").count() == done.count()
    rows = [r for r in done.collect() if r.doc_id is not None]
    want = removed(pairs(edge_docs), 20)
    for r in rows:
        assert (r.n_bytes, sum(s.end - s.start for s in r.removed_spans), len(r.removed_spans)) == want[r.doc_id][:3]
    assert all(not r.removed_spans for r in done.filter("doc_id is null").collect())
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    # two texts under one id: one of them is the document, the other passes
    rows = [(1, "p" * 30 + "q"), (1, "r" * 22 + "s"), (2, "p" * 30)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=16).collect()
    assert len(got) == 3 and all(s.end <= r.n_bytes for r in got for s in r.removed_spans)


def test_cut_text_keeps_characters_whole(spark):
    rows = [(1, "x" * 30 + "é" * 40), (2, "y" + "é" * 40 + "é" + "zü")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=21, as_text=True)
    for r in got.collect():
        assert r.kept_text == r.kept_text.encode().decode()


def test_hash_windows_of_long_texts(monkeypatch):
    text = np.frombuffer((b"abcdefghij" * 5 + bytes(range(97, 123)) * 9) * 40, np.uint8)
    data = np.append(text, np.uint8(32))
    whole = suffix_dedup.anchors_of(data, np.array([0, len(data)]), 100, 32)
    assert whole[6].sum() == len(text) - 99
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1024)
    batch = pa.RecordBatch.from_arrays([pa.array([text.tobytes().decode()])], ["text"])
    parts = list(suffix_dedup.text_segments(batch, 100, 32))
    assert sum(p[6].sum() for p in parts) == len(text) - 99


def base_of(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def test_divergence_matches_brute_force(spark, sf_dir, edge_docs, no_docs):
    for docs in (small_docs(spark, sf_dir), edge_docs):
        want = collections.Counter((i, *base_of(t)) for i, t in pairs(docs))
        got = divergence.judge(docs)
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert collections.Counter(tuple(r) for r in got.select(*names).collect()) == want
        assert got.filter("base_failed and kept").count() == 0
    assert divergence.judge(no_docs).count() == 0


def test_clean_text_stays_and_symbols_go(spark, sf_dir):
    judged = divergence.judge(small_docs(spark, sf_dir)).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    shares = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.9 and shares[0] < 0.5


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = nbsvm.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_classifier_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (None, 1), (7, None), (9, 0), (9, 1)], "doc_id long, quality int")
    got = nbsvm.classify(edge_docs, labels)
    assert got.count() == edge_docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert nbsvm.classify(no_docs, labels).count() == 0
    assert nbsvm.classify(edge_docs, labels.limit(0)).select("score").distinct().count() == 1


def test_dual_descent_finds_the_margin():
    rng = np.random.default_rng(0)
    y = rng.choice([-1, 1], 200)
    rows = [np.unique(np.append(rng.integers(0, 50, 8), 60 if c > 0 else 61)) for c in y]
    w = nbsvm.descend(rows, y, np.ones(64))
    assert all((w[:-1][r].sum() / np.sqrt(len(r) + 1) + w[-1] / np.sqrt(len(r) + 1)) * c > 0 for r, c in zip(rows, y, strict=True))


def test_mix_matches_rates(spark, edge_docs, no_docs):
    rows = [(i, f"t{i}", "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix_sources(docs, weights={"big": 1, "small": 1}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 250 for r in got)
    again = source_mix.mix_sources(docs.repartition(7), weights={"big": 1, "small": 1})
    assert again.exceptAll(source_mix.mix_sources(docs, weights={"big": 1, "small": 1})).count() == 0
    assert source_mix.mix_sources(docs, weights={}).count() == 0
    out = source_mix.mix_sources(edge_docs, epochs=3.0)
    assert set(edge_docs.columns) <= set(out.columns)
    assert out.filter("doc_id = 1").groupBy("copy").count().filter("count <> 2").count() == 0
    assert source_mix.mix_sources(no_docs).count() == 0


def test_poisson_draws(spark):
    draws = spark.range(20000).select((source_mix.uniform("s", F.col("id"))).alias("u"), source_mix.poisson_steps(F.lit(2.5)).alias("c"))
    k = [r[0] for r in draws.select(F.size(F.filter("c", lambda x: x <= F.col("u")))).collect()]
    assert np.mean(k) == pytest.approx(2.5, abs=0.05) and np.var(k) == pytest.approx(2.5, abs=0.12)


def test_packing_is_whole_and_within_capacity(spark, edge_docs, no_docs, sf_dir):
    for docs in (small_docs(spark, sf_dir), edge_docs):
        rows = best_fit.pack_documents(docs, best_fit.byte_tokens(), shard_docs=50).collect()
        bins = collections.defaultdict(lambda: [0, set()])
        for r in rows:
            bins[r.bin][0] += r.n_tokens
            bins[r.bin][1].add(r.capacity)
        for used, caps in bins.values():
            (cap,) = caps
            assert cap == min(c for c in best_fit.CAPACITIES if c >= used)
        lengths = collections.Counter((i, len((t or "").encode()) + 1) for i, t in pairs(docs))
        assert sum(r.n_tokens for r in rows) == sum(n * c for (_, n), c in lengths.items())
        assert sum(r.start == 0 for r in rows) == sum(lengths.values())
    assert best_fit.pack_documents(no_docs, best_fit.byte_tokens()).count() == 0


def test_packing_beats_one_length():
    rng = np.random.default_rng(5)
    sizes = np.minimum(16384, rng.lognormal(7, 1.2, 3000).astype(int) + 1).tolist()
    where, caps = best_fit.pack(sizes)
    cost = sum(c + best_fit.BIN_COST for c in caps)
    one, one_caps = best_fit.pack(sizes, (16384,))
    assert cost <= sum(c + best_fit.BIN_COST for c in one_caps)
    assert sum(sizes) / sum(caps) > 0.97
    assert best_fit.pack([]) == ([], []) and best_fit.pack([0, 0])[1] == [2048]


def test_store_round_trip(spark, sf_dir, edge_docs, no_docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(token_store.tokenizer_path())
    for docs in (small_docs(spark, sf_dir), edge_docs):
        path = token_store.new_path(spark, "store")
        token_store.write_store(docs, path, token_store.tokenizer_path())
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_back(spark, path).collect()))
        at, left = 0, collections.Counter()
        for i, t in pairs(docs):
            ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            left[i, len(ids), zlib.crc32(ids.tobytes())] += 1
        for start, i, n, crc in got:
            assert start == at
            at += n
        assert collections.Counter((i, n, c) for _, i, n, c in got) == left
        ids = [i for _, i, _, _ in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
        assert token_store.chunks(spark, path).groupBy("address").count().filter("count > 1").count() == 0
    path = token_store.new_path(spark, "store")
    token_store.write_store(no_docs, path, token_store.tokenizer_path())
    assert token_store.read_back(spark, path).count() == 0


def test_encoder_is_the_library(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(token_store.tokenizer_path())
    encode = token_store.Encoder(token_store.tokenizer_path())

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.sampled_from(list("abé 1.'\n\t 　\u0085\x01\x1c日<|")) | st.characters(codec="utf-8"), max_size=25), max_size=6))
    def same(texts):
        ids, starts = encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[starts[i] : starts[i + 1]].tolist() == [*reference.encode(t, add_special_tokens=False).ids, 0]

    same()


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(token_store.tokenizer_path())
    texts = ["one <|endoftext|> two", "plain one two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\nc", "<|endoftext |>", None, "one <|endof\ntext|> two"]
    ids, starts = token_store.Encoder(token_store.tokenizer_path())(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [[*reference.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert got[0] == [505, 220, 50256, 734, 0]


def test_chunks_meet_again_after_an_insertion():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50000, 60000).astype(np.uint32)
    b = np.concatenate([a[:20000], [7, 8, 9], a[20000:]]).astype(np.uint32)

    def cut(x):
        ends = token_store.chunk_ends(x, np.array([0, len(x)])).tolist()
        return {token_store.address(x[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)}

    assert len(cut(a) & cut(b)) >= len(cut(a)) - 3
    sizes = np.diff(np.concatenate([[0], token_store.chunk_ends(a, np.array([0, len(a)]))]))
    assert sizes.sum() == len(a) and sizes.max() <= token_store.MOST_IDS


def test_url_rules_against_a_loop(spark):
    hosts = ["example.com", "a.example.com", "EXAMPLE.com", "notexample.com", "com", "x.net", "example.net", "b.example.net", "org", "o.org", "", "a.b.c.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/78/x", "/de/", "/de/8", "/de/9?q=/en/", "/es/#x", "/es", "?/en/", "#/en/"]
    rows = [(i, f"https://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(5000, None), (5001, "no scheme"), (5002, ""), (None, "http://example.com/en/7"), (7, "https://example.com/en/"), (7, "https://example.com/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    rules = [*url_rules.RULES, ("a.example.com", "/en/7", "block"), ("example.com", "/", "block"), ("example.com", "/en/", "allow")]
    got = collections.Counter(tuple(r) for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules)).collect())
    want = collections.Counter()
    for i, url in rows:
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest).group().lower()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want[i, host, path, rule, verdict] += 1
    assert got == want
    assert url_rules.judge_urls(pages, url_rules.rules_frame(spark, [])).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_frame(spark, rules)).count() == 0


def test_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    got = collections.defaultdict(list)
    for r in ann_partitions.nearest(vectors).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    queries = np.flatnonzero(ids % 20 == 0)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = sorted(got[int(ids[q])])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        hits += len({v for _, v, _ in mine} & set(ids[best].tolist()))
        assert all(score == pytest.approx(s[np.flatnonzero(ids == v)[0]], abs=1e-12) for _, v, score in mine)
    assert hits / (20 * len(queries)) >= 0.9


def test_neighbours_edges(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, []), (None, [1.0, 1.0, 1.0]), (106, [1.0, 1.0]), (20, same), (120, [3.0, 2.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("rank", F.lit(2))
    got = collections.defaultdict(list)
    for r in ann_partitions.nearest(vectors).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 120}
    assert [v for _, v, _ in sorted(got[20])] == [i for i in range(21) if i != 20]
    assert [v for _, v, _ in sorted(got[120])] == list(range(20))
    few = spark.createDataFrame([(20, same), (21, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann_partitions.nearest(few).collect()] == [(20, 1, 21)]
    assert ann_partitions.nearest(vectors.limit(0)).count() == 0


def test_partition_is_balanced_and_router_learns_it():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (300, 8)) for c in rng.normal(0, 2, (6, 8))])
    near = ann_partitions.neighbour_graph(x, 10)
    part = ann_partitions.balanced_partition(near, 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(1.1 * len(x) / 6)
    w = ann_partitions.fit_router(x, part, 6, near)
    assert (np.argmax(np.hstack([x, np.ones((len(x), 1))]) @ w, axis=1) == part).mean() > 0.6
