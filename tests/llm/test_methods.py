"""The operators' methods against plain versions of them, and what must not change a result."""

import collections
import hashlib
import itertools
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann_partitions, best_fit, common, divergence, nbsvm, near_dup, source_mix, suffix_dedup, super_minhash, token_store, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


def mix(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def word_hash(word):
    value = sum((b + 1) * pow(words.BASE, i, words.PRIME) for i, b in enumerate(word)) % words.PRIME
    return mix((value + len(word) * 0xA24BAED4963EE407) & MASK)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# words


def test_word_hash_is_the_polynomial():
    texts = ["one two  three", "ünï code " + "x" * 70, thue_morse(1024)]
    data, starts = words.flat_bytes(pa.array(texts))
    begin, end, _ = words.word_bounds(data, starts)
    got = words.slice_hash(words.prefix_hash(data), begin, end).tolist()
    assert got == [word_hash(w.encode()) for t in texts for w in WORD.findall(t)]


def test_word_hash_is_the_same_in_any_span(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    a = np.arange(0, 4900, 7)
    whole = words.slice_hash(words.prefix_hash(data), a, a + 60)
    monkeypatch.setattr(words, "SPAN", 512)
    assert np.array_equal(whole, words.slice_hash(words.prefix_hash(data), a, a + 60))


def test_words_are_told_apart_by_bytes_where_hashes_agree():
    data, starts = words.flat_bytes(pa.array(["aa bb aa cc bb", "dd aa"]))
    begin, end, _ = words.word_bounds(data, starts)
    ids = words.word_ids(data, begin, end, np.zeros(len(begin), np.uint64)).tolist()
    assert ids[0] == ids[2] == ids[6] and ids[1] == ids[4] and len(set(ids)) == 4


def test_complements_are_not_equal(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(8))
    got = near_dup.near_duplicates(frame(spark, [f"{one} {rest}", f"{two} {rest}"]), 5, 80).collect()
    assert all(r.kept for r in got)
    lines = divergence.judge(frame(spark, [f"{one}\n{two}\n{one}"]).withColumn("lang", F.lit("en"))).head()
    assert lines.n_dup_lines == 1


# op1


def plain_buckets(text):
    raw, out = (text or "").encode(), set()
    flat = raw + b" "
    for size in nbsvm.GRAMS:
        for i in range(len(flat) - size + 1):
            key = int.from_bytes(flat[i : i + size], "big")
            out.add(mix((key * 31 + size) & MASK) >> 64 - nbsvm.BITS)
    own = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    for size in nbsvm.WORD_GRAMS:
        for i in range(len(own) - size + 1):
            h = 0
            for k, w in enumerate(own[i : i + size]):
                h = mix((h + word_hash(w) + k + 1) & MASK)
            out.add(mix((h + 100 + size) & MASK) >> 64 - nbsvm.BITS)
    for size in nbsvm.RENAMED:
        for i in range(len(own) - size + 1):
            gram, code = own[i : i + size], 0
            for k in range(1, size):
                code = (code * size + gram.index(gram[k])) & MASK
            out.add(mix((mix(code) + 200 + size) & MASK) >> 64 - nbsvm.BITS)
    return sorted(out)


def test_classifier_is_the_plain_one(spark):
    rng = np.random.default_rng(8)
    text = lambda vocabulary: " ".join(rng.choice(vocabulary, int(rng.integers(3, 14))))
    good, bad = "alpha beta gamma delta unit".split(), "win win cash now now beta".split()
    rows = [(i, text(good if i % 3 else bad), int(i % 3 > 0)) for i in range(120)] + [(200, None, 1), (201, "", 0), (202, "é", 2)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    data = nbsvm.training_rows(docs, labels).select("doc_id", F.col("label"), "text", (F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)).alias("draw")).collect()
    assert {r.label for r in data} == {0, 1}
    counts = np.zeros((2, nbsvm.BUCKETS))
    for r in data:
        for b in plain_buckets(r.text):
            counts[r.label, b] += 1
    p = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    chosen = sorted(data, key=lambda r: (r.draw, r.label))
    model = nbsvm.fit_sample([np.array(plain_buckets(r.text), np.int64) for r in chosen], np.array([r.label for r in chosen]), ratio)
    got = {r.doc_id: r.score for r in nbsvm.classify(docs, labels).collect()}
    for i, t, _ in rows:
        own = plain_buckets(t)
        margin = (sum(model["w"][b] for b in own) + model["bias"]) / np.sqrt(len(own) + 1)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model["a"] * margin + model["b"]))), abs=1e-9)


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 9000, 400)) + (" good" if i % 2 else " bad"), i % 2) for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert nbsvm.train(labelled)["rows"] == 300
    monkeypatch.setattr(nbsvm, "FIT_BYTES", 1 << 20)
    used = nbsvm.train(labelled)["rows"]
    assert 20 <= used < 150 and used * 4 * 2000 <= 1 << 21
    scores = {r.doc_id: r.score for r in nbsvm.score(labelled, nbsvm.train(labelled)).collect()}
    assert np.mean([scores[i] for i, _, y in rows if y]) > np.mean([scores[i] for i, _, y in rows if not y])


def test_descent_reaches_the_least_loss():
    """The primal loss at the dual solution is that of a long run of subgradient steps, or less."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    y = np.where([r[0] % 3 == 0 for r in rows], 1, -1)
    ratio = rng.normal(0, 1, 30)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r], x[i, 30] = ratio[r], 1
        x[i] /= np.sqrt(len(r) + 1)
    weight = np.array([80 / (2 * (y == c).sum()) for c in y])
    loss = lambda w: w @ w / 2 + (weight * np.maximum(0, 1 - y * (x @ w))).sum()
    w, best = np.zeros(31), np.inf
    for t in range(1, 20000):
        on = y * (x @ w) < 1
        w = w - (w - ((weight * y)[:, None] * x)[on].sum(axis=0)) / t
        best = min(best, loss(w))
    assert loss(nbsvm.descend(rows, y, ratio, rounds=200)) <= best * 1.001


# op3


def distance_of(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
    return np.sqrt(max(0, (kl(p) + kl(q)) / 2))


def class_of(c):
    for k, some in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\x0b\x0c\r ", "\n", ".,;:!?'\"-", "#*$%&|<>@^~`_=+\\/{}", "()[]")):
        if c in some:
            return k
    return 8 if 0xC3 <= c.encode()[0] < 0xDC else 9


def plain_judgement(rows, guard):
    """doc_id -> (character distance, word distance, both over the limits or not) of (doc_id, lang, text)."""
    chars, vocabulary = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, lang, text in rows:
        chars[lang].update(class_of(c) for c in text)
        vocabulary[lang].update(WORD.findall(text))
    out = {}
    for i, lang, text in rows:
        total = sum(vocabulary[lang].values())
        char_d = word_d = None
        if total >= guard:
            n_chars, own = len(text), collections.Counter(WORD.findall(text))
            if n_chars >= divergence.GUARD_CHARS:
                mine = collections.Counter(map(class_of, text))
                whole = sum(chars[lang].values())
                char_d = distance_of([mine[k] / n_chars for k in range(10)], [chars[lang][k] / whole for k in range(10)])
            n = sum(own.values())
            if n >= divergence.GUARD_WORDS:
                common = sorted(vocabulary[lang], key=lambda w: (-vocabulary[lang][w], w.encode()))[: divergence.COMMON_WORDS]
                p, q = [own[w] / n for w in common], [vocabulary[lang][w] / total for w in common]
                word_d = distance_of([*p, 1 - sum(p)], [*q, 1 - sum(q)])
            far = (char_d or 0) > divergence.CHAR_LIMIT + 1 / np.sqrt(n_chars or 1) or (word_d or 0) > divergence.WORD_LIMIT + 1 / np.sqrt(n or 1)
            out[i] = (char_d, word_d, far)
        else:
            out[i] = (None, None, False)
    return out


@pytest.mark.parametrize("few", [1000, 0])
def test_divergence_is_exact_in_any_partitioning(spark, sf_dir, monkeypatch, few):
    monkeypatch.setattr(divergence, "REFERENCES", few)  # 0: references are joined
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    want = plain_judgement([tuple(r) for r in docs.collect()], divergence.GUARD_REFERENCE)
    assert sum(w is not None for _, w, _ in want.values()) > 50
    seen = []
    for n in (1, 7, 64) if few else (5,):
        got = divergence.judge(docs.repartition(n, "text")).collect()
        seen.append(sorted(tuple(r) for r in got))
        for r in got:
            char_d, word_d, far = want[r.doc_id]
            for mine, plain in ((r.char_distance, char_d), (r.word_distance, word_d)):
                assert (mine is None) == (plain is None) and (plain is None or mine == pytest.approx(plain, abs=1e-6))
            assert r.kept == (not r.base_failed and not far)
    assert all(s == seen[0] for s in seen)


def test_common_words_of_a_wide_vocabulary(spark):
    """Words that are rare in each task but common over all, and ties."""
    rows = [(i, "xx", " ".join([f"u{i}n{k}" for k in range(60)] + [f"t{(i * 7 + k) % 50}" for k in range(2)])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(40)
    (row,) = divergence.references(docs).collect()
    count = collections.Counter(w for _, _, t in rows for w in t.split())
    assert [w.decode() for w in row.words] == sorted(count, key=lambda w: (-count[w], w))[:40]
    assert row.counts == [count[w.decode()] for w in row.words] and row.n_words == 900 * 62


# op4


@pytest.mark.parametrize("beam", [4096, 1])
def test_many_partitions_find_the_nearest(spark, monkeypatch, beam):
    """Cuts of cuts: more partitions than one cut makes, few of which a query visits, and recall against brute force.

    A beam that is too small for the recall is widened."""
    for name, value in (("CELL", 40), ("MOST_PARTS", 8), ("PROBES", 100), ("BEAM", beam)):
        monkeypatch.setattr(ann_partitions, name, value)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.35, (75, 12)) for c in rng.normal(0, 1, (40, 12))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(0, 1, (60, 5))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(4000 + i, v.tolist()) for i, v in enumerate(other)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = {}
    real = ann_partitions.visits

    def watch(filed, models, k):
        seen["cells"], seen["levels"] = filed.select("dim", "cell").distinct().count(), len(models)
        seen["visit"] = real(filed, models, k)
        return seen["visit"]

    monkeypatch.setattr(ann_partitions, "visits", watch)
    got = collections.defaultdict(list)
    for r in ann_partitions.nearest(vectors).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert seen["cells"] >= 30 and seen["levels"] >= 2 and seen["visit"] <= seen["cells"] // 2
    hits = total = 0
    for space, first in ((x, 0), (other, 4000)):
        for i in range(0, len(space), 20):
            s = space @ space[i]
            s[i] = -np.inf
            best = {int(j) + first for j in np.lexsort((np.arange(len(s)), -s))[:20]}
            mine = sorted(got[i + first])
            assert [r for r, _, _ in mine] == list(range(1, 21)) and all(v == pytest.approx(space[i] @ space[j - first]) for _, j, v in mine)
            hits, total = hits + len({j for _, j, _ in mine} & best), total + 20
    assert hits / total >= 0.9


# op5


def test_merkle_roots_level_by_level():
    for n in range(14):
        leaves = [bytes([i]) for i in range(n)]
        level = [token_store.node(b"\x00" + x) for x in leaves] or [token_store.node(b"")]
        while len(level) > 1:
            level = [token_store.node(b"\x01" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)] + level[len(level) - len(level) % 2 :]
        assert token_store.merkle_root(leaves) == level[0]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World and\nsome more", None, "", "x y"]
    ids, starts = token_store.Encoder(path)(pa.array(texts, pa.string()))
    plain = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_a_changed_part_is_found(spark):
    docs = frame(spark, [f"text {i} of some words" for i in range(40)])
    path = token_store.new_path(spark, "store")
    token_store.write_store(docs, path, token_store.tokenizer_path())
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(r.documents for r in manifest) == 40
    changed = spark.createDataFrame([r.asDict() | {"root": b"0" * 16} for r in manifest], spark.read.parquet(f"{path}/manifest").schema)
    changed.write.mode("overwrite").parquet(f"{path}/manifest2")
    os.rename(f"{path}/manifest", f"{path}/manifest0")
    os.rename(f"{path}/manifest2", f"{path}/manifest")
    with pytest.raises(Exception, match="isn't what the manifest says"):
        token_store.read_back(spark, path).collect()


# op6


def plain_groups(texts, size, percent):
    sets = []
    for t in texts:
        own = WORD.findall(t.lower())
        sets.append({tuple(own)} if 0 < len(own) < size else {tuple(own[i : i + size]) for i in range(len(own) - size + 1)})
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(sets))}


@pytest.mark.parametrize("block", [2, 5])
def test_buckets_of_unlike_documents_in_many_blocks(spark, monkeypatch, block):
    """A passage that all have, unlike rests, a few near copies among them: filtered by rare shingles."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    monkeypatch.setattr(near_dup, "BAND_ROWS", ((0, 1),))  # bands that unlike documents share
    rng = np.random.default_rng(2)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(60):
        rest = [f"r{i // 3}x{k}" for k in range(25)] if i % 3 < 2 else [f"q{i}x{k}" for k in range(int(rng.integers(5, 60)))]
        if i % 3 == 1:
            rest[int(rng.integers(25))] = "changed"
        texts.append(" ".join(passage + rest))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, texts), 3, 85).collect()}
    want = plain_groups(texts, 3, 85)
    assert got == want and len(set(want.values())) < 60


def test_rows_repeated_very_often_do_not_fill_a_block(spark):
    one, two = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}" for i in range(31))
    rows = [(1, one)] * 300 + [(2, two)] * 200 + [(3, "other words here")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert got.count() == 501 and {tuple(r) for r in got.groupBy("doc_id", "component_id").count().collect()} == {(1, 1, 300), (2, 1, 200), (3, 3, 1)}


def test_exact_sets_count_common_shingles():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdef"), int(rng.integers(0, 30)))) for _ in range(60)] + ["A b", "a  B", ""]
    own = super_minhash.Words(pa.array(texts))
    for size in (1, 3, 5):
        sets = [{tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (t.lower().split() for t in texts)]
        for numbers, firsts in (super_minhash.exact_sets(own, size), super_minhash.shingle_sets(own, size)):
            got = [set(numbers[a:b].tolist()) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            assert all(len(got[i] & got[j]) == len(sets[i] & sets[j]) for i, j in itertools.combinations_with_replacement(range(len(texts)), 2))


# op8


def test_longest_previous_factors_are_those_of_all_earlier_places():
    rng = np.random.default_rng(1)
    for _ in range(40):
        text = bytes(rng.integers(97, 99, 70).astype(np.uint8))

        def prefix(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        order = sorted(range(len(text)), key=lambda i: text[i:])
        common_ = [0, *(prefix(a, b) for a, b in itertools.pairwise(order))]
        got = suffix_dedup.previous_factors(order, common_)
        assert got == [max((prefix(i, j) for j in range(i)), default=0) for i in order]


def test_later_copies_of_windows():
    rng = np.random.default_rng(2)
    for length in (16, 20, 33):
        data = np.concatenate([rng.integers(97, 99, 400), np.zeros(length)]).astype(np.uint8)
        data[150:200], data[300:340] = data[20:70], data[25:65]
        starts = np.arange(400 - length)
        place = rng.permutation(len(starts))
        got = suffix_dedup.later_copies(data, starts, place, length)
        least = {}
        for s in sorted(starts, key=lambda s: place[s]):
            least.setdefault(bytes(data[s : s + length]), s)
        assert got.tolist() == [least[bytes(data[s : s + length])] != s for s in starts]


@pytest.mark.parametrize(("group", "flush", "hot"), [(2048, 50, 500), (1, 10, 1)])
def test_repeats_with_small_groups_flushes_and_hot_anchors(spark, monkeypatch, group, flush, hot):
    for name, value in (("GROUP", group), ("FLUSH", flush), ("HOT", hot), ("HOT_SAMPLE", 1)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = np.random.default_rng(9)
    words_ = [f"w{i}" for i in range(400)]
    noise = lambda n: " ".join(rng.choice(words_, n))
    shared = [noise(40) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [noise(int(rng.integers(1, 30)))]
        for k in range(int(rng.integers(0, 3))):
            cut = int(rng.integers(0, 60))
            parts += [shared[int(rng.integers(4))][cut:], noise(int(rng.integers(1, 8)))]
        rows.append((i, " ".join(parts)))
    rows += [(500, shared[0]), (501, shared[0]), (502, noise(5)), (500, shared[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    seen, want = set(), {}
    for i, text in sorted(set(rows)):
        raw = text.encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                mark[p : p + 100] = b"\x01" * 100
            seen.add(raw[p : p + 100])
        want[i] = hashlib.sha256(bytes(x for x, y in zip(raw, mark, strict=True) if not y)).hexdigest()
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: hashlib.sha256(bytes(r.kept_bytes)).hexdigest() for r in got} == want


# op9


def least_cost(sizes, caps, cost):
    """Of all ways to put sizes into bins, the least sum of the shortest permitted lengths and the bins' costs."""
    best = [float("inf")]

    def go(i, bins):
        if sum(min((c for c in caps if c >= b)) + cost for b in bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = sum(min(c for c in caps if c >= b) + cost for b in bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= caps[-1]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_least_cost():
    rng = np.random.default_rng(3)
    caps, cost, ratios = (8, 16, 32, 64), 2, []
    for _ in range(60):
        sizes = rng.integers(1, 65, int(rng.integers(1, 8))).tolist()
        where, final = best_fit.pack(sizes, caps, cost)
        used = collections.Counter()
        for s, b in zip(sizes, where, strict=True):
            used[b] += s
        assert all(final[b] == min(c for c in caps if c >= n) for b, n in used.items())
        ratios.append(sum(c + cost for c in final) / least_cost(sizes, caps, cost))
    assert max(ratios) <= 1.35 and np.mean(ratios) <= 1.03 and np.mean(np.array(ratios) == 1) >= 0.7


def test_packing_is_the_same_in_any_partitioning(spark, sf_dir, monkeypatch):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id % 3 = 0"))
    one = sorted(tuple(r) for r in best_fit.pack_documents(docs.coalesce(1), best_fit.byte_tokens(), (256, 1024, 2048), shard_docs=40).collect())
    monkeypatch.setattr(best_fit, "COPIES", 1)
    two = sorted(tuple(r) for r in best_fit.pack_documents(docs.repartition(9), best_fit.byte_tokens(), (256, 1024, 2048), shard_docs=40).collect())
    assert one == two


# op10


def test_a_rare_source_beside_a_large_one(spark, tmp_path):
    rows = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 7, "rare").otherwise("large").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    path = f"{tmp_path}/documents.parquet"
    rows.coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    (rate,) = [r.rate for r in source_mix.target_rates(docs).collect() if r.source == "rare"]
    assert rate > 500
    got = source_mix.mix_sources(docs)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["rare"] - rate) < 5 * rate**0.5 and abs(counts["large"] - (300_000 - rate)) < 5 * 300_000**0.5
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT source, count(*), sum(copy), min(mix_key), max(mix_key) FROM ({source_mix.ORACLES['op10_source_mix']}) GROUP BY source ORDER BY source").fetchall()
    mine = got.groupBy("source").agg(F.count("*"), F.sum("copy"), F.min("mix_key"), F.max("mix_key")).orderBy("source").collect()
    assert [tuple(r) for r in mine] == want


def test_large_rates_are_poisson(spark):
    n = source_mix.draws(F.lit(100.0))
    k = [r[0] for r in spark.range(4000).select(source_mix.times("s", F.col("id"), n, source_mix.poisson_steps(F.lit(100.0) / n))).collect()]
    assert np.mean(k) == pytest.approx(100, abs=0.7) and np.var(k) == pytest.approx(100, rel=0.1)


# all


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
