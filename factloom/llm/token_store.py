"""Token ids in a content-addressed store.

Every document's ids, with an end id, are cut into chunks where a rolling hash of the last ids says so;
equal passages cut alike wherever they stand. A chunk is addressed by a hash of its bytes and stored once.

The store is a folder of Parquet files:
  staged/    kind=chunks: address, n, ids: n token ids as little-endian 16-bit integers, or 32-bit where one
             doesn't fit, compressed by zstandard; kind=recipes: what recipes/ holds, not in order
  recipes/   part, doc_id, n_tokens, addresses, root: in ascending doc_id order over files; addresses are
             those of the document's chunks in order, root the Merkle root of them
  manifest/  part, first and last doc_id, documents, tokens, root: one row for each part of recipes, in
             order; root is the Merkle root of the part's document roots
A reader gets a document by its recipe; every level can be verified from the one below.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import new_path, partitions, table
from factloom.llm.words import U, blocks, mix

END_ID = 0
#: A chunk ends where the hash of its last WINDOW ids is 0 modulo MEAN_IDS, not before LEAST_IDS, at MOST_IDS at last.
WINDOW, MEAN_IDS, LEAST_IDS, MOST_IDS = 12, 1024, 128, 8192
ADDRESS_BYTES = 16
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 500_000
MARK = "\x01"
_worker: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer's file says that texts may be cut as Encoder does."""
    before = tokenizer["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return plain and tokenizer["model"]["type"] == "BPE" and not any(tokenizer.get(k) for k in ("normalizer", "truncation", "padding"))


class Encoder:
    """encode_batch of a byte-level BPE tokenizer, with the ids of frequent pieces remembered.

    A byte-level tokenizer starts a new word at a space between two characters that aren't white space, and
    before and after a line end between two such. Texts are cut there and each distinct piece is encoded
    once. Texts with other white space next to a space or line end, and texts that contain an added token of the
    tokenizer, are encoded whole; so are all texts with a tokenizer of another kind.
    """

    ODD = r"\s\s|^\s|\s$|[\x{01}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([self.ODD, *(re.escape(t) for t in added if t)])
        # characters of a token stand for its bytes; tokens of special kinds don't come up
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.pool, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces, strung together as a text would have them; their bytes say which ids are whose."""
        strung = [p if p[0] == " " or p == "\n" else "\n" + p for p in pieces if p]
        lead = np.array([p[0] != " " and p != "\n" for p in pieces if p], np.int64)
        some = [s for s in strung if s != "\n"]
        ids = np.concatenate([np.zeros(0, np.uint32), *self.raw(["".join(some[i : i + 2000]) for i in range(0, len(some), 2000)])])
        line = self.raw(["\n"])[0]
        upto = np.concatenate([[0], np.cumsum(self.token_bytes[ids])])
        size = np.zeros(len(pieces), np.int64)
        ends = np.searchsorted(upto, np.cumsum(np.array([len(s.encode()) for s in some], np.int64)))
        full = np.array([bool(p) for p in pieces])
        is_line = np.array([p == "\n" for p in pieces])
        counts = np.diff(np.concatenate([[0], ends])) - len(line) * lead[~is_line[full]]
        keep = np.ones(len(ids), bool)
        begins = np.concatenate([[0], ends[:-1]])[lead[~is_line[full]] > 0]
        for k in range(len(line)):
            keep[begins + k] = False
        size[full & ~is_line] = counts
        size[is_line] = len(line)
        own = ids[keep]
        for i in np.flatnonzero(is_line):  # once at most
            before = int(size[:i].sum())
            own = np.concatenate([own[:before], line, own[before:]])
        self.known = pa.concat_arrays([self.known, pa.array(pieces, pa.large_string())])
        self.pool, self.size = np.concatenate([self.pool, own]), np.concatenate([self.size, size])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an END_ID after each text, and the n + 1 starts of texts. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd)) if self.pieces else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd))
        cut = pc.replace_substring(pc.replace_substring(plain, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        lists = pc.split_pattern(cut, MARK)
        pieces = lists.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.forget()
        slot = pc.fill_null(pc.index_in(pieces.dictionary, self.known).cast(pa.int64()), -1).to_numpy().copy()
        if len(new := np.flatnonzero(slot < 0)):
            slot[new] = len(self.known) + np.arange(len(new))
            self.learn(pieces.dictionary.take(pa.array(new)).to_pylist())
        index = slot[pieces.indices.to_numpy()]
        whole = self.raw(texts.filter(pa.array(odd)).to_pylist())
        # a row of (start, length) in one pool for each piece, whole text and end, in order
        pool = np.concatenate([self.pool, *whole, np.array([END_ID], np.uint32)])
        size = np.concatenate([self.size, np.array([len(x) for x in whole] + [1], np.int64)])
        begin = np.cumsum(size) - size
        n = len(texts)
        n_pieces = np.ones(n, np.int64)
        n_pieces[~odd] = np.diff(np.asarray(lists.offsets)) if len(plain) else n_pieces[~odd]
        slots = np.empty(int(n_pieces.sum()) + n, np.int64)
        first = np.cumsum(n_pieces + 1) - n_pieces - 1
        slots[first + n_pieces] = len(size) - 1
        slots[first[odd]] = len(self.size) + np.arange(int(odd.sum()))
        counts = n_pieces[~odd]
        at = np.repeat(first[~odd] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        slots[at] = index
        lengths = size[slots]
        total = np.cumsum(lengths)
        out = pool[np.repeat(begin[slots] - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]
        ends = total[first + n_pieces] if n else np.zeros(0, np.int64)
        return out, np.concatenate([[0], ends])


def encoder(path: str) -> Encoder:
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def chunk_ends(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ends of chunks, the ends of texts among them."""
    cuts = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        h = mix(ids.astype(U) + U(1))
        rolling = np.zeros(len(ids) - WINDOW + 1, U)
        for i in range(WINDOW):
            rolling += h[i : i + len(rolling)] * U(pow(0x9E3779B97F4A7C15, WINDOW - i, 1 << 64))
        cuts = np.flatnonzero(mix(rolling) % U(MEAN_IDS) == 0) + WINDOW
    cuts = cuts.tolist()
    out, at = [], 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        last = a
        while at < len(cuts) and cuts[at] < a + WINDOW:
            at += 1
        while at < len(cuts) and cuts[at] <= b - LEAST_IDS:
            c = cuts[at]
            at += 1
            if c - last < LEAST_IDS:
                continue
            while c - last > MOST_IDS:
                last += MOST_IDS
                out.append(last)
            if c > last:
                out.append(c)
                last = c
        while b - last > MOST_IDS:
            last += MOST_IDS
            out.append(last)
        out.append(b)
    return np.array(out, np.int64)


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def address(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=ADDRESS_BYTES).digest()


def node(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=ADDRESS_BYTES).digest()


class Merkle:
    """The root of a binary tree over leaves that come one by one; an odd last node of a level goes up as it is."""

    def __init__(self, leaves: Iterable[bytes] = ()):
        self.peaks: list[tuple[int, bytes]] = []  # (height, root) of full trees, each lower than the one before
        for x in leaves:
            self.add(x)

    def add(self, leaf: bytes) -> None:
        height, x = 0, node(b"\x00" + leaf)
        while self.peaks and self.peaks[-1][0] == height:
            height, x = height + 1, node(b"\x01" + self.peaks.pop()[1] + x)
        self.peaks.append((height, x))

    def root(self) -> bytes:
        """Of no leaves: the hash of nothing."""
        if not self.peaks:
            return node(b"")
        *rest, (_, x) = self.peaks
        for _, left in reversed(rest):
            x = node(b"\x01" + left + x)
        return x


def merkle_root(leaves: list[bytes]) -> bytes:
    return Merkle(leaves).root()


def in_turn(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches sorted by their first column, each of one value, with it."""
    for batch in batches:
        if batch.num_rows:
            first = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield int(first[a]), batch.slice(a, b - a)


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode every text of docs (doc_id, text) and write the store to path, a folder that all machines see.

    Null and empty texts have the end id alone. Repeated doc_ids are documents one after another, in an
    order fixed by their ids. A null doc_id sorts first. An empty table makes a store of no documents.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, names = encoder(tokenizer), ["address", "n", "ids", "doc_id", "row", "n_tokens", "addresses"]
        sent: set[bytes] = set()
        for batch in batches:
            for part in blocks(batch):
                ids, starts = encode(part.column(1))
                ends = chunk_ends(ids, starts)
                begins = np.concatenate([[0], ends[:-1]]).tolist()
                addresses = [address(ids[a:b]) for a, b in zip(begins, ends.tolist(), strict=True)]
                press = zstandard.ZstdCompressor(level=1)
                new, size, data = [], [], []
                for a, b, x in zip(begins, ends.tolist(), addresses, strict=True):
                    if x not in sent:
                        sent.add(x)
                        new.append(x)
                        size.append(b - a)
                        data.append(press.compress(packed(ids[a:b])))
                if len(sent) > 1_000_000:
                    sent.clear()
                k = len(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(size, pa.int32()), pa.array(data, pa.binary()), pa.nulls(k, part.column(0).type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.binary()))], names)
                upto = np.searchsorted(ends, starts, "right").tolist()
                lists = [addresses[upto[i] : upto[i + 1]] for i in range(part.num_rows)]
                m = part.num_rows
                order = [int.from_bytes(hashlib.blake2b(b"".join(x), digest_size=7).digest()) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), part.column(0), pa.array(order, pa.int64()), pa.array(np.diff(starts)), pa.array(lists, pa.list_(pa.binary()))], names)

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first of rows that agree in a chunk's address, and every recipe, of batches sorted by address."""
        last = None
        for batch in batches:
            names = batch.column(0).to_pylist()
            keep = []
            for x in names:
                keep.append(x is None or x != last)
                last = x
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = f"address binary, n int, ids binary, doc_id {kind}, row long, n_tokens long, addresses array<binary>"
    parts = docs.select("doc_id", "text").mapInArrow(cut, schema)
    key = F.when(F.col("address").isNull(), F.xxhash64("doc_id", "row")).otherwise(F.xxhash64("address"))
    both = parts.withColumn("key", key).repartition(partitions(spark), "key").sortWithinPartitions("address").drop("key").mapInArrow(once, schema)
    both = both.withColumn("kind", F.when(F.col("address").isNull(), "recipes").otherwise("chunks"))
    both.write.option("compression", "none").partitionBy("kind").parquet(f"{path}/staged")
    staged = spark.read.schema(both.schema).parquet(f"{path}/staged")
    recipes = staged.filter("kind = 'recipes'").select("doc_id", "row", "n_tokens", "addresses")
    recipes = recipes.repartitionByRange(partitions(spark), "doc_id", "row").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "row")

    def roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [merkle_root(x) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, "root"])

    rooted = recipes.select("part", "doc_id", "row", "n_tokens", "addresses").mapInArrow(roots, f"part int, doc_id {kind}, row long, n_tokens long, addresses array<binary>, root binary")
    rooted.write.option("compression", "zstd").parquet(f"{path}/recipes")
    again = spark.read.schema(rooted.schema).parquet(f"{path}/recipes")

    def manifest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def out() -> pa.RecordBatch:
            *row, tree = now
            kinds = [pa.int32(), batch_type, batch_type, pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*row, tree.root()], kinds, strict=True)], ["part", "first_id", "last_id", "documents", "tokens", "root"])

        for part, g in in_turn(batches):
            if now is None or now[0] != part:
                if now is not None:
                    yield out()
                now = [part, g.column(1)[0].as_py(), None, 0, 0, Merkle()]
            now[2] = g.column(1)[-1].as_py()
            now[3] += g.num_rows
            now[4] += pc.sum(g.column(2)).as_py()
            for x in g.column(3).to_pylist():
                now[5].add(x)
        if now is not None:
            yield out()

    batch_type = to_arrow_type(docs.schema["doc_id"].dataType)
    by_part = again.select("part", "doc_id", "n_tokens", "root", "row").repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "row")
    by_part.select("part", "doc_id", "n_tokens", "root").mapInArrow(manifest, f"part int, first_id {kind}, last_id {kind}, documents long, tokens long, root binary").write.parquet(f"{path}/manifest")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("address binary, n int, ids binary, kind string").parquet(f"{path}/staged").filter("kind = 'chunks'").select("address", "n", "ids")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def times_x(n_bytes: np.ndarray) -> np.ndarray:
    """x ** (8 * n_bytes) modulo the CRC-32 polynomial, bits reversed."""
    out = np.full(len(n_bytes), 1 << 31, np.uint64)
    square = np.array([1 << 23], np.uint64)  # x ** 8
    left = n_bytes.astype(np.uint64)
    while left.any():
        out = np.where(left & U(1), multiply(out, np.broadcast_to(square, out.shape)), out)
        square, left = multiply(square, square), left >> U(1)
    return out


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial; the highest bit is the lowest power."""
    out, b = np.zeros(a.shape, np.uint64), b.astype(np.uint64)
    for i in range(31, -1, -1):
        out ^= np.where((a >> U(i)) & U(1), b, U(0))
        b = np.where(b & U(1), (b >> U(1)) ^ U(0xEDB88320), b >> U(1))
    return out


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a store alone.

    Every chunk is read and must have its address, every document its root, every part the manifest's
    root and counts; an error is raised otherwise. CRCs of chunks are joined to the document's by their
    lengths, so that chunks needn't be gathered.
    """

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            crc = []
            for x, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = unpacked(press.decompress(raw), n)
                if address(ids) != x or len(ids) != n:
                    raise ValueError(f"chunk {x.hex()} doesn't have its address")
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64())], ["address", "n", "crc"])

    sums = chunks(spark, path).mapInArrow(check, "address binary, n int, crc long")
    known = recipes(spark, path)
    kind = known.schema["doc_id"].dataType.simpleString()
    asked = known.select("part", "doc_id", "row", F.posexplode("addresses").alias("seq", "address"))
    # equal documents have equal rows; they are told apart by nothing, and so are counted
    found = asked.distinct().join(sums, "address")
    listed = found.groupBy("part", "doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc", "address"))).alias("list"))
    copies = known.groupBy("part", "doc_id", "row").agg(F.count("*").alias("copies"), F.min("n_tokens").alias("n_tokens"), F.min("root").alias("root"))
    whole = copies.join(listed, (copies["part"] == listed["part"]) & copies["doc_id"].eqNullSafe(listed["doc_id"]) & (copies["row"] == listed["row"]), "left").select(copies["part"], copies["doc_id"], copies["row"], "copies", "n_tokens", "root", "list")

    def join_crc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(6)
            flat, sizes = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            n, crc, names = flat.field(1).to_numpy().astype(np.int64), flat.field(2).to_numpy().astype(np.uint64), flat.field(3).to_pylist()
            begin = np.cumsum(sizes) - sizes
            out = np.zeros(batch.num_rows, np.uint64)
            shift = times_x(4 * n)
            for step in range(int(sizes.max(initial=0))):
                at = np.flatnonzero(sizes > step)
                k = begin[at] + step
                out[at] = multiply(out[at], shift[k]) ^ crc[k] if step else crc[k]
            got = np.add.reduceat(np.append(n, 0), begin) if len(begin) else n
            got = np.where(sizes > 0, got, 0)
            for i, (want, tokens, b, s) in enumerate(zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), begin.tolist(), sizes.tolist(), strict=True)):
                if merkle_root(names[b : b + s]) != want or got[i] != tokens:
                    raise ValueError(f"document {batch.column(1)[i].as_py()} can't be rebuilt from its recipe")
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out.astype(np.int64))], ["part", "doc_id", "row", "copies", "n_tokens", "root", "ids_crc32"])

    done = whole.mapInArrow(join_crc, f"part int, doc_id {kind}, row long, copies long, n_tokens long, root binary, ids_crc32 long")
    done = done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("part", "doc_id", "row", "n_tokens", "root", "ids_crc32")
    manifest = spark.read.parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.withColumn("before", before).select("part", "before", F.col("documents").alias("m_documents"), F.col("tokens").alias("m_tokens"), F.col("root").alias("m_root"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def check_part() -> None:
            if now is not None and (*now[2:4], now[4].root()) != now[1]:
                raise ValueError(f"part {now[0]} isn't what the manifest says")

        for part, g in in_turn(batches):
            if now is None or now[0] != part:
                check_part()
                now = [part, tuple(g.column(c)[0].as_py() for c in (7, 8, 9)), 0, 0, Merkle()]
            n = g.column(3).to_numpy()
            start = g.column(6)[0].as_py() + now[3] + np.cumsum(n) - n
            now[2], now[3] = now[2] + len(n), now[3] + int(n.sum())
            for x in g.column(4).to_pylist():
                now[4].add(x)
            yield pa.RecordBatch.from_arrays([g.column(1), pa.array(start), g.column(3), g.column(5)], ["doc_id", "start", "n_tokens", "ids_crc32"])
        check_part()

    placed = done.join(starts, "part").repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "row")
    return placed.select("part", "doc_id", "row", "n_tokens", "root", "ids_crc32", "before", "m_documents", "m_tokens", "m_root").mapInArrow(place, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_back(spark, path)


QUERIES = {"op5_token_store": op5_token_store}
