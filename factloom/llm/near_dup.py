"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. Every text becomes a signature and a 128-bit cryptographic hash of its words. Texts of the same words form
   a class; from here on only the class's smallest doc_id takes part, so copies never meet each other.
2. Signatures are cut into bands; documents that share a band are a bucket. Buckets with the same members
   count once. Bands are so short that a pair at the threshold shares none with a probability under 1e-6.
3. A bucket is dealt to blocks of bounded size. In a block, full shingle sets are rebuilt from the texts, on
   words compared byte by byte, and compared exactly; a union-find keeps one link per merge, so a block gives
   fewer links than members.
4. Where a bucket has several blocks and is not one component by now, the members outside its largest component
   go to the other blocks and are compared with those of other components there. Nothing is left uncompared.
5. Where that would be more members than a block holds, they are filtered exactly first: two sets of the least
   similarity share one of their rarest shingles (all but as many as they must share, and one). Documents with
   such a shingle in common are a bucket again, unless they are one component, so documents that have only a
   frequent passage in common never meet. Buckets go through 3 and 4; outsiders, if many, in chunks.
6. Components are the least doc_id that reaches a document: roots are hooked to their least neighbours, pointers
   are doubled to the end, and what is left between roots is linked again. Each round joins every root with
   another, so a chain of n documents takes log2(n) rounds at most, and each of these as many doublings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import super_minhash as smh
from factloom.llm.common import deleted, partitions, scratch, table, written
from factloom.llm.words import U, blocks

REGISTERS = 120
#: Registers in a band, by the least similarity in percent: shorter bands for lower ones.
BAND_ROWS = ((85, 5), (75, 4), (60, 3), (40, 2), (0, 1))
#: A block holds so many documents or shingles of a bucket, about.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
#: Slots that shingles are counted in, to tell rare ones from frequent ones.
COUNT_SLOTS = 1 << 18


def sign(docs: DataFrame, size: int, band_rows: int) -> DataFrame:
    """doc_id, n (shingles), s1, s2 (the words' hash), bands for each row."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=1 << 20):
                words = smh.Words(part.column(1))
                elements, firsts = smh.shingle_sets(words, size)
                keys = smh.bands(smh.signatures(elements, firsts, REGISTERS), band_rows)
                digests = np.frombuffer(b"".join(words.digests()), np.int64).reshape(-1, 2)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(firsts)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands], ["doc_id", "n", "s1", "s2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n long, s1 long, s2 long, bands array<bigint>")


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def link_block(sets: list[np.ndarray], percent: int, comps: list[int] | None = None, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the members as all links of at least `percent` would: a spanning forest.

    comps: members with the same number are known to be joined. probes: only links of these are wanted.
    """
    n, union, out = len(sets), Union(len(sets)), []
    parts = n
    if comps is not None:
        first: dict[int, int] = {}
        for i, c in enumerate(comps):
            parts -= union.join(first.setdefault(c, i), i)
    sizes = np.array([len(s) for s in sets])
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    for i in range(n) if probes is None else probes:
        if parts == 1:
            break
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        counts = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        common = np.bincount(of[at], minlength=n)
        for j in np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common)):
            if union.join(i, int(j)):
                out.append((i, int(j)))
                parts -= 1
    return out


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def block_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: verified links inside each (bucket, block, chunk) of bucket, block, chunk, doc_id, comp, probe, text."""
    spark = members.sparkSession

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            comps, probe = group.column(4).to_pylist(), group.column(5).to_pylist()
            if len(set(comps)) < 2 or not any(probe):
                continue
            numbers, firsts = smh.exact_sets(smh.Words(group.column(6).combine_chunks()), size)
            sets = [numbers[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            ids = group.column(3).to_pylist()
            found = link_block(sets, percent, comps, [i for i, p in enumerate(probe) if p])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

    keys = ["bucket", "block", "chunk"]
    dealt = members.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "doc_id")
    return dealt.select(*keys, "doc_id", "comp", "probe", "text").mapInArrow(links, "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """bucket, blocks, block, doc_id of the buckets with two documents or more of bucket, doc_id, n, comp, all but
    those of one component; of buckets with the same documents, one."""
    sums = rows.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("doc_id")).alias("x1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x2"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    buckets = sums.filter("least < most").groupBy("docs", "shingles", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    n_blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    buckets = written(buckets.select("bucket", n_blocks.alias("blocks")), "buckets")
    return rows.join(buckets, "bucket").select("bucket", "blocks", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int").alias("block"), "doc_id")


def named(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with comp, a document without a link being its own."""
    return members.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets of several blocks and several components, with comp and the bucket's largest, top."""
    known = written(named(members.filter("blocks > 1"), comps), "named")
    sizes = known.groupBy("bucket", "comp").count()
    most = sizes.groupBy("bucket").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("count").alias("docs")).filter("comps > 1")
    return known.join(most.select("bucket", F.col("top.comp").alias("top"), (F.col("docs") - F.col("top.count")).alias("others")), "bucket")


def rare_shingles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """bucket (a shingle's hash), doc_id, n, comp: of each of doc_id, text, comp, the rarest of its shingles; as many
    that two sets without one in common are under `percent`. Any order would do; the counts only make it a good one."""
    docs = docs.select("doc_id", "text", "comp")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            for part in blocks(batch):
                elements, _ = smh.shingle_sets(smh.Words(part.column(1)), size)
                total += np.bincount((elements % U(COUNT_SLOTS)).astype(np.int64), minlength=COUNT_SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    slots = docs.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # COUNT_SLOTS rows at most
    often = np.zeros(COUNT_SLOTS, np.int64)
    often[slots["slot"]] = slots["n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                elements, firsts = smh.shingle_sets(smh.Words(part.column(1)), size)
                n = np.diff(firsts)
                of = np.repeat(np.arange(len(n)), n)
                by = np.lexsort((elements, often[(elements % U(COUNT_SLOTS)).astype(np.int64)], of))
                keep = n + percent * -n // 100 + 1  # all but those that must be shared, and one
                by = by[np.arange(len(by)) - firsts[of] < keep[of]]
                ids, comp = part.column(0).take(pa.array(of[by])), part.column(2).take(pa.array(of[by]))
                yield pa.RecordBatch.from_arrays([pa.array(elements[by].view(np.int64)), ids, pa.array(n[of[by]]), comp], ["bucket", "doc_id", "n", "comp"])

    return docs.mapInArrow(run, "bucket long, doc_id long, n long, comp long")


def roots(edges: DataFrame) -> DataFrame:
    """doc_id, up for each end of edges (a, b): every document is hooked to its least neighbour, and up is its tree's root."""
    both = edges.union(edges.select("b", "a"))
    near = both.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("up"))
    # hooks to least neighbours run in circles of two only; the lesser of the two is the root
    back = near.select(F.col("doc_id").alias("up"), F.col("up").alias("back"))
    hooked = near.join(back, "up").select("doc_id", F.when((F.col("back") == F.col("doc_id")) & (F.col("doc_id") < F.col("up")), F.col("doc_id")).otherwise(F.col("up")).alias("up"))
    hooked = written(hooked, "hooks")
    while True:
        over = hooked.select(F.col("doc_id").alias("up"), F.col("up").alias("over"))
        moved = written(hooked.join(over, "up").select("doc_id", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")), "hooks")
        deleted(hooked)
        hooked = moved
        if moved.filter("moved").isEmpty():
            return hooked


def components(links: DataFrame) -> DataFrame:
    """doc_id, comp (the least doc_id it is joined with) for each end of links (a, b).

    Minima combine before the shuffle, so that a hub costs no more than other documents.
    """
    ends = lambda df: df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(ends(links), "edges")
    trees: list[DataFrame] = []
    while not edges.isEmpty() or not trees:
        trees.append(roots(edges))
        root = trees[-1].select("doc_id", "up")
        between = edges.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        between = written(ends(between), "edges")
        deleted(edges)
        edges = between
    deleted(edges)
    found = trees[-1].select("doc_id", "up")
    for tree in reversed(trees[:-1]):  # a root of one round is a document of the next
        found = tree.select("doc_id", "up").join(found.toDF("up", "top"), "up", "left").select("doc_id", F.coalesce("top", "up").alias("up"))
    found = written(found, "roots")
    out = written(found.join(found.groupBy("up").agg(F.min("doc_id").alias("comp")), "up").select("doc_id", "comp"), "labels")
    deleted(found, *trees)
    return out


def across_blocks(left: DataFrame) -> DataFrame:
    """bucket, block, chunk, doc_id, comp, probe from unsettled: every block with every chunk of members outside
    the bucket's largest component that come from other blocks."""
    chunks = F.ceil(F.col("others") / BLOCK_DOCS).cast("int")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit("chunk")), chunks).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    probes = left.filter("comp <> top").select("bucket", F.col("block").alias("home"), chunk.alias("chunk"), "doc_id", "comp", F.lit(True).alias("probe"), upto(F.col("blocks")).alias("block"))
    probes = probes.filter("home <> block").drop("home")
    return left.select("bucket", "block", upto(chunks).alias("chunk"), "doc_id", "comp", F.lit(False).alias("probe")).unionByName(probes)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id a long, text).

    Texts are linked where 100 * intersection >= percent * union of their sets of distinct `size`-word
    shingles (A-Z lower-cased; fewer words: the whole sequence). Null or wordless texts have no shingle
    and are linked with nothing. A null doc_id takes no part: component_id is null and the row is kept.
    Rows that repeat a doc_id get the answer of their own text; kept is doc_id = component_id. Other
    columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    band_rows = next(r for p, r in BAND_ROWS if percent >= p)
    with scratch() as keep:
        signed = written(sign(docs, size, band_rows), "signed")
        some = signed.filter("n > 0 and doc_id is not null")
        if not some.groupBy("doc_id").count().filter("count > 1").isEmpty():
            docs = docs.distinct()  # a row that is repeated very often would fill its block
        classes = written(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
        reps = some.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi")
        rows = written(reps.select("doc_id", "n", F.explode("bands").alias("bucket"), F.col("doc_id").alias("comp")).distinct(), "bands")
        members = written(in_blocks(rows), "members")

        def linked(blocks_: DataFrame) -> DataFrame:
            # members grow with the corpus, so they are never broadcast: texts are shuffled at every size
            return block_links(blocks_.hint("merge").join(docs, "doc_id"), size, percent)

        inside = lambda m: m.select("bucket", "block", F.lit(0).alias("chunk"), "doc_id", "comp", F.lit(True).alias("probe"))
        links = written(linked(inside(members.withColumn("comp", F.col("doc_id")))), "links")
        comps = components(links)
        if not members.filter("blocks > 1").isEmpty():
            left = written(unsettled(members, comps), "unsettled")
            found = linked(across_blocks(left.filter(F.col("others") <= BLOCK_DOCS)))
            many = written(left.filter(F.col("others") > BLOCK_DOCS).select("doc_id", "comp").distinct(), "many")
            again = None
            if not many.isEmpty():
                again = written(in_blocks(written(rare_shingles(many.hint("merge").join(docs, "doc_id"), size, percent), "rare")), "members")
                found = found.unionByName(linked(inside(named(again, comps))))
            links = written(links.unionByName(found), "links")
            comps = components(links)
            if again is not None and not (left := written(unsettled(again, comps), "unsettled")).isEmpty():
                links = written(links.unionByName(linked(across_blocks(left))), "links")
                comps = components(links)
        keep(signed, classes, comps)
    answer = signed.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left").join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.coalesce("comp", "rep")).otherwise(F.col("doc_id"))
    return answer.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES = {"op6_near_dup": op6_near_dup}
