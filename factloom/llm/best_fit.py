"""Best-fit packing into several permitted sequence lengths.

Documents longer than the longest sequence are cut into pieces of that length, which fill bins of their
own; what is left of each document is dealt by hash to shards of a bounded number of pieces. In a shard,
pieces go by falling length into the open bin they leave the least room in. Where none has room, the
permitted lengths compete: each is filled in thought with the pieces to come, and the one with the least
cost (its length plus a fixed cost) per token it would hold is opened. At the end each bin shrinks to
the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written

CAPACITIES = (2048, 4096, 8192, 16384)
#: Tokens that a sequence costs besides its length (kernel launch, padding to the batch).
BIN_COST = 64
#: Documents in a shard, on average; one task holds a shard's lengths.
SHARD_DOCS = 20_000
#: Copies of a repeated row that one task numbers at a time.
COPIES = 1_000_000
#: Pieces that are tried in thought to judge a length.
LOOK_AHEAD = 6


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list[int], list[int]]:
    """Bin of each piece (lengths at most the largest capacity), and each bin's final capacity.

    Of letting all lengths compete and of opening bins of the few largest ones only, what costs least.
    """
    caps = sorted(capacities)
    tried = [place(lengths, caps, caps[i:], bin_cost) for i in range(len(caps))]
    return min(tried, key=lambda t: sum(c + bin_cost for c in t[1]))


def place(lengths: list[int], caps: list[int], openable: list[int], bin_cost: int) -> tuple[list[int], list[int]]:
    """pack, with bins opened at the lengths `openable` and shrunk to those of `caps`; both rise."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    ahead = [lengths[i] for i in reversed(order)]  # rising; those still to come are a prefix
    where, used = [0] * len(lengths), []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for done, i in enumerate(order):
        size = lengths[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            to_come = len(order) - done - 1
            best = None
            for cap in openable[bisect_left(openable, size) :]:
                filled, rest, high = size, cap - size, to_come
                for _ in range(LOOK_AHEAD):
                    high = bisect_right(ahead, rest, 0, high)
                    if not high or not rest:
                        break
                    high -= 1
                    filled, rest = filled + ahead[high], rest - ahead[high]
                shrunk = caps[bisect_left(caps, filled)]
                price = (shrunk + bin_cost) / max(filled, 1)
                if best is None or price < best[0]:
                    best = (price, cap)
            left, b = best[1], len(used)
            used.append(0)
        where[i] = b
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return where, [caps[bisect_left(caps, n)] for n in used]


def pack_documents(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, piece (from 0), start, n_tokens, bin (string), capacity: one row for each piece.

    `length` is a document's tokens; null counts as 0. Documents of no tokens are placed too, as a piece of
    length 0. Rows of one doc_id are documents of their own. Every token of every row is in one piece. Shards
    go by doc_id, length and the number among equal rows, so that the partitioning of docs changes nothing,
    and a row that is repeated very often spreads over all shards. Columns beyond doc_id and those `length`
    needs are not read.
    """
    top = max(capacities)
    sized = docs.select("doc_id", F.coalesce(length, F.lit(0)).cast("long").alias("total")).groupBy("doc_id", "total").agg(F.count("*").alias("rows"))
    sized = written(sized, "lengths")
    rows, most = sized.agg(F.sum("rows"), F.max("rows")).head()
    shards = max(1, -(-(rows or 0) // shard_docs))
    # a piece of exactly the longest length is a full bin by itself; the rest of each document is packed
    full = F.when(F.col("total") % top == 0, F.greatest(F.expr(f"total div {top}") - 1, F.lit(0))).otherwise(F.expr(f"total div {top}"))
    runs = sized.select("doc_id", "total", full.alias("full"), "rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows", F.lit(COPIES).cast("long"))).alias("first"))
    if (most or 0) > COPIES:  # else no row has many copies to number
        runs = runs.repartition("doc_id", "total", "first")
    sized = runs.select("doc_id", "total", "full", F.explode(F.sequence("first", F.least("rows", F.col("first") + COPIES - 1))).alias("copy"))
    name = F.concat_ws("-", F.when(F.col("doc_id").isNull(), "w").otherwise(F.concat(F.lit("w-"), F.col("doc_id").cast("string"))), "total", "copy", "piece")
    whole = sized.filter("full > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.lit(top).cast("long").alias("n_tokens"), name.alias("bin"), F.lit(top).cast("long").alias("capacity"))
    rest = sized.select("doc_id", F.col("full").alias("piece"), (F.col("full") * top).alias("start"), (F.col("total") - F.col("full") * top).alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "total", "copy"), F.lit(shards)).alias("shard"))

    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "start"], kind="stable", na_position="last").reset_index(drop=True)
        where, caps = pack(pdf["n_tokens"].tolist(), capacities, bin_cost)
        pdf["bin"] = [f"s{key[0]}-{b}" for b in where]
        pdf["capacity"] = [caps[b] for b in where]
        return pdf[["doc_id", "piece", "start", "n_tokens", "bin", "capacity"]]

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece long, start long, n_tokens long, bin string, capacity long"
    return rest.groupBy("shard").applyInPandas(pack_shard, schema).unionByName(whole)


def byte_tokens() -> Column:
    """Tokens of a byte-level model: the text's UTF-8 bytes and an end token."""
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 1


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), byte_tokens())


QUERIES = {"op9_best_fit": op9_best_fit}
