"""Best-fit packing under conflicts.

Documents are cut into pieces of at most the capacity (whole texts: a document's pieces cover all its tokens) and packed
into bins of that capacity. Open bins are ordered by residual and carry bitmaps of the sources and of the duplicate
clusters that they hold. A piece goes to the tightest bin that holds neither a piece of its cluster nor LANES pieces of
its source: the successor search starts at the smallest residual that fits and goes on upwards, bin by bin, until a
compatible one is found, else a bin is opened. Pieces come by falling size.

Pieces are dealt by hash into groups of about GROUP; each group is packed alone, so one task holds a bounded number of
small rows (no text) and groups are packed side by side. A source or cluster of any size is spread over all groups.

Defined results: a null or empty text is one piece of 0 tokens and takes room in no bin, but respects conflicts; a null
source conflicts with nothing; a null cluster is that of the equal texts; pieces of one document don't share a bin; repeated rows are in
one cluster (equal texts); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.mixing import token_count

CAPACITY = 4096
#: Pieces of one source that a bin takes at most.
LANES = 4
#: Pieces in a group, on average.
GROUP = 8192


class Packer:
    """The open bins of one group."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list[int]] = []  # residual, source lanes, clusters, tokens held
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.occupied = 0  # bit r: some bin has residual r

    def add(self, size: int, lane: int | None, cluster: int | None) -> tuple[int, int]:
        """(bin, offset in it) of a piece. lane: the first bit of its source's lanes; cluster: its cluster's bit."""
        lanes = ((1 << LANES) - 1) << lane if lane is not None else 0
        own = 1 << cluster if cluster is not None else 0
        above = self.occupied >> size
        residual = size
        while above:
            step = (above & -above).bit_length() - 1
            residual += step
            row = self.by_residual[residual]
            for k in range(len(row) - 1, -1, -1):
                b = self.bins[row[k]]
                if not b[2] & own and (not lanes or b[1] & lanes != lanes):
                    at = row.pop(k)
                    if not row:
                        self.occupied &= ~(1 << residual)
                    return self._put(at, size, lane, own)
            above >>= step + 1
            residual += 1
        self.bins.append([self.capacity, 0, 0, 0])
        return self._put(len(self.bins) - 1, size, lane, own)

    def _put(self, at: int, size: int, lane: int | None, own: int) -> tuple[int, int]:
        b = self.bins[at]
        offset = b[3]
        b[0] -= size
        b[3] += size
        b[2] |= own
        if lane is not None:
            bit = lane
            while b[1] >> bit & 1:
                bit += 1
            b[1] |= 1 << bit
        self.by_residual[b[0]].append(at)
        self.occupied |= 1 << b[0]
        return at, offset


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start, tokens, source, cluster: no text goes on. cluster: a column that names duplicate clusters;
    without it, and where it is null, equal texts are a cluster."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    if cluster is not None:
        own = F.when(F.col(cluster).isNotNull(), F.xxhash64(F.col(cluster).cast("string"))).otherwise(own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("cluster"), token_count().alias("all"))
    number = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("all") - 1, F.lit(0).cast("long")), F.lit(capacity).cast("long"))).alias("piece", "start")
    return rows.select("*", number).select("doc_id", "piece", "start", F.least(F.col("all") - F.col("start"), F.lit(capacity)).cast("long").alias("tokens"), "source", "cluster")


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        size = table.column("tokens").to_numpy().astype(np.int64)
        cluster = table.column("cluster").to_numpy()
        source = table.column("source").combine_chunks().dictionary_encode()
        lane = source.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        _, own = np.unique(cluster, return_inverse=True)
        order = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), cluster, -size))
        packer = Packer(capacity)
        bins, offsets = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
        for i in order.tolist():
            bins[i], offsets[i] = packer.add(int(size[i]), int(lane[i]) * LANES if lane[i] >= 0 else None, int(own[i]))
        group = table.column("bin_group").to_numpy().astype(np.int64)
        return pa.table({"doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "tokens": table.column("tokens"), "source": table.column("source"), "bin_id": pa.array((group << 32) + bins), "bin_offset": pa.array(offsets)})

    return run


_PACKED = "doc_id long, piece int, start long, tokens long, source string, bin_id long, bin_offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, cluster: str | None = None) -> DataFrame:
    """A row per piece: which bin it is in, and from which of the bin's tokens on. cluster: as of pieces_of()."""
    pieces = pieces_of(docs, capacity, cluster)
    groups = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)).cast("int"))
    return dealt.groupBy("bin_group").applyInArrow(_pack(capacity), _PACKED)
