"""Sharding by a k-d tree: split at weighted medians along the widest dimension.

Every level of the tree is one short run of grouped histograms over all rows; only the cut
values of the nodes, which the number of shards bounds, come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, stored

#: Bits of a value and of the tie-breaker in the key by which a dimension is cut.
VALUE_BITS = 31
TIE_BITS = 31
#: Bins of a histogram, and the part of a shard's weight that a cut may be off.
BIN_BITS = 12
TOLERANCE = 1 / 4096


def heavy_groups(weights: list[int], total: int, shards: int) -> int:
    """How many of the heaviest groups (in falling order) have more than an even part of what is left."""
    n = 0
    while n < min(len(weights), shards - 1) and weights[n] * (shards - n) > total:
        total -= weights[n]
        n += 1
    return n


def children_of(rows: DataFrame, keys: list[str], leaves: dict[int, int]) -> dict[int, int]:
    """Leaves of the nodes 2i and 2i + 1 below each node i, by the weight that they got; one for a single group."""
    found = rows.groupBy("node").agg(
        F.sum("weight").alias("weight"), F.greatest(*[F.max(k) - F.min(k) for k in keys], F.lit(0)).alias("span")
    ).collect()
    weight, span = {r["node"]: r["weight"] for r in found}, {r["node"]: r["span"] for r in found}
    below = {}
    for node, m in leaves.items():
        left, right = 2 * node, 2 * node + 1
        if m == 1:
            below[left] = 1
            continue
        both = weight.get(left, 0) + weight.get(right, 0)
        part = round(m * weight.get(left, 0) / both) if both else m // 2
        if not span.get(left, 0):
            part = 1
        elif not span.get(right, 0):
            part = m - 1
        below[left] = min(max(part, 1), m - 1)
        below[right] = m - below[left] if span.get(right, 0) else 1
    return below


def with_nodes(rows: DataFrame, values: dict[int, tuple], fields: str) -> DataFrame:
    """Attach values to the nodes of a level: a table of at most as many rows as there are shards."""
    table = rows.sparkSession.createDataFrame([(n, *v) for n, v in sorted(values.items())], f"node int, {fields}")
    return rows.join(F.broadcast(table), "node")


def node_cuts(rows: DataFrame, keys: list[str], leaves: dict[int, int], shard_weight: float) -> tuple[dict, dict]:
    """The widest dimension of each node and the key at which its weight splits.

    ``rows``: ``node``, ``weight`` and the keys (0 <= key < 2^62).  A cut is narrowed by
    histograms until the bin that holds it has little weight or a single key.
    """
    split = [n for n, m in leaves.items() if m > 1]
    spans = (
        rows.where(F.col("node").isin(split))
        .groupBy("node")
        .agg(
            F.sum("weight").alias("weight"),
            *[(F.max(k) - F.min(k)).alias(k) for k in keys],
            *[F.min(k).alias(f"least{k}") for k in keys],
            *[F.max(k).alias(f"most{k}") for k in keys],
        )
        .collect()
    )
    dims = {n: 0 for n in leaves} | {r["node"]: max(range(len(keys)), key=lambda i: (r[keys[i]], -i)) for r in spans}
    # Rows below the cut go left: none has a key of 2^62 or more, so a leaf passes all to its left child.
    top = 1 << (VALUE_BITS + TIE_BITS)
    low = {r["node"]: r[f"least{keys[dims[r['node']]]}"] for r in spans}
    # The least and the greatest key of a node go to different sides.
    first, last = dict(low), {r["node"]: r[f"most{keys[dims[r['node']]]}"] for r in spans}
    width = {r["node"]: (r[keys[dims[r["node"]]]] + 1).bit_length() for r in spans}
    bits = max(width.values(), default=0)
    want = {r["node"]: r["weight"] * (leaves[r["node"]] // 2) / leaves[r["node"]] for r in spans}
    cuts = {n: top for n in leaves}
    open_nodes = set(want)
    while open_nodes:
        shift = max(0, bits - BIN_BITS)
        state = {n: (dims[n], low[n], float(want[n])) for n in open_nodes}
        offset = F.element_at(F.array(*keys), F.col("dim") + 1) - F.col("low")
        held = (
            with_nodes(rows, state, "dim int, low long, goal double")
            .select("node", "goal", "weight", offset.alias("_offset"))
            .where((F.col("_offset") >= 0) & (F.col("_offset") < F.lit(1 << bits)))
            .groupBy("node", "goal", F.shiftright("_offset", shift).alias("bin"))
            .agg(F.sum("weight").alias("w"), F.min("_offset").alias("least"), F.max("_offset").alias("most"))
        )
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        found = (
            held.withColumn("upto", upto)
            .where("upto >= goal")
            .groupBy("node")
            .agg(F.min(F.struct("bin", "upto", "w", "least", "most")).alias("x"))
            .collect()
        )
        for r in found:
            node, (_, total, weight, least, most) = r["node"], r["x"]
            if least == most or weight <= TOLERANCE * shard_weight:
                # Cut at the nearer edge of the bin.
                nearer = want[node] - (total - weight) > weight / 2
                cuts[node] = low[node] + (most + 1 if nearer else least)
                if cuts[node] <= first[node]:
                    cuts[node] = low[node] + most + 1
                cuts[node] = min(cuts[node], max(last[node], first[node] + 1))
                open_nodes.discard(node)
            else:
                low[node] += least
                want[node] -= total - weight
                width[node] = (most - least + 1).bit_length()
        open_nodes -= set(want) - {r["node"] for r in found}
        bits = max((width[n] for n in open_nodes), default=0)
    return dims, cuts


def kd_shards(
    df: DataFrame, dims: list[Column], tie: Column, weight: Column, shards: int, *, keep: list[str]
) -> DataFrame:
    """Put rows into ``shards`` shards of nearly equal weight.

    Returns the ``keep`` columns, ``weight``, ``shard`` (0 up to ``shards`` - 1) and ``slot``, the gapless place
    of the row in its shard.  ``dims`` are numeric; rows that agree in all dimensions and in
    ``tie`` (a non-negative number) stay together.  A group heavier than an even part of what
    the heavier groups leave has a shard of its own, the last ones, and the others share the rest evenly.
    Fewer groups than shards get a shard each and leave the others empty.  Null dimensions count as 0, null
    weights as 0; rows that repeat all get slots; no rows give no rows.
    """
    names = [f"_d{i}" for i in range(len(dims))]
    base = df.select(
        *keep,
        *[F.coalesce(d.cast("double"), F.lit(0.0)).alias(n) for d, n in zip(dims, names, strict=True)],
        F.coalesce(tie, F.lit(0)).cast("long").alias("_tie"),
        F.coalesce(weight, F.lit(0)).cast("long").alias("weight"),
    )
    base = stored(base)
    ends = base.agg(
        F.sum("weight").alias("total"), *[F.min(n).alias(f"min{n}") for n in names], *[F.max(n).alias(f"max{n}") for n in names]
    ).first()
    if ends["total"] is None:
        return base.select(*keep, "weight", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    keys = []
    for i, n in enumerate(names):
        width = ends[f"max{n}"] - ends[f"min{n}"]
        part = (F.col(n) - F.lit(ends[f"min{n}"])) / F.lit(width) if width > 0 else F.lit(0.0)
        value = F.least(F.floor(part * F.lit(float(1 << VALUE_BITS))), F.lit((1 << VALUE_BITS) - 1)).cast("long")
        keys.append(F.shiftleft(value, TIE_BITS).bitwiseOR(F.col("_tie").bitwiseAND(F.lit((1 << TIE_BITS) - 1))).alias(f"_k{i}"))
    key_names = [f"_k{i}" for i in range(len(keys))]
    rows = base.select(*keep, "weight", "_tie", *keys, F.lit(0).alias("node"))
    # At most as many groups as there are shards.
    largest = rows.groupBy(*key_names).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), *key_names).limit(shards).collect()
    # Where the groups are fewer than the shards, these are all of them, and each has a shard.
    few = len(largest) < shards
    alone = largest if few else largest[: heavy_groups([r["weight"] for r in largest], ends["total"], shards)]
    own = F.lit(None).cast("int")
    for i, r in enumerate(alone):
        same = F.lit(True)
        for k in key_names:
            same = same & (F.col(k) == F.lit(r[k]))
        own = F.when(same, shards - 1 - i).otherwise(own)
    marked = rows.withColumn("_own", own)
    rows = marked.where("_own IS NULL").drop("_own")
    leaves = {0: 1 if few else shards - len(alone)}
    share = (ends["total"] - sum(r["weight"] for r in alone)) / leaves[0]
    while max(leaves.values()) > 1:
        way, cuts = node_cuts(rows, key_names, leaves, share)
        known = with_nodes(rows, {n: (way[n], cuts[n]) for n in leaves}, "dim int, cut long")
        right = (F.element_at(F.array(*key_names), F.col("dim") + 1) >= F.col("cut")).cast("int")
        rows = known.withColumn("node", 2 * F.col("node") + right).drop("dim", "cut")
        leaves = children_of(rows, key_names, leaves)
    number = {node: i for i, node in enumerate(sorted(leaves))}
    placed = with_nodes(rows, {n: (i,) for n, i in number.items()}, "shard int").select(*keep, "weight", "_tie", "shard")
    if alone:
        placed = placed.unionByName(marked.where("_own IS NOT NULL").select(*keep, "weight", "_tie", F.col("_own").alias("shard")))
    placed = placed.withColumn("_mix", F.xxhash64(*keep))
    numbered = running(placed, ["shard", *keep, "_tie", "_mix"], None, "_place")
    first = numbered.groupBy("shard").agg(F.min("_place").alias("_first"))
    # One row for each shard.
    return numbered.join(F.broadcast(first), "shard").select(
        *keep, "weight", "shard", (F.col("_place") - F.col("_first")).alias("slot")
    )
