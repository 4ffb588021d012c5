"""Filling containers of fixed capacity with documents.

Documents are spread by a hash over groups, which are packed on their own: a group holds
about ``CONTAINERS_PER_GROUP`` containers or ``ITEMS_PER_GROUP`` documents, whichever is
more, so the size of a task follows from the capacity and not from the input. Each group
leaves a few containers less than full; these are opened again, and their documents are
packed anew in fewer groups, round by round, until one group is left or a round no longer
helps. Within a group the documents with copies come first and then the others, each from
large to small. The open containers are kept in order of the space left; each carries a
bitmap of the sources and one of the duplicate clusters it holds. From the tightest
container that is large enough the search goes on to the next, until one is compatible;
if none is, a new container is opened.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialize

ITEMS_PER_GROUP = 5_000
CONTAINERS_PER_GROUP = 20
#: A container with at most this share of its capacity left is not opened again.
FULL = 0.01
#: A round that leaves more than this share of its documents in open containers is the last.
PROGRESS = 0.7
MAX_KINDS = 10_000

_PACKED = ["container_name", "pack_group", "container_no", "doc_id", "piece_no", "start_token", "n_tokens"]
_ITEMS = ["container_name", "capacity", "doc_id", "source", "cluster", "piece_no", "start_token", "n_tokens"]
_ROUND_SCHEMA = (
    "container_name string, pack_group bigint, container_no int, capacity bigint, doc_id bigint, source string, cluster bigint, piece_no int,"
    " start_token bigint, n_tokens bigint, full boolean"
)


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, apart: dict[int, int]) -> list[int]:
    """The container of each item. Two items of one cluster (0 or more) are never together,
    nor are sources of which one's mask in ``apart`` has the other's bit; sizes are at most
    the capacity."""
    placed = [0] * len(sizes)
    space: list[tuple[int, int]] = []  # (space left, container), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    # copies need as many containers as there are of them: the small ones must not come last
    for k in sorted(range(len(sizes)), key=lambda k: (clusters[k] < 0, -sizes[k], k)):
        size, against = sizes[k], apart.get(sources[k], 0)
        cluster = 1 << clusters[k] if clusters[k] >= 0 else 0
        at = bisect_left(space, (size, -1))
        while at < len(space) and (source_bits[space[at][1]] & against or cluster_bits[space[at][1]] & cluster):
            at += 1
        if at < len(space):
            left, box = space.pop(at)
        else:
            left, box = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        placed[k] = box
        source_bits[box] |= 1 << sources[k]
        cluster_bits[box] |= cluster
        insort(space, (left - size, box))
    return placed


def pack(items: DataFrame, containers: DataFrame, apart: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Assign documents to containers of each kind.

    ``items`` has doc_id (unique), source, cluster, n_tokens; ``containers`` has
    container_name, capacity_tokens (a handful of rows). A document above a capacity is
    split into pieces that fill a container each, and a rest that is packed like any
    other. Null ids, and documents of no tokens (null, 0), are left out; kinds whose
    capacity is null or below 1 yield nothing. A null cluster is no cluster, a null
    source stands apart from none. Copies with equal clusters never share a container,
    nor do sources named together in ``apart``. Returns ``container_name, pack_group,
    container_no`` (in the group; a piece that fills a container by itself has -1 for both),
    ``doc_id, piece_no, start_token, n_tokens``.
    """
    pairs = list(apart)
    names = sorted({s for pair in pairs for s in pair})
    bit = {s: k + 1 for k, s in enumerate(names)}  # bit 0: any other source
    masks: dict[int, int] = {}
    for a, b in pairs:
        masks[bit[a]] = masks.get(bit[a], 0) | 1 << bit[b]
        masks[bit[b]] = masks.get(bit[b], 0) | 1 << bit[a]
    kinds = [(r[0], int(r[1])) for r in containers.select("container_name", "capacity_tokens").filter("capacity_tokens >= 1").distinct().limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    spark = items.sparkSession
    items = items.filter("doc_id is not null and n_tokens > 0").select("doc_id", "source", F.col("cluster").cast("bigint").alias("cluster"), F.col("n_tokens").cast("bigint").alias("total"))
    kind = F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in kinds]) if kinds else F.array().cast("array<struct<container_name:string,capacity:bigint>>")
    each = items.withColumn("kind", F.explode(kind)).select("doc_id", "source", "cluster", "total", "kind.*")
    each = each.withColumn("full", F.floor(F.col("total") / F.col("capacity")).cast("bigint"))
    whole = each.filter("full >= 1").withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)))
    # a container of its own for each full piece: named by document and piece
    whole = whole.select(
        "container_name", F.lit(-1).cast("bigint").alias("pack_group"), F.lit(-1).alias("container_no"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens")
    )
    rest = each.withColumn("n_tokens", F.col("total") - F.col("full") * F.col("capacity")).filter("n_tokens > 0")
    rest = rest.select("container_name", "capacity", "doc_id", "source", "cluster", F.col("full").cast("int").alias("piece_no"), (F.col("full") * F.col("capacity")).alias("start_token"), "n_tokens")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable").reset_index(drop=True)
        counts = group["cluster"].value_counts()
        number = {c: k for k, c in enumerate(counts.index[counts > 1])}  # a cluster's only member conflicts with none
        clusters = [number.get(c, -1) for c in group["cluster"]]
        sources = [bit.get(s, 0) for s in group["source"]]
        capacity = int(group["capacity"].iloc[0])
        group["container_no"] = best_fit(group["n_tokens"].tolist(), sources, clusters, capacity, masks)
        held = group.groupby("container_no")["n_tokens"].transform("sum")
        group["full"] = (held >= capacity * (1 - FULL)) | (group["groups"] == 1)
        group["pack_group"] += group["first_group"]
        return group[["container_name", "pack_group", "container_no", *_ITEMS[1:], "full"]]

    parts, used, before = [whole], dict.fromkeys((n for n, _ in kinds), 0), {}
    open_items = materialize(rest, "to-pack")
    while True:
        # one row a kind
        sizes = open_items.groupBy("container_name", "capacity").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()
        plan = []
        for r in sizes:
            per_group = max(ITEMS_PER_GROUP, math.ceil(CONTAINERS_PER_GROUP * r["capacity"] * r["n"] / r["tokens"]))
            stuck = r["n"] > PROGRESS * before.get(r["container_name"], math.inf)
            groups = math.ceil(r["n"] / per_group)
            plan.append((r["container_name"], groups, used[r["container_name"]], stuck))
            used[r["container_name"]] += groups
            before[r["container_name"]] = r["n"]
        if not plan:
            break
        deal = spark.createDataFrame(plan, "container_name string, groups bigint, first_group bigint, stuck boolean")
        dealt = open_items.join(F.broadcast(deal), "container_name").withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "first_group"), F.col("groups")))
        packed = materialize(dealt.drop("stuck").groupBy("container_name", "pack_group").applyInPandas(fill, _ROUND_SCHEMA).join(F.broadcast(deal.select("container_name", "stuck")), "container_name"), "packed")
        final = F.col("full") | F.col("stuck")
        parts.append(packed.filter(final).select(_PACKED))
        open_items = packed.filter(~final).select(_ITEMS)
    return reduce(DataFrame.unionByName, parts)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, the fewest that could hold the tokens, tokens packed, and the
    share of space that is filled."""
    per = packed.groupBy("container_name", "pack_group", "container_no").agg(
        F.sum("n_tokens").alias("tokens"), F.when(F.col("container_no") < 0, F.count("*")).otherwise(F.lit(1)).alias("used")
    )
    total = per.groupBy("container_name").agg(F.sum("used").cast("bigint").alias("containers"), F.sum("tokens").cast("bigint").alias("tokens"))
    share = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")
    return total.join(containers.select("container_name", "capacity_tokens"), "container_name").select("container_name", "capacity_tokens", "containers", least, "tokens", share.alias("filled"))
