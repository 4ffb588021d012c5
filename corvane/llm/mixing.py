"""Mixing sources to target weights.

How many tokens each source gives is settled first, from its target share, what it has
and how often it may be repeated. The documents of a source form a stream in hash order,
repeated pass by pass. A document is a block of the stream; in tokens of the whole mix
its release time is where it begins in the stream divided by the source's share, and its
deadline where it ends divided by that share. The mix is filled from the front: of the
blocks released so far the one of the earliest deadline comes next. So no source runs
ahead of its share or falls behind it by as much as one block of the size
``Mix.block_tokens`` (that of the largest document at least).

Times are absolute, so that the mix can be cut into windows of equal length which are
scheduled on their own: a document belongs to the window that its middle falls into, and
what a source owes at a window's border is in the times of its documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.running import running_sum

BLOCK_TOKENS = 8_192
#: Blocks of the mix that one task schedules at once.
WINDOW_BLOCKS = 256
MAX_SOURCES = 10_000

_MIXED = "window_no bigint, place bigint, source string, at bigint, doc_id bigint, repeat_no int, n_tokens bigint"


def source_name(c: Column) -> Column:
    """Lower case, outer blanks dropped, `-` and blanks as `_`."""
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]+", "_")


def shares_out(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, int]:
    """Tokens that each source gives: in proportion to the targets, none beyond what its
    documents hold times its repeats; what one can't give the others make up for, as far
    as they can."""
    most = {s: available.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    wanted = {s: w for s, (w, _) in targets.items() if w and w > 0 and most[s] > 0}
    gives = dict.fromkeys(targets, 0)
    left = min(total, sum(most[s] for s in wanted))
    while wanted and left > 0:
        scale = left / sum(wanted.values())
        short = [s for s in wanted if most[s] <= wanted[s] * scale]
        if not short:
            for s, w in wanted.items():
                gives[s] = round(w * scale)
            break
        for s in short:
            gives[s] = most[s]
            left -= most[s]
            del wanted[s]
    return gives


def fair_order(blocks: Iterable[tuple[str, float, float, int]], now: float = 0.0) -> list[int]:
    """The order of ``blocks`` (source, release, deadline, tokens; a source's own in order of
    their release) from ``now`` on: of those released the one of the earliest deadline. If
    none is released, the next one to be."""
    streams: dict[str, list[int]] = {}
    blocks = list(blocks)
    for k, block in enumerate(blocks):
        streams.setdefault(block[0], []).append(k)
    for stream in streams.values():
        stream.reverse()
    waiting = [(blocks[s[-1]][1], blocks[s[-1]][0], s[-1]) for s in streams.values()]
    heapq.heapify(waiting)
    ready: list[tuple[float, str, int]] = []
    order = []
    while waiting or ready:
        while waiting and (waiting[0][0] <= now or not ready):
            _, source, k = heapq.heappop(waiting)
            heapq.heappush(ready, (blocks[k][2], source, k))
        _, source, k = heapq.heappop(ready)
        order.append(k)
        now += blocks[k][3]
        stream = streams[source]
        stream.pop()
        if stream:
            heapq.heappush(waiting, (blocks[stream[-1]][1], source, stream[-1]))
    return order


class Mix:
    """A mix of ``items`` (doc_id, source, n_tokens) to ``targets`` (source, target_share,
    max_repeats).

    Sources are compared as ``source_name`` writes them. Documents of sources without a
    target, of null ids and of no tokens are left out. ``total_tokens`` defaults to what
    the named sources hold. Only one row a source comes to the driver. An empty table, or
    targets that nothing can serve, give an empty mix.
    """

    def __init__(self, items: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, window_blocks: int = WINDOW_BLOCKS):
        self.spark = items.sparkSession
        wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null")
        rows = wanted.groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.targets = {r["source"]: (float(r["w"] or 0), int(r["r"] or 0)) for r in rows}
        items = items.select("doc_id", source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
        named = self.spark.createDataFrame([(s,) for s in self.targets], "source string")  # at most MAX_SOURCES rows
        self.items = items.filter(F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0)).join(F.broadcast(named), "source", "left_semi")
        held = self.items.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("n_tokens").alias("largest")).collect()
        self.available = {r["source"]: int(r["tokens"]) for r in held}
        self.documents = sum(r["documents"] for r in held)
        self.total = sum(self.available.values()) if total_tokens is None else total_tokens
        self.gives = shares_out(self.available, self.targets, self.total)
        self.planned = sum(self.gives.values())
        #: Less than this much a source deviates from its share, at any place of the mix.
        self.block_tokens = max([block_tokens, *(int(r["largest"]) for r in held if self.gives[r["source"]] > 0)])
        self.window_tokens = self.block_tokens * window_blocks
        plan = [(s, g, self.available[s], self.targets[s][1]) for s, g in self.gives.items() if g > 0]
        #: One row a source that gives anything, for broadcast joins.
        self.plan = self.spark.createDataFrame(plan, "source string, gives bigint, holds bigint, repeats int")

    def selection(self) -> DataFrame:
        """``source, doc_id, repeat_no, n_tokens, at, gives``: every use of a document; ``at`` is
        where it begins in its source's stream. The last one is kept if half of it fits."""
        stream = running_sum(self.items, "source", "doc_id", "n_tokens", self.documents).join(F.broadcast(self.plan), "source")
        uses = F.least(F.ceil(F.col("gives") / F.col("holds")).cast("int"), F.col("repeats"))
        stream = stream.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), uses)))
        stream = stream.withColumn("at", (F.col("repeat_no") - 1) * F.col("holds") + F.col("before"))
        return stream.filter(F.col("at") + F.col("n_tokens") / 2 <= F.col("gives")).select("source", "doc_id", "repeat_no", "n_tokens", "at", "gives")

    def _windows(self) -> DataFrame:
        """The selection with the window of each use."""
        middle = (F.col("at") + F.col("n_tokens") / 2) / F.col("gives") * self.planned
        return self.selection().withColumn("window_no", F.floor(middle / self.window_tokens).cast("bigint"))

    def mixed(self) -> DataFrame:
        """``window_no, place, source, at, doc_id, repeat_no, n_tokens``; the mix is in order of
        window_no, place (which counts from 0 in each window)."""
        planned, window_tokens = self.planned, self.window_tokens

        def schedule(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["source", "at"], kind="stable").reset_index(drop=True)
            scale = planned / group["gives"].to_numpy(float)
            release, deadline = group["at"].to_numpy() * scale, (group["at"] + group["n_tokens"]).to_numpy() * scale
            blocks = zip(group["source"], release.tolist(), deadline.tolist(), group["n_tokens"].tolist())
            group = group.iloc[fair_order(blocks, float(group["window_no"].iloc[0] * window_tokens))]
            return group.assign(place=range(len(group)))[["window_no", "place", "source", "at", "doc_id", "repeat_no", "n_tokens"]]

        return self._windows().groupBy("window_no").applyInPandas(schedule, _MIXED)

    def positions(self, mixed: DataFrame) -> DataFrame:
        """``mixed`` with ``position``: the tokens of the mix before each row. ``mixed`` is read
        twice. Windows are added up in stretches of 4,096, so no task orders them all."""
        stretch = F.floor(F.col("window_no") / 4096)
        sums = mixed.groupBy("window_no").agg(F.sum("n_tokens").alias("_tokens")).withColumn("_stretch", stretch)
        before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        whole = sums.groupBy("_stretch").agg(F.sum("_tokens").alias("_all"))
        whole = whole.select("_stretch", F.coalesce(F.sum("_all").over(before(F.lit(0)).orderBy("_stretch")), F.lit(0)).alias("_far"))
        sums = sums.select("window_no", "_stretch", F.coalesce(F.sum("_tokens").over(before("_stretch").orderBy("window_no")), F.lit(0)).alias("_near"))
        offsets = sums.join(whole, "_stretch").select("window_no", (F.col("_far") + F.col("_near")).alias("_offset"))
        inside = F.coalesce(F.sum("n_tokens").over(before("window_no").orderBy("place")), F.lit(0))
        return mixed.withColumn("_inside", inside).join(offsets, "window_no").withColumn("position", F.col("_offset") + F.col("_inside")).drop("_inside", "_offset")

    def deviations(self, mixed: DataFrame) -> DataFrame:
        """Per source: how far it was ahead of its share and behind it, at most, in tokens, at
        any place of ``mixed``. A source is furthest behind right before one of its documents
        and furthest ahead right after one."""
        share = F.col("gives") / F.lit(float(self.planned or 1))
        placed = self.positions(mixed).join(F.broadcast(self.plan.select("source", "gives")), "source")
        ahead = F.col("at") + F.col("n_tokens") - share * (F.col("position") + F.col("n_tokens"))
        behind = share * F.col("position") - F.col("at")
        out = placed.groupBy("source", "gives").agg(F.max(ahead).alias("_ahead"), F.max(behind).alias("_behind"), F.sum("n_tokens").alias("used_tokens"))
        whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # of one row a source
        at_end = share * whole - F.col("used_tokens")
        return out.select(
            "source", F.round("_ahead", 1).alias("most_ahead"), F.round(F.greatest("_behind", at_end), 1).alias("most_behind"), F.lit(self.block_tokens).cast("bigint").alias("block_tokens")
        )

    def shares(self) -> DataFrame:
        """Per source: target and reached share, tokens held and used, most and actual repeats."""
        used = self.selection().groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.max("repeat_no").alias("most_repeats"))
        rows = [(s, w, r, self.available.get(s, 0)) for s, (w, r) in sorted(self.targets.items())]
        plan = self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, held_tokens bigint")
        out = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))
        everything = used.agg(F.sum("used_tokens")).first()[0] or self.planned or 1
        return out.withColumn("reached_share", F.col("used_tokens") / F.lit(int(everything)))
