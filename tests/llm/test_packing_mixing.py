from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import packing as P
from corvane.llm.mixing import Mix, fair_order, shares_out


def test_best_fit():
    assert P.best_fit([5, 5, 3, 2], [0] * 4, [-1] * 4, 10, {}) == [0, 0, 1, 1]
    assert len(set(P.best_fit([1, 1, 1], [0] * 3, [4, 4, 4], 10, {}))) == 3
    assert len(set(P.best_fit([1, 1, 1], [1, 2, 0], [-1] * 3, 10, {1: 4, 2: 2}))) == 2


@pytest.mark.parametrize("group", [40, 5000])
def test_pack(spark, monkeypatch, group):
    monkeypatch.setattr(P, "ITEMS_PER_GROUP", group)
    random.seed(1)
    rows = [(k, random.choice(["a", "b", "c", None]), k % 7 if k % 3 == 0 else None, random.randint(1, 900)) for k in range(600)]
    rows += [(9001, "a", None, 2500), (9002, "b", None, 1000), (9003, "a", None, 0), (9004, "a", None, None), (None, "a", None, 5)]
    items = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, source string, cluster long, n_tokens long, capacity int")
    kinds = spark.createDataFrame([("s", 500), ("l", 1000), ("none", None), ("zero", 0)], "container_name string, capacity_tokens int")
    got = P.pack(items, kinds, [("a", "b")]).collect()
    info = {r[0]: r for r in rows}
    for kind, capacity in (("s", 500), ("l", 1000)):
        mine = [r for r in got if r["container_name"] == kind]
        per_doc, boxes = defaultdict(list), defaultdict(list)
        for r in mine:
            per_doc[r["doc_id"]].append(r)
            if r["container_no"] >= 0:
                boxes[r["pack_group"], r["container_no"]].append(r)
            else:
                assert r["n_tokens"] == capacity  # fills a container of its own
        assert set(per_doc) == {i for i, _, _, n in rows if i is not None and n}
        for i, pieces in per_doc.items():
            pieces.sort(key=lambda r: r["piece_no"])
            assert [r["piece_no"] for r in pieces] == list(range(len(pieces)))
            assert [r["start_token"] for r in pieces] == [sum(x["n_tokens"] for x in pieces[:k]) for k in range(len(pieces))]
            assert sum(r["n_tokens"] for r in pieces) == info[i][3] and (len(pieces) == 1 or info[i][3] > capacity)
        for box in boxes.values():
            assert sum(r["n_tokens"] for r in box) <= capacity
            clusters = [info[r["doc_id"]][2] for r in box if info[r["doc_id"]][2] is not None]
            assert len(clusters) == len(set(clusters))
            assert not {"a", "b"} <= {info[r["doc_id"]][1] for r in box}
    assert {r["container_name"] for r in got} == {"s", "l"}
    assert P.pack(items.limit(0), kinds).count() == 0 and P.pack(items, kinds.limit(0)).count() == 0


def test_fill(spark):
    random.seed(2)
    items = spark.createDataFrame([(k, "s", None, random.randint(20, 700)) for k in range(4000)], "doc_id long, source string, cluster long, n_tokens long")
    kinds = spark.createDataFrame([("m", 2048)], "container_name string, capacity_tokens int")
    report = P.fill_report(P.pack(items, kinds), kinds).first()
    assert report["filled"] > 0.99 and report["containers"] >= report["least_containers"] and report["tokens"] == items.agg(F.sum("n_tokens")).first()[0]


def test_rounds_fill_the_containers_of_many_groups(spark, monkeypatch):
    random.seed(5)
    # copies of a small text, and a capacity that a group of few items can't fill well
    rows = [(k, "s", 1 if k < 40 else None, 30 if k < 40 else random.randint(20, 700)) for k in range(3000)]
    items = spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long")
    kinds = spark.createDataFrame([("m", 16384)], "container_name string, capacity_tokens int")
    monkeypatch.setattr(P, "ITEMS_PER_GROUP", 100)
    monkeypatch.setattr(P, "CONTAINERS_PER_GROUP", 3)
    packed = P.pack(items, kinds)
    assert packed.count() == packed.select("doc_id").distinct().count() == 3000 and packed.select("pack_group").distinct().count() > 5
    report = P.fill_report(packed, kinds).first()
    assert report["containers"] <= report["least_containers"] + 2


def most_deviation(placed, gives):
    """Brute force over (source, tokens) in order of the mix."""
    whole, seen, done, most = sum(gives.values()), Counter(), 0, 0.0
    for source, tokens in placed:
        seen[source] += tokens
        done += tokens
        most = max(most, *(abs(seen[s] - g * done / whole) for s, g in gives.items()))
    return most


def test_order_deviates_less_than_a_block():
    random.seed(3)
    for _ in range(40):
        sizes = {f"s{k}": [random.choice([1, 5, random.randint(1, 100)]) for _ in range(random.randint(1, 60))] for k in range(random.randint(1, 9))}
        gives = {s: sum(x) for s, x in sizes.items()}
        whole, blocks = sum(gives.values()), []
        for s, x in sizes.items():
            at = 0
            for n in x:
                blocks.append((s, at * whole / gives[s], (at + n) * whole / gives[s], n))
                at += n
        order = fair_order(blocks)
        assert sorted(order) == list(range(len(blocks)))
        for s in sizes:
            mine = [k for k in order if blocks[k][0] == s]
            assert mine == sorted(mine)
        assert most_deviation([(blocks[k][0], blocks[k][3]) for k in order], gives) < max(max(x) for x in sizes.values()) + 1e-6
    assert fair_order([]) == []


def test_shares():
    targets = {"big": (0.5, 1), "small": (0.3, 2), "none": (0.2, 3)}
    assert shares_out({"big": 1000, "small": 50}, targets, 1050) == {"big": 950, "small": 100, "none": 0}
    assert shares_out({"big": 1000, "small": 1000}, targets, 800) == {"big": 500, "small": 300, "none": 0}
    assert shares_out({}, targets, 10) == {"big": 0, "small": 0, "none": 0}


@pytest.mark.parametrize("windows", [3, 256])
def test_mix(spark, windows):
    random.seed(4)
    rows = [(k, random.choice(["Big", " big", "BIG", "big"]) if k % 3 else "Small-One", random.randint(1, 50)) for k in range(900)]
    rows += [(2000, "other", 10), (2001, None, 10), (None, "big", 10), (2002, "big", None), (2003, "big", 0)]
    items = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, n_tokens long, at int")
    targets = spark.createDataFrame([("big", 0.25, 2), ("small_one", 0.7, 2), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    mix = Mix(items, targets, block_tokens=60, window_blocks=windows)
    got = sorted(mix.mixed().collect(), key=lambda r: (r["window_no"], r["place"]))
    used = Counter(r["doc_id"] for r in got)
    assert max(used.values()) <= 2 and len({(r["doc_id"], r["repeat_no"]) for r in got}) == len(got)
    totals = Counter()
    for r in got:
        assert r["at"] == totals[r["source"]]  # each source's stream is in order and without gaps
        totals[r["source"]] += r["n_tokens"]
    for s, g in mix.gives.items():
        assert abs(totals[s] - g) <= 50
    whole = sum(totals.values())
    gives = {s: g for s, g in mix.gives.items() if g}
    assert most_deviation([(r["source"], r["n_tokens"]) for r in got], gives) < mix.block_tokens
    position = {(r["doc_id"], r["repeat_no"]): r["position"] for r in mix.positions(mix.mixed()).collect()}
    before = 0
    for r in got:
        assert position[r["doc_id"], r["repeat_no"]] == before
        before += r["n_tokens"]
    told = mix.deviations(mix.mixed()).collect()
    assert {r["source"] for r in told} == set(gives) and all(max(r["most_ahead"], r["most_behind"]) < r["block_tokens"] for r in told)
    report = {r["source"]: r for r in mix.shares().collect()}
    assert report["absent"]["used_tokens"] == 0 and report["big"]["used_tokens"] == totals["big"]
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1) and whole == sum(r["used_tokens"] for r in report.values())
    assert Mix(items.limit(0), targets).mixed().count() == 0 and Mix(items, targets.limit(0)).mixed().count() == 0
    assert Mix(items.limit(0), targets).shares().count() == 3 and Mix(items.limit(0), targets).deviations(Mix(items.limit(0), targets).mixed()).count() == 0
