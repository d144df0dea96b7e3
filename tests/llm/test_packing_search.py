"""Operator 2's search where a descent needs more fillings than there are lengths."""

import random
from collections import Counter

from lumispec.llm import packing


def held(counts, steps, capacity=2048):
    got = Counter()
    for times, chosen in steps:
        assert times > 0 and sum(chosen) <= capacity
        for l in chosen:
            got[l] += times
    assert got == Counter(counts)
    return sum(times for times, _ in steps)


def test_search_betters_the_incumbent_over_all_lengths():
    r = random.Random(0)
    counts = {l: r.randint(1, 60) if l > 300 else 1 for l in range(1, 2049)}
    first = min(held(counts, f(counts, 2048)) for f in (packing.first_fit, packing.best_fit))
    seen = {}
    size = held(counts, packing.plan(counts, 2048, seen))
    assert seen["bound"] <= size < first and seen["whole"] >= 1 and seen["descents"] >= packing.DESCENTS


def test_best_fit_takes_the_tightest_room():
    # 7 goes beside 3 and not into the room of 4 that 6 leaves; 4 finds it.
    assert held({6: 1, 7: 1, 4: 1, 3: 1}, packing.best_fit({6: 1, 7: 1, 4: 1, 3: 1}, 10), 10) == 2
    r = random.Random(1)
    for _ in range(200):
        counts = {l: r.randint(1, 9) for l in r.sample(range(1, 61), r.randint(1, 30))}
        rooms = []
        for l in sorted(counts, reverse=True):
            for _ in range(counts[l]):
                fit = min((x for x in rooms if x >= l), default=60)
                if fit in rooms:
                    rooms.remove(fit)
                rooms.append(fit - l)
        assert held(counts, packing.best_fit(counts, 60), 60) == len(rooms)
