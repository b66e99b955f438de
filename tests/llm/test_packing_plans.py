"""The packing's plan against the fewest sequences that hold the pieces, found by trying all placements."""

import random

from nimbora.llm.packing import plan_sequences


def fewest(lengths, capacity):
    """The least number of sequences, by branch and bound over every placement."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[k]:
                at = rooms.index(room)
                place(k + 1, [*rooms[:at], room - lengths[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def sequences(histogram, capacity):
    """How many sequences the plan opens; asserts that each holds at most the capacity and each piece lies in one."""
    held, placed = {}, dict.fromkeys(histogram, 0)
    for length, first, last, each, sequence, offset in plan_sequences(histogram, capacity):
        placed[length] += last - first + 1
        for i in range(last - first + 1):
            at = offset + i % each * length
            held.setdefault(sequence + i // each, []).append((at, at + length))
    assert placed == histogram
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    return len(held)


def test_plans_are_near_the_fewest_sequences():
    rng = random.Random(8)
    over = []
    for _ in range(300):
        capacity = rng.choice([12, 30, 100])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, capacity // 3 + 2) for _ in range(rng.randint(1, 10))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        over.append(sequences(histogram, capacity) - fewest(lengths, capacity))
    # greedy matching is no exact packing: one sequence more at most, and that rarely
    assert min(over) == 0 and max(over) <= 1 and sum(over) <= 15, (max(over), sum(over))


def test_a_case_that_greedy_matching_does_not_meet():
    histogram = {400: 3, 324: 3, 300: 3}
    assert fewest([n for n, c in histogram.items() for _ in range(c)], 1024) == 3
    assert sequences(histogram, 1024) <= 4
