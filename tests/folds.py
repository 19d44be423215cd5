"""Row-by-row statements of the buffer and release rules, to check the table forms against."""

import math


def buffer_fold(times, low, high, coefficient, history=500):
    """(n, target, occupancy, evicted ids) after each arrival of one shard."""
    gaps, held, last, out = [], [], None, []
    for n, t in enumerate(times, start=1):
        if last is not None:
            gaps = [*gaps, t - last][-history:]
        last = t
        mean = sum(gaps) / len(gaps) if gaps else 1000
        target = high if mean == 0 else max(low, min(high, math.floor(coefficient * 60000 / mean + 0.5)))
        gone = []
        while len(held) >= target:
            gone.append(held.pop(0))
        held.append(n)
        out.append((n, target, len(held), gone))
    return out


def release_fold(trace, workers, delay):
    """{(worker, clock): time} at which a worker may start a clock > 0; rows of ``trace`` are (t, worker)."""
    clock, sent, out = [0] * workers, [True] * workers, {}
    for t, w in trace:
        clock[w] += 1
        sent[w] = False
        for v in range(workers):
            free = v == w if delay < 0 else min(clock) >= clock[v] - delay
            if not sent[v] and free:
                out[v, clock[v]] = t
                sent[v] = True
    return out
