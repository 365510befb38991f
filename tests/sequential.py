"""Plain sequential versions of the ordered operators, to compare with on small data."""

import statistics
from datetime import timedelta


def consecutive(rows, size, gap):
    groups, previous = [], None
    for seq, ts, value in rows:
        late = previous is not None and ts is not None and ts - previous > timedelta(seconds=gap)
        if not groups or late or len(groups[-1]) == size:
            groups.append([])
        groups[-1].append((seq, ts, value))
        previous = ts
    return groups


def fixed(rows, size):
    return [rows[i : i + size] for i in range(0, len(rows) - size + 1, size)]


def windows(rows, size, gap):
    groups = []
    for row in rows:
        if row[1] is None:
            continue
        if not groups or row[1] - groups[-1][0][1] > timedelta(seconds=gap) or len(groups[-1]) == size:
            groups.append([])
        groups[-1].append(row)
    return groups


def statistics_of(groups):
    out = []
    for number, group in enumerate(groups, start=1):
        values = [v for _, _, v in group]
        out.append(
            (number, group[0][0], len(group), statistics.fmean(values), max(values) - min(values),
             statistics.stdev(values) if len(values) > 1 else None)
        )
    return out


def runs(values, keeps_going, length):
    """Hits of a run rule: a run starts again at the point that completed it."""
    hits, start = [], 0
    for i in range(1, len(values)):
        if not keeps_going(values[i - 1], values[i]):
            start = i
        elif i - start + 1 == length:
            hits.append((start, i))
            start = i
    return hits


def rising(values, length):
    return runs(values, lambda a, b: b > a, length)


def falling(values, length):
    return runs(values, lambda a, b: b < a, length)


def same_side(values, centre, length):
    def side(v):
        return (v > centre) - (v < centre)

    return runs(values, lambda a, b: side(b) != 0 and side(a) == side(b), length)
