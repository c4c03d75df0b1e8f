"""Quality-control results of a few reads in plain Python."""

import math
from collections import Counter, defaultdict

from readprism.functions.bases import ADAPTERS


def nearest_rank(values, share):
    values = sorted(values)
    return values[max(1, math.ceil(share * len(values))) - 1]


def mean_q(qual, offset=33):
    n = len(qual)
    return min((sum(max(ord(c) - offset, 0) for c in qual) + n // 2) // n, 93)


def percent(seq, letters):
    n = len(seq)
    return min((100 * sum(c in letters for c in seq.upper()) + n // 2) // n, 100)


def positions(reads, offset=33):
    out = defaultdict(list)
    for seq, qual in reads:
        for i, (b, c) in enumerate(zip(seq.upper(), qual), 1):
            out[i].append((b, min(max(ord(c) - offset, 0), 93)))
    return out


def adapter_starts(seq):
    seq, at, out = seq.upper(), 0, []
    while at < len(seq):
        hit = next((i for i, a in enumerate(ADAPTERS) if seq.startswith(a, at)), None)
        if hit is None:
            at += 1
        else:
            out.append((at + 1, hit))
            at += len(ADAPTERS[hit])
    return out


def kmers(reads):
    counts = Counter()
    for seq, _ in reads:
        seq, n = seq.upper(), len(seq)
        for s in range(n - 6):
            word = seq[s : s + 7]
            if set(word) <= set("ACGT"):
                counts[word, min((s + 1) * 10 // n, 9)] += 1
    return counts
