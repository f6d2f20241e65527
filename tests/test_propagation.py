"""Nodes are looked at again only when a label around them has moved; labels are those of whole rounds. (Speed is not tested.)"""

import random
from collections import Counter

from ledgerflow.operators.communities import propagate


def whole_rounds(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    colour = {}
    for v in sorted(near, key=lambda v: (-len(near[v]) - (v in near[v]), v)):
        used = {colour[w] for w in near[v] if w in colour}
        colour[v] = next(c for c in range(len(used) + 1) if c not in used)
    label = {v: v for v in near}

    def best(v):
        counts = Counter(label[w] for w in near[v])
        return {x for x, n in counts.items() if n == max(counts.values())}

    while not all(label[v] in best(v) for v in near):
        for c in range(max(colour.values()) + 1):
            for v in [v for v in near if colour[v] == c]:
                if label[v] not in best(v):
                    label[v] = max(best(v))
    return label


def test_same_labels_as_whole_rounds():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(2, 25)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 4 * n))]
        assert propagate(pairs) == whole_rounds(pairs)
