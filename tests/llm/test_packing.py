"""The packer against a plain version of its rule, with all three limits at work."""

import random

import numpy as np

from watchloom.llm.vector_packing import Packer, first_lines


def _plain(examples, capacity, segments, max_loss, pool, min_piece):
    """Pieces (example, start, length, loss) by the rule as stated: the largest dot product that fits, else the piece of which most fits, cut."""
    slots = [None] * (2 * pool + 64)
    free, done = list(range(len(slots))), []
    loss = lambda e, at, n: max(0, at + n - max(at, examples[e][1]))

    def sequence():
        left, out = [capacity, segments, max_loss], []
        while left[0] and left[1] and any(slots):
            best = None
            for i, p in enumerate(slots):
                if p and p[2] <= left[0] and loss(*p) <= left[2]:
                    dot = sum(d * r / m / m for d, r, m in zip((p[2], 1, loss(*p)), left, (capacity, segments, max_loss)))
                    if best is None or dot > best[0] + 1e-12:
                        best = (dot, i, p[2])
            if best is None and left[0] >= min_piece:
                for i, p in enumerate(slots):
                    n = min(p[2], left[0], p[2] - loss(*p) + left[2]) if p else 0
                    if best is None or n > best[2]:
                        best = (0, i, n)
                if best[2] < min_piece or best[2] == slots[best[1]][2]:
                    break
            if best is None:
                break
            _, i, n = best
            (e, at, size), slots[i] = slots[i], None
            free.append(i)
            if n < size:
                slots[free.pop()] = (e, at + n, size - n)
            left = [left[0] - n, left[1] - 1, left[2] - loss(e, at, n)]
            out.append((e, at, n, loss(e, at, n)))
        done.append(out)

    held = lambda: sum(p is not None for p in slots)
    for e, (n, _) in enumerate(examples):
        at = 0
        while at < n:
            size = min(n - at, capacity, max_loss)
            if size == capacity:
                done.append([(e, at, size, loss(e, at, size))])
            else:
                slots[free.pop()] = (e, at, size)
                if held() > 2 * pool:
                    while held() > pool:
                        sequence()
            at += size
    while held():
        sequence()
    return done


def test_packer_equals_a_plain_version():
    rnd = random.Random(6)
    bound = set()
    for limits in ((100, 4, 80), (100, 2, 100), (64, 3, 40)):
        examples = []
        for _ in range(120):
            n = rnd.choice([1, 5, 20, 60, 99, 100, 250])
            examples.append((n, rnd.choice([0, 0, 3, 30, n])))
        packer = Packer(*limits, pool=10, min_piece=4)
        got = [s for e, (n, prompt) in enumerate(examples) for s in packer.add((e, prompt), np.arange(n), prompt)] + list(packer.rest())
        mine = [[(e, at, len(ids), max(0, at + len(ids) - max(at, p))) for (e, p), at, ids, _ in s] for s in got]
        assert mine == _plain(examples, *limits, 10, 4)
        for s in mine:
            assert sum(p[2] for p in s) <= limits[0] and len(s) <= limits[1] and sum(p[3] for p in s) <= limits[2]
            bound |= {name for name, at, most in (("tokens", sum(p[2] for p in s), limits[0]), ("segments", len(s), limits[1]), ("loss", sum(p[3] for p in s), limits[2])) if at == most}
    assert bound == {"tokens", "segments", "loss"}


def test_first_lines():
    assert [first_lines(t, 1) for t in ("a", "a\n", "a\nb", "\nb", "")] == ["", "", "a\n", "\n", ""]
    assert first_lines("a\nb\nc", 2) == "a\nb\n" and first_lines("a\nb", 0) == ""
