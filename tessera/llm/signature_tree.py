"""Signature trees over token sets: nodes with OR-combined bitmaps and size ranges, joined by dual traversal.

A leaf holds a set's bitmap (one bit a token, by hash) and size. A node holds the OR of its children's bitmaps, the
range of their sizes and the most tokens of a leaf that fell on a bit already set. For sets A below X and B below Y the
overlap is at most the bits common to both bitmaps plus the smaller of those surpluses; a pair of nodes is pruned when
that, or the size ranges, cannot reach the overlap a link needs.
"""

FANOUT = 8


class Links:
    """Union-find over the sets of a join; only links that connect something new are kept."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.kept.append((i, j))


class Node:
    __slots__ = ("children", "high", "leaves", "low", "mask", "surplus")

    def __init__(self, children, leaves, mask, low, high, surplus):
        self.children, self.leaves, self.mask, self.low, self.high, self.surplus = children, leaves, mask, low, high, surplus


def _bits(sizes) -> int:
    """Bits of a bitmap: four for each token of the middling set, from 256 to 16,384."""
    middle = sorted(sizes)[len(sizes) // 2]
    return 1 << min(14, max(8, (4 * middle - 1).bit_length()))


def build(sets, members: list[int], bits: int) -> Node:
    """A tree over the sets of the given numbers; sets alike by size and least tokens stand side by side."""
    import numpy as np

    leaves = []
    for i in sorted(members, key=lambda i: (len(sets[i]).bit_length(), tuple(sets[i][:3].tolist()))):
        row = np.zeros(bits, np.uint8)
        row[(sets[i] & np.uint64(bits - 1)).astype(np.int64)] = 1
        mask = int.from_bytes(np.packbits(row).tobytes(), "big")
        n = len(sets[i])
        leaves.append(Node(None, [i], mask, n, n, n - mask.bit_count()))
    level = leaves
    while len(level) > 1:
        above = []
        for at in range(0, len(level), FANOUT):
            part = level[at : at + FANOUT]
            mask = 0
            for x in part:
                mask |= x.mask
            above.append(Node(part, [i for x in part for i in x.leaves], mask, min(x.low for x in part), max(x.high for x in part), max(x.surplus for x in part)))
        level = above
    return level[0]


def _hopeless(x: Node, y: Node, percent: int) -> bool:
    """Whether no set below x can link with one below y."""
    if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
        return True
    most = (x.mask & y.mask).bit_count() + min(x.surplus, y.surplus)
    # 100 * overlap >= percent * union, with union = sizes - overlap
    return (100 + percent) * most < percent * (x.low + y.low)


def linked(a, b, percent: int) -> bool:
    """Exactly: 100 * |a & b| >= percent * |a | b|, of sorted distinct tokens."""
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def join(sets, left: list[int], right: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links that span the components among the sets of left, or between left and right if given."""
    links = Links(len(sets))
    if not left or right is not None and not right:
        return []
    bits = _bits([len(sets[i]) for i in [*left, *(right or [])]])
    x = build(sets, left, bits)
    work = [(x, x if right is None else build(sets, right, bits))]
    while work:
        x, y = work.pop()
        if x is y:
            if x.children:  # what is alike is joined first, so that other pairs often need no look
                work += [(a, b) for i, a in enumerate(x.children) for b in x.children[i + 1 :]]
                work += [(a, a) for a in x.children]
            continue
        if _hopeless(x, y, percent):
            continue
        if not x.children and not y.children:
            i, j = x.leaves[0], y.leaves[0]
            if links.root(i) != links.root(j):
                gone = (x.mask & ~y.mask).bit_count(), (y.mask & ~x.mask).bit_count()
                most = min(x.low - gone[0], y.low - gone[1])
                if (100 + percent) * most >= percent * (x.low + y.low) and linked(sets[i], sets[j], percent):
                    links.join(i, j)
            continue
        root = links.root(x.leaves[0])
        if all(links.root(i) == root for i in x.leaves) and all(links.root(j) == root for j in y.leaves):
            continue  # one component already
        if not y.children or x.children and len(x.leaves) >= len(y.leaves):
            work += [(a, y) for a in x.children]
        else:
            work += [(x, b) for b in y.children]
    return links.kept
