"""Signature trees over token sets, and the verified links between sets by their dual traversal."""

import numpy as np

from quillspark.llm.arrays import starts

FAN = 8
SMALL = 24  #: members of a group that are compared pair by pair


class TokenSets:
    """Sets of 64-bit tokens, each sorted, one after another."""

    def __init__(self, rows: np.ndarray, tokens: np.ndarray, count: int):
        self.at, self.tokens = starts(rows, count), tokens
        self.size = np.diff(self.at)

    def overlap(self, i: int, j: int) -> int:
        a, b = (self.tokens[self.at[k] : self.at[k + 1]] for k in (i, j))
        if len(a) > len(b):
            a, b = b, a
        place = np.searchsorted(b, a)
        place[place == len(b)] = 0
        return int((b[place] == a).sum()) if len(b) else 0

    def bitmaps(self) -> list[bytes]:
        return [bitmap(self.tokens[a:b]) for a, b in zip(self.at[:-1], self.at[1:])]


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, in at least twice as many bits (a power of two) as there are tokens."""
    width = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.zeros(width, bool)
    bits[tokens & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Signatures:
    """Sizes and bitmaps of items. Bitmaps of unlike width are compared in the smaller one: both halves of a bitmap, OR-combined, are the bitmap of half the width."""

    def __init__(self, size: np.ndarray, bitmaps: list[bytes], num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.width = np.array([len(x) for x in bitmaps], int)
        self.row = np.zeros(len(bitmaps), int)
        self.bits: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.bits[w, w] = np.frombuffer(b"".join(bitmaps[i] for i in own), np.uint64).reshape(len(own), -1)

    def at_width(self, own: int, width: int) -> np.ndarray:
        """The bitmaps of width `own`, folded to `width`."""
        if (own, width) not in self.bits:
            wide = self.at_width(own, 2 * width)
            half = wide.shape[1] // 2
            self.bits[own, width] = wide[:, :half] | wide[:, half:]
        return self.bits[own, width]

    def sizes_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.size[a], self.size[b]
        return (self.num * x <= self.den * y) & (self.num * y <= self.den * x)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pairs may be similar enough, by sizes and bitmaps."""
        out = self.sizes_fit(a, b)
        for wa in np.unique(self.width[a[out]]):
            for wb in np.unique(self.width[b[out]]):
                here = np.flatnonzero(out & (self.width[a] == wa) & (self.width[b] == wb))
                w = min(wa, wb)
                left, right = self.at_width(wa, w), self.at_width(wb, w)
                step = max(1, 4_000_000 // w)
                for s in range(0, len(here), step):
                    k = here[s : s + step]
                    x, y = left[self.row[a[k]]], right[self.row[b[k]]]
                    common = np.bitwise_count(x & y).sum(1, dtype=np.int64)
                    out[k] = possible(self.size[a[k]], self.size[b[k]], np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64), common, self.size[a[k]], self.size[b[k]], self.num, self.den)
        return out

    def pairs(self, left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (among left, or of left and right) that may be similar enough."""
        if max(len(left), 0 if right is None else len(right)) <= SMALL:
            i, j = np.triu_indices(len(left), 1) if right is None else (x.ravel() for x in np.indices((len(left), len(right))))
            a, b = left[i], (left if right is None else right)[j]
            keep = self.near(a, b)
            return a[keep], b[keep]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        other = left if right is None else right
        for wa in np.unique(self.width[left]):
            for wb in np.unique(self.width[other]):
                if right is None and wb < wa:
                    continue
                w = min(wa, wb)
                x = SignatureTree(self, left[self.width[left] == wa], w)
                y = None if right is None and wa == wb else SignatureTree(self, other[self.width[other] == wb], w)
                found.append(candidate_pairs(x, y, self.num, self.den))
        return tuple(np.concatenate(x) for x in zip(*found))


def possible(low_a, low_b, bits_a, bits_b, common, high_a, high_b, num: int, den: int) -> np.ndarray:
    """Whether the largest possible overlap is enough: a token of either side whose bit isn't common to both isn't shared, so at least as many tokens as such bits aren't."""
    most = np.minimum(high_a - np.maximum(0, bits_a - common), high_b - np.maximum(0, bits_b - common))
    return (most * (num + den) >= num * (low_a + low_b)) & (num * low_a <= den * high_b) & (num * low_b <= den * high_a)


class SignatureTree:
    """Level 0 has a node for each member, every FAN nodes of a level have one above them. A node holds the OR of its
    members' bitmaps, the range of their sizes and the fewest bits that a member sets."""

    def __init__(self, signatures: Signatures, members: np.ndarray, width: int):
        size = signatures.size[members]
        own = signatures.at_width(int(signatures.width[members[0]]), width)[signatures.row[members]]
        order = np.lexsort((own[:, 0], size))
        self.members, bits, size = members[order], own[order], size[order]
        self.levels = [(bits, size, size, np.bitwise_count(bits).sum(1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, few = self.levels[-1]
            cut = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.minimum.reduceat(few, cut)))

    def level(self, k: int) -> tuple[np.ndarray, ...]:
        return self.levels[min(k, len(self.levels) - 1)]


def candidate_pairs(a: SignatureTree, b: SignatureTree | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that the dual traversal of two trees (or of one with itself) can't rule out."""
    one = b is None
    b = b or a
    u, v = np.zeros(1, int), np.zeros(1, int)
    for k in range(max(len(a.levels), len(b.levels)) - 1, -1, -1):
        (bx, lx, hx, fx), (by, ly, hy, fy) = a.level(k), b.level(k)
        keep = np.zeros(len(u), bool)
        step = max(1, 500_000 // bx.shape[1])
        for s in range(0, len(u), step):
            i, j = u[s : s + step], v[s : s + step]
            common = np.bitwise_count(bx[i] & by[j]).sum(1, dtype=np.int64)
            keep[s : s + step] = possible(lx[i], ly[j], fx[i], fy[j], common, hx[i], hy[j], num, den)
        u, v = u[keep], v[keep]
        if not k or not len(u):
            break
        u, v = expand(u, v, len(a.levels) > k, len(b.levels) > k, len(a.level(k - 1)[0]), len(b.level(k - 1)[0]))
        if one:
            u, v = u[u <= v], v[u <= v]
    if one:
        u, v = u[u < v], v[u < v]
    return a.members[u], b.members[v]


def expand(u: np.ndarray, v: np.ndarray, down_u: bool, down_v: bool, count_u: int, count_v: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the pairs of nodes; a tree that ends above this level stays at its root."""
    fu, fv = (np.arange(FAN) if d else np.zeros(1, int) for d in (down_u, down_v))
    cu = (u[:, None] * (FAN if down_u else 1) + fu)[:, :, None] + np.zeros((1, 1, len(fv)), int)
    cv = (v[:, None] * (FAN if down_v else 1) + fv)[:, None, :] + np.zeros((1, len(fu), 1), int)
    cu, cv = cu.ravel(), cv.ravel()
    keep = (cu < count_u) & (cv < count_v)
    return cu[keep], cv[keep]


def verified_links(sets: TokenSets, signatures: Signatures, left: np.ndarray, right: np.ndarray | None, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of members with exact Jaccard similarity over the threshold that join two components.

    right: None compares the left members among each other. label: each set's component so far, changed in place; pairs
    within one component are passed over, as they link nothing new.
    """
    num, den = signatures.num, signatures.den
    a, b = signatures.pairs(left, right)
    out = []
    near = np.argsort(np.abs(sets.size[a] - sets.size[b]), kind="stable")
    a, b = a[near], b[near]
    for s in range(0, len(a), 1000):
        x, y = a[s : s + 1000], b[s : s + 1000]
        apart = label[x] != label[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            if label[i] == label[j]:
                continue
            both = sets.overlap(i, j)
            if den * both >= num * (sets.size[i] + sets.size[j] - both):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out
