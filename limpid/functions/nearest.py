"""The most similar of many texts for each of many others, by a tree of their letters.

Texts of the right side are filed in a tree, a letter a level. A left text goes down it with its row of edits, so texts that
begin alike share that work. The row bounds the edits to all texts below a node, and the letters on the way there that the
left text lacks bound those that can match; together they bound the score. Nodes that can't hold a better text are left out:
what is looked at grows with what is near, not with the number of texts. A narrow search finds good texts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from limpid.functions.fuzzy import codes, jaro_coded, score_by

#: Letters of a text that the tree takes at most; left texts that go together; pairs of a text and a node held at once, by
#: level; nodes kept for each text by the narrow search.
DEEP, TOGETHER, PAIRS, NARROW = 64, 1024, 1 << 16, 8


@dataclass(frozen=True)
class Level:
    """The nodes of a level: their letter and how often it came on the way there, the least and greatest length of the texts
    below and the least number of one, the text that ends there (-1: none), and their children, which follow each other."""

    letter: np.ndarray
    times: np.ndarray
    least: np.ndarray
    most: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    child: np.ndarray
    children: np.ndarray


def tree(own: np.ndarray, size: np.ndarray, order: np.ndarray) -> list[Level]:
    """Levels from 0 on, of texts as rows of letters' numbers; order: their rows, sorted by text."""
    s, n = own[order], size[order]
    at = np.arange(s.shape[1])
    alike = (s[1:] == s[:-1]) & (at < np.minimum(n[1:], n[:-1])[:, None])
    common = np.r_[-1, np.cumprod(alike, axis=1).sum(1)]
    levels, starts = [], [np.flatnonzero((n >= d) & (common < d)) for d in range(s.shape[1] + 1)] + [np.array([], np.int64)]
    starts[0] = np.array([0])
    for d in range(s.shape[1] + 1):
        rows = np.flatnonzero(n >= d)
        begin = starts[d]
        if not len(begin):
            break
        cut = np.searchsorted(rows, begin)
        reduced = lambda f, x: f.reduceat(x[rows], cut)  # noqa: B023, E731
        deeper = np.searchsorted(begin, starts[d + 1], side="right") - 1
        children = np.bincount(deeper, minlength=len(begin))
        letter = s[begin, d - 1] if d else np.zeros(1, s.dtype)
        times = (s[begin, :d] == letter[:, None]).sum(1) if d else np.zeros(1, np.int64)
        levels.append(Level(letter, times, reduced(np.minimum, n), reduced(np.maximum, n), reduced(np.minimum, order), np.where(n[begin] == d, order[begin], -1), np.cumsum(children) - children, children))
    return levels


def _ranked(i: np.ndarray, by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """An order by i and then by the others, the first of them last, and each one's place among those of equal i."""
    order = np.lexsort((*by, i))
    return order, np.arange(len(i)) - np.searchsorted(i[order], i[order])


class _Lefts:
    """Left texts of similar lengths on their way through a tree, and the best that they found."""

    def __init__(self, p, x, mine, counts, q, y, levels, best, where):
        self.p, self.x, self.mine, self.counts, self.q, self.y, self.levels = p, x, mine, counts, q, y, levels
        self.best, self.where, self.scored = best, where, np.zeros(len(x), np.int64)
        # Letters of each text, and how many are left after so many: a column a text, so that steps go along rows.
        rest = (x - np.arange(mine.shape[1] + 1)[:, None]).astype(np.int16)
        self.across, self.rest, self.off = np.ascontiguousarray(mine.T), rest, np.where(rest < 0, 127, 0).astype(np.int16)

    def may(self, i, u, j) -> np.ndarray:
        return (u > self.best[i]) | (u == self.best[i]) & (j < self.where[i])

    def begin(self):
        n = len(self.x)
        rows = np.repeat(np.arange(self.mine.shape[1] + 1, dtype=np.int8)[:, None], n, axis=1)
        return np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), rows

    def down(self, d, i, v, lacks, same, rows):
        """The children of nodes v of a level that may hold something better, with their bounds; texts that end there are
        scored."""
        up, level = self.levels[d], self.levels[d + 1]
        n = up.children[v]
        k = np.repeat(np.arange(len(v)), n)
        v = up.child[v][k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        i, old, letter = i[k], rows.take(k, axis=1), level.letter[v]
        new = np.empty_like(old)
        new[0] = d + 1
        np.minimum(old[1:] + np.int8(1), old[:-1] + (self.across.take(i, axis=1) != letter), out=new[1:])
        for c in range(1, len(new)):  # insertions from the left
            np.minimum(new[c], new[c - 1] + np.int8(1), out=new[c])
        lacks = lacks[k] + (level.times[v] > self.counts[i, letter])
        same = same[k]
        if d < 4:
            same = same + ((same == d) & (self.x[i] > d) & (self.mine[i, min(d, self.mine.shape[1] - 1)] == letter))
        x, least, most = self.x[i], level.least[v], level.most[v]
        rest = self.rest.take(i, axis=1)
        gap = np.maximum(rest - (most - d - 1).astype(np.int16), (least - d - 1).astype(np.int16) - rest)
        np.maximum(gap, self.off.take(i, axis=1), out=gap)
        gap += new
        edits = gap.min(0)
        u = self.bound(x, least, most, edits, lacks, np.where(same > d, 4, same))
        j = level.ends[v]
        last = np.flatnonzero(j >= 0)
        if len(last):
            e = new[x[last], last].astype(np.int64)
            y = np.full(len(last), d + 1)
            self.score(i[last], j[last], e, self.bound(x[last], y, y, e, lacks[last], same[last]))
        on = np.flatnonzero((level.children[v] > 0) & self.may(i, u, level.first[v]))
        return (i[on], v[on], lacks[on], same[on], new.take(on, axis=1)), u[on]

    @staticmethod
    def bound(x, least, most, edits, lacks, same) -> np.ndarray:
        m = np.minimum(x, np.maximum(most - lacks, 0))
        j = np.where(m > 0, (m / x + np.minimum(np.minimum((most - lacks) / most, x / least), 1) + 1) / 3, 0.0)
        return score_by(j + 0.1 * same * (1 - j) + 1e-11, edits, np.maximum(x, most))

    def score(self, i, j, edits, u) -> None:
        """Scores pairs from a text's highest bound on, as long as they may be better."""
        keep = np.flatnonzero(self.may(i, u, j))
        if not len(keep):
            return
        order, place = _ranked(i[keep], (j[keep], -u[keep]))
        keep, lo, step = keep[order], 0, 1
        while len(keep):
            now, later = keep[place < lo + step], place >= lo + step
            now = now[self.may(i[now], u[now], j[now])]
            a, b = i[now], j[now]
            s = score_by(jaro_coded(self.p[a], self.q[b], self.x[a], self.y[b], True), edits[now], np.maximum(self.x[a], self.y[b]))
            np.add.at(self.scored, a, 1)
            top, rank = _ranked(a, (b, -s))
            top = top[rank == 0]
            top = top[self.may(a[top], s[top], b[top])]
            self.best[a[top]], self.where[a[top]] = s[top], b[top]
            keep, place = keep[later], place[later]
            on = self.may(i[keep], u[keep], j[keep])
            keep, place, lo, step = keep[on], place[on], lo + step, 2 * step

    def run(self) -> None:
        pairs, d = self.begin(), 0
        while d + 1 < len(self.levels) and len(pairs[0]):
            pairs, u = self.down(d, *pairs)
            order, place = _ranked(pairs[0], (self.levels[d + 1].first[pairs[1]], -u))
            pairs, d = tuple(x[..., order[place < NARROW]] for x in pairs), d + 1
        stack = [(0, self.begin())]
        while stack:
            d, pairs = stack.pop()
            if d + 1 >= len(self.levels) or not len(pairs[0]):
                continue
            if d:  # what was found since may rule more out
                n = self.levels[d].children[pairs[1]]
                if n.sum() > PAIRS and len(n) > 1:
                    cut = min(max(1, int(np.searchsorted(np.cumsum(n), PAIRS))), len(n) - 1)
                    stack.append((d, tuple(x[..., cut:] for x in pairs)))
                    pairs = tuple(x[..., :cut] for x in pairs)
            stack.append((d + 1, self.down(d, *pairs)[0]))


def nearest(a: list[str], b: list[str], over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a: the best score over `over`, the number in b of the first text that has it (-1: none), and how many
    pairs were scored. All texts have 1 to DEEP letters, those of b are all different."""
    x, y = np.array([len(v) for v in a]), np.array([len(v) for v in b])
    q = codes(b, int(y.max()))
    letters = np.unique(q[np.arange(q.shape[1]) < y[:, None]])
    kind = np.int16 if len(letters) < 1 << 15 else np.int32
    levels = tree(np.searchsorted(letters, q).astype(kind), y, np.array(sorted(range(len(b)), key=b.__getitem__)))
    best, where, scored = over.astype(np.int64), np.full(len(a), -1), np.zeros(len(a), np.int64)
    order = np.argsort(x, kind="stable")
    for lo in range(0, len(a), TOGETHER):
        own = order[lo : lo + TOGETHER]
        p = codes([a[k] for k in own.tolist()], int(x[own].max()))
        mine = np.minimum(np.searchsorted(letters, p), len(letters) - 1).astype(kind)
        mine[(letters[mine] != p) | (np.arange(p.shape[1]) >= x[own, None])] = -1
        counts = np.zeros((len(own), len(letters)), np.int8)
        k, c = np.nonzero(mine >= 0)
        np.add.at(counts, (k, mine[k, c]), 1)
        some = _Lefts(p, x[own], mine, counts, q, y, levels, best[own], where[own])
        some.run()
        best[own], where[own], scored[own] = some.best, some.where, some.scored
    return best, where, scored
