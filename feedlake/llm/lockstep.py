"""Viterbi search over many short stretches at once, one character of all of them a step.

Only for models whose pieces join by merges: behind each boundary one piece is left. The stretches lie side by side, sorted
by falling length. An automaton over all pieces gives the longest piece that ends at the character; while it may not
follow the piece before it, the next shorter one is tried. A character without a piece stands alone, as its bytes. Whether one piece may follow another is remembered in a table of
fixed size, where a newer pair takes an older one's place and the older one is worked out again when it is met.
"""

from __future__ import annotations

import numpy as np

#: Slots of the table of pairs (8 bytes each) and cells, characters by stretches, searched at once: limits on memory only.
PAIRS, CELLS = 1 << 20, 1 << 20
CODE_POINTS = 0x110000


class Lockstep:
    """Tables of a model: ``goto`` node by character, ``ending`` the longest piece that ends in a node, ``shorter`` the next one."""

    def __init__(self, model):
        pieces = sorted(model.usable)
        index = {p: k for k, p in enumerate(pieces)}
        #: Two numbers behind those of the pieces: the start of a stretch, and a character without a piece.
        self.model, self.pieces, self.start, self.alien = model, pieces, len(pieces), len(pieces) + 1
        self.ids = np.array([model.pieces[p][0] for p in pieces] + [0, 0], np.int32)
        self.sizes = np.array([len(p) for p in pieces] + [0, 1], np.int32)
        alphabet = sorted(set().union(*(p for p in pieces if len(p) > 1)))
        prefixes = sorted({p[:k] for p in pieces if len(p) > 1 for k in range(len(p) + 1)} | {"", *alphabet}, key=lambda p: (len(p), p))
        node = {p: k for k, p in enumerate(prefixes)}
        # Class 0: characters that are in no longer piece, so that nothing goes on behind them.
        self.classes = np.zeros(CODE_POINTS, np.int32)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.single = np.full(CODE_POINTS, self.alien, np.int32)
        self.single[[ord(p) for p in pieces if len(p) == 1]] = [k for k, p in enumerate(pieces) if len(p) == 1]
        self.goto = np.zeros((len(prefixes), len(alphabet) + 1), np.uint16 if len(prefixes) < 65536 else np.int32)
        self.ending, fail = np.full(len(prefixes), -1, np.int32), np.zeros(len(prefixes), np.int32)
        for size in range(1, max(map(len, prefixes)) + 1):
            level = [p for p in prefixes if len(p) == size]
            at, parent = np.array([node[p] for p in level]), np.array([node[p[:-1]] for p in level])
            by = self.classes[[ord(p[-1]) for p in level]]
            if size > 1:
                fail[at] = self.goto[fail[parent], by]
            self.goto[parent, by] = at
            own = np.array([index.get(p, -1) for p in level])
            shorter = self.ending[fail[at]] if size > 1 else self.single[[ord(p) for p in level]]
            self.ending[at] = np.where(own < 0, shorter, own)
            # A row is that of the node's longest suffix; the next level puts the node's own children over it.
            self.goto[at] = self.goto[fail[at]]
        self.shorter = np.array([self.ending[fail[node[p]]] if len(p) > 1 else -1 for p in pieces], np.int32)
        self.pairs = np.full(PAIRS, -1, np.int64)

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) * (self.alien + 1) + piece
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (PAIRS.bit_length() - 1))).astype(np.int64)
        found = self.pairs[slots]
        new = np.flatnonzero(found >> 1 != keys)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            pairs = zip(*(x.tolist() for x in np.divmod(fresh, self.alien + 1)))
            fits = [max(a, b) >= self.start or self.model.follows(self.pieces[a], self.pieces[b]) for a, b in pairs]
            found[new] = (fresh * 2 + np.array(fits, np.int64))[back]
            self.pairs[slots[new]] = found[new]
        return (found & 1).astype(bool)

    def encode(self, parts: list[str]) -> dict[str, np.ndarray]:
        """Ids of each stretch."""
        out, begin = {}, 0
        parts = sorted(filter(None, parts), key=len, reverse=True)
        while begin < len(parts):
            end = begin + max(1, CELLS // len(parts[begin]))
            out.update(self._search(parts[begin:end]))
            begin = end
        return out

    def _search(self, parts: list[str]) -> dict[str, np.ndarray]:
        sizes = np.array([len(p) for p in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        n, longest = len(parts), int(sizes[0])
        lane = np.repeat(np.arange(n), sizes)
        at = np.arange(len(codes)) - starts[lane]
        grid = np.zeros((longest, n), np.uint32)
        grid[at, lane] = codes
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        last = np.empty((longest + 1, n), np.int32)
        last[0] = self.start
        state, lanes = np.zeros(n, self.goto.dtype), np.arange(n)
        for p in range(longest):
            k = active[p]
            by = self.classes[grid[p, :k]]
            state = self.goto[state[:k], by]
            piece = self.ending[state]
            alone = np.flatnonzero(by == 0)
            piece[alone] = self.single[grid[p, alone]]
            todo = lanes[:k]
            while len(todo):
                some = piece[todo]
                fits = self._fits(last[p + 1 - self.sizes[some], todo], some)
                todo = todo[~fits]
                piece[todo] = self.shorter[piece[todo]]
            last[p + 1, :k] = piece
        # All paths meet at the end of a stretch: back from there, the boundaries on the way.
        way, back, todo = np.zeros((longest + 1, n), bool), sizes.copy(), lanes
        while len(todo):
            way[back[todo], todo] = True
            back[todo] -= self.sizes[last[back[todo], todo]]
            todo = todo[back[todo] > 0]
        who, where = np.nonzero(way.T)
        pieces = last[where, who]
        ids = self.ids[pieces]
        alien = np.flatnonzero(pieces == self.alien)
        if len(alien):
            own = [self.model.alone(chr(c)) for c in grid[where[alien] - 1, who[alien]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[alien] = [len(x) for x in own]
            place = np.repeat(pieces == self.alien, times)
            ids, who = np.repeat(ids, times), np.repeat(who, times)
            ids[place] = np.concatenate(own)
        cuts = np.searchsorted(who, np.arange(n + 1)).tolist()
        return {p: ids[a:b] for p, a, b in zip(parts, cuts, cuts[1:])}
