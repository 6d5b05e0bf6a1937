"""Many markers at once: an automaton for whole-word matches, a gram index for near ones.

Both are flat arrays of the size of the markers and go to the tasks with the function, so the
plan does not grow with the number of markers. A task runs them over whole Arrow batches.
"""

from __future__ import annotations

import numpy as np

from folioline.functions.sequences import block_ratios

#: Words of a text that one lane of the automaton reads; longer texts are cut, with overlap.
LANE_WORDS = 2048
#: Distinct windows of words looked at together.
WINDOWS = 1 << 14
#: Values that have bits of their own, and cells of (window, marker) looked at together.
KINDS, CELLS = 64, 1 << 17
#: Words of texts whose windows are held at a time, and whole texts at least.
TEXT_WORDS = 1 << 18


class WordAutomaton:
    """An Aho-Corasick automaton over words.

    ``first`` tells of each text the smallest number of a marker that it holds as whole words.
    """

    def __init__(self, markers: list[str]):
        self.vocabulary: dict[str, int] = {}
        edges: list[dict[int, int]] = [{}]
        depth, first = [0], [len(markers)]
        for number, marker in enumerate(markers):
            state = 0
            for word in marker.split(" "):
                code = self.vocabulary.setdefault(word, len(self.vocabulary))
                if code not in edges[state]:
                    edges[state][code] = len(edges)
                    edges.append({})
                    depth.append(depth[state] + 1)
                    first.append(len(markers))
                state = edges[state][code]
            first[state] = min(first[state], number)
        # Breadth first: where to go on without the first words, and what ends there.
        fail, queue = [0] * len(edges), list(edges[0].values())
        for state in queue:
            first[state] = min(first[state], first[fail[state]])
            for code, below in edges[state].items():
                back = fail[state]
                while back and code not in edges[back]:
                    back = fail[back]
                fail[below] = edges[back].get(code, 0)
                queue.append(below)
        self.none, self.longest = len(markers), max(depth)
        self.words = max(1, len(self.vocabulary))
        flat = sorted((s * self.words + c, t) for s, own in enumerate(edges) for c, t in own.items())
        self.keys, self.targets = (np.array(x, dtype=np.int64) for x in (zip(*flat, strict=True) if flat else ((), ())))
        self.fail, self.found = np.array(fail), np.array(first)

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        after = np.zeros_like(state)
        # Lanes that still look for an edge; without one in the root they stay there.
        lanes = np.flatnonzero(code >= 0)
        state = state[lanes]
        while lanes.size:
            key = state * self.words + code[lanes]
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            hit = self.keys[at] == key
            after[lanes[hit]] = self.targets[at[hit]]
            back = ~hit & (state > 0)
            lanes, state = lanes[back], self.fail[state[back]]
        return after

    def first(self, texts: list[str]) -> np.ndarray:
        """For texts of words with one space between; the number of markers where there is none."""
        found = np.full(len(texts), self.none, dtype=np.int64)
        if not self.keys.size:
            return found
        lanes, owner, overlap = [], [], self.longest - 1
        for row, text in enumerate(texts):
            if text:
                codes = np.array([self.vocabulary.get(w, -1) for w in text.split(" ")], dtype=np.int64)
                for at in range(0, max(1, codes.size - overlap), LANE_WORDS):
                    lanes.append(codes[at : at + LANE_WORDS + overlap])
                    owner.append(row)
        order = np.argsort([-lane.size for lane in lanes], kind="stable")
        lanes, owner = [lanes[i] for i in order], np.array(owner, dtype=np.int64)[order]
        lengths = np.array([lane.size for lane in lanes], dtype=np.int64)
        state, best = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), self.none, dtype=np.int64)
        table = np.full((int(lengths.max(initial=0)), len(lanes)), -1, dtype=np.int64)
        for number, lane in enumerate(lanes):
            table[: lane.size, number] = lane
        for step in range(table.shape[0]):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            state[:live] = self._step(state[:live], table[step, :live])
            np.minimum(best[:live], self.found[state[:live]], out=best[:live])
        np.minimum.at(found, owner, best)
        return found


class _Shared:
    """How many values two texts have in common, each as often as both have it.

    A text is a row of bits, one for each value of the markers and number of times up to which a
    marker has it, so that common bits are common values. Beyond the most frequent ``KINDS`` values
    the others count as one, which can only raise the number.
    """

    def __init__(self, owner: np.ndarray, values: np.ndarray, rows: int):
        self.kinds, seen = np.unique(values, return_counts=True)
        place = np.empty(self.kinds.size, dtype=np.int64)
        place[np.argsort(-seen, kind="stable")] = np.arange(self.kinds.size)
        self.place = np.minimum(place, KINDS - 1)
        self.width = max(1, min(self.kinds.size, KINDS))
        counts = self._counts(owner, values, rows)
        most = counts.max(axis=0, initial=0)
        self.column = np.repeat(np.arange(self.width), most)
        self.times = 1 + np.arange(self.column.size) - np.repeat(np.cumsum(most) - most, most)
        self.bits = self._packed(counts)

    def _counts(self, owner: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        if not self.kinds.size:
            return np.zeros((rows, self.width), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.kinds, values), self.kinds.size - 1)
        known = self.kinds[at] == values
        cells = owner[known] * self.width + self.place[at[known]]
        return np.bincount(cells, minlength=rows * self.width).reshape(rows, self.width)

    def _packed(self, counts: np.ndarray) -> np.ndarray:
        flags = np.zeros((counts.shape[0], max(1, -(-self.column.size // 64)) * 64), dtype=bool)
        flags[:, : self.column.size] = counts[:, self.column] >= self.times
        return np.packbits(flags, axis=1).view(np.uint64)

    def of(self, owner: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        """The bits of texts."""
        return self._packed(self._counts(owner, values, rows))


class GramIndex:
    """Markers by their characters and their pairs of neighbouring characters, as bits.

    With ratio 2 m / (la + lb) >= t, m characters are common. They lie in at most la + lb - 2 m + 1
    blocks, so at least 3 m - la - lb - 1 pairs of neighbours are common. Windows are held against
    all markers by common characters, those that are left by common pairs, and the rest is compared.
    """

    def __init__(self, markers: list[str], threshold: float):
        self.markers, self.threshold = markers, threshold
        self.length = np.array([len(m) for m in markers], dtype=np.int64)
        self.words = np.array([m.count(" ") + 1 for m in markers], dtype=np.int64)
        self.low = np.floor(self.length * threshold / (2 - threshold)).astype(np.int64)
        self.high = np.ceil(self.length * (2 - threshold) / threshold).astype(np.int64)
        self.need = threshold / 2 - 1e-9
        self.letters = _Shared(*_characters(markers), len(markers))
        self.pairs = _Shared(*_neighbours(markers), len(markers))

    def _candidates(self, windows: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, marker) that can reach the threshold."""
        size = np.array([len(w) for w in windows], dtype=np.int64)
        bits = self.letters.of(*_characters(windows), len(windows))
        markers = np.flatnonzero(self.words == words)
        # Windows of like lengths together: they meet the markers of like lengths only.
        order = np.argsort(size, kind="stable")
        step = max(1, CELLS // max(1, markers.size))
        found = [(order[:0], markers[:0])]
        for at in range(0, order.size, step):
            rows = order[at : at + step]
            near = markers[(self.low[markers] <= size[rows[-1]]) & (self.high[markers] >= size[rows[0]])]
            if not near.size:
                continue
            both = size[rows][:, None] + self.length[near][None, :]
            wanted = np.ceil(self.need * np.arange(int(both.max()) + 1)).astype(np.int32)
            common = np.zeros(both.shape, dtype=np.int32)
            for own, other in zip(bits[rows].T, self.letters.bits[near].T, strict=True):
                common += np.bitwise_count(own[:, None] & other[None, :])
            row, marker = np.nonzero(common >= wanted[both])
            found.append((rows[row], near[marker]))
        window, marker = (np.concatenate(x) for x in zip(*found, strict=True))
        seen, at = np.unique(window, return_inverse=True)
        bits = self.pairs.of(*_neighbours([windows[w] for w in seen]), seen.size)
        pairs = np.bitwise_count(bits[at] & self.pairs.bits[marker]).sum(axis=1, dtype=np.int64)
        both = size[window] + self.length[marker]
        keep = pairs >= 3 * np.ceil(self.need * both) - both - 1
        return window[keep], marker[keep]

    def best(self, texts: list[str | None]) -> list[tuple[int | None, float]]:
        """The marker of the highest ratio from the threshold up, the earliest of equal ones; null
        texts are not looked at."""
        top: list[tuple[int | None, float]] = [(None, 0.0)] * len(texts)
        held = np.cumsum([text.count(" ") + 1 if text else 0 for text in texts]) // TEXT_WORDS
        for part in np.unique(held):
            rows = np.flatnonzero(held == part).tolist()
            for row, best in zip(rows, self._best([texts[row] for row in rows]), strict=True):
                top[row] = best
        return top

    def _best(self, texts: list[str | None]) -> list[tuple[int | None, float]]:
        top: list[tuple[int | None, float]] = [(None, 0.0)] * len(texts)
        for words in np.unique(self.words).tolist():
            number: dict[str, int] = {}
            owners: list[int] = []
            places: list[int] = []
            for row, text in enumerate(texts):
                if not text:
                    continue
                split = text.split(" ")
                for window in {" ".join(split[i : i + words]) for i in range(len(split) - words + 1)}:
                    owners.append(row)
                    places.append(number.setdefault(window, len(number)))
            windows = list(number)
            ratio, order = np.zeros(len(windows)), np.full(len(windows), -1, dtype=np.int64)
            for at in range(0, len(windows), WINDOWS):
                part = windows[at : at + WINDOWS]
                window, marker = self._candidates(part, words)
                found = block_ratios([self.markers[m] for m in marker], [part[w] for w in window])
                # Written from the worst to the best, the earlier of equal ones last.
                rank = np.lexsort((-marker, found))
                ratio[at + window[rank]], order[at + window[rank]] = found[rank], marker[rank]
            for row, place in zip(owners, places, strict=True):
                own, value = int(order[place]), float(ratio[place])
                if value >= self.threshold and (value > top[row][1] or (value == top[row][1] and own < top[row][0])):
                    top[row] = (own, value)
        return top


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every character."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return np.repeat(np.arange(len(texts)), lengths), codes.astype(np.int64)


def _neighbours(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, pair) of every two neighbouring characters."""
    owner, codes = _characters(texts)
    same = owner[1:] == owner[:-1]
    return owner[1:][same], ((codes[:-1] << 21) | codes[1:])[same]
