"""A word lexicon as a minimal acyclic transducer in flat arrays.

Sorted words are added one by one and finished states are merged with equal ones (Daciuk and
others, 2000), so words share prefixes and suffixes. Each arc carries a number; the numbers along
a word's path add up to its place in the sorted list, which is the transducer's output and leads
to the word's ids. The arrays lie in one file that tasks map into memory, so that pages which the
walk does not touch need not stay there.
"""

from __future__ import annotations

import tempfile

import numpy as np

# Arrays of the file, in order, each as little-endian 64- or 32-bit integers.
FIELDS = ("arc_key", "arc_to", "arc_add", "final", "id_from", "ids")


class Builder:
    """Adds sorted words; ``arrays`` gives states numbered from 0, the start."""

    def __init__(self) -> None:
        self.arcs: list[dict[int, int]] = [{}]
        self.final = [False]
        self.register: dict[tuple, int] = {}
        self.path = [0]
        self.last = b""

    def add(self, word: bytes) -> None:
        if word <= self.last and self.last:
            raise ValueError("words must be sorted and distinct")
        common = 0
        while common < min(len(word), len(self.last)) and word[common] == self.last[common]:
            common += 1
        self._finish(common)
        for byte in word[common:]:
            self.arcs.append({})
            self.final.append(False)
            self.arcs[self.path[-1]][byte] = len(self.arcs) - 1
            self.path.append(len(self.arcs) - 1)
        self.final[self.path[-1]] = True
        self.last = word

    def _finish(self, depth: int) -> None:
        """Merge the states of the last word's path below ``depth`` with equal ones."""
        for i in range(len(self.path) - 1, depth, -1):
            state, parent = self.path[i], self.path[i - 1]
            form = (self.final[state], tuple(self.arcs[state].items()))
            same = self.register.setdefault(form, state)
            if same != state:
                self.arcs[parent][self.last[i - 1]] = same
                self.arcs[state] = {}
        del self.path[depth + 1 :]

    def arrays(self) -> dict[str, np.ndarray]:
        self._finish(0)
        order, number, below = [], {}, {}
        stack = [(0, False)]
        while stack:  # children before parents, without recursion
            state, ready = stack.pop()
            if ready:
                below[state] = self.final[state] + sum(below[t] for t in self.arcs[state].values())
                order.append(state)
            elif state not in below and state not in number:
                number[state] = -1
                stack.append((state, True))
                stack += [(t, False) for t in self.arcs[state].values() if t not in below]
        number = {state: i for i, state in enumerate(reversed(order))}
        keys, to, add, final = [], [], [], []
        for state in reversed(order):
            final.append(self.final[state])
            before = int(self.final[state])
            for byte, target in sorted(self.arcs[state].items()):
                keys.append(number[state] << 8 | byte)
                to.append(number[target])
                add.append(before)
                before += below[target]
        return {
            "arc_key": np.array(keys, "<i8"),
            "arc_to": np.array(to, "<i8"),
            "arc_add": np.array(add, "<i8"),
            "final": np.array(final, "<i8"),
        }


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """The file's bytes for words and their ids."""
    builder, encoded = Builder(), sorted((w.encode("utf-8"), ids) for w, ids in words.items() if w)
    for word, _ in encoded:
        builder.add(word)
    arrays = builder.arrays()
    arrays["id_from"] = np.cumsum([0, *(len(ids) for _, ids in encoded)]).astype("<i8")
    arrays["ids"] = np.array([i for _, ids in encoded for i in ids], "<i4")
    sizes = np.array([len(arrays[name]) for name in FIELDS], "<i8")
    return b"".join([sizes.tobytes(), *(arrays[name].tobytes() for name in FIELDS)])


def mapped(data: bytes) -> np.ndarray:
    """The bytes as a read-only memory map of a file in the task's temporary folder.

    The file's name goes at once and its pages with the map, so that nothing stays behind, even
    if the worker is killed.
    """
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        return np.asarray(np.memmap(file, np.uint8, "r"))


class Lexicon:
    """The transducer over a memory-mapped file."""

    def __init__(self, data: bytes) -> None:
        raw = mapped(data)
        at = 8 * len(FIELDS)
        for name, n in zip(FIELDS, raw[:at].view("<i8"), strict=True):
            width = 4 if name == "ids" else 8
            setattr(self, name, raw[at : at + width * int(n)].view(f"<i{width}"))
            at += width * int(n)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the sorted list, -1 for a word that is not in it.

        All words walk through the transducer together, a byte at a step.
        """
        n = len(words)
        place = np.full(n, -1, np.int64)
        if not n or not len(self.arc_key):
            return place
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(lengths > 0)
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | flat[starts[live] + step]
            arc = np.searchsorted(self.arc_key, key)
            arc[arc == len(self.arc_key)] = 0
            found = self.arc_key[arc] == key
            live, arc = live[found], arc[found]
            state, total = self.arc_to[arc], total[found] + self.arc_add[arc]
            step += 1
            ended = lengths[live] == step
            accepted = ended & (self.final[state] == 1)
            place[live[accepted]] = total[accepted]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return place
