"""Minimal acyclic transducers from sorted words to their ordinals.

Words come in byte order.  States behind the last shared prefix are final as soon as the next word
is known; a state that equals an earlier one is replaced by it, so the automaton is minimal at
every step.  Every arc carries the number of words that come before those behind it; the sum along
a word's path is its place in the order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Transducer:
    """Arcs sorted by (state, byte), each with its target and its addend; state 0 is the root."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, addends: np.ndarray, final: np.ndarray):
        self.keys, self.targets, self.addends, self.final = keys, targets, addends, final

    @classmethod
    def build(cls, words: Sequence[bytes]) -> Transducer:
        """From distinct words in byte order; others are an error."""
        register: dict[tuple, int] = {}
        done: list[tuple] = []  # (is a word's end, bytes, targets) of finished states

        # the unfinished path: per state whether a word ends there, its bytes and its targets
        path: list[list] = [[False, [], []]]

        def finish(depth: int) -> None:
            while len(path) > depth:
                end, labels, targets = path.pop()
                state = (end, bytes(labels), tuple(targets))
                number = register.get(state)
                if number is None:
                    number = register[state] = len(done)
                    done.append(state)
                if path:
                    path[-1][2].append(number)

        before = None
        for word in words:
            if before is not None and word <= before:
                raise ValueError("words must be distinct and in byte order")
            shared = 0
            if before is not None:
                most = min(len(word), len(before))
                while shared < most and word[shared] == before[shared]:
                    shared += 1
            finish(shared + 1)
            for byte in word[shared:]:
                path[-1][1].append(byte)
                path.append([False, [], []])
            path[-1][0] = True
            before = word
        finish(0)
        # targets were finished before the states that point to them
        behind = np.zeros(len(done), np.int64)
        for k, (end, _, targets) in enumerate(done):
            behind[k] = int(end) + sum(int(behind[t]) for t in targets)
        last = len(done) - 1
        keys, heads, addends = [], [], []
        for number in range(last, -1, -1):  # the root, which is finished last, becomes state 0
            end, labels, targets = done[number]
            reached = int(end)
            for byte, target in zip(labels, targets):
                keys.append((last - number) << 8 | byte)
                heads.append(last - target)
                addends.append(reached)
                reached += int(behind[target])
        final = np.array([done[last - k][0] for k in range(len(done))], bool)
        return cls(np.array(keys, np.int64), np.array(heads, np.int32), np.array(addends, np.int64), final)

    def ordinals(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word in the order, -1 for a word that is not in it.

        All words walk at once, a byte a step; those that have no arc drop out.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        out = np.full(len(words), -1, np.int64)
        going, state, total = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(going):
            ended = sizes[going] == step
            here = ended & self.final[state]
            out[going[here]] = total[here]
            if not len(self.keys):
                break
            going, state, total = going[~ended], state[~ended], total[~ended]
            key = state << 8 | data[begin[going] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            going, arc = going[there], arc[there]
            state, total = self.targets[arc].astype(np.int64), total[there] + self.addends[arc]
            step += 1
        return out

    def word(self, ordinal: int) -> bytes:
        """The word at a place in the order."""
        state, left, out = 0, ordinal, bytearray()
        if not 0 <= ordinal:
            raise IndexError(ordinal)
        while True:
            if self.final[state] and left == 0:
                return bytes(out)
            lo, hi = np.searchsorted(self.keys, [state << 8, (state + 1) << 8])
            arc = lo + int(np.searchsorted(self.addends[lo:hi], left, side="right")) - 1
            if arc < lo:
                raise IndexError(ordinal)
            left -= int(self.addends[arc])
            out.append(int(self.keys[arc]) & 0xFF)
            state = int(self.targets[arc])

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.keys), len(self.final)], "<i8")
        parts = (sizes, self.keys.astype("<i8"), self.addends.astype("<i8"), self.targets.astype("<i4"), self.final.astype(np.uint8))
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        arcs, states = np.frombuffer(blob, "<i8", 2).tolist()
        keys, addends = np.frombuffer(blob, "<i8", arcs, 16), np.frombuffer(blob, "<i8", arcs, 16 + 8 * arcs)
        targets = np.frombuffer(blob, "<i4", arcs, 16 + 16 * arcs)
        return cls(keys, targets, addends, np.frombuffer(blob, np.uint8, states, 16 + 20 * arcs).astype(bool))
