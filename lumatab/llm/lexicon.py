"""A minimal acyclic transducer: words to outputs, with shared prefixes and suffixes, in one mappable file.

Words are added in sorted order; a finished node is looked up by its final flag and edges, so equal suffixes
are one node. An edge carries how many words come before the ones through it; their sum along a word's path
is the word's place in sorted order, where its output stands. A batch of words is looked up at once, byte by
byte, with array operations on the mapped file.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LTLEX001"


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """The file for words (not empty) with their output sequences."""
    known: dict[tuple, int] = {}
    below: list[int] = []
    keys: list[int] = []
    targets: list[int] = []
    adds: list[int] = []

    def close(final: bool, edges: list[tuple[int, int]]) -> int:
        shape = (final, tuple(edges))
        node = known.get(shape)
        if node is None:
            node = known[shape] = len(known)
            total = int(final)
            for label, child in edges:
                keys.append(node << 8 | label)
                targets.append(child)
                adds.append(total)
                total += below[child]
            below.append(total)
        return node

    words = sorted(entries)
    if words and not words[0]:
        raise ValueError("the empty word has no path")
    stack: list[list] = [[False, []]]
    last = b""
    for w in [*words, b""]:
        same = 0
        for x, y in zip(w, last, strict=False):
            if x != y:
                break
            same += 1
        while len(stack) - 1 > same:
            final, edges = stack.pop()
            stack[-1][1].append((last[len(stack) - 1], close(final, edges)))
        if not w:
            break
        stack += [[False, []] for _ in w[same:]]
        stack[-1][0] = True
        last = w
    root = close(*stack[0])
    final = np.zeros(len(known), np.uint8)
    for (is_final, _), node in known.items():
        final[node] = is_final
    lengths = np.array([len(entries[w]) for w in words], np.int64)
    ends = np.cumsum(lengths)
    flat = np.array([x for w in words for x in entries[w]], "<u4")
    arrays = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(adds, "<i4"), ends.astype("<i8"), flat, final]
    out = [MAGIC, struct.pack("<q6q", root, *(a.nbytes for a in arrays))]
    return b"".join(out + [a.tobytes() for a in arrays])


class Lexicon:
    """A compiled file, memory-mapped: processes on a machine share its pages."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path}: not a lexicon")
        self.root, *sizes = struct.unpack("<q6q", bytes(data[8 : 8 + 56]))
        at, parts = 64, []
        for size, kind in zip(sizes, ("<i8", "<i4", "<i4", "<i8", "<u4", "u1"), strict=True):
            parts.append(data[at : at + size].view(kind) if size else np.zeros(0, kind))
            at += size
        self.keys, self.targets, self.adds, self.ends, self.flat, self.final = parts

    def __len__(self) -> int:
        return len(self.ends)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in sorted order, or -1."""
        place = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return place
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths > 0)
        node = np.full(len(live), self.root, np.int64)
        total = np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            want = node << 8 | text[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            live, at = live[hit], at[hit]
            node = self.targets[at].astype(np.int64)
            total = total[hit] + self.adds[at]
            depth += 1
            done = lengths[live] == depth
            ends = done & (self.final[node] == 1)
            place[live[ends]] = total[ends]
            live, node, total = live[~done], node[~done], total[~done]
        return place

    def output(self, place: int) -> np.ndarray:
        return self.flat[int(self.ends[place - 1]) if place else 0 : int(self.ends[place])]
