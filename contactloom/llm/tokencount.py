"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest piece of the vocabulary at each place of a word;
pieces at a word's start and pieces that continue one are two sets.  The automaton reads each byte
once.  Its states are the nodes of a trie over both sets.  When a node has no edge for the next
byte, a failure link leads to the node for what is left of the string after its leading pieces are
taken off; how many pieces that were was counted when the automaton was built.  So a word's number
of pieces comes from adding up small numbers, and no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, CONTINUE = 0, 1


class Automaton:
    """Trie with failure links and popped-piece counts over bytes."""

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        self.edge: dict[int, int] = {}  # node * 256 + byte -> node
        piece: list[bool] = [False, False]
        for root, pieces in ((START, initial), (CONTINUE, continuing)):
            for p in pieces:
                if not p:
                    continue
                at = root
                for b in p:
                    to = self.edge.get(at << 8 | b)
                    if to is None:
                        to = self.edge[at << 8 | b] = len(piece)
                        piece.append(False)
                    at = to
                piece[at] = True
        self.link = [-1] * len(piece)
        self.popped = [0] * len(piece)
        # parents come before children, level by level
        level = [(START, -1, 0), (CONTINUE, -1, 0)]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.edge.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        while level:
            below = []
            for node, parent, b in level:
                if piece[node]:
                    self.link[node], self.popped[node] = CONTINUE, 1
                elif parent >= 0:
                    # take pieces off the parent's string until the rest can be followed by b
                    n, at = self.popped[parent], self.link[parent]
                    while at >= 0 and at << 8 | b not in self.edge:
                        n, at = n + self.popped[at], self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.edge[at << 8 | b], n
                below += [(to, node, c) for c, to in children.get(node, [])]
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if greedy matching gets stuck, 0 for the empty word."""
        if not word:
            return 0
        edge, link, popped = self.edge, self.link, self.popped
        at, n = START, 0
        for b in word:
            to = edge.get(at << 8 | b)
            while to is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return -1
                to = edge.get(at << 8 | b)
            at = to
        while at != CONTINUE:
            n += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return n


def bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible bytes are written as
    themselves, the others as the letters from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_pieces(json_path: str | None = None) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a byte-level vocabulary file: those with a leading space start words, without it;
    the others continue words.  Single bytes do both, so no word is without pieces."""
    import json

    if json_path is None:
        import public_tokenizers

        json_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(json_path, encoding="utf-8") as f:
        content = json.load(f)
    added = {t["content"] for t in content.get("added_tokens", [])}
    byte = bytes_of_letters()
    raw = {bytes(byte[c] for c in t) for t in content["model"]["vocab"] if t not in added}
    single = {bytes([b]) for b in range(256)}
    initial = {p[1:] for p in raw if p[:1] == b" " and len(p) > 1 and b" " not in p[1:]}
    return initial | single, {p for p in raw if b" " not in p} | single


def counts(docs: DataFrame, pieces: tuple[set[bytes], set[bytes]] | None = None, vocabulary: str | None = None, memory: int = 400_000) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_words, n_tokens, n_unknown.

    Words are runs of anything but the space and the controls 9 to 13.  A word that greedy matching
    can't split counts as one token, and as unknown.  Null and empty texts have zeros.  A word of
    any length takes time in proportion to it.  Repeated rows get equal results.  An empty table
    gives an empty result.  Other columns, of any name, are not read.
    """
    given = pieces

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*(given or word_pieces(vocabulary)))
        known: dict[bytes, int] = {}

        def learn(words: list[bytes]) -> list[int]:
            out = []
            for w in words:
                n = known.get(w)
                if n is None:
                    n = automaton.count(w)
                    if len(w) <= 64:
                        if len(known) >= memory:
                            known.clear()
                        known[w] = n
                out.append(n)
            return out

        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # for bytes, at these six characters
                try:
                    each = list(map(known.__getitem__, words))
                except KeyError:
                    each = learn(words)
                unknown = each.count(-1)
                n_words.append(len(words))
                n_tokens.append(sum(each) + 2 * unknown)
                n_unknown.append(unknown)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.array(x, dtype=np.int64)) for x in (n_words, n_tokens, n_unknown))],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_words long, n_tokens long, n_unknown long")
