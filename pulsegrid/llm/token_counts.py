"""Token counts of greedy longest-match word pieces, in one linear pass over each word.

A trie of the vocabulary has a root for pieces that begin a word and one for pieces that go on.
Each node has a failure link, the node that stands for what is left after the longest pieces
have been popped off, and the number of pieces popped on the way. Counting follows edges and
links and adds the numbers; no piece is ever built. Distinct words of a batch walk the trie
together, one byte per step; a very long word walks alone.

Defined results: null, empty and blank texts have no words and no tokens. A word with a part
that no piece matches counts as one unknown token. Repeated rows give repeated results, null
ids stay null, extra columns are ignored, no rows give no rows.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import BATCH_BYTES, REMEMBERED, byte_letters

#: Words of up to this many bytes walk together; a longer one walks alone, edge by edge.
WIDE = 64


class Automaton:
    """Trie with failure links and popped-token counts. Nodes 0 and 1 are the two roots."""

    def __init__(self, initial, going_on):
        edges, ends, level = {}, set(), {0: 0, 1: 0}
        for root, pieces in ((0, initial), (1, going_on)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = edges.get(node << 8 | c)
                    if child is None:
                        child = edges[node << 8 | c] = len(level)
                        level[child] = level[node] + 1
                    node = child
                if piece:
                    ends.add(node)
        parent = {child: key for key, child in edges.items()}
        fail, pops = [-1] * len(level), [0] * len(level)
        for v in sorted(parent, key=level.__getitem__):
            u, c = parent[v] >> 8, parent[v] & 255
            if v in ends:
                fail[v], pops[v] = 1, 1
                continue
            z, popped = fail[u], pops[u]
            while z >= 0 and z << 8 | c not in edges:
                popped, z = popped + pops[z], fail[z]
            if z >= 0:
                fail[v], pops[v] = edges[z << 8 | c], popped
        # what the rest of a word adds when the word ends at a node; -1: it has no pieces
        rest = [-1] * len(level)
        rest[1] = 0
        for v in sorted(parent, key=level.__getitem__):
            at, total = v, 0
            while at >= 0 and at != 1:
                total, at = total + pops[at], fail[at]
            rest[v] = total if at == 1 else -1
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.fail, self.pops, self.rest = (np.array(x, np.int64) for x in (fail, pops, rest))
        self.plain = None

    def _step(self, node, c):
        key = node << 8 | c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)

    def counts(self, words: list):
        """(tokens, unknown) of each word (bytes, not empty)."""
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        out, bad = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        *groups, long = np.split(order, np.searchsorted(size[order], [8, 16, 32, WIDE], side="right"))
        for i in long:
            out[i], bad[i] = self._alone(words[i])
        for part in groups:
            if len(part):
                top = int(size[part].max())
                for rows in np.array_split(part, max(1, len(part) * top // (8 << 20))):
                    out[rows], bad[rows] = self._together([words[i] for i in rows], size[rows], top)
        return np.where(bad, 1, out), bad

    def _alone(self, word):
        """(tokens, unknown) of one word, over plain tables that are made from the arrays when first needed."""
        if self.plain is None:
            self.plain = dict(zip(self.keys.tolist(), self.child.tolist())), *(x.tolist() for x in (self.fail, self.pops, self.rest))
        edges, fail, pops, rest = self.plain
        node = total = 0
        for c in word:
            to = edges.get(node << 8 | c)
            while to is None:
                if fail[node] < 0:
                    return 0, True
                total += pops[node]
                node = fail[node]
                to = edges.get(node << 8 | c)
            node = to
        return total + max(rest[node], 0), rest[node] < 0

    def _together(self, words, size, top):
        raw = np.frombuffer(b"".join(w.ljust(top, b"\0") for w in words), np.uint8).reshape(len(words), top)
        node, total, alive = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        bad = np.zeros(len(words), bool)
        for i in range(top):
            alive = alive[(size[alive] > i) & ~bad[alive]]
            todo = alive
            while len(todo):
                to = self._step(node[todo], raw[todo, i].astype(np.int64))
                node[todo[to >= 0]] = to[to >= 0]
                todo = todo[to < 0]
                lost = self.fail[node[todo]] < 0
                bad[todo[lost]] = True
                todo = todo[~lost]
                total[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
        rest = self.rest[node]
        return total + np.maximum(rest, 0), bad | (rest < 0)


def word_pieces(path: str):
    """Pieces of a byte-level vocabulary: those with a leading space begin a word (the space kept)."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {a["content"] for a in spec["added_tokens"]}
    tokens = [bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    return [t for t in tokens if t.startswith(b" ")], [t for t in tokens if not t.startswith(b" ")]


def count_tokens(docs: DataFrame, path: str, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: greedy word-piece lengths of every text.

    A word stands with a leading space, as the vocabulary has it. The tables of the automaton
    are bounded by the vocabulary and broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(*word_pieces(path)))

    def run(batches):
        auto, known, unknown = shared.value, {}, set()
        for b in batches:
            words_n, tokens, bad = [], [], []
            texts, size = [], 0

            def settle():
                cut = [t.split() for t in texts]
                new = list({w for ws in cut for w in ws if w not in known})
                if new:
                    n, lost = auto.counts([b" " + w for w in new])
                    known.update(zip(new, n.tolist()))
                    unknown.update(w for w, x in zip(new, lost) if x)
                for ws in cut:
                    words_n.append(len(ws))
                    tokens.append(sum(map(known.__getitem__, ws)))
                    bad.append(sum(map(unknown.__contains__, ws)) if unknown else 0)

            for t in b.column(1):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                texts.append(t)
                size += len(t)
                if size > BATCH_BYTES:
                    settle()
                    texts, size = [], 0
                    if len(known) > REMEMBERED:
                        known, unknown = {}, set()
            settle()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (words_n, tokens, bad))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_unknown long")
