"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of the tree are the ranks of neighbouring symbol pairs and every inner node holds the
smaller child, ties to the left. The root is the leftmost lowest-rank merge; a merge changes at
most three leaves, each a logarithmic update; the end is a root without a rank. Distinct pieces
of a batch are merged together, one merge per piece and step, on trees that lie in one array per
size class; a long piece has a tree of its own.

Defined results: a null text is the empty text: no ids, and the digest of the empty string. Text
that spells an added token becomes its id, as the file's settings say. Repeated rows give
repeated results, null ids stay null, extra columns are ignored by ``encode`` and kept by
``with_ids`` (whose own columns win over columns of the same name). No rows give no rows.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split before the merges, as byte-level tokenizers do it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to this many bytes are merged together in arrays.
WIDE = 64
#: Remembered pieces and chunks of a task, and bytes of text handled at once.
REMEMBERED, BATCH_BYTES = 300_000, 2 << 20
_NONE = np.int64(1) << 40


def byte_letters() -> dict:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges of a byte-level tokenizer file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.table = None

    def rank(self, a, b):
        """Rank of each pair, or _NONE."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def _merge_together(m: Merges, pieces: list, width: int) -> list:
    """Ids of pieces of at most ``width`` bytes (a power of two): all trees in one flat array."""
    n = len(pieces)
    raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8)
    length = np.array([len(p) for p in pieces])
    sym = m.first[raw]
    place = np.arange(width)
    slot = np.arange(n * width).reshape(n, width)
    # neighbours as flat slots; the slot after the last symbol of a piece is -1
    nxt = np.where(place + 1 < length[:, None], slot + 1, -1).ravel()
    prv = np.where(place > 0, slot - 1, -1).ravel()
    tree = np.full((n, 2 * width), _NONE, np.int64)
    pairs = m.rank(sym[:-1], sym[1:])
    leaf = np.where((nxt[:-1] >= 0) & (pairs < _NONE), pairs * width + np.tile(place, n)[:-1], _NONE)
    tree[:, width:] = np.append(leaf, _NONE).reshape(n, width)
    half = width
    while half > 1:
        level = tree[:, half:2 * half]
        half //= 2
        tree[:, half:2 * half] = np.minimum(level[:, ::2], level[:, 1::2])
    tree = tree.ravel()
    alive = (place < length[:, None]).ravel()

    def put(base, pos, value):
        node = base + base + pos + width  # trees start at twice the slots' start
        off = base + base
        tree[node] = value
        node = pos + width
        for _ in range(width.bit_length() - 1):
            other = tree[off + (node ^ 1)]
            value = np.minimum(value, other)
            node = node >> 1
            tree[off + node] = value

    base = np.flatnonzero(tree[1::2 * width] < _NONE) * width
    while len(base):
        rank, pos = np.divmod(tree[2 * base + 1], width)
        at = base + pos
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = m.merged[rank]
        alive[gone] = False
        nxt[at] = after
        inner = after >= 0
        prv[after[inner]] = at[inner]
        put(base, gone - base, np.full(len(base), _NONE))
        right = m.rank(sym[at], sym[after])
        put(base, pos, np.where(inner & (right < _NONE), right * width + pos, _NONE))
        before = prv[at]
        has = before >= 0
        if has.any():
            own, old = base[has], before[has]
            left = m.rank(sym[old], sym[at[has]])
            put(own, old - own, np.where(left < _NONE, left * width + old - own, _NONE))
        base = base[tree[2 * base + 1] < _NONE]
    ends = np.cumsum(alive.reshape(n, width).sum(1)).tolist()
    ids = sym[alive].tolist()
    return [ids[i:j] for i, j in zip([0, *ends], ends)]


def _merge_one(m: Merges, piece: bytes) -> list:
    """Ids of one long piece: the same tree, with a dictionary of pair ranks."""
    if m.table is None:
        m.table = dict(zip(m.keys.tolist(), m.ranks.tolist()))
    table, n = m.table, len(piece)
    width = 1 << (n - 1).bit_length()
    sym = m.first[np.frombuffer(piece, np.uint8)].tolist()
    none = int(_NONE)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = table.get(sym[i] << 20 | sym[i + 1])
        if r is not None:
            tree[width + i] = r * width + i
    for at in range(width - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(pos, value):
        node = pos + width
        tree[node] = value
        while node > 1:
            node >>= 1
            value = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == value:
                return
            tree[node] = value

    def pair(i):
        j = nxt[i]
        r = table.get(sym[i] << 20 | sym[j]) if j < n else None
        put(i, none if r is None else r * width + i)

    while tree[1] < none:
        rank, pos = divmod(tree[1], width)
        gone = nxt[pos]
        sym[pos], nxt[pos] = int(m.merged[rank]), nxt[gone]
        if nxt[gone] < n:
            prv[nxt[gone]] = pos
        put(gone, none)
        sym[gone] = -1
        pair(pos)
        if prv[pos] >= 0:
            pair(prv[pos])
    return [s for s in sym if s >= 0]


def merge_pieces(m: Merges, pieces: list) -> list:
    """Ids of each piece (bytes), in order."""
    out, by_width = [None] * len(pieces), {}
    for i, n in enumerate(map(len, pieces)):
        by_width.setdefault(1 << max(1, (n - 1).bit_length()), []).append(i)
    for width, index in by_width.items():
        if width > WIDE:
            for i in index:
                out[i] = _merge_one(m, pieces[i])
        else:
            for i, ids in zip(index, _merge_together(m, [pieces[i] for i in index], width)):
                out[i] = ids
    return out


class Encoder:
    """Text to runs of decimal ids joined by commas, and back.

    A text is cut at its spaces: a chunk that begins and ends with other than white space falls
    into the same pieces wherever it stands, so the ids of a chunk are remembered. Beyond REMEMBERED only the chunks that came back in the last call are kept.
    Texts with doubled or outer white space, or with an added token, are cut into pieces as a whole.
    """

    def __init__(self, m: Merges):
        self.m, self.find = m, regex.compile(PIECES).findall
        self.name = {i: str(i) for i in m.token_bytes}.__getitem__
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(m.special, key=len, reverse=True)) + ")").split if m.special else None
        self.bytes_of = {str(i): b for i, b in m.token_bytes.items()}.__getitem__
        self.chunks, self.again = {}, set()
        self.forget()

    def forget(self):
        """Remembered: ids of pieces, ids of chunks after a space (None: not safe)."""
        self.pieces = {s: str(i) for s, i in self.m.special.items()}
        self.chunks = {c: self.chunks[c] for c in self.again}

    def _ids(self, pieces):
        return [",".join(map(self.name, ids)) for ids in merge_pieces(self.m, [p.encode() for p in pieces])]

    @staticmethod
    def _outer(text):
        """Empty, or with outer white space."""
        return not text or text[0].isspace() or text[-1].isspace()

    def _whole(self, text):
        if self.split is None or not any(s in text for s in self.m.special):
            return self.find(text)
        out = []
        for part in self.split(text):
            out += [part] if part in self.m.special else self.find(part)
        return out

    def encode(self, texts: list) -> list:
        """For each text a list of id runs; joined by commas they are its ids."""
        if len(self.chunks) + len(self.pieces) > REMEMBERED:
            self.forget()
        pieces, chunks = self.pieces, self.chunks
        cut = [t.split(" ") for t in texts]
        seen = set()
        for c in cut:
            seen.update(c[1:])
        fresh = seen.difference(chunks)
        self.again = seen.difference(fresh) if len(seen) < REMEMBERED // 2 else set()
        # letters alone are one piece
        plain = [c for c in fresh if c.isascii() and c.isalpha()]
        chunks.update(zip(plain, self._ids([" " + c for c in plain])))
        new = {c: None if self._outer(c) else self.find(" " + c) for c in fresh.difference(plain)}
        whole = {}
        special = tuple(self.m.special)
        for i, c in enumerate(cut):
            if "" in c or any([s in texts[i] for s in special]):
                whole[i] = self._whole(texts[i])
            elif c[0] and self._outer(c[0]):
                whole[i] = self._whole(texts[i])
        heads = [self.find(c[0]) if i not in whole else [] for i, c in enumerate(cut)]
        fresh = set()
        for found in (new.values(), whole.values(), heads):
            for p in found:
                if p:
                    fresh.update(p)
        fresh = list(fresh.difference(pieces))
        pieces.update(zip(fresh, self._ids(fresh)))
        get = pieces.__getitem__
        for c, found in new.items():
            chunks[c] = None if found is None else ",".join(map(get, found))
        out, unsafe = [], any(chunks[c] is None for c in seen)
        for i, c in enumerate(cut):
            if i not in whole:
                run = list(map(chunks.__getitem__, c[1:]))
                if unsafe and None in run:
                    whole[i] = self._whole(texts[i])
                    lost = [p for p in set(whole[i]) if p not in pieces]
                    pieces.update(zip(lost, self._ids(lost)))
            out.append(list(map(get, whole[i] if i in whole else heads[i])) + ([] if i in whole else run))
        return out

    def decode(self, runs: list) -> str:
        """Text of id runs: the bytes of their ids in order, as UTF-8."""
        ids = ",".join(runs)
        return b"".join(map(self.bytes_of, ids.split(","))).decode("utf-8", "replace") if ids else ""


def _text_batches(column):
    """Texts of an Arrow column in runs of about BATCH_BYTES."""
    run, size = [], 0
    for t in column:
        t = t.as_py() or ""
        run.append(t)
        size += len(t)
        if size > BATCH_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def with_ids(docs: DataFrame, path: str, text="text", ids=False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and the ids themselves if asked for.

    The file at ``path`` is read once by the driver; its tables (bounded by the vocabulary) are
    broadcast. Pieces are looked up per task, so nothing is shuffled.
    """
    own = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    docs = docs.select("*", F.col(text).alias("_text")).drop(*[c for c in own if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(Merges(path))
    kept = [c for c in docs.columns if c != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_text"),
                        "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if ids else [])])

    def run(batches):
        tables = shared.value  # kept by the worker from task to task, and with it what it remembers
        enc = tables.encoder = getattr(tables, "encoder", None) or Encoder(tables)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, digest, decoded, listed = [], [], [], []
            for texts in _text_batches(b.column(b.num_columns - 1)):
                for runs in enc.encode(texts):
                    t = ",".join(runs)
                    n.append(t.count(",") + 1 if t else 0)
                    digest.append(sha(t))
                    decoded.append(sha(enc.decode([t])))
                    if ids:
                        listed.append(np.array(t.split(",") if t else [], np.int32))
            cols = [b.column(i) for i in range(len(kept))] + [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            if ids:
                cols.append(pa.array(listed, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, kept + own)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    return with_ids(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path).drop("text")
