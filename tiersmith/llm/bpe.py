"""Byte-level BPE: encoding by speculation and verification, decoding by table.

A text falls into words that are encoded by themselves. For each new word a
greedy longest match proposes tokens. A proposal is what merging in rank order
gives exactly if every adjacent pair of its tokens is compatible: no symbol on
the right edge of the left token may merge with a symbol on the left edge of
the right token before one of the two is absorbed into its own token. That
test runs over all distinct pairs of a block at once; only words with a failing
pair are merged step by step.

Null and empty texts give no tokens. Added tokens of the vocabulary file are
cut out of a text first, as the public library does. Texts of any length are
encoded whole; words and their codes are remembered in a dictionary of bounded
size, which does not change results. Repeated rows are encoded alike; columns
beyond the named ones are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import Lookup, row_blocks, text_bytes

# Fixed value: the public word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 200_000
NEVER = 1 << 30
_MARK = "\x01"


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables read from a public vocabulary file; a few megabytes whatever is encoded with it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for t, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in t)
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.rank = np.full(size, -1, np.int64)
        pairs = np.zeros((len(merges), 3), np.int64)
        for k, (a, b) in enumerate(merges):
            made = ids[a + b]
            pairs[k] = ids[a], ids[b], made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, ids[a], ids[b]
        self.pairs = pairs


class Encoder:
    """The tables of a vocabulary in the form that encoding wants; made once in each worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.words = regex.compile(WORDS)
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        special = set(v.added.values())
        self.ids = {t: i for i, t in enumerate(v.tokens) if t and i not in special}
        size = len(v.tokens)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.rank_of = Lookup(v.pairs[:, 0] * size + v.pairs[:, 1], np.arange(len(v.pairs)), NEVER)
        self._grow_tree()
        self.lengths = np.array([len(t) for t in v.tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(v.tokens), np.uint8)
        self.known: dict[str, bytes] = {m: np.uint32(i).tobytes() for m, i in v.added.items()}

    def _grow_tree(self) -> None:
        """The tokens as a prefix tree: step gives (node, byte) -> node, ends the token that a node completes."""
        nodes: dict[bytes, int] = {b"": 0}
        keys, ends = [], {0: -1}
        for token in self.ids:
            at = 0
            for k in range(1, len(token) + 1):
                below = nodes.setdefault(token[:k], len(nodes))
                if below not in ends:
                    ends[below] = self.ids.get(token[:k], -1)
                    keys.append((at * 256 + token[k - 1], below))
                at = below
        steps = np.array(keys, np.int64)
        self.step, self.ends = Lookup(steps[:, 0], steps[:, 1]), np.array([ends[i] for i in range(len(nodes))], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank at which a and b merge; NEVER where they don't."""
        return self.rank_of.get(a * len(self.v.tokens) + b)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging keeps the tokens x[i], y[i] apart when their texts stand side by side."""
        v, good = self.v, np.ones(len(x), bool)
        rows, a, until_a = np.arange(len(x)), x, np.full(len(x), NEVER, np.int64)
        while len(rows):
            sub, b, until_b = np.arange(len(rows)), y[rows], np.full(len(rows), NEVER, np.int64)
            while len(sub):
                r = self.pair_ranks(a[sub], b)
                good[rows[sub[(r < until_a[sub]) & (r <= until_b) & (r < NEVER)]]] = False
                deeper = v.left[b] >= 0
                sub, until_b, b = sub[deeper], v.rank[b[deeper]], v.left[b[deeper]]
            deeper = (v.right[a] >= 0) & good[rows]
            rows, until_a, a = rows[deeper], v.rank[a[deeper]], v.right[a[deeper]]
        return good

    def propose(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once; returns the owning words in order and their tokens."""
        owners, tokens = [], []
        word, at = np.arange(len(starts)), starts.copy()
        while len(word):
            node, walk, left = np.zeros(len(word), np.int64), at.copy(), np.arange(len(word))
            token, after = np.full(len(word), -1, np.int64), at.copy()
            while len(left):
                left = left[walk[left] < stops[word[left]]]
                node[left] = self.step.get(node[left] * 256 + data[walk[left]])
                left = left[node[left] >= 0]
                walk[left] += 1
                made = self.ends[node[left]]
                hit = left[made >= 0]
                token[hit], after[hit] = made[made >= 0], walk[hit]
            owners.append(word)
            tokens.append(token)
            more = after < stops[word]
            word, at = word[more], after[more]
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def merged(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all given words together: in each round every word merges its lowest, leftmost pair."""
        size = stops - starts
        owner = np.repeat(np.arange(len(starts)), size)
        ends = np.cumsum(size)
        sym = self.single[data[np.arange(len(owner)) + np.repeat(starts - (ends - size), size)]]
        rank = np.full(len(sym), NEVER, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pair_ranks(sym[inner], sym[inner + 1])
        done_owner, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), first)
            at, live = lowest & 0xFFFFFFFF, (lowest >> 32) < NEVER
            sym[at[live]] = self.v.pairs[lowest[live] >> 32, 2]
            keep = np.repeat(live, np.diff(np.append(first, len(sym))))
            done_owner.append(owner[~keep])
            done_sym.append(sym[~keep])
            touched = np.zeros(len(sym), bool)
            touched[at[live]] = True
            before = at[live] - 1
            touched[before[before >= 0]] = True
            keep[at[live] + 1] = False
            owner, sym, rank, touched = owner[keep], sym[keep], rank[keep], touched[keep]
            again = np.flatnonzero(touched)
            rank[again] = NEVER
            again = again[again + 1 < len(sym)]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.pair_ranks(sym[again], sym[again + 1])
        owner, sym = np.concatenate(done_owner or [owner]), np.concatenate(done_sym or [sym])
        order = np.argsort(owner, kind="stable")
        return owner[order], sym[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Codes of distinct words: propose, verify all adjacent pairs together, merge what fails."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate([[0], stops[:-1]])
        owner, token = self.propose(data, starts, stops)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(token[inner] * len(self.v.tokens) + token[inner + 1], return_inverse=True)
        good = self.compatible(pairs // len(self.v.tokens), pairs % len(self.v.tokens))
        failed = np.zeros(len(words), bool)
        failed[owner[inner[~good[back]]]] = True
        wrong = np.flatnonzero(failed)
        again, exact = self.merged(data, starts[wrong], stops[wrong])
        owner, token = np.concatenate([owner[~failed[owner]], wrong[again]]), np.concatenate([token[~failed[owner]], exact])
        order = np.argsort(owner, kind="stable")
        flat = token[order].astype(np.uint32).tobytes()
        cut = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *cut], cut)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the codes of pieces that are not known yet."""
        fresh = [p for p in pieces if p not in self.known]
        parts = [self.words.findall(p) for p in fresh]
        words = list({w for ws in parts for w in ws})
        codes = dict(zip(words, self.encode_words([w.encode() for w in words])))
        for p, ws in zip(fresh, parts):
            self.known[p] = codes[ws[0]] if len(ws) == 1 else b"".join([codes[w] for w in ws])

    def pieces(self, text: str, regular: bool) -> list[str]:
        """Pieces that are encoded by themselves.

        In a regular text every white space is a single blank or line end
        between other characters; there a blank begins a piece and a line end
        is one, which string functions find faster than the pattern.
        """
        if self.added is not None and "<" in text and self.added.search(text):
            out = []
            for part in self.added.split(text):
                out += [part] if part in self.v.added else self.words.findall(part)
            return out
        if regular:
            return text.replace("\n", f"{_MARK}\n{_MARK}").replace(" ", f"{_MARK} ").split(_MARK)
        return self.words.findall(text)

    def encode(self, texts: list[str], regular: np.ndarray) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        rows = [self.pieces(t, r) for t, r in zip(texts, regular.tolist())]
        if len(self.known) > REMEMBERED:
            self.known = {m: np.uint32(i).tobytes() for m, i in self.v.added.items()}
        self.learn(set().union(*rows))
        known = self.known.__getitem__
        return [b"".join(map(known, r)) for r in rows]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        if len(ids) == 0:
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends + n, n)].tobytes()


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that may belong to other white space, or to the mark.
_ODD = np.zeros(256, bool)
_ODD[[*range(10), 11, 12, 13, *range(14, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def regular_rows(data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> np.ndarray:
    """Which texts have single blanks and line ends as their only white space, not doubled."""
    blank = _BLANK[data]
    twice = np.flatnonzero(blank[1:] & blank[:-1])
    odd = np.flatnonzero(_ODD[data])
    out = np.ones(len(texts), bool)
    out[np.searchsorted(offsets, twice, "right") - 1] = False
    for i in np.unique(np.searchsorted(offsets, odd, "right") - 1).tolist():
        out[i] = out[i] and _MARK not in texts[i] and not regex.search(r"[^\S \n]|\s\s|[\x1c-\x1f]", texts[i])
    return out


_encoders: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    key = shared.value
    if id(key) not in _encoders:
        _encoders.clear()
        _encoders[id(key)] = Encoder(key)
    return _encoders[id(key)]


def _mapped(df: DataFrame, vocabulary: Vocabulary, column: str, keep: tuple[str, ...], kinds: str, work) -> DataFrame:
    """Apply ``work(encoder, column)``, which gives Arrow columns, and carry the columns of ``keep``."""
    taken = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(column).alias("v"))
    carried = "".join(f"`k{i}` {f.dataType.simpleString()}, " for i, f in enumerate(taken.schema.fields[:-1]))
    names = [x.split()[0] for x in kinds.split(", ")]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            value = batch.column("v")
            if pa.types.is_string(value.type) or pa.types.is_large_string(value.type):
                ranges = list(row_blocks(text_bytes(value)[1]))
            else:
                ranges = [(i, min(i + 1000, len(value))) for i in range(0, len(value), 1000)]
            for lo, hi in ranges:
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([*part.columns[:-1], *work(encoder, part.column("v"))],
                                      names=[*batch.schema.names[:-1], *names])

    out = taken.mapInArrow(run, carried + kinds)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def _encoded(encoder: Encoder, column: pa.Array) -> list[bytes]:
    data, offsets = text_bytes(column)
    texts = [t or "" for t in column.to_pylist()]
    return encoder.encode(texts, regular_rows(data, offsets, texts))


def _decoded(encoder: Encoder, ids: list[bytes]) -> list[str]:
    """Whole block at once, then cut at the texts' ends."""
    flat = np.frombuffer(b"".join(ids), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    ends = np.concatenate([[0], np.cumsum(encoder.lengths[flat])])[np.concatenate([[0], np.cumsum(sizes)])]
    raw = encoder.decode(flat)
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ids, the tokens as little-endian unsigned 32-bit numbers."""
    return _mapped(docs, vocabulary, text, keep, "ids binary", lambda e, c: [pa.array(_encoded(e, c), pa.binary())])


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the text of the ids; bytes that are no UTF-8 become replacement characters, null ids no text."""
    return _mapped(encoded, vocabulary, ids, keep, "text string",
                   lambda e, c: [pa.array(_decoded(e, [x or b"" for x in c.to_pylist()]), pa.string())])


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids and decoded, the text that the ids stand for, in one pass."""
    def work(e: Encoder, c: pa.Array) -> list[pa.Array]:
        ids = _encoded(e, c)
        return [pa.array(ids, pa.binary()), pa.array(_decoded(e, ids), pa.string())]

    return _mapped(docs, vocabulary, text, keep, "ids binary, decoded string", work)
