"""Byte-level BPE as a compiled tokenization automaton, and an encoder of whole texts with it.

The merges are compiled one after another, in priority order, into a deterministic automaton over token arcs. At first
every byte is an arc from every state to the state named by that byte. The gadget of merge (u, v) -> uv

* gives the new arc uv a state of its own, which leaves by the arcs that the state of v has at that time;
* closes, in the state of u, the arc v and all arcs that will be made of v and what follows it, from this merge on.

A state keeps its closed arcs as a table of intervals over arcs numbered so that those which a gadget closes lie side by
side. A pre-split word is read from left to right by table lookups alone: at each place exactly one arc arrives, the one
that ends there and is open in the state at which it begins. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from emberlane.llm.text import blocks, buffers

def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton of a merge list; states and arcs are tokens, closed arcs are intervals of arc numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        words, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.label: list[bytes] = [b""] * (max([*words.values(), *self.special.values()]) + 1)
        for word, i in words.items():
            self.label[i] = spell(word) if word not in self.special else b""
        for word, i in self.special.items():
            self.label[i] = word.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.compile([words[letter] for letter in letters if letter in words], [(words[u], words[v], words[u + v]) for u, v in pairs])

    def compile(self, alphabet: list[int], merges: list[tuple[int, int, int]]) -> None:
        """All gadgets, in order. A token that a second merge makes again keeps its first gadget's state and number."""
        n = len(self.label)
        made = [-1] * n  # the merge that opened an arc
        front: list[list[int]] = [[] for _ in range(n)]  # arcs that begin with this one, as they were made
        for rank, (u, v, uv) in enumerate(merges):
            if made[uv] < 0:
                made[uv] = rank
                front[u].append(uv)
        # arcs in preorder, what was made last first: v and all that is made of it from some merge on are one interval
        self.number = [0] * n
        self.after = [0] * n
        count, stack = 0, [(a, False) for a in reversed(alphabet)]
        while stack:
            t, done = stack.pop()
            if done:
                self.after[t] = count
            else:
                self.number[t] = count
                count += 1
                stack.append((t, True))
                stack.extend((x, False) for x in front[t])
        self.closed: list[array | None] = [None] * n
        for a in alphabet:
            self.closed[a] = array("I")
        opened = set(alphabet)
        for rank, (u, v, uv) in enumerate(merges):
            if u not in opened or v not in opened or self.is_closed(u, v):
                continue  # the gadget meets no state: another merge comes before it wherever the pair stands
            if made[uv] == rank:
                opened.add(uv)
                self.closed[uv] = self.closed[v]  # shared until a gadget changes it
            older = next((x for x in reversed(self._older(front[v], made, rank))), None)
            self.closed[u] = self._close(self.closed[u], self.number[v], self.number[older] if older is not None else self.after[v])
        self.arc = {self.label[t]: t for t in opened}
        self.start = array("I")
        self.longest = max(map(len, self.arc))
        # what labels end with: a scan back from a place stops where no label ends so
        self.suffix = {w[k:] for w in self.arc for k in range(1, len(w))}

    @staticmethod
    def _older(arcs: list[int], made: list[int], rank: int) -> list[int]:
        """Arcs made before a merge; arcs come in the order of their making."""
        return arcs[: bisect_left(arcs, rank, key=made.__getitem__)]

    @staticmethod
    def _close(table: array, low: int, high: int) -> array:
        """The table with [low, high) closed too; bounds at even places begin an interval."""
        i, j = bisect_left(table, low), bisect_right(table, high)
        bounds = ([low] if not i % 2 else []) + ([high] if not j % 2 else [])
        return table[:i] + array("I", bounds) + table[j:]

    def is_closed(self, state: int, arc: int) -> bool:
        return bisect_right(self.closed[state], self.number[arc]) % 2 == 1

    def read(self, word: bytes) -> list[int]:
        """The token arcs of the only path that spells the word."""
        n = len(word)
        arrived, tables, number = [-1] * (n + 1), [None] * (n + 1), self.number
        tables[0] = self.start
        for end in range(1, n + 1):
            for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                part = word[begin:end]
                t = self.arc.get(part)
                if t is not None and bisect_right(tables[begin], number[t]) % 2 == 0:
                    arrived[end], tables[end] = t, self.closed[t]
                    break
                if part not in self.suffix:
                    break
        path = []
        while n:
            path.append(arrived[n])
            n -= len(self.label[arrived[n]])
        return path[::-1]


#: Classes of code points: 0 other, 1 letter, 2 number, 3 white space.
def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = 1
        elif kind == "N":
            table[c] = 2
    for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = 3
    return table


_TABLE: np.ndarray | None = None


def class_table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    return _TABLE


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    if not len(raw):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    if raw.max() < 128:
        return raw.astype(np.int32), np.arange(len(raw))
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.int32)
    code = lead.copy()
    padded = np.concatenate([raw, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
    for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        rows = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[rows] & bits
        for k in range(1, more + 1):
            value = (value << 6) | (padded[at[rows] + k] & 0x3F)
        code[rows] = value
    return code, at


def pre_split(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-split words begin, in texts that begin at the given edges (the first 0, the last len(raw)).

    Contractions after a lone apostrophe; runs of letters, of numbers and of other signs, each with one space before it;
    white space else, of which a text's inner runs leave the last character to what follows.
    """
    code, at = code_points(raw)
    n = len(code)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = class_table()[code]
    first = np.zeros(n + 1, dtype=bool)  # first character of a text
    first[np.searchsorted(at, edges[:-1])] = True
    first[n] = True
    run = first[:n].copy()  # a run of one class begins
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == 3
    last_white = white & np.concatenate([~white[1:] & ~first[1:n], [False]])  # white space right before something, in one text
    begin = run | last_white
    joined = np.flatnonzero(last_white & (code == 32)) + 1
    begin[joined] = False  # the space goes to the word after it
    lone = np.flatnonzero((code == 39) & begin[:n] & (kind == 0))
    if len(lone):
        pad = np.concatenate([code, np.zeros(3, dtype=code.dtype)])
        stop = np.concatenate([first[:n], np.ones(3, dtype=bool)])
        one = np.isin(pad[lone + 1], [ord(c) for c in "stmd"]) & ~stop[lone + 1]
        two = np.zeros(len(lone), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (pad[lone + 1] == ord(a)) & (pad[lone + 2] == ord(b))
        two &= ~stop[lone + 1] & ~stop[lone + 2]
        for hit, size in ((one, 2), (two & ~one, 3)):
            apostrophe = lone[hit]
            begin[apostrophe + 1] = False
            after = apostrophe + size
            after = after[after < n]
            begin[after[~last_white[after - 1] if len(after) else []]] = True
    return at[np.flatnonzero(begin)]


class Encoder:
    """Encodes whole texts; keeps the ids of words it has met. spell: bytes of a pre-split word -> ids."""

    MOST = 600_000

    def __init__(self, spell, special: dict[str, int]):
        self.spell, self.special = spell, special
        self.marks = {k.encode(): v for k, v in special.items()}
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _learn(self, word: bytes) -> int:
        ids = [self.marks[word[1:]]] if word[:1] == b"\xff" else self.spell(word)
        k = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if k == len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[word] = k
        return k

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows' texts, and the offset of each row's first id."""
        if len(self.known) > self.MOST:
            self.reset()
        data = raw.tobytes()
        edges, marked = offsets, {}
        for mark in self.marks:
            at = data.find(mark)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(mark) <= offsets[row + 1]:
                    marked[at] = mark
                    at += len(mark) - 1
                at = data.find(mark, at + 1)
        if marked:
            cut = np.array(sorted({*marked, *(a + len(m) for a, m in marked.items())}))
            edges = np.unique(np.concatenate([offsets, cut]))
        else:
            edges = np.unique(offsets)
        begins = pre_split(raw, edges) if len(raw) else np.zeros(0, dtype=np.int64)
        if marked:
            inside = np.zeros(len(begins), dtype=bool)
            for a, m in marked.items():
                inside |= (begins > a) & (begins < a + len(m))
            begins = begins[~inside]
        stops = np.append(begins[1:], len(raw)).tolist()
        words = [data[a:b] for a, b in zip(begins.tolist(), stops)]
        if marked:
            place = {int(a): i for i, a in enumerate(begins)}
            for a, m in marked.items():
                words[place[a]] = b"\xff" + m
        get = self.known.get
        which = [get(w, -1) for w in words]
        which = np.fromiter(which, dtype=np.int64, count=len(which))
        for i in np.flatnonzero(which < 0).tolist():
            w = words[i]
            k = get(w, -1)
            which[i] = self._learn(w) if k < 0 else k
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[which] - (ends - sizes), sizes)] if total else np.zeros(0, dtype=np.int32)
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(begins, offsets)]


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(path)
    return _AUTOMATA[path]


def automaton_encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    key = ("automaton", path)
    if key not in _ENCODERS:
        a = automaton(path)
        _ENCODERS[key] = Encoder(a.read, a.special)
    return _ENCODERS[key]


def library_encoder(path: str) -> Encoder:
    """The same ids, with a library's merge loop for words that are new to the worker."""
    key = ("library", path)
    if key not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        core = tiktoken.Encoding(os.path.basename(path), pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[key] = Encoder(core._encode_single_piece, special)
    return _ENCODERS[key]


def labels_table(a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in a.label], dtype=np.int64)
    return np.frombuffer(b"".join(a.label), dtype=np.uint8), np.cumsum(size) - size, size


def emit(ids: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """The arcs' labels, one after another, and where each begins."""
    flat, start, size = table
    sizes = size[ids]
    ends = np.cumsum(sizes)
    begin = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[ids] - begin, sizes)], np.append(begin, total)


def encode_decode(batches, path: str):
    """Arrow batches (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encoder, a = automaton_encoder(path), automaton(path)
    table = labels_table(a)
    comma = [b"%d," % i for i in range(len(a.label))]
    digits = (np.frombuffer(b"".join(comma), dtype=np.uint8), np.cumsum([len(x) for x in comma]) - [len(x) for x in comma], np.array([len(x) for x in comma], dtype=np.int64))
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        for i, j in blocks(offsets):
            ids, row = encoder.block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            text, begin = emit(ids, table)
            said, place = emit(ids, digits)
            text, said = text.tobytes(), said.tobytes()
            shas, decoded = [], []
            for p, q in zip(row[:-1].tolist(), row[1:].tolist()):
                shas.append(hashlib.sha256(said[place[p] : max(place[p], place[q] - 1)]).hexdigest())
                got = text[begin[p] : begin[q]]
                decoded.append(hashlib.sha256(got.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(np.diff(row)), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def tokenize_roundtrip(docs, path: str | None = None):
    """One row per document: token count, digest of its ids and of the text decoded from them.

    A null text is empty: no tokens, digests of the empty string. Rows are kept as they come, repeated ones too; other
    columns are ignored. Words are cut from whole texts; no text is shortened.
    """
    path = path or vocabulary_path()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: encode_decode(batches, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
