"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last characters says so; equal chunks, in whatever document, are
encoded once for each task (within a bounded cache). A chunk's own pieces are right except near its ends, where
the neighbouring text can change how the pattern splits it. So each join is encoded again, from the last
piece of the left chunk that later text can't change, onwards until a piece start agrees with one of the right
chunk's own; without agreement the whole right chunk is encoded with what was open before it.

Null texts count as empty; empty texts have no ids. Rows are independent, so ties and repeats need no rule.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, groups, texts_of

#: Mean length of chunks, in characters.
CHUNK = 512
#: Characters whose hash decides a cut.
SPAN = 16
#: Entries of the two caches of a task, which are cleared when full.
MAX_CHUNKS, MAX_WORDS = 20_000, 600_000
#: How many characters behind a piece can change it (the longest contraction is three characters).
SIGHT = 3
#: How much of the right chunk a join reads first.
AHEAD = 32
#: Piece starts that a chunk offers to a join before it.
HEADS = 12

# fixed value: the pre-tokenization pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed values: white space of the pattern's \s
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# fixed value: no letter or number has a higher code point
LAST_LETTER = 0x33479
# fixed values: endings that the pattern takes as contractions
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point."""
    kinds = np.full(0x110000, 3, np.uint8)
    for c in range(LAST_LETTER + 1):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kinds[c] = 1 if k == "L" else 2
    kinds[WHITE] = 0
    return kinds


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def piece_starts(text: str, starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokenization pattern starts a piece, of parts of a text that begin at starts and don't see each other."""
    c = codes(text)
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[c]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    white = kind == 0
    # the last white character of a run that text follows stands alone or, if it is a space, before that text
    last_white = np.zeros(n, bool)
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    space = last_white & (c == 0x20)
    begin = change | last_white
    begin[1:] &= ~space[:-1]  # the text behind such a space doesn't start a piece
    begin |= first[:n]
    begin[1:] |= last_white[:-1] & ~space[:-1]
    quotes = np.flatnonzero((c == 0x27) & begin)
    if len(quotes):
        ends = np.flatnonzero(first)
        stop = ends[np.searchsorted(ends, quotes, side="right")]
        for q, e in zip(quotes.tolist(), stop.tolist(), strict=True):
            tail = text[q + 1 : min(q + 3, e)]
            for end in CONTRACTIONS:
                if tail.startswith(end):
                    begin[q + 1 : q + 1 + len(end)] = False
                    after = q + 1 + len(end)
                    if after < e and not space[after]:
                        begin[after] = True
                    elif after < e:
                        begin[after] = True
                    break
    return np.flatnonzero(begin)


def cuts(c: np.ndarray, starts: np.ndarray, mean: int = CHUNK, span: int = SPAN) -> np.ndarray:
    """Chunk starts: text starts, and places behind span characters whose hash is 0 modulo mean."""
    n = len(c)
    if n <= span:
        return starts
    h = c.astype(np.uint64)
    width, out = 1, h * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    while width < span:
        m = np.uint64((0xC2B2AE3D27D4EB4F * (2 * width + 1)) & 0xFFFFFFFFFFFFFFFF)
        out = out[:-width] * m + out[width:]
        width *= 2
    out ^= out >> np.uint64(32)
    at = np.flatnonzero(out % np.uint64(mean) == 0) + span
    return np.union1d(at[at < n], starts)


class _Words(dict):
    """Ids of pieces, each encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        ids = self[word] = array("I", self.encode(word)).tobytes()
        return ids


class Encoder:
    """Encodes texts as the tokenizer in a file does, with add_special_tokens=False and no truncation."""

    def __init__(self, path: str, mean: int = CHUNK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.mean = mean
        self.pattern = regex.compile(PATTERN)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tok.get_added_tokens_decoder().items()}
        self.bytes_of = self._vocabulary()
        self.words = _Words(self._ranked() or (lambda w: self.tok.encode(w, add_special_tokens=False).ids))
        self.chunks: dict[str, tuple] = {}
        self.reused = self.encoded = 0

    def _vocabulary(self) -> list[bytes]:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        out = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(byte[x] for x in piece) if all(x in byte for x in piece) else piece.encode()
        return out

    def _ranked(self):
        """A merge by rank, three times as fast, where ids rise in the order of the merges; else None."""
        spec = json.loads(self.tok.to_str())
        merges, vocab = spec["model"]["merges"], spec["model"]["vocab"]
        ids = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        singles = {i for p, i in vocab.items() if len(self.bytes_of[i]) == 1}
        if ids != sorted(set(ids)) or max(singles) > ids[0] or len(ids) + len(singles) + len(self.special) != len(self.bytes_of):
            return None
        core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes_of[i]: i for i in [*singles, *ids]}, special_tokens={})
        return core._encode_single_piece

    def _whole(self, text: str) -> tuple[list[int], list[bytes]]:
        found = list(self.pattern.finditer(text))
        return [m.start() for m in found], [self.words[m.group()] for m in found]

    @staticmethod
    def _chunk(text: str, starts: list[int], ids: list[bytes]) -> tuple:
        """Ids of the pieces that no later text can change, where they end, and the first piece starts with their place in the ids."""
        safe = next((k for k in range(len(starts) - 1, -1, -1) if starts[k] <= len(text) - SIGHT), 0)
        heads, at = {}, 0
        for k in range(min(safe + 1, HEADS)):
            heads[starts[k]] = at
            at += len(ids[k])
        return b"".join(ids[:safe]), starts[safe], heads

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not any(s in t for t in texts for s in self.special):
            return self._encode(texts)
        parts, owner = [], []
        for i, t in enumerate(texts):
            for p in self._split(t):
                parts.append(p)
                owner.append(i)
        plain = self._encode([p if isinstance(p, str) else "" for p in parts])
        out: list[list[bytes]] = [[] for _ in texts]
        for i, p, e in zip(owner, parts, plain, strict=True):
            out[i].append(e if isinstance(p, str) else p)
        return [b"".join(x) for x in out]

    def _split(self, text: str) -> list[str | bytes]:
        """Strings of special tokens in a text become their ids."""
        out: list[str | bytes] = [text]
        for s, i in self.special.items():
            out = [y for x in out for y in ([z for p in x.split(s) for z in (i, p)][1:] if isinstance(x, str) else [x])]
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = "".join(texts)
        if not whole:
            return [b""] * len(texts)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.unique(np.concatenate([[0], ends[:-1]]))
        starts = starts[starts < len(whole)]
        chunk_at = cuts(codes(whole), starts, self.mean)
        bounds = [*chunk_at.tolist(), len(whole)]
        chunks = [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        if len(self.chunks) > MAX_CHUNKS:
            self.chunks.clear()
        new = dict.fromkeys(c for c in chunks if c not in self.chunks)
        self.encoded += len(new)
        self.reused += len(chunks) - len(new)
        if new:
            joined = "".join(new)
            at = np.cumsum([0, *map(len, new)])
            piece_at = piece_starts(joined, at[:-1])
            edges = np.searchsorted(piece_at, at).tolist()
            places, words = piece_at.tolist(), self.words
            ids = [words[joined[a:b]] for a, b in zip(places, [*places[1:], len(joined)], strict=True)]
            for c, start, a, b in zip(new, at.tolist(), edges, edges[1:], strict=False):
                self.chunks[c] = self._chunk(c, [p - start for p in places[a:b]], ids[a:b])
        out, k = [], 0
        for t, end in zip(texts, ends.tolist(), strict=True):
            mine = []
            while t and k < len(chunks) and bounds[k] < end:
                mine.append(chunks[k])
                k += 1
            out.append(self._joined(mine))
        return out

    def _joined(self, chunks: list[str]) -> bytes:
        if not chunks:
            return b""
        ids, done, _ = self.chunks[chunks[0]]
        out, tail = [ids], chunks[0][done:]
        for c in chunks[1:]:
            ids, done, heads = self.chunks[c]
            window = tail + c[:AHEAD]
            starts, pieces = self._whole(window)
            n = len(tail)
            for k, s in enumerate(starts):
                if n <= s <= len(window) - SIGHT and (h := heads.get(s - n)) is not None:
                    out += [*pieces[:k], ids[h:]]
                    tail = c[done:]
                    break
            else:
                whole = tail + c
                starts, pieces = self._whole(whole)
                k = next((k for k in range(len(starts) - 1, -1, -1) if starts[k] <= len(whole) - SIGHT), 0)
                out += pieces[:k]
                tail = whole[starts[k] :]
        return b"".join([*out, *self._whole(tail)[1]])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; invalid bytes are replaced, as the tokenizer's decoder does."""
        table = self.bytes_of
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str, keep_ids: bool = True) -> DataFrame:
    """Per row: the id, ids (array of long; if kept), n_tokens, and hashes of the ids and of the text decoded from them."""
    kind = df.select(F.col(id_col)).dtypes[0][1]
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * keep_ids

    def make():
        enc = Encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            n, a, b, all_ids = [], [], [], []
            for lo, hi in groups(texts):
                for ids in enc.encode(texts[lo:hi]):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    if keep_ids:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int64))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        return step

    return arrow_map(df.select(F.col(id_col), F.col(text_col).cast("string")), schema, make)
