"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; the best score and its number of
pieces are all the state kept. Tie rules are those of the unigram tokenizer: candidates come by start, earliest first,
and a later one must score strictly more. A character no single piece covers costs the lowest score less ten, and
neighbouring unknown characters count as one piece.

Pieces hold the word mark only as a leading run, so texts split before marks and equal words are counted once for
each task; without that property the text is one word. Null and empty texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import arrow_map, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_WORDS = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without its control pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Counter:
    def __init__(self, pieces: Sequence[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        inner = regex.compile(f"[^{MARK}]{MARK}")
        exact = all(float(s).is_integer() for _, s in pieces)  # sums don't depend on where a text is split
        self.split = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if exact and not any(inner.search(p) for p, _ in pieces) else None
        self.known: dict[str, tuple[int, bool, bool]] = {}

    def word(self, text: str) -> tuple[int, bool, bool]:
        """Pieces of a text, and whether its first and last are unknown."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        if len(self.auto):
            for last, (size, score) in self.auto.iter(text):
                ends[last + 1].append((size, score))
                if size == 1:
                    single[last] = True
        # per end: score, count, whether the last piece is unknown, whether the first is
        best: list[tuple[float, int, bool, bool]] = [(0.0, 0, False, False)] + [(0.0, 0, False, False)] * n
        for e in range(1, n + 1):
            top = None
            for size, score in sorted(ends[e], reverse=True):
                s, c, _, f = best[e - size]
                if top is None or s + score > top[0]:
                    top = (s + score, c + 1, False, f)
            if not single[e - 1]:
                s, c, u, f = best[e - 1]
                if top is None or s + self.unknown > top[0]:
                    top = (s + self.unknown, c + (not u), True, f or e == 1)
            best[e] = top
        return best[n][1], best[n][3], best[n][2]

    def count(self, text: str) -> int:
        text = text.replace(" ", MARK)
        if not text:
            return 0
        parts = self.split.findall(text) if self.split else [text]
        total, open_unknown = 0, False
        for p in parts:
            got = self.known.get(p)
            if got is None:
                if len(self.known) >= MAX_WORDS:
                    self.known.clear()
                got = self.word(p)
                if len(p) < 200:
                    self.known[p] = got
            total += got[0] - (open_unknown and got[1])
            open_unknown = got[2]
        return total


def count_tokens(df: DataFrame, pieces: Sequence[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and n_tokens."""
    kind = df.select(id_col).dtypes[0][1]
    shared = df.sparkSession.sparkContext.broadcast(list(pieces))

    def make():
        counter = Counter(shared.value)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.count(t) for t in texts_of(b.column(1))], pa.int64())], names=[id_col, "n_tokens"])

        return step

    return arrow_map(df.select(F.col(id_col), F.col(text_col).cast("string")), f"`{id_col}` {kind}, n_tokens bigint", make)
