"""Exact token counts of every prefix of a text (operator 1), by dynamic programming over prefixes.

For byte-pair merges, the tokens of a piece up to any point inside a token's end are themselves the tokens of that prefix. So
each prefix of a piece has exactly one last token: one that ends there, whose start is the end of a shorter prefix, and which
stands next to that prefix's last token when the two are merged alone. ``counts[i] = counts[start of the last token] + 1`` then
gives every prefix's count in one pass. Pieces are independent (the vocabulary's own split), so a text's prefix counts are
running sums; each distinct piece is solved once in a task and remembered (a bounded table).

Truncation and budgets are read from the counts: ``budget_cut`` is the longest prefix within a budget, without encoding again. It
needs the counts before each piece and, of the piece in which the budget ends, those of all its prefixes; ``prefixes`` gives all.

Texts outside a plain alphabet, or with special strings, take the library's own normaliser and split; special strings are
handled as the library does by default (each is one token). Positions are then those of the normalised text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted one by one; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import per_text, table

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"
#: Pieces kept in a task's table, and the longest piece kept.
MEMO_PIECES = 400_000
MEMO_CHARS = 40
#: Characters whose class, lower case and composition every Unicode version agrees on.
PLAIN = regex.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f¡-įı-ɏ–—‘-”†-•…€]*")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts for a BPE vocabulary file of the tokenizers library with a byte-level split and an end-of-word mark."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.vocab = frozenset(made["model"]["vocab"])
        self.rank = {tuple(m): i for i, m in enumerate(made["model"]["merges"])}
        self.made = {}
        for i, (x, y) in enumerate(made["model"]["merges"]):
            self.made.setdefault(x + y, (i, x, y))
        self.end = made["model"]["end_of_word_suffix"] or ""
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in made["added_tokens"]))
        self.split = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.wholes: dict[str, tuple[int, ...]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """The merges of the model on a short list of symbols."""
        rank = self.rank
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            stem = token[: -len(self.end)]
            return [*stem[:-1], stem[-1] + self.end]
        return list(token)

    def adjoin(self, a: str, b: str) -> bool:
        """Whether a and b stay two tokens side by side (a empty: whether b's symbols merge to b). The merges that made both are
        undone, latest first; the two must never have met as a pair that would have been merged earlier. Equal pairs merge from
        the left, which decides ties."""
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        if len(self.pairs) > 2 * MEMO_PIECES:
            self.pairs.clear()
        if not a:
            found = self.merge(self.symbols(b)) == [b]
        else:
            x, y, limit, found = a, b, 1 << 60, True
            rank, made = self.rank, self.made
            while True:
                if rank.get((x, y), limit) < limit:
                    found = False
                    break
                p, q = made.get(x), made.get(y)
                if p and (not q or p[0] > q[0]):
                    limit, x = p[0], p[2]
                elif q:
                    limit, y = q[0] + 1, q[1]
                else:
                    break
        self.pairs[a, b] = found
        return found

    def piece(self, piece: str, whole: bool = False) -> tuple[int, ...]:
        """Token counts of the prefixes of 1, 2, ... characters of one piece, or (``whole``) of all of it alone."""
        memo = self.wholes if whole else self.memo
        counts = memo.get(piece)
        if counts is None:
            counts = self.solve(piece, whole)
            if len(piece) <= MEMO_CHARS:
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                memo[piece] = counts
        return counts

    def solve(self, piece: str, whole: bool) -> tuple[int, ...]:
        if not whole and piece[0] == "'" and len(piece) > 1 and piece[1:].isalpha():  # a contraction, whose prefixes split otherwise
            return tuple(self.flat([piece[:j]] if j in (1, len(piece)) else self.split.findall(piece[:j])) for j in range(1, len(piece) + 1))
        s = "".join(map(self.letters.__getitem__, piece.encode()))
        if whole:
            return self.plain(s, (len(s),))
        ends = [len(piece[:j].encode()) for j in range(1, len(piece) + 1)] if len(s) > len(piece) else range(1, len(s) + 1)
        return self.plain(s, ends)

    def flat(self, pieces: list[str]) -> int:
        return sum(self.plain(s, [len(s)])[0] for p in pieces for s in ["".join(map(self.letters.__getitem__, p.encode()))])

    def plain(self, s: str, ends) -> tuple[int, ...]:
        vocab, adjoin, end, longest = self.vocab, self.adjoin, self.end, self.longest
        last, count = [""], [0]
        for j in range(1, len(s)):
            for i in range(max(0, j - longest), j):
                if (t := s[i:j]) in vocab and (not i or last[i]) and adjoin(last[i], t):
                    last.append(t)
                    count.append(count[i] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary has no token that ends the prefix {s[: j + 1]!r}: it lacks a byte")
        out = []
        for j in ends:
            for i in range(max(0, j - longest), j):
                if (t := s[i:j] + end) in vocab and adjoin(last[i], t):
                    out.append(count[i] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary has no last token for the prefix {s[:j]!r}")
        return tuple(out)

    def pieces(self, text: str) -> tuple[str, list[tuple[int, str]]]:
        """The normalised text and its pieces with their starts; no special strings in ``text``."""
        if PLAIN.fullmatch(text):
            low = text.lower()
            return low, [(m.start(), m[0]) for m in self.split.finditer(low)]
        low = self.lib.normalizer.normalize_str(text)
        return low, [(at, low[at:to]) for _, (at, to) in self.lib.pre_tokenizer.pre_tokenize_str(low)]

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        if "<|" not in text and PLAIN.fullmatch(text):
            memo, n = self.wholes, 0
            for p in self.split.findall(text.lower()):
                n += (memo.get(p) or self.piece(p, True))[0]
            return n
        return sum(self.piece(p, True)[0] for part in self.special.split(text) for _, p in self.pieces(part)[1]) + len(self.special.findall(text))

    def budget_cut(self, text: str, n: int, limit: int) -> int:
        """Of a text of ``n`` tokens: the longest prefix, in characters of the normalised text, of at most ``limit`` tokens. A prefix has
        the tokens of the pieces before its last piece and that piece's stored prefix count, so only one piece is looked into."""
        if self.special.search(text):
            return int(np.flatnonzero(self.prefixes(text) <= limit)[-1])
        low, pieces = (text.lower(), None) if PLAIN.fullmatch(text) else self.pieces(text)
        if n <= limit:
            return len(low)
        base, last = 0, (0, "")
        for start, p in pieces or ((m.start(), m[0]) for m in self.split.finditer(low)):
            if base >= limit:
                if base == limit:
                    return start
                break
            base, last = base + self.piece(p, True)[0], (start, p)
        start, p = last
        before = base - self.piece(p, True)[0]
        inside = [j for j, k in enumerate(self.piece(p), 1) if before + k <= limit]
        return start + (inside[-1] if inside else 0)

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, 2, ... characters of the normalised text."""
        out, base, at = [np.zeros(1, np.int32)], 0, 0
        for m in [*self.special.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            low, pieces = self.pieces(part)
            counts = np.zeros(len(low) + 1, np.int32)
            n = 0
            for start, p in pieces:
                counts[start + 1 : start + 1 + len(p)] = own = self.piece(p)
                counts[start + 1 : start + 1 + len(p)] += n
                n += own[-1]
                counts[start + len(p)] = n
            gaps = np.ones(len(low) + 1, bool)
            for start, p in pieces:
                gaps[start + 1 : start + 1 + len(p)] = False
            filled = np.maximum.accumulate(np.where(gaps, 0, np.arange(len(low) + 1)))
            counts = counts[filled]
            out.append(base + counts[1:])
            base += n
            if m:  # inside a special string its beginning is ordinary text, at its end it is one token
                inside = [base - n + self.total(part + m[0][:j]) for j in range(1, len(m[0]))]
                base += 1
                out.append(np.array([*inside, base], np.int32))
                at = m.end()
        return np.concatenate(out).astype(np.int32)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, budget_cut): budget_cut is the longest prefix, in characters of the normalised text, of at
    most ``limit`` tokens. With ``prefixes`` also prefix_tokens: array<int>, the count of every prefix from 0 characters on."""
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_cut long" + ", prefix_tokens array<int>" * prefixes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = [c.total(t) for t in texts]
        cuts = [c.budget_cut(t, k, limit) for t, k in zip(texts, n, strict=True)]
        counts = pa.array(n, pa.int64())
        columns = [batch.column(0), pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64()), counts, pc.greater(counts, limit), pa.array(cuts, pa.int64())]
        if prefixes:
            columns.append(pa.array([c.prefixes(t).tolist() for t in texts], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_cut", "prefix_tokens"][: len(columns)])

    return per_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
