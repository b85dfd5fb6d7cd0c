"""Byte-level BPE, encoded by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton (pyahocorasick) can
hold the vocabulary. One pass of the automaton gives the longest token at every byte of a
piece. The encoder takes the longest token, and accepts it only if the pair with the token
before it could stand side by side in the real merge order; else it takes the token's next
shorter prefix, or steps back one token. Positions found to be dead ends are not entered again,
and the answer for a pair of adjacent tokens is memoised, so a piece costs linear time, where
merging costs n log n or worse. The result equals that of the merges exactly.

Pieces (matches of the pattern) are encoded separately and memoised up to a fixed number per
Python worker. Spark deals the rows; the vocabulary file is read on the driver by its path and
shipped once per executor as a broadcast of a fixed size.

Defined results: a null text is empty and has no tokens; lone surrogates cannot occur in
Spark strings; rows with equal ids are separate rows; an empty table gives an empty result;
columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept per Python worker; the store starts anew when it is full.
MEMO = 400_000
#: A piece longer than this is encoded without being kept.
MEMO_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class BytePairCodec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.halves = self._halves()
        self.made = {pair: r for r, pair in self.halves.items() if pair[0] != r}
        usable = [t for t, r in ranks.items() if r in self.halves]
        self.automaton = ahocorasick.Automaton()
        for token in usable:
            self.automaton.add_word(token.decode("latin-1"), (len(token), ranks[token]))
        self.automaton.make_automaton()
        self.shorter = self._shorter(usable)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token; a byte is its own half.

        Tokens are settled in rank order. A token that the earlier merges never join to two
        parts cannot come out of merging (only as a whole piece) and is left out.
        """
        halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                halves[rank] = (rank, rank)
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(
                    ((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)),
                )
                if best[0] >= rank:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2 and all(p in self.ranks for p in parts):
                halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return halves

    def _shorter(self, usable: list[bytes]) -> dict[int, int]:
        """The longest usable proper prefix of each token."""
        known, out = set(usable), {}
        for token in usable:
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in known:
                    out[self.ranks[token]] = self.ranks[token[:n]]
                    break
        return out

    def _stand_together(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both would end in exactly these two tokens.

        Both are taken apart, the later merge first. At each step the tokens that face each
        other across the border must not join by a merge that comes before the ones undone.
        """
        halves, made = self.halves, self.made
        a, b, before = left, right, len(self.ranks) + 1
        while True:
            joined = made.get((a, b))
            if joined is not None and joined < before:
                return False
            split_a, split_b = halves[a][0] != a, halves[b][0] != b
            if not split_a and not split_b:
                return True
            # Undo the later merge. To the right, an equal merge at the border would have come first.
            if split_a and (a > b or not split_b):
                before, a = a, halves[a][1]
            else:
                before, b = b + 1, halves[b][0]

    def _adjacent(self, left: int, right: int) -> bool:
        pair = (left, right)
        got = self.fits.get(pair)
        if got is None:
            if len(self.fits) > 4 * MEMO:
                self.fits.clear()
            got = self.fits[pair] = self._stand_together(left, right)
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank
        open_at, ids, pos = bytearray(b"\1") * (n + 1), [], 0
        lengths, shorter = self.bytes_of, self.shorter
        token: int | None = longest[0]
        while pos < n:
            while token is not None:
                end = pos + len(lengths[token])
                if open_at[end] and (not ids or self._adjacent(ids[-1], token)):
                    break
                token = shorter.get(token)
            if token is None:  # nothing fits here: never come back, and shorten the token before
                open_at[pos] = 0
                token = ids.pop()
                pos -= len(lengths[token])
            else:
                ids.append(token)
                pos = end
                token = longest[pos] if pos < n else None
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memo, put = self.memo, ids.extend
        for piece in self.pattern.findall(text):
            got = memo.get(piece)
            if got is None:
                data = piece.encode("utf-8")
                got = tuple(self.encode_piece(data))
                if len(data) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = got
            put(got)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[int, str], BytePairCodec] = {}


def _codec(key: int, ranks: dict[bytes, int], pattern: str) -> BytePairCodec:
    """One codec per Python worker; workers are reused between tasks."""
    if (key, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[key, pattern] = BytePairCodec(ranks, pattern)
    return _CODECS[key, pattern]


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids (array<int>).

    ``vocabulary``: path of the ranks file on the driver.
    """
    ranks = read_ranks(vocabulary)
    key = hash(frozenset(ranks.items()))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(key, shared.value, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = codec.encode(text) if text else []
                packed = np.array(ids, dtype="<u4")
                row = (len(ids), hashlib.sha256(packed.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                rows.append((*row, packed.astype(np.int32)) if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    # Ids pass as text: beside a null pandas would make them floating-point numbers.
    texts = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
