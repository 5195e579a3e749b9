"""Byte-pair encoding and decoding over a pair occurrence index.

Texts are cut into words by the tokenizer's pattern. The distinct words of a stretch of a partition are
laid out as one array of symbols; an index maps every adjacent pair to all its positions there. Merge
ranks that occur are applied in ascending order, each to all its positions at once, and the lists of
the neighbouring pairs are updated. Every merged symbol has one rank, above the ranks of its parts, so
no later merge can bring back an earlier rank (checked when the vocabulary is read).
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

STRETCH_CHARS = 2_000_000  # texts indexed at once
MEMORY_WORDS = 300_000  # encoded words a task remembers between stretches


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others take the letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level vocabulary file of the tokenizers library: ids, merges and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.first = np.zeros(256, np.int64)  # the id of each byte
        for c, b in letters.items():
            self.first[b] = ids[c]
        self.size = max(known) + 1
        self.bytes_of = [known.get(i, b"") for i in range(self.size)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        rank_of = np.full(self.size, -1, np.int64)
        rank_of[self.made] = np.arange(len(pairs))
        parts = np.maximum(rank_of[keys // self.size], rank_of[keys % self.size])
        if len(set(self.made.tolist())) != len(pairs) or (parts >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.rank_type = np.uint16 if len(pairs) < 2**16 else np.uint32  # short integers sort faster
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.pairs = keys
        # letters first: the other alternatives begin with other characters, so their order is free
        self.words = regex.compile(r" ?\p{L}++| ?\p{N}++|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
        # the same pattern for texts without other scripts, other numerals and rare white space
        self.plain = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.plain_bytes = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x100)])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def _is_plain(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, self.plain_bytes)
        except UnicodeEncodeError:
            return False

    def pieces(self, text: str) -> list[str]:
        """Words and special strings, in order; together they are the text."""
        find = self.plain.findall if self._is_plain(text) else self.words.findall
        if not any(t in text for t in self.special):
            return find(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += find(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + find(text[at:])


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """All entries in ascending order, each once."""
    values = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))  # each part is sorted
    return values[np.r_[True, values[1:] != values[:-1]]]


def encode_words(vocabulary: Vocabulary, words: list[str]) -> list[bytes]:
    """The ids of each word (no special strings) as little-endian 32-bit integers, by one pair
    occurrence index over all of them."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    symbol = vocabulary.first[np.frombuffer(b"".join(raw), np.uint8)]
    n = len(symbol)
    if not n:
        return [b"" for _ in words]
    word = np.repeat(np.arange(len(raw)), sizes)
    after = np.arange(1, n + 1)  # the next live symbol of the word, n at its end
    after[ends[sizes > 0] - 1] = n
    before = np.arange(-1, n - 1)
    before[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(n + 1, bool)
    alive[n] = False

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []

    def add(positions: np.ndarray) -> None:
        """Index the pairs that begin at these positions, given in ascending order."""
        positions = positions[after[positions] < n]
        rank = vocabulary.ranks(symbol[positions], symbol[after[positions]])
        positions, rank = positions[rank >= 0], rank[rank >= 0].astype(vocabulary.rank_type)
        if not len(rank):
            return
        by = np.argsort(rank, kind="stable")
        positions, rank = positions[by], rank[by]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
            if r not in index:
                heapq.heappush(queue, r)
            index[r].append(part)

    add(np.arange(n))
    while queue:
        rank = heapq.heappop(queue)
        left, right = divmod(int(vocabulary.pairs[rank]), vocabulary.size)
        at = _distinct(index.pop(rank))
        nxt = after[at]
        live = alive[at] & (symbol[at] == left) & (nxt < n)  # entries of merged symbols are stale
        at, nxt = at[live], nxt[live]
        at = at[symbol[nxt] == right]
        if left == right and len(at) > 1:  # in a run only every other pair merges
            chained = np.r_[False, after[at[:-1]] == at[1:]]
            begin = np.flatnonzero(~chained)
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            at = at[place % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = vocabulary.made[rank]
        alive[gone] = False
        after[at] = after[gone]
        inner = after[at] < n
        before[after[at[inner]]] = at[inner]
        previous = before[at]
        add(np.sort(np.concatenate([at, previous[previous >= 0]])))
    live = alive[:n]
    packed = symbol[live].astype("<u4").tobytes()
    upto = (4 * np.cumsum(np.bincount(word[live], minlength=len(words)))).tolist()
    return [packed[a:b] for a, b in zip([0, *upto], upto, strict=False)]


def encoder(vocabulary: Vocabulary) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian 32-bit integers. It remembers what words
    encode to; when it holds too many, those that the texts at hand did not use are forgotten."""
    special = {t: int(i).to_bytes(4, "little") for t, i in vocabulary.special.items()}
    known = dict(special)

    def encode(texts: list[str]) -> list[bytes]:
        cut = [vocabulary.pieces(t) for t in texts]
        used = set().union(*cut)
        fresh = list(used.difference(known))
        if len(known) + len(fresh) > MEMORY_WORDS:
            kept = {w: known[w] for w in used.intersection(known)} | special
            known.clear()
            known.update(kept)
        known.update(zip(fresh, encode_words(vocabulary, fresh), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    return encode


def decode(vocabulary: Vocabulary, ids: bytes) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _stretches(frames: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Runs of rows of about STRETCH_CHARS characters, so that what is indexed at once is bounded."""
    for frame in frames:
        ends = frame[column].str.len().fillna(0).cumsum()
        for _, part in frame.groupby(ends // STRETCH_CHARS, sort=False):
            yield part


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with token_ids (binary: little-endian 32-bit ids), n_tokens and decoded_text.

    Ids are those of the tokenizers library without added special tokens, truncation and padding; a
    special string inside a text is its id. Null counts as empty and gives no ids. Columns named like
    a result column are replaced; an empty table gives an empty result. `vocabulary` is the path of a
    byte-level vocabulary file that every worker can read.
    """
    keep = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "decoded_text")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = Vocabulary(vocabulary)
        encode = encoder(vocab)
        for frame in _stretches(frames, text):
            ids = encode(frame[text].fillna("").tolist())
            yield frame.assign(
                token_ids=ids, n_tokens=[len(x) // 4 for x in ids], decoded_text=[decode(vocab, x) for x in ids]
            )

    schema = docs.select(*keep).schema.add("token_ids", "binary").add("n_tokens", "long").add("decoded_text", "string")
    return docs.select(*keep).mapInPandas(run, schema)
