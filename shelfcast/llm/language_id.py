"""Language spans of mixed-language texts.

A word is a run of letters of one script. The scripts seen with each language narrow the candidates, a
letter-trigram model scores every word in every candidate language, and a Viterbi pass with a penalty
for switching labels the words of a text, which gives spans of one language each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.words import mixed, sliced

TRIGRAMS = 1 << 14
SMOOTHING = 0.5
SWITCH = 12.0  # nats that a change of language costs
LEAST_SHARE = 1e-4  # of a language's letters, for a script to count as one of its scripts
FORBIDDEN = -50.0  # for each letter of a script that the language does not use

# First code point after which a script's letters are found, from the Unicode blocks.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"),
    (0x3190, "other"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"), (0xA720, "Latin"),
    (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "other"), (0x20000, "Han"),
    (0x40000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def script_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: the script of a letter, as 1 + its place in NAMES, 0 for what is no letter; and
    whether it is a mark."""
    starts = np.array([s for s, _ in SCRIPTS])
    codes = np.array([0, *(1 + NAMES.index(name) for _, name in SCRIPTS)], np.uint8)
    table = codes[np.searchsorted(starts, np.arange(0x110000), side="right")]
    kinds = "".join(unicodedata.category(chr(cp))[0] for cp in range(0x110000))
    kind = np.frombuffer(kinds.encode("ascii"), "S1")
    table[kind != b"L"] = 0
    return table, kind == b"M"


def scripts_of(code: np.ndarray) -> np.ndarray:
    """The script of each character of a text, 0 where it is in no word. A mark is of the word, and the
    script, of the letter that it follows, with only marks between; it makes no word by itself."""
    table, mark = script_table()
    script, marks = table[code], mark[code]
    if marks.any():
        place = np.arange(len(code))
        letter = np.maximum.accumulate(np.where(script > 0, place, -1))
        other = np.maximum.accumulate(np.where((script == 0) & ~marks, place, -1))
        follows = marks & (letter > other)
        script[follows] = script[letter[follows]]
    return script


def lowered(text: str) -> str:
    """Lower case with one character for each, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


@dataclass
class Words:
    """The words of some texts: owner (which text), start and end (characters), script, and for each
    letter the word it is in and its trigram."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    word: np.ndarray
    trigram: np.ndarray


def split_words(texts: list[str]) -> Words:
    size = np.array([len(t) + 1 for t in texts], np.int64)
    code = np.frombuffer(("\n" + "\n".join(map(lowered, texts)) + "\n").encode("utf-32-le", "replace"), np.uint32)
    script = scripts_of(code)
    letter = np.flatnonzero(script)
    joined = np.r_[False, (np.diff(letter) == 1) & (script[letter[1:]] == script[letter[:-1]])] if len(letter) else np.zeros(0, bool)
    head = np.flatnonzero(~joined)
    word = np.cumsum(~joined) - 1
    follows = np.r_[joined[1:], False] if len(letter) else joined
    left = np.where(joined, code[np.maximum(letter - 1, 0)], 0).astype(np.uint64)
    right = np.where(follows, code[np.minimum(letter + 1, len(code) - 1)], 0).astype(np.uint64)
    here = code[letter].astype(np.uint64)
    trigram = (mixed((left << np.uint64(42)) ^ (here << np.uint64(21)) ^ right) % np.uint64(TRIGRAMS)).astype(np.int64)
    base = 1 + np.cumsum(size) - size  # of each text in `code`
    first = letter[head]
    last = letter[np.r_[head[1:] - 1, len(letter) - 1]] + 1 if len(head) else first
    owner = np.searchsorted(base, first, side="right") - 1
    return Words(owner, first - base[owner], last - base[owner], script[first], word, trigram)


@dataclass
class Model:
    """log probability of each trigram (TRIGRAMS x languages), and which scripts each language uses."""

    languages: list[str]
    trigram: np.ndarray
    script: np.ndarray

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, int]]]:
        """For each text its spans: start, end (characters), language, letters."""
        w = split_words(texts)
        out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
        if not len(w.owner) or not self.languages:
            return out
        letters = np.bincount(w.word, minlength=len(w.owner))
        begin = np.cumsum(letters) - letters
        score = np.add.reduceat(self.trigram[w.trigram], begin, axis=0)
        allowed = self.script[w.script]
        known = allowed.any(1)  # a script of no language says nothing
        score = np.where(known[:, None], score + np.where(allowed, 0.0, FORBIDDEN * letters[:, None]), 0.0)
        best = viterbi(w.owner, score, len(texts))
        new = np.flatnonzero(np.r_[True, (w.owner[1:] != w.owner[:-1]) | (best[1:] != best[:-1])])
        stop = np.r_[new[1:], len(best)] - 1
        count = np.add.reduceat(letters, new)
        for o, a, b, lang, n in zip(w.owner[new].tolist(), w.start[new].tolist(), w.end[stop].tolist(), best[new].tolist(), count.tolist(), strict=True):
            out[o].append((a, b, self.languages[lang], n))
        return out


def viterbi(owner: np.ndarray, score: np.ndarray, texts: int, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; words of a text stand together. All texts advance at once, the
    longest first, so that those still going are the first rows. Ties go to the earlier language and to
    staying."""
    length = np.bincount(owner, minlength=texts)
    order = np.argsort(-length, kind="stable")
    start = (np.cumsum(length) - length)[order]
    length = length[order]
    going = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts with a word at each step
    best = np.empty(len(owner), np.int64)
    came = np.empty(score.shape, np.int8 if score.shape[1] < 128 else np.int16)
    own = np.arange(score.shape[1])
    value = score[start[: going[0]]].copy()
    for t in range(1, length[0]):
        n = going[t]
        done = n < len(value)
        if done:
            rest = value[n:].argmax(1)
            best[start[n : len(value)] + length[n : len(value)] - 1] = rest
            value = value[:n]
        top = value.argmax(1)
        jump = value[np.arange(n), top][:, None] - switch
        stay = value >= jump
        at = start[:n] + t
        came[at] = np.where(stay, own, top[:, None])
        value = np.where(stay, value, jump) + score[at]
    best[start[: len(value)] + length[: len(value)] - 1] = value.argmax(1)
    for t in range(length[0] - 1, 0, -1):
        at = start[: going[t]] + t
        best[at - 1] = came[at, best[at]]
    return best


def fit_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram and script counts of all given documents with a language. What reaches the driver is
    bounded by languages x (TRIGRAMS + scripts)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = TRIGRAMS + len(NAMES) + 1
        total: dict[str, np.ndarray] = {}
        for frame in sliced(frames, "_text"):
            w = split_words(frame["_text"].tolist())
            langs = frame["_lang"].to_numpy()[w.owner]
            for name in set(langs):
                mine = langs == name
                here = mine[w.word]
                seen = total.setdefault(name, np.zeros(width, np.int64))
                seen[:TRIGRAMS] += np.bincount(w.trigram[here], minlength=TRIGRAMS)
                seen[TRIGRAMS:] += np.bincount(w.script[w.word[here]], minlength=width - TRIGRAMS)
        for name, seen in total.items():
            some = np.flatnonzero(seen)
            yield pd.DataFrame({"lang": name, "cell": some, "n": seen[some]})

    rows = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where("_lang is not null and _text is not null")
    cells = rows.mapInPandas(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(cells["lang"].unique())
    table = np.zeros((TRIGRAMS + len(NAMES) + 1, len(languages)))
    table[cells["cell"].to_numpy(np.int64), [languages.index(x) for x in cells["lang"]]] = cells["n"]
    seen, scripts = table[:TRIGRAMS], table[TRIGRAMS:]
    log_p = np.log((seen + SMOOTHING) / (seen.sum(0) + SMOOTHING * TRIGRAMS)) if languages else seen
    return Model(languages, log_p, scripts > LEAST_SHARE * scripts.sum(0))


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and spans (start, end in characters, lang).

    The prediction is the language of most letters, of ties the first by name; the score is its share of
    the letters. Texts that are null or without letters are `und` with score 0 and no spans. Columns of
    these names are replaced; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, text, 4096):
            found = sent.value.spans(frame[text].fillna("").tolist())
            pred, score = [], []
            for spans in found:
                letters: dict[str, int] = {}
                for _, _, name, n in spans:
                    letters[name] = letters.get(name, 0) + n
                first = min(letters, key=lambda x: (-letters[x], x), default="und")
                pred.append(first)
                score.append(letters[first] / sum(letters.values()) if letters else 0.0)
            spans = [[{"start": a, "end": b, "lang": name} for a, b, name, _ in s] for s in found]
            yield frame.assign(lang_pred=pred, score=score, spans=spans)

    keep = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "spans")])
    empty = F.array().cast("array<struct<start:int,end:int,lang:string>>")
    return keep.mapInPandas(run, keep.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), empty.alias("spans")).schema)
