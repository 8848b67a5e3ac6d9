"""Byte-pair token counts by heap and linked list, and cached token ids."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

#: fixed values: the pre-token pattern of byte-level BPE vocabularies, for texts without ODD characters; letters come first,
#: which changes no match as no other alternative starts with one
PIECES = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: characters in which `re` and the tokenizer's own pattern agree; other texts are split by the tokenizer itself
ODD = re.compile("[^\t\n\r\x20-\x7eÀ-ɏ¡«»¿–—‘’“”…]")
#: the same pattern as the vocabularies' makers state it
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: the last character of a pre-token, before a blank
SAFE = re.compile(r"\S(?= )")
CACHE = 300_000


def _alphabet() -> dict[int, int]:
    """Byte -> printable character, the rule of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: b for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = spare
            spare += 1
    return out


ALPHABET = _alphabet()


class Counts(dict):
    """Pre-token -> number of tokens; at most CACHE entries, emptied when full."""

    def __init__(self, ranks: dict[tuple[str, str], int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = merged(piece.encode().decode("latin-1").translate(ALPHABET), self.ranks)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n
        return n


def merged(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging: the lowest-rank adjacent pair is popped again and again, the leftmost of equals first.

    A heap holds candidate pairs, a doubly linked list the live symbols; an entry is stale if either side has changed.
    The count is the initial symbols minus the merges; no identifiers are made.
    """
    part, n, merges = list(symbols), len(symbols), 0
    if n < 2:
        return n
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if part[i] == left else -1
        if j < 0 or part[j] != right:
            continue
        part[i], part[j] = left + right, ""
        k = after[i] = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((part[i], part[k]))) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
            heapq.heappush(heap, (r, h, part[h], part[i]))
    return n - merges


class Vocabulary:
    """What counting needs of a tokenizers .json file: merge ranks, the special strings, the library's own splitter."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.raw = raw = json.loads(Path(path).read_text(encoding="utf-8"))
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in raw["model"]["merges"])
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.special = [t["content"] for t in raw["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and the number of these; each counts as one token, as is the library's default."""
        if not self.split_special or not any(s in text for s in self.special):
            return [text], 0
        found = self.split_special.split(text)
        return found, len(found) - 1

    def count(self, text: str, counts: Counts) -> int:
        parts, n = self.segments(text)
        for p in parts:
            if ODD.search(p):  # already in the printable alphabet
                n += sum(merged(w, self.ranks) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(p))
            else:
                n += sum(map(counts.__getitem__, PIECES.findall(p)))
        return n


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Each row of docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of its whole text, and without the text.

    Null and empty texts have 0 tokens; ties and repeated rows are rows like others; an empty table gives no rows; a long
    text is counted whole; any other columns are kept, but a column named like one of these three is replaced. Nothing is
    shuffled.
    """
    common.ship(docs.sparkSession)
    own = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in (text, *own)]
    kept = docs.select(*keep, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(vocabulary)
        counts = Counts(v.ranks)
        for f in frames:
            texts = [x if isinstance(x, str) else "" for x in f.pop(text)]
            n = [v.count(x, counts) for x in texts]
            f = f.assign(n_bytes=[len(x.encode()) for x in texts], n_tokens=n, over_limit=[x > limit for x in n])
            yield f

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema if x.name != text), "n_bytes long, n_tokens long, over_limit boolean"])
    return kept.mapInPandas(run, schema)


class Ids:
    """Ids of whole texts as the library gives them, by a byte-pair encoder that holds no Python object for a token.

    The encoder merges the adjacent pair whose joined bytes rank lowest; the library merges the pair that its list ranks
    lowest. Both give one result where every token's parts rank below it and the library gives the token's own text back
    as that one token: what stands before the last merge of a token is then the same pair in any context. `exact` tells
    whether the vocabulary is of that kind (and of the pre-token pattern above); if not, the library itself is asked.
    """

    def __init__(self, path: str, fits: bool | None = None) -> None:
        import tiktoken

        self.vocabulary = v = Vocabulary(path)
        raw = v.raw
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.exact = exact(path) if fits is None else fits
        if self.exact:
            back = {c: b for b, c in ALPHABET.items()}
            ranks = {bytes(back[ord(c)] for c in name): k for name, k in raw["model"]["vocab"].items() if name not in self.special}
            self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.back = {c: chr(b) for c, b in back.items()}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit numbers; special strings are one id, as is the library's default."""
        if not self.exact:
            return np.array(self.vocabulary.library.encode(text, add_special_tokens=False).ids, "<u4")
        parts, _ = self.vocabulary.segments(text)
        found = self.vocabulary.split_special.findall(text) if len(parts) > 1 else []
        out = []
        for k, part in enumerate(parts):
            out += [self._plain(x) for x in pieces_of(part)]
            if k < len(found):
                out.append(np.array([self.special[found[k]]], "<u4"))
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, "<u4")

    def _plain(self, text: str) -> np.ndarray:
        if not ODD.search(text):
            return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        ids: list[int] = []
        for w, _ in self.vocabulary.library.pre_tokenizer.pre_tokenize_str(text):  # in the printable alphabet
            ids += self.core._core_bpe.encode_single_piece(w.translate(self.back).encode("latin-1"))
        return np.array(ids, "<u4")


def pieces_of(text: str, size: int = 1 << 18) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut before a blank that follows another character than white space.

    No pre-token goes over such a place, as a blank stands at the start of a pre-token or among white space only.
    """
    low = 0
    while len(text) - low > size:
        at = SAFE.search(text, low + size)
        if at is None:
            break
        yield text[low : at.start() + 1]
        low = at.start() + 1
    yield text[low:] if low else text


@functools.lru_cache(4)
def exact(path: str) -> bool:
    """Whether Ids may use the encoder for this vocabulary file."""
    v = Vocabulary(path)
    model, names = v.raw["model"], v.raw["model"]["vocab"]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    of = v.raw.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or v.raw.get("normalizer") or any(of.get(k) != x for k, x in plain.items()) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    if any(t.get(k) for t in v.raw["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        return False
    special, single = {*v.special}, {chr(c) for c in ALPHABET.values()}
    if not single <= names.keys() or any(max(names[a], names[b]) >= names.get(a + b, -1) for a, b in v.ranks if len(a) > 1 or len(b) > 1):
        return False
    if [names.get(a + b) for a, b in v.ranks] != sorted(names[x] for x in names if x not in special and x not in single):
        return False
    return all(merged(x, v.ranks) == 1 for x in names if x not in special)


@functools.lru_cache(1)
def ids_of(path: str, fits: bool) -> Ids:
    """One encoder for all tasks of a worker process; its size is that of the vocabulary and does not grow."""
    return Ids(path, fits)
