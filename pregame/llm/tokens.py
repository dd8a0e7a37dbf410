"""Public tokenizers inside tasks: texts are looked up in parts that encode the same alone as in place.

A worker loads a tokenizer once per file. Parts that were merged before are kept in a bounded table, which is
emptied when it is full; the results do not depend on it. The table of words outlives a task: most words of the next task are known.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import regex

#: Code points whose class and normal form the splitting below shares with the tokenizer files: Latin letters,
#: digits and punctuation up to U+017F without odd spaces, the soft hyphen and the dotted capital I. A text with any other code point
#: is encoded as one piece by the library.
PLAIN = regex.compile(r"[\t-\r -~¡-¬®-įı-ſ]*+")
#: The split pattern of the byte-level file, and its special string.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KEPT = 1_500_000
LONG = 60


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None


class Parts:
    """Values of parts; ``value`` turns an encoding into what is kept, ``kept`` of them at most. ``fixed`` parts are never dropped."""

    def __init__(self, path: str, value, fixed: dict | None = None, kept: int = KEPT) -> None:
        self.tokenizer, self.value, self.fixed, self.kept = load(path), value, fixed or {}, kept
        self.known = dict(self.fixed)
        self.passing: list[str] = []

    def learn(self, parts: set[str]) -> dict:
        """The table with all of ``parts`` in it; long parts are merged for this call only and go with the next."""
        for p in self.passing:
            self.known.pop(p, None)
        self.passing = []
        new = list(parts.difference(self.known))
        if len(self.known) + len(new) > self.kept + len(self.fixed):
            self.known = dict(self.fixed)
            new = list(parts.difference(self.known))
        if new:
            self.known.update(zip(new, self.encode(new), strict=True))
            self.passing = [p for p in new if len(p) > LONG]
        return self.known

    def encode(self, parts: list[str]) -> list:
        # ids alone: the library keeps no offsets then
        return [self.value(e) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def merges(path: str):
    """For words that are lower-case already: the file's merges without its normal form and splitting pattern, the pattern, and the
    special strings. None for a file that does more than lower-case, split by one pattern and merge bytes."""
    whole = json.loads(load(path).to_str())
    normal, split = whole["normalizer"] or {}, whole["pre_tokenizer"] or {}
    steps = split.get("pretokenizers", [])
    if (
        {n["type"] for n in normal.get("normalizers", [])} != {"NFC", "Replace", "Lowercase"}
        or [x["type"] for x in steps] != ["Split", "ByteLevel"]
        or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True)
        or (steps[1]["add_prefix_space"], steps[1]["use_regex"]) != (False, False)
    ):
        return None
    from tokenizers import Tokenizer

    special = "|".join(regex.escape(t["content"]) for t in whole["added_tokens"])
    whole |= {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
    return Tokenizer.from_str(json.dumps(whole)), regex.compile(steps[0]["pattern"]["Regex"]), regex.compile(special or "(?!)")


@lru_cache(maxsize=4)
def word_ends(path: str, ending: str) -> np.ndarray:
    vocabulary = load(path).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for t, i in vocabulary.items() if t.endswith(ending)]] = True
    return ends


class WordParts(Parts):
    """Ids of white-space-free parts for a file whose words end in a marked token.

    Parts are split by the file's pattern into words, which are encoded many at a time and cut at the marked tokens. Parts with a special string,
    and all parts of a file that ``merges`` does not know, are encoded one by one.
    """

    def __init__(self, path: str, ending: str = "</w>", kept: int = KEPT) -> None:
        super().__init__(path, lambda e: np.array(e.ids, dtype="<u4").tobytes(), kept=kept)
        self.ends, self.merges = word_ends(path, ending), merges(path)

    def encode(self, parts: list[str]) -> list:
        if self.merges is None:
            return super().encode(parts)
        merge, pattern, special = self.merges
        letters = list(filter(str.isalpha, parts))
        mixed = {p: pattern.findall(p.lower()) for p in filterfalse(str.isalpha, parts) if special.search(p) is None}
        words = [*letters, *set(chain.from_iterable(mixed.values())).difference(self.known, letters)]
        (joined,) = merge.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)
        ids = np.array(joined.ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return super().encode(parts)
        raw, to = ids.tobytes(), (cuts * 4).tolist()
        out = dict(zip(words, map(raw.__getitem__, map(slice, [0, *to], to)), strict=True))
        for p, own in mixed.items():
            out[p] = b"".join([out.get(w) or self.known[w] for w in own])
        rest = [p for p in parts if p not in out]
        if rest:
            out.update(zip(rest, super().encode(rest), strict=True))
        return list(map(out.__getitem__, parts))


@lru_cache(maxsize=1)
def word_parts(path: str, kept: int) -> WordParts:
    """The worker's table, for this task and later ones."""
    return WordParts(path, kept=kept)


#: A full stop or comma behind a letter or digit and before white space is a part of its own either way.
MARK = re.compile(r"(?<=[^\W_])([.,])(?=\s|\Z)")
#: A full stop or comma behind a mark. The search looks for the stop first, which most characters are not.
CLUSTER = re.compile(r"[.,](?:(?<=[^\w\s].)|(?<=_.))")


def words(text: str) -> list[str]:
    """Parts of a plain text for ``WordParts``."""
    text = text.lower()
    if CLUSTER.search(text) is None:
        return text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").split()
    return MARK.sub(r" \1", text).split()
